"""What readers of the results ask for: overviews, levels, trends, plain labels, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.functions import expr as E
from phenolake.operators.quantiles import exact_quantiles
from phenolake.sources.io import first_wins

# --- fixed values ---
NOT_STRESS = ("data_suspect", "crop_rotation")
LEVELS = ("high", "medium", "data", "context", "unknown", "clear")
SHAPE = ("peak_ratio", "peak_shift", "sos_shift", "integral_ratio", "decline_shift", "mean_z", "share_days_depressed", "amplitude")
TREND_DAYS, TREND_STEP = 14, 0.5


def filter_episodes(ep: DataFrame, year: int | None = None, cause: str | None = None, severity: str | None = None) -> DataFrame:
    """Episodes of a year, of causes whose code contains a text (any case), of a severity."""
    if year is not None:
        ep = ep.filter(F.col("year") == year)
    if cause:
        ep = ep.filter(F.lower("cause").contains(cause.lower()))
    return ep.filter(F.col("severity") == severity) if severity else ep


def asked_seasons(questions: DataFrame, seasons: DataFrame, text: str = "question") -> DataFrame:
    """Adds to each question about an entity the ``season`` it names: the first year in its text that the entity has.

    ``seasons`` holds (pid, year) rows in any number; an entity's years are bounded by the calendar. A question that names none of
    them, or whose entity is unknown, keeps a NULL.
    """
    known = seasons.groupBy("pid").agg(F.collect_set("year").alias("_known"))
    return questions.join(known, "pid", "left").withColumn("season", E.year_in_text(F.col(text), F.col("_known"))).drop("_known")


def episode_summary(ep: DataFrame) -> DataFrame:
    """Counts by cause, by year, by severity and over all, in one pass."""
    c, y, s = F.col("cause"), F.col("year"), F.col("severity")
    return ep.groupingSets([[c], [y], [s], []], c, y, s).agg(F.count("*").alias("n"), F.count_distinct("pid").alias("n_entities"))


def entity_overview(obs: DataFrame, ep: DataFrame, gaps: DataFrame, driven: DataFrame) -> DataFrame:
    """One row per entity: years, observations, episodes, critical ones, gaps, whether it has drivers."""
    o = obs.groupBy("pid").agg(F.count("*").alias("n_obs"), F.array_sort(F.collect_set("year")).alias("years"))
    e = ep.groupBy("pid").agg(F.count("*").alias("n_episodes"), F.count(F.when(F.col("severity") == "critical", 1)).alias("n_critical"))
    g = gaps.groupBy("pid").agg(F.count("*").alias("n_gaps"))
    d = driven.select("pid").distinct().withColumn("has_drivers", F.lit(True))
    out = o.join(e, "pid", "left").join(g, "pid", "left").join(d, "pid", "left")
    return out.fillna(0, ["n_episodes", "n_critical", "n_gaps"]).fillna(False, ["has_drivers"])


def season_level(seasons: DataFrame, ep: DataFrame, assessed: DataFrame) -> DataFrame:
    """Level of each season: stress first, then data doubts, then context; no assessment is not the same as clear."""
    stress = ~F.col("cause").isin(*NOT_STRESS)
    f = ep.groupBy("pid", "year").agg(
        F.bool_or(stress & (F.col("severity") == "critical")).alias("_hi"), F.bool_or(stress).alias("_st"),
        F.bool_or(F.col("cause") == "data_suspect").alias("_da"), F.count("*").alias("n_episodes"))
    d = seasons.select("pid", "year").distinct().join(f, ["pid", "year"], "left").join(
        assessed.select("pid", "year").distinct().withColumn("_as", F.lit(True)), ["pid", "year"], "left")
    level = (F.when(F.col("_hi"), "high").when(F.col("_st"), "medium").when(F.col("_da"), "data")
             .when(F.col("n_episodes") > 0, "context").when(F.col("_as"), "clear").otherwise("unknown"))
    return d.select("pid", "year", F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"), level.alias("level"))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1


def deviation_trend(points: DataFrame) -> DataFrame:
    """Median z of the last 14 days against the 14 before, from real observations of one source per day."""
    p = points.filter(~F.col("artifact") & F.col("h").isNotNull()).select("pid", "year", "day", "source", "h", "norm_mean", "norm_std")
    p = first_wins(p, ["pid", "year", "day"], "source")
    end = F.max("day").over(Window.partitionBy("pid", "year"))
    z = F.when(F.col("norm_std") > 0, (F.col("h") - F.col("norm_mean")) / F.col("norm_std"))
    d = p.withColumns({"end": end, "_z": z}).filter(F.col("day") > F.col("end") - 2 * TREND_DAYS)
    late = F.col("day") > F.col("end") - TREND_DAYS
    before, after = F.when(~late, F.col("_z")), F.when(late, F.col("_z"))
    g = d.groupBy("pid", "year", "end").agg(F.count(before).alias("n_before"), F.count(after).alias("n_after"),
                                            F.median(before).alias("_b"), F.median(after).alias("_a"))  # 28 values at most
    ok = F.least("n_before", "n_after") >= 2
    b, a = F.col("_b"), F.col("_a")
    status = (F.when(~ok, "insufficient").when((b >= -1) & (a >= -1), "within")
              .when((a - b >= TREND_STEP) & (a >= -1), "recovered").when(a - b >= TREND_STEP, "easing")
              .when(a - b <= -TREND_STEP, "worsening").otherwise("stable"))
    return g.select("pid", "year", "end", "n_before", "n_after", status.alias("status"), F.when(ok, b).alias("before_z"),
                    F.when(ok, a).alias("after_z"), F.when(ok, a - b).alias("delta_z"))


def value_tone(value: Column, normal: Column, spread: Column) -> tuple[Column, Column]:
    """(label, tone) of a value against its norm; inside one spread nothing alarms."""
    off = F.when(normal >= 0.08, F.floor((value - normal) / normal * 100 + 0.5))
    within = F.coalesce((spread > 0) & (F.abs(value - normal) < spread), F.lit(False))
    label = (F.when(off.isNull(), "unknown").when(within & (normal < 0.25), "low_but_usual")
             .when((F.abs(off) <= 7) | within, "usual").when(off > 0, "more").otherwise("less"))
    tone = F.when((label == "less") & (off < -25), "crit").when(label == "less", "warn").otherwise("ok")
    return label, tone


def amount_tone(value: Column, mean: Column) -> tuple[Column, Column]:
    r = F.when(mean > 0, value / mean)
    label = (F.when(r.isNull(), "unknown").when(r < 0.35, "almost_none").when(r < 0.6, "half").when(r < 0.85, "slightly_less")
             .when(r <= 1.25, "usual").when(r <= 1.8, "more").otherwise("double"))
    return label, F.when(label == "almost_none", "crit").when(label.isin("half", "double"), "warn").otherwise("ok")


def heat_tone(value: Column, mean: Column) -> tuple[Column, Column]:
    days = F.when(mean > 0, F.floor((value - mean) / 20 + 0.5))
    label = F.when(days.isNull(), "unknown").when(F.abs(days) < 3, "on_schedule").when(days > 0, "ahead").otherwise("behind")
    return label, F.when(F.abs(days) > 10, "warn").otherwise("ok")


def dry_tone(days: Column) -> Column:
    return F.when(days < 14, "ok").when(days < 21, "warn").otherwise("crit")


def confidence_word(c: Column) -> Column:
    return F.when(c >= 0.8, "almost_certain").when(c >= 0.6, "likely").otherwise("possible")


def season_verdict(last: DataFrame, ep: DataFrame) -> DataFrame:
    """Traffic light of a season from its last observation (day, tone, trend) and its episodes."""
    real = ~F.col("cause").isin(*NOT_STRESS)
    d = last.join(ep.select("pid", "year", "end", "min_z", "severity", "cause"), ["pid", "year"], "left")
    now = real & (F.col("end") >= F.col("last_day") - 7)
    g = d.groupBy("pid", "year", "last_day", "tone", "trend").agg(
        F.min_by("severity", F.when(now, F.struct("min_z", "end"))).alias("_now"), F.coalesce(F.bool_or(real), F.lit(False)).alias("_real"),
        F.count("cause").alias("_n"))
    over = F.coalesce(F.col("trend").isin("recovered", "within"), F.lit(False)) | (F.col("tone") == "ok")
    verdict = (F.when(F.col("_now") == "critical", "behind").when(F.col("_now").isNotNull(), "watch")
               .when(F.col("_real") & over, "recovered").when(F.col("_real"), "watch").when(F.col("_n") > 0, "explained")
               .when(F.col("tone") == "crit", "low").otherwise("normal"))
    light = F.when(verdict == "behind", "crit").when(verdict.isin("watch", "low"), "warn").otherwise("ok")
    return g.select("pid", "year", verdict.alias("verdict"), light.alias("light"))


def shape_outliers(seasons: DataFrame, share: float = 0.05) -> DataFrame:
    """Seasons of unusual shape: mean robust deviation of eight features, the top ``share`` flagged."""
    d = seasons.filter(F.col("valid") & (F.col("norm_source") == "own"))
    long = d.select("pid", "year", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in SHAPE])).alias("f")) \
        .select("pid", "year", "f.*")
    med = exact_quantiles(long, ["feature"], "x", {"med": 0.5}).select("feature", "med")
    long = long.join(F.broadcast(med), "feature").withColumn("_d", F.abs(F.coalesce("x", "med") - F.col("med")))  # eight rows
    mad = exact_quantiles(long, ["feature"], "_d", {"mad": 0.5}).select("feature", "mad")
    long = long.join(F.broadcast(mad), "feature")
    dev = F.col("_d") / F.when(F.col("mad") > 1e-9, 1.4826 * F.col("mad")).otherwise(1.0)
    val = lambda n: F.max(F.when(F.col("feature") == n, F.coalesce("x", "med")))
    g = long.withColumn("dev", dev).groupBy("pid", "year").agg(
        F.avg("dev").alias("score"), F.array_sort(F.collect_list(F.struct((-F.round("dev", 6)).alias("k"), "feature"))).alias("_f"),
        F.when((val("integral_ratio") < 1) | (val("mean_z") < 0), "weaker").otherwise("stronger").alias("direction"))
    cut = exact_quantiles(g, [], "score", {"cut": 1 - share}).select("cut")
    return g.withColumn("flag", F.col("score") >= cut.scalar()).select(
        "pid", "year", "score", "flag", "direction", F.concat_ws(",", F.transform(F.slice("_f", 1, 3), lambda x: x["feature"])).alias("reasons"))


def selectivity(ep: DataFrame, seasons: DataFrame) -> DataFrame:
    """How often the detector fires; episode lengths are whole days of a season, so the median buffer is small."""
    e = ep.agg(F.count("*").alias("episodes"), F.count_distinct("pid", "year").alias("_w"),
               F.avg(F.when(F.col("days") < 14, 1.0).otherwise(0.0)).alias("share_short"),
               F.avg(F.when(F.col("n_obs") <= 2, 1.0).otherwise(0.0)).alias("share_few_obs"), F.median("days").alias("median_days"))
    n = seasons.agg(F.count("*")).scalar()
    return e.withColumn("seasons", n).select("seasons", "episodes", (F.col("_w") / F.col("seasons")).alias("with_episode"),
                                             (F.col("episodes") / F.col("seasons")).alias("per_season"), "share_short", "share_few_obs", "median_days")


def agreement(obs: DataFrame) -> DataFrame:
    """Recall and precision of episodes against pointwise z; needs columns z and inside."""
    d = obs.filter("z IS NOT NULL")
    mean = lambda c, when: F.avg(F.when(when, F.when(c, 1.0).otherwise(0.0)))
    inside, low, crit = F.col("inside"), F.col("z") < -1, F.col("z") < -2
    return d.agg(F.count("*").alias("n"), mean(inside, low).alias("recall_depressed"), mean(inside, crit).alias("recall_critical"),
                 mean(low, inside).alias("precision"), mean(low, F.lit(True)).alias("base_rate"), mean(inside, F.lit(True)).alias("share_inside"))


def year_ranking(ep: DataFrame, seasons: DataFrame) -> DataFrame:
    """Share of entities with an episode per year and its descending rank, ties averaged; one row per year."""
    e = ep.groupBy("year").agg(F.count_distinct("pid").alias("_e"))
    d = seasons.groupBy("year").agg(F.count("*").alias("n")).join(e, "year", "left")
    d = d.withColumn("rate", F.coalesce("_e", F.lit(0)) / F.col("n"))
    w = Window.orderBy(F.desc("rate"))
    ties = F.count("*").over(Window.partitionBy("rate"))
    return d.select("year", "rate", (F.rank().over(w) + (ties - 1) / 2).alias("rank"))


def example_seasons(d: DataFrame, least: int = 40) -> DataFrame:
    """The most depressed season and the best observed one without any depression, among well observed ones."""
    low = F.when(F.col("status") != "normal", 1.0).otherwise(0.0)
    s = d.filter("status IS NOT NULL").groupBy("pid", "year").agg(F.count("*").alias("n"), F.avg(low).alias("share")).filter(F.col("n") >= least)
    one = s.agg(F.max_by(F.struct("pid", "year", "n", "share"), F.struct("share", -F.col("pid"), -F.col("year"))).alias("worst"),
                F.max_by(F.struct("pid", "year", "n", "share"), F.when(F.col("share") == 0, F.struct("n", -F.col("pid"), -F.col("year")))).alias("calm"))
    return one.select(F.explode(F.array(F.struct(F.lit("worst").alias("kind"), F.col("worst").alias("s")), F.struct(F.lit("calm").alias("kind"), F.col("calm").alias("s"))))
                      .alias("r")).select("r.kind", "r.s.*").filter("pid IS NOT NULL")


def field_facts(ep: DataFrame, seasons: DataFrame, most: int = 12) -> DataFrame:
    """One JSON document per entity: its seasons and its first ``most`` episodes by severity and depth."""
    e = top_episodes(ep, most).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct(
        "place", "year", "start", "end", "days", "severity", "cause", F.round("min_z", 2).alias("min_z"), "text"))).alias("episodes"))
    s = seasons.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct(
        "year", "n_obs", F.round("peak", 3).alias("peak"), "peak_doy", F.round("mean_z", 2).alias("mean_z"), "norm_source"))).alias("seasons"))
    d = s.join(e, "pid", "left")
    return d.select("pid", F.size("seasons").alias("n_seasons"), F.coalesce(F.size("episodes"), F.lit(0)).alias("n_episodes"),
                    F.to_json(F.struct("pid", "seasons", "episodes")).alias("doc"))


def top_episodes(ep: DataFrame, most: int) -> DataFrame:
    """First episodes per entity, critical before moderate, deeper before shallower; an entity has few per season."""
    w = Window.partitionBy("pid").orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "min_z", "year", "start")
    return ep.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)

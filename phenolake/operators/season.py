"""Season pipeline: harmonised series, daily curves, norms, deviations, episodes.

Everything up to the episodes partitions by entity (entity-year windows reuse it), so the chain needs one shuffle of
the daily panel plus one small aggregate for the category norm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.functions.expr import clip, day_num, phase_of, source_offset
from phenolake.operators import frames
from phenolake.operators.norms import moments
from phenolake.operators.aggregate import shrink
from phenolake.operators.smooth import loo_fit, scatter, solve, sums


def with_entity_offsets(df: DataFrame, k: int = C.OFFSET_SHRINK, offsets=C.SOURCE_OFFSET) -> DataFrame:
    """Adds ``offset`` (of the row's source, shrunk per entity) and ``h``, the value on the first source's scale."""
    w = Window.partitionBy("pid")
    out = F.when(F.col("source") == 0, F.lit(0.0))
    for i, c in ((1, "s2"), (2, "s3")):
        diff = F.col(c) - F.col("s1")
        out = out.when(F.col("source") == i, shrink(F.count(diff).over(w), F.avg(diff).over(w), k, offsets[i]))
    return df.withColumn("offset", out).withColumn("h", F.col("value") - F.col("offset"))


def split_unknown(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejects): a row whose source is unknown cannot be harmonised and goes to the rejects."""
    return df.filter("source >= 0"), df.filter("source < 0 OR source IS NULL")


def confirmed_by_neighbor(df: DataFrame, days: int = C.CONFIRM_DAYS, diff: float = C.CONFIRM_DIFF) -> DataFrame:
    """Adds ``confirmed``: the nearest clean row before or after is close in time and value."""
    item, clean = F.struct("day", "h"), ~F.col("suspect")
    near = lambda x: F.coalesce((F.abs(x["day"] - F.col("day")) <= days)
                                & (F.abs(x["h"] - F.col("h")) <= diff), F.lit(False))
    d = df.withColumns({"_p": frames.last_before(clean, item, ["pid"]), "_n": frames.first_after(clean, item, ["pid"])})
    return d.withColumn("confirmed", F.col("suspect") & (near(F.col("_p")) | near(F.col("_n")))).drop("_p", "_n")


def harmonize(df: DataFrame) -> DataFrame:
    """Adds offset, h, res (leave-one-out residual), suspect, confirmed and artifact."""
    d = loo_fit(with_entity_offsets(df), ["pid"], "h", C.CURVE_BW)
    d = d.withColumn("res", F.when(F.col("fit_weight") >= 0.5, F.col("h") - F.col("fit")))
    w = Window.partitionBy("pid")
    d = d.withColumn("_m", F.median("res").over(w))   # an entity's residuals are bounded by the calendar
    d = d.withColumn("_mad", F.coalesce(1.4826 * F.median(F.abs(F.col("res") - F.col("_m"))).over(w), F.lit(0.05)))
    limit = F.greatest(F.lit(C.ARTIFACT_ABS), C.ARTIFACT_MAD_K * F.col("_mad"))
    d = d.withColumn("suspect", F.coalesce(F.abs("res") > limit, F.lit(False))).drop("_m", "fit", "fit_slope", "fit_weight")
    d = confirmed_by_neighbor(d.withColumnRenamed("_mad", "mad"))
    return d.withColumn("artifact", F.col("suspect") & ~F.col("confirmed"))


def season_bounds(year: Column) -> tuple[Column, Column]:
    return (day_num(F.make_date(year, F.lit(4), F.lit(1))), day_num(F.make_date(year, F.lit(10), F.lit(30))))


def daily_curve(series: DataFrame, as_of: Column | None = None, bw: float = C.CURVE_BW,
                least: int = C.CURVE_MIN_POINTS) -> DataFrame:
    """Daily value, slope and weight on the season grid from clean points, for seasons with ``least`` of them.

    Outside the observed span (two days of tolerance, never past ``as_of``) value and slope are NULL and weight is 0.
    """
    clean = series.filter(~F.col("artifact")).select("pid", "year", "day", "h")
    w = Window.partitionBy("pid", "year")
    lo, hi = season_bounds(F.col("year"))
    d = clean.withColumns({"n_obs": F.count("*").over(w), "first": F.min("day").over(w), "last": F.max("day").over(w),
                           "_rn": F.row_number().over(w.orderBy("day")), "_lo": lo, "_hi": hi}).filter(F.col("n_obs") >= least)
    # the first point of a season also emits the empty season grid, so no outer join is needed
    s = scatter(d, C.KERNEL_CUTOFF * bw, ["pid", "year", "h", "n_obs", "first", "last", "_lo", "_hi"],
                skeleton=F.when(F.col("_rn") == 1, F.sequence("_lo", "_hi")))
    s = s.filter(F.col("eval_day").between(F.col("_lo"), F.col("_hi")))
    g = s.groupBy("pid", "year", "eval_day").agg(
        F.max("n_obs").alias("n_obs"), F.max("first").alias("first"), F.max("last").alias("last"),
        *sums(F.col("d"), F.when(F.col("d").isNotNull(), F.col("h")), None, bw, "k"))
    value, slope, weight = solve("k", 2.0)
    end = F.col("last") + C.EDGE_DAYS if as_of is None else F.least(F.col("last") + C.EDGE_DAYS, day_num(as_of))
    inside = F.col("eval_day").between(F.col("first") - C.EDGE_DAYS, end)
    date = F.date_add(F.lit(C.EPOCH).cast("date"), F.col("eval_day"))
    return g.select("pid", "year", F.col("eval_day").alias("day"), date.alias("date"), F.dayofyear(date).alias("doy"),
                    F.when(inside, clip(value, *C.CURVE_RANGE)).alias("value"), F.when(inside, slope).alias("slope"),
                    F.when(inside, weight).otherwise(0.0).alias("weight"), "n_obs")


def reliable(c: str = "value") -> Column:
    return F.when(F.col("weight") >= C.MIN_CURVE_WEIGHT, F.col(c))


def curve_norm(curves: DataFrame) -> DataFrame:
    """Own norm from the other years' curves: moments of the (entity, day of year)'s values, one a year, without the own one."""
    w = Window.partitionBy("pid", "doy")
    every = F.collect_list(F.when(reliable().isNotNull(), F.struct(F.col("year").alias("y"), reliable().alias("v")))).over(w)
    d = curves.withColumn("_m", moments(F.transform(F.filter(every, lambda x: x["y"] != F.col("year")), lambda x: x["v"])))
    n = F.col("_m.n")
    return d.withColumns({"norm_n": n.cast("long"), "norm_mean": F.col("_m.mean"),
                          "norm_std": F.when(n > 1, F.greatest(F.col("_m.std"), F.lit(C.STD_FLOOR)))}).drop("_m")


def category_norm(curves: DataFrame, categories: DataFrame) -> DataFrame:
    """Norm per category and day of year over all its curves; needs three entities and more than two values. Count, mean and
    second moment are merged from partial aggregates."""
    d = curves.select("pid", "doy", reliable().alias("v")).join(categories, "pid")
    g = d.groupBy("category", "doy").agg(F.count("v").alias("cat_n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    size = d.select("category", "pid").distinct().groupBy("category").agg(F.count("*").alias("entities"))
    ok = F.col("cat_n") > 2
    return (g.join(size.filter(F.col("entities") >= C.CATEGORY_MIN_ENTITIES).select("category"), "category", "left_semi")
            .select("category", "doy", "cat_n", F.when(ok, F.col("mean")).alias("cat_mean"),
                    F.when(ok, F.greatest(F.col("std"), F.lit(C.STD_FLOOR))).alias("cat_std")))


def choose_norm(own: DataFrame, cat: DataFrame, categories: DataFrame, days: int = 60, years: int = 3) -> DataFrame:
    """Own norm when at least ``days`` days have ``years`` other years, else the category's, else own marked none."""
    w = Window.partitionBy("pid", "year")
    d = own.withColumn("_own", F.count(F.when(F.col("norm_n") >= years, 1)).over(w) >= days)
    d = d.join(categories, "pid", "left").join(cat, ["category", "doy"], "left")
    has_cat = F.max(F.col("cat_n").isNotNull()).over(w)
    kind = F.when(F.col("_own"), "own").when(has_cat, "category").otherwise("none")
    d = d.withColumn("norm_source", kind)
    use = F.col("norm_source") == "category"
    pick = lambda c, o: F.when(use, F.col(c)).otherwise(F.col(o))
    return d.withColumns({"norm_mean": pick("cat_mean", "norm_mean"), "norm_std": pick("cat_std", "norm_std"),
                          "norm_n": pick("cat_n", "norm_n")}).drop("_own", "cat_n", "cat_mean", "cat_std")


def sure() -> Column:
    return F.col("weight") >= C.MIN_CURVE_WEIGHT


def with_z(d: DataFrame, reliable: Column) -> DataFrame:
    ok = reliable & F.col("norm_mean").isNotNull() & F.col("norm_std").isNotNull()
    gap = F.col("value") - F.col("norm_mean")
    return d.withColumns({"z": F.when(ok, gap / F.col("norm_std")), "deficit": F.when(ok, gap)})


def z_series(d: DataFrame, least: int = 30) -> DataFrame:
    """Daily z and deficit; seasons whose norm covers fewer than ``least`` days are dropped."""
    w = Window.partitionBy("pid", "year")
    return with_z(d.withColumn("_days", F.count("norm_mean").over(w)).filter(F.col("_days") >= least).drop("_days"), sure())


def is_episode(days: Column, mean_z: Column, min_z: Column, n_obs: Column, strict: bool = True) -> Column:
    base = (days >= C.EPISODE_MIN_DAYS) & (n_obs >= C.EPISODE_MIN_OBS)
    if not strict:
        return base
    return base & (((days >= C.SUSTAINED_DAYS) & (mean_z <= C.SUSTAINED_MEAN_Z)) | (min_z <= C.STRONG_Z)
                   | ((days >= C.PROLONGED_DAYS) & (mean_z <= C.PROLONGED_MEAN_Z)))


def with_islands(z: DataFrame) -> DataFrame:
    """Adds ``island``: the number of the merged run of z < -1 that the day lies in, NULL outside of them.

    Instead of joining the runs back to their days, every day takes the island of the flagged days on both sides of
    it: a day lies inside an island when both agree.
    """
    keys = ["pid", "year"]
    w = Window.partitionBy(*keys).orderBy("day")
    flag = F.coalesce(F.col("z") < C.Z_DEPRESSED, F.lit(False))
    d = z.withColumn("_f", flag)
    last = F.last(F.when(F.col("_f"), F.col("day")), ignorenulls=True).over(w.rowsBetween(frames.UNBOUNDED, -1))
    d = d.withColumn("_start", F.when(F.col("_f") & (F.coalesce(F.col("day") - last, F.lit(9999)) > C.EPISODE_MERGE_GAP + 1), 1).otherwise(0))
    d = d.withColumn("island", F.sum("_start").over(w.rowsBetween(frames.UNBOUNDED, 0)))
    end = F.max(F.when(F.col("_f"), F.col("day"))).over(Window.partitionBy(*keys, "island"))
    d = d.withColumn("_end", end)
    return d.withColumn("island", F.when((F.col("island") > 0) & (F.col("day") <= F.col("_end")), F.col("island"))).drop("_f", "_start", "_end")


def find_episodes(z: DataFrame, series: DataFrame, strict: bool = True, pad: int = 10) -> DataFrame:
    """Merged runs of z < -1 with their facts; gap days count in length and, when known, in the means.

    ``z`` may already hold the ``island`` of each day. Observations join as arrays of their season.
    """
    keys = ["pid", "year"]
    d = (z if "island" in z.columns else with_islands(z)).filter("island IS NOT NULL")
    worst = F.struct("z", "day")
    ep = d.groupBy(*keys, "island").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("days"),
        F.min("z").alias("min_z"), F.avg("z").alias("mean_z"), F.count(F.when(F.col("z") < C.Z_CRITICAL, 1)).alias("critical_days"),
        F.min("deficit").alias("max_deficit"), F.avg("deficit").alias("mean_deficit"),
        F.min_by(F.struct("day", "value", "norm_mean"), F.when(F.col("z").isNotNull(), worst)).alias("_w"),
        F.min("doy").alias("start_doy"), F.max("doy").alias("end_doy"), F.max("norm_source").alias("norm_source"))
    ep = interval_counts(ep, series, pad)
    return (ep.filter(is_episode(F.col("days"), F.col("mean_z"), F.col("min_z"), F.col("n_obs"), strict))
            .select("pid", "year", "start", "end", "days", "n_obs", "artifacts_near", "min_z", "mean_z", "critical_days", "max_deficit",
                    "mean_deficit", F.col("_w.day").alias("worst_day"), F.col("_w.value").alias("value_at_worst"),
                    F.col("_w.norm_mean").alias("norm_at_worst"), phase_of(F.col("start_doy")).alias("phase"),
                    phase_of(F.col("end_doy")).alias("phase_end"), "start_doy", "end_doy", "norm_source"))


def interval_counts(ep: DataFrame, series: DataFrame, pad: int) -> DataFrame:
    """Clean observations inside each interval and artifacts within ``pad`` days of it, in the same season."""
    days = F.array_sort(F.collect_list(F.when(~F.col("artifact"), F.col("day"))))
    bad = F.array_sort(F.collect_list(F.when(F.col("artifact"), F.col("day"))))
    per = series.groupBy("pid", "year").agg(days.alias("_obs"), bad.alias("_bad"))  # at most one row per season day
    inside = lambda arr, lo, hi: F.size(F.filter(arr, lambda x: (x >= lo) & (x <= hi)))
    d = ep.join(per, ["pid", "year"], "left")
    empty = F.array().cast("array<int>")
    return d.withColumns({
        "n_obs": inside(F.coalesce("_obs", empty), F.col("start"), F.col("end")),
        "artifacts_near": inside(F.coalesce("_bad", empty), F.col("start") - pad, F.col("end") + pad)}).drop("_obs", "_bad")


def phenology(df: DataFrame, value: str = "value", ok: Column | None = None, keys=("pid", "year")) -> DataFrame:
    """Peak, base, amplitude, start of season, half decline and integral per season; ``valid`` is false when too thin."""
    use = sure() & F.col(value).isNotNull() if ok is None else ok
    w = Window.partitionBy(*keys)
    v, doy = F.col(value), F.col("doy")
    d = df.filter(use).select(*keys, "doy", v.alias("_v"))
    main = doy <= C.MAIN_SEASON_END
    d = d.withColumns({"covered": F.count("*").over(w), "_main": F.count(F.when(main, 1)).over(w),
                       "_pk": F.max(F.when(main, F.struct(F.col("_v"), (-doy).alias("m")))).over(w),
                       "base": F.percentile("_v", F.lit(0.05)).over(w),
                       "_pv": F.lag("_v").over(w.orderBy("doy")), "_pd": F.lag("doy").over(w.orderBy("doy"))})
    peak, peak_doy = F.col("_pk")["_v"], -F.col("_pk")["m"]
    d = d.withColumns({"peak": peak, "peak_doy": peak_doy})
    amp = F.col("peak") - F.col("base")
    g = d.groupBy(*keys).agg(
        F.first("covered").alias("covered_days"), F.first("_main").alias("_main"), F.first("peak").alias("peak"),
        F.first("peak_doy").alias("peak_doy"), F.first("base").alias("base"),
        F.coalesce(F.min(F.when(main & (F.col("_v") >= F.col("base") + 0.2 * amp), doy)), F.min(F.when(main, doy))).alias("sos_doy"),
        F.min(F.when((doy > F.col("peak_doy")) & (F.col("_v") <= F.col("peak") - 0.5 * amp), doy)).alias("half_decline_doy"),
        F.sum((F.col("_v") + F.col("_pv")) / 2 * (doy - F.col("_pd"))).alias("integral"))
    valid = (F.col("covered_days") >= 30) & (F.col("_main") >= 20)
    facts = {c: F.when(valid, F.col(c)) for c in ("peak", "peak_doy", "base", "sos_doy", "half_decline_doy", "integral")}
    return g.select(*keys, valid.alias("valid"), "covered_days", *[c.alias(n) for n, c in facts.items()],
                    F.when(valid, F.col("peak") - F.col("base")).alias("amplitude"))


def phenology_deviation(own: DataFrame, norm: DataFrame, keys=("pid", "year")) -> DataFrame:
    """Ratios to and day shifts from the norm's phenology; NULL where either is not valid."""
    n = norm.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("peak", "peak_doy", "sos_doy", "half_decline_doy", "integral")])
    d = own.join(n, list(keys), "left")
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-6))
    ratio = lambda c: F.when(F.col(f"n_{c}").isNotNull(), F.col(c) / floor(f"n_{c}"))
    shift = lambda c: F.col(c) - F.col(f"n_{c}")
    return d.select(*own.columns, ratio("peak").alias("peak_ratio"), shift("peak_doy").alias("peak_shift"),
                    shift("sos_doy").alias("sos_shift"), ratio("integral").alias("integral_ratio"),
                    shift("half_decline_doy").alias("decline_shift"))

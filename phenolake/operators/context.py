"""Context of an episode: region, second index, severity, cause, text."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.functions.expr import TIE_SHIFT
from phenolake.operators.norms import loyo_norm
from phenolake.operators.quantiles import order_statistics
from phenolake.operators.season import season_bounds

EPISODE_KEY = ["pid", "year", "start"]
SEASON_DAYS = 213  # 1 April to 30 October
SALTS = 128        # tasks that share the entities of a region and year
HELD = 128         # tables of counts that a task holds at once, 0.7 MB each
LOW_MEAN = 1 + 5e-10  # means are compared with -1 after rounding to 9 digits


def day_medians(z: DataFrame, within=()) -> DataFrame:
    """Per region (columns ``within``) and day: number of entities and the four values around the middle."""
    return order_statistics(z, [*within, "day"], "z", {
        "za": lambda n: F.floor(n / 2), "zb": lambda n: F.floor(n / 2) + 1,
        "zc": lambda n: F.ceil(n / 2), "zd": lambda n: F.ceil(n / 2) + 1})


def median_of_others(own: Column) -> Column:
    """Median of a day's values without one of them, from the values around the middle (see ``day_medians``).

    Removing a value shifts the ranks above it by one, so only the neighbours of the middle can matter.
    """
    n = F.col("n")
    everyone = F.when(n % 2 == 0, (F.col("za") + F.col("zb")) / 2).otherwise(F.col("zb"))
    left = F.when(F.col("za") < own, F.col("za")).otherwise(F.col("zb"))
    right = F.when(F.col("zc") < own, F.col("zc")).otherwise(F.col("zd"))
    return F.when(own.isNull(), everyone).when(n >= 2, (left + right) / 2)


def interval_number(start: Column, end: Column) -> Column:
    """Place of the interval from the ``start``-th to the ``end``-th season day (from 0) among all intervals, by start, then end."""
    return (start * (2 * SEASON_DAYS + 1 - start) / 2 + end - start).cast("int")


def entity_shares(z: DataFrame, within=()) -> DataFrame:
    """Per region, year and interval of season days: entities with a z inside and those with a mean below -1.

    A season has at most 213 * 214 / 2 intervals, so all of them together are one array of counts. A task adds up the arrays
    of its entity-seasons, each from running sums, and sends one array a region and year; no row of an entity and an interval
    is made. Entities of a region and year are dealt to SALTS tasks. A task that meets more than HELD regions and years sends
    what it has and goes on.
    """
    keys = [*within, "year"]
    offset = F.col("day") - season_bounds(F.col("year"))[0]
    d = z.filter("z IS NOT NULL").select(*keys, "pid", F.pmod(F.xxhash64("pid"), F.lit(SALTS)).alias("_salt"), offset.alias("_at"), "z")
    d = d.filter(F.col("_at").between(0, SEASON_DAYS - 1)).repartition(*keys, "_salt")  # the grouping below needs no other exchange
    packed = d.groupBy(*keys, "_salt", "pid").agg(F.collect_list("_at").alias("at"), F.collect_list("z").alias("z")).select(*keys, "at", "z")
    types = {f.name: f.dataType.simpleString() for f in z.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_all array<bigint>, n_low array<bigint>"

    def counts(batches):
        upper = np.triu_indices(SEASON_DAYS)
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def sent():
            cols = {k: pa.array([key[i] for key in held], type=kinds[i]) for i, k in enumerate(keys)}
            for i, name in enumerate(("n_all", "n_low")):
                cols[name] = pa.array([x[i][upper] for x in held.values()], type=pa.list_(pa.int64()))
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            rows = zip(*[batch.column(k).to_pylist() for k in keys])
            at, v = batch.column("at"), batch.column("z")
            for i, key in enumerate(rows):
                day = at[i].values.to_numpy() + 1
                seen, below = np.zeros((2, SEASON_DAYS + 1))
                np.add.at(seen, day, 1.0)
                np.add.at(below, day, v[i].values.to_numpy() + LOW_MEAN)
                seen, below = np.cumsum(seen), np.cumsum(below)
                if key not in held and len(held) >= HELD:
                    yield sent()
                    held = {}
                mine = held.setdefault(key, np.zeros((2, SEASON_DAYS, SEASON_DAYS), dtype=np.int64))
                mine[0] += seen[1:] > seen[:-1, None]     # [first day, last day]
                mine[1] += below[1:] < below[:-1, None]   # a sum of z + 1 below 0: a mean below -1
        if held:
            yield sent()

    added = lambda c: F.reduce(F.collect_list(c), F.array_repeat(F.lit(0).cast("long"), SEASON_DAYS * (SEASON_DAYS + 1) // 2),
                               lambda x, y: F.zip_with(x, y, lambda i, j: i + j))
    sums = packed.mapInArrow(counts, schema).groupBy(*keys).agg(added("n_all").alias("n_all"), added("n_low").alias("n_low"))
    return (sums.select(*keys, F.posexplode(F.arrays_zip("n_all", "n_low")).alias("_interval", "_n"))
            .select(*keys, "_interval", "_n.n_all", "_n.n_low").filter("n_all > 0"))


def region_context(ep: DataFrame, z: DataFrame, within=()) -> DataFrame:
    """Adds region_z, n_entities and share_low of the other entities; NULL with fewer than three of them.

    ``within`` names columns of ``z`` that tell an entity's region (none: all entities are one). NULL is a region of its own.
    """
    z = z.select("pid", "year", "day", "z", *within)
    days = day_medians(z.filter("z IS NOT NULL"), within)
    own = ep.select(*EPISODE_KEY, "end").join(z, ["pid", "year"]).filter(F.col("day").between(F.col("start"), F.col("end")))
    if within:
        days = days.withColumnsRenamed({k: f"_of_{k}" for k in [*within, "day"]})
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*within, "day"]])
        own = own.join(days, same)
    else:
        own = own.join(F.broadcast(days), "day")  # bounded by the calendar
    of_episode = F.avg(median_of_others(F.col("z"))).alias("_rz")
    region = own.groupBy(*EPISODE_KEY, *[F.col(k).alias(f"_in_{k}") for k in within]).agg(of_episode)
    lo = season_bounds(F.col("year"))[0]
    d = ep.join(region, EPISODE_KEY).withColumn("_interval", interval_number(F.col("start") - lo, F.col("end") - lo))
    shares = entity_shares(z, within).withColumnsRenamed({"year": "_of_year", "_interval": "_of_interval"} | {k: f"_of_{k}" for k in within})
    same = reduce(Column.__and__, [F.col(f"_in_{k}").eqNullSafe(F.col(f"_of_{k}")) for k in within],
                  (F.col("year") == F.col("_of_year")) & (F.col("_interval") == F.col("_of_interval")))
    d = d.join(shares, same)
    # an episode always holds z values of its own entity: total minus own
    n = F.col("n_all") - 1
    # rounded as the shares are: an average and a difference of running sums may differ in the last bit
    low = F.col("n_low") - F.when(F.round("mean_z", 9) < -1, 1).otherwise(0)
    ok = n >= C.REGION_MIN_ENTITIES
    return d.select(*ep.columns, F.when(ok, F.col("_rz")).alias("region_z"), F.when(ok, n).alias("n_entities"),
                    F.when(ok, low / n).alias("share_low"))


def index_anomaly(ep: DataFrame, series: DataFrame, least: int = 2, refs: int = 3) -> DataFrame:
    """Mean anomaly of the second index inside each episode against the same source and season part of other years."""
    idx = F.when(F.col("source") == 0, F.col("x1")).when(F.col("source") == 1, F.col("x2"))
    d = series.withColumn("idx", idx).filter("idx IS NOT NULL").select("pid", "year", "day", "doy", "source", "artifact", "idx")
    d = loyo_norm(d, value="idx", keys=("pid", "source"))
    pts = d.filter("NOT artifact").select("pid", "year", "day", "source", F.when(
        F.col("norm_n") >= refs, F.col("idx") - F.col("norm_mean")).alias("a"))
    inside = ep.select(*EPISODE_KEY, "end").join(pts, ["pid", "year"]).filter(F.col("day").between(F.col("start"), F.col("end")))
    per = (inside.groupBy(*EPISODE_KEY, "source").agg(F.count("*").alias("p"), F.count("a").alias("n"), F.sum("a").alias("s"))
           .filter(F.col("p") >= least))
    return (per.groupBy(*EPISODE_KEY).agg(F.sum("n").alias("index_n"), F.sum("s").alias("_s")).filter(F.col("index_n") >= least)
            .select(*EPISODE_KEY, (F.col("_s") / F.col("index_n")).alias("index_anomaly"), "index_n"))


def severity(min_z: Column, critical_days: Column) -> Column:
    return F.when((min_z < C.Z_CRITICAL) & (critical_days >= C.CRITICAL_MIN_DAYS), "critical").otherwise("moderate")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def with_driver_signal(d: DataFrame) -> DataFrame:
    """Driver stress from the combined window (columns c_*): dry, hot, long dry spell, stress and its strength."""
    known = F.col("c_deficit_pct").isNotNull() & (F.col("c_n_days") >= C.MIN_DRIVER_DAYS)
    deficit, warm = F.col("c_deficit_pct"), F.col("c_level_anomaly")
    dry = yes(known & (deficit >= C.DEFICIT_PCT))
    hot = yes(known & (warm >= C.WARM_ANOMALY) & (F.col("c_hot_days") >= 5))
    spell = yes(known & (F.col("c_max_dry_spell") >= C.LONG_DRY_SPELL) & (deficit > 0))
    num = lambda c: F.when(c, 1.0).otherwise(0.0)
    strength = (0.20 * num(dry) + 0.15 * num(yes(known & (deficit >= 2 * C.DEFICIT_PCT))) + 0.15 * num(hot)
                + 0.10 * num(yes(known & (warm >= 2 * C.WARM_ANOMALY))) + 0.05 * num(spell))
    return d.withColumns({"dry": dry, "hot": hot, "dry_spell": spell, "stress": dry | hot | spell,
                          "strength": F.round(strength, 3)})


def with_scope(d: DataFrame) -> DataFrame:
    z, share = F.col("region_z"), F.col("share_low")
    return d.withColumn("scope", F.when(z.isNull(), "unknown").when((z <= C.REGION_LOW_Z) | (share >= 0.5), "regional")
                        .when(z >= C.REGION_NORMAL_Z, "local").otherwise("mixed"))


def classify(d: DataFrame) -> DataFrame:
    """Adds cause, confidence and arguments from episode facts, phenology deviation, drivers and region.

    The rules are ordered; the first that holds decides.
    """
    # facts of the windows before and during the episode only add arguments: they may be absent
    parts = [f"{w}_{c}" for w in "bd" for c in ("amount", "amount_norm", "deficit_pct")]
    d = with_scope(with_driver_signal(d.withColumns({c: F.lit(None).cast("double") for c in parts if c not in d.columns})))
    ratio, shift = F.col("peak_ratio"), F.coalesce("peak_shift", F.lit(0))
    start, stress, local = F.col("start_doy"), F.col("stress"), F.col("scope") == "local"
    good_peak = ratio >= 0.85
    bonus = F.when(F.col("scope") == "regional", 0.10).when(local, -0.10).otherwise(0.0)
    driver_conf = F.round(F.least(F.lit(0.85), F.greatest(F.lit(0.40), 0.45 + F.col("strength") + bonus)) + 1e-9, 2)
    early = good_peak & (F.coalesce("decline_shift", F.lit(0)) <= -C.EARLY_DECLINE_DAYS) & (start <= C.MAIN_SEASON_END)
    rules = [
        ((F.col("n_obs") <= 2) & (F.col("artifacts_near") >= 2), "few_obs", "data_suspect", F.lit(0.4)),
        (good_peak & (shift >= C.ROTATION_SHIFT) & (F.col("end_doy") <= 200), "late_peak", "crop_rotation", F.lit(0.7)),
        (good_peak & (shift <= -C.ROTATION_SHIFT) & (start >= 150) & ~stress, "early_peak", "crop_rotation", F.lit(0.65)),
        (F.col("valid") & ((F.col("peak") < C.FLAT_PEAK) | yes(ratio < 0.6)) & (start <= 165), "flat", "unsown_or_changed", F.lit(0.8)),
        (early & stress, "decline", "weather_drought", driver_conf),
        (early, "decline", "early_decline", F.lit(0.6)),
        ((F.coalesce("sos_shift", F.lit(0)) >= 15) & (start <= 150) & (F.coalesce(ratio, F.lit(0.0)) >= C.LOW_PEAK_RATIO),
         "late_start", "late_start", F.lit(0.6)),
        (stress, "drivers", "weather_drought", driver_conf),
        (F.col("scope") == "regional", "no_deficit", "weather_drought", F.lit(0.5)),
        (ratio < C.LOW_PEAK_RATIO, "low_peak", "weak_season", F.when(local, 0.6).otherwise(0.55)),
        (F.lit(True), "no_signal", "weak_season", F.when(local, 0.45).otherwise(0.4))]
    hit = F.coalesce(*[F.when(yes(cond), F.struct(F.lit(rule).alias("rule"), F.lit(cause).alias("cause"), conf.cast("double").alias("confidence")))
                       for cond, rule, cause, conf in rules])
    d = d.withColumn("_hit", hit).withColumns({c: F.col(f"_hit.{c}") for c in ("rule", "cause", "confidence")}).drop("_hit")
    d = d.withColumn("arguments", arguments())
    return d.withColumn("reasons", F.transform("arguments", rendered))


def argument(when: Column, code: str | Column, *numbers) -> Column:
    """A typed argument: its code and its numbers; NULL where it doesn't apply."""
    code = F.lit(code) if isinstance(code, str) else code
    values = [F.col(x) if isinstance(x, str) else x for x in numbers]
    return F.when(yes(when), F.struct(code.alias("code"), F.array(*[x.cast("double") for x in values]).cast("array<double>").alias("n")))


def arguments() -> Column:
    """Arguments of an episode in reading order: what decides first, then the region, then the drivers; where drivers decide, they come first."""
    rule, scope, ratio = F.col("rule"), F.col("scope"), F.col("peak_ratio")
    wet = F.col("c_deficit_pct") <= 0
    known = F.col("c_deficit_pct").isNotNull() & (F.col("c_n_days") >= C.MIN_DRIVER_DAYS)
    main = [argument(rule == "few_obs", "few_obs", "n_obs", "artifacts_near"), argument(rule == "late_peak", "late_peak", ratio, "peak_shift"),
            argument(rule == "early_peak", "early_peak", ratio, -F.col("peak_shift")),
            argument(rule == "flat", "flat", "peak", F.when(ratio > 0, F.col("peak") / F.greatest(ratio, F.lit(1e-6)))),
            argument(rule == "decline", "decline", ratio, -F.col("decline_shift")), argument(rule == "late_start", "late_start", "sos_shift", ratio),
            argument(rule == "no_deficit", "no_deficit"), argument(rule == "low_peak", "low_peak", ratio), argument(rule == "no_signal", "no_signal")]
    region = [argument(scope == "regional", "region_low", "region_z", "share_low", "n_entities"), argument(scope == "local", "region_normal", "region_z", "share_low", "n_entities"),
              argument(scope == "mixed", "region_mixed", "region_z")]
    drivers = [argument(F.col("dry"), "dry", "c_amount", "c_amount_norm", "c_deficit_pct"),
               argument(F.col("hot"), "hot", "c_level_anomaly", "c_level", F.col("c_level") - F.col("c_level_anomaly"), "c_hot_days"),
               argument(known & (F.col("c_max_dry_spell") >= 15) & ~wet, "dry_spell", "c_max_dry_spell"),
               *[argument(F.col("stress") & (F.abs(f"{w[0]}_deficit_pct") >= C.DEFICIT_PCT), w, f"{w[0]}_amount", f"{w[0]}_amount_norm") for w in ("before", "during")]]
    index = [argument(F.abs("index_anomaly") >= 0.05, "second_index", "index_anomaly", "index_n")]
    by_drivers = (F.col("rule") == "drivers") | ((F.col("rule") == "decline") & F.col("stress"))
    return F.array_compact(F.when(by_drivers, F.array(*drivers, *main, *region, *index)).otherwise(F.array(*main, *region, *drivers, *index)))


def fixed(x: Column, digits: int = 0) -> Column:
    """A number with a fixed count of decimals, rounded as every compared column is."""
    return F.round(x + TIE_SHIFT, digits).cast(f"decimal(18,{digits})").cast("string")


def counted(n: Column, one: str, many: str) -> Column:
    """"1 day", "2 days"."""
    return F.concat(fixed(n), F.when(F.abs(n) == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def rendered(a: Column) -> Column:
    """The sentence of a typed argument."""
    n = lambda i: F.get(a["n"], F.lit(i))
    pct = lambda i: F.concat(fixed(n(i) * 100), F.lit(" %"))
    days = lambda i: counted(n(i), "day", "days")
    t = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    texts = {
        "few_obs": t("only ", counted(n(0), "observation", "observations"), " inside, ", counted(n(1), "artifact", "artifacts"), " near"),
        "late_peak": t("peak reached (", pct(0), " of the norm) but ", days(1), " late: another crop, not stress"),
        "early_peak": t("peak reached (", pct(0), " of the norm) but ", days(1), " early: another crop, not stress"),
        "flat": t("peak of the main season is only ", fixed(n(0), 2), F.coalesce(t(" against a norm of ", fixed(n(1), 2)), F.lit("")), ": flat from spring on"),
        "decline": t("peak at the norm (", pct(0), ") but the decline began ", days(1), " early"),
        "late_start": t("growth began ", days(0), " late, but the peak was reached (", pct(1), " of the norm)"),
        "no_deficit": t("no clear deficit in the drivers, but the whole region is low"),
        "low_peak": t("peak at ", pct(0), " of the norm without a clear driver signal"), "no_signal": t("no driver signal"),
        "region_low": t("other entities are low too (median z ", fixed(n(0), 1), ", ", pct(1), " of ", fixed(n(2)), " low)"),
        "region_normal": t("other entities are normal (median z ", fixed(n(0), 1), ", ", pct(1), " of ", fixed(n(2)), " low)"),
        "region_mixed": t("other entities are slightly low (median z ", fixed(n(0), 1), ")"),
        "dry": t("amount ", fixed(n(0)), " against a norm of ", fixed(n(1)), " (deficit ", fixed(n(2)), " %)"),
        "hot": t("level above the norm by ", fixed(n(0), 1), " (", fixed(n(1), 1), " against ", fixed(n(2), 1), "), ", counted(n(3), "hot day", "hot days")),
        "dry_spell": t("dry run of ", days(0)), "before": t("in the 30 days before: amount ", fixed(n(0)), " against a norm of ", fixed(n(1))),
        "during": t("during the episode: amount ", fixed(n(0)), " against a norm of ", fixed(n(1))),
        "second_index": t("second index off its norm by ", fixed(n(0), 2), " (", counted(n(1), "point", "points"), ")")}
    out = F.when(F.lit(False), "")
    for code, text in texts.items():
        out = out.when(a["code"] == code, text)
    return out


def describe() -> Column:
    """One sentence per episode from its facts."""
    day = lambda c: F.date_format(F.date_add(F.lit(C.EPOCH).cast("date"), F.col(c)), "yyyy-MM-dd")
    c = lambda name: F.col(name).cast("string")
    head = F.concat(c("pid"), F.lit(", season "), c("year"), F.lit(": "), F.col("severity"), F.lit(" anomaly from "), day("start"), F.lit(" to "), day("end"), F.lit(" ("),
                    counted(F.col("days"), "day", "days"), F.lit(", "), counted(F.col("n_obs"), "observation", "observations"), F.lit("), phase "), F.coalesce(F.col("phase"), F.lit("none")),
                    F.lit(". Value on the worst day "), day("worst_day"), F.lit(": "), fixed(F.col("value_at_worst"), 2), F.lit(" against a norm of "), fixed(F.col("norm_at_worst"), 2),
                    F.lit(" (z = "), fixed(F.col("min_z"), 1), F.lit("). Probable cause: "), F.col("cause"), F.lit(" (confidence "), fixed(F.col("confidence") * 100), F.lit(" %)."))
    tail = F.when(F.size("reasons") > 0, F.concat(F.lit(" Arguments: "), F.concat_ws("; ", "reasons"), F.lit("."))).otherwise("")
    return F.concat(head, tail, F.lit(" Norm: "), F.col("norm_source"), F.lit("."))


def season_table(series: DataFrame, z: DataFrame, pheno: DataFrame) -> DataFrame:
    """One row per season: observations, artifacts, mean z, share of depressed days over all days, phenology."""
    obs = series.groupBy("pid", "year").agg(F.count("*").alias("n_obs"), F.count(F.when(F.col("artifact"), 1)).alias("n_artifacts"))
    low = F.coalesce(F.col("z") < -1, F.lit(False))
    days = z.groupBy("pid", "year").agg(F.avg("z").alias("mean_z"), F.avg(F.when(low, 1.0).otherwise(0.0)).alias("share_days_depressed"),
                                        F.max("norm_source").alias("norm_source"))
    return days.join(obs, ["pid", "year"]).join(pheno, ["pid", "year"], "left")

"""As-of neighbours, range counts, islands and calendar windows.

All windows partition by entity (or entity and year). The panel holds one row per entity and day, so a partition is
bounded by the calendar. Forward searches run as backward searches on the negated day, because a frame that grows
from the start costs one pass while a frame that shrinks towards the end is recomputed for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


def before(keys, day: str = "day", inclusive: bool = False):
    """Frame of the rows strictly earlier than the current day."""
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(UNBOUNDED, 0 if inclusive else -1)


def after(keys, day: str = "day", inclusive: bool = False):
    return Window.partitionBy(*keys).orderBy(-F.col(day)).rangeBetween(UNBOUNDED, 0 if inclusive else -1)


def around(keys, half: int, day: str = "day"):
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(-half, half)


def last_before(when: Column, value: Column, keys, inclusive: bool = False) -> Column:
    return F.last(F.when(when, value), ignorenulls=True).over(before(keys, inclusive=inclusive))


def first_after(when: Column, value: Column, keys, inclusive: bool = False) -> Column:
    return F.last(F.when(when, value), ignorenulls=True).over(after(keys, inclusive=inclusive))


def tagged(targets: DataFrame, known: DataFrame, cols) -> DataFrame:
    """One stream of target and known rows, told apart by ``is_target``."""
    return (targets.select(*cols).withColumn("is_target", F.lit(True))
            .unionByName(known.select(*cols).withColumn("is_target", F.lit(False))))


def neighbors(marked: DataFrame, by, is_target: Column, is_known: Column) -> DataFrame:
    """Strict nearest known row before and after each target, with source, distance in days and ``min_dist``."""
    item = F.struct("date", "day", "value", "source")
    d = (marked.withColumns({"_p": last_before(is_known, item, by), "_n": first_after(is_known, item, by)})
         .filter(is_target))
    out = d.withColumns({
        "date_prev": F.col("_p.date"), "val_prev": F.col("_p.value"), "source_prev": F.col("_p.source"),
        "date_next": F.col("_n.date"), "val_next": F.col("_n.value"), "source_next": F.col("_n.source"),
        "days_prev": F.col("day") - F.col("_p.day"), "days_next": F.col("_n.day") - F.col("day")})
    return out.withColumn("min_dist", F.least("days_prev", "days_next")).drop("_p", "_n")


def k_neighbors(marked: DataFrame, by, is_target: Column, is_known: Column, k: int, max_days: int,
                values, prefix: str = "nb") -> DataFrame:
    """k nearest known rows each side within ``max_days``: ``<prefix>_p1_days``, ``<prefix>_p1_<value>``, ...

    A known row first collects its own k-1 predecessors with ``lag``; one as-of step then brings the whole chain to
    the target. No range join, and the next side includes the target's own day.
    """
    known = marked.withColumn("_k", is_known)
    w = Window.partitionBy(*by, "_k").orderBy("day")
    item = F.struct("day", *values)
    prev = F.array(*[F.lag(item, i).over(w) if i else item for i in range(k)])
    nxt = F.array(*[F.lead(item, i).over(w) if i else item for i in range(k)])
    d = (known.withColumns({"_pc": prev, "_nc": nxt})
         .withColumns({"_p": last_before(F.col("_k"), F.col("_pc"), by),
                       "_n": first_after(F.col("_k"), F.col("_nc"), by, inclusive=True)})
         .filter(is_target))
    return d.withColumns(chain_columns("_p", "_n", k, max_days, values, prefix)).drop("_k", "_pc", "_nc", "_p", "_n")


def chain_columns(before_: str, after_: str, k: int, max_days: int, values, prefix: str) -> dict[str, Column]:
    """``<prefix>_p1_days``, ``<prefix>_p1_<value>``, ... of the chains of neighbours before and after a row."""
    cols = {}
    for i in range(k):
        for side, arr in (("p", before_), ("n", after_)):
            x = F.get(F.col(arr), F.lit(i))
            dist = F.abs(x["day"] - F.col("day"))
            cols[f"{prefix}_{side}{i + 1}_days"] = F.when(dist <= max_days, dist)
            for v in values:
                cols[f"{prefix}_{side}{i + 1}_{v}"] = F.when(dist <= max_days, x[v])
    return cols


def k_neighbors_by_kind(marked: DataFrame, by, is_known: Column, kind: str, kinds: dict[str, int], k: int, max_days: int, values) -> DataFrame:
    """``k_neighbors`` of every row among the known rows of each kind (prefix: value of the column ``kind``): one window gives known rows the chain of
    their own kind, one each way brings the chains of all kinds to a row."""
    w = Window.partitionBy(*by, "_k", kind).orderBy("day")
    item = F.struct("day", *values)
    d = marked.withColumn("_k", is_known)
    d = d.withColumns({"_pc": F.array(*[F.lag(item, i).over(w) if i else item for i in range(k)]),
                       "_nc": F.array(*[F.lead(item, i).over(w) if i else item for i in range(k)])})
    of = {n: F.col("_k") & (F.col(kind) == v) for n, v in kinds.items()}
    d = d.withColumns({f"_p_{n}": last_before(on, F.col("_pc"), by) for n, on in of.items()} |
                      {f"_n_{n}": first_after(on, F.col("_nc"), by, inclusive=True) for n, on in of.items()})
    d = d.withColumns({c: x for n in kinds for c, x in chain_columns(f"_p_{n}", f"_n_{n}", k, max_days, values, n).items()})
    return d.drop("_k", "_pc", "_nc", *[f"_{s}_{n}" for n in kinds for s in "pn"])


def interpolate(vp: Column, vn: Column, dp: Column, dn: Column) -> Column:
    """Straight line in time between two neighbours; NULL unless both exist."""
    return vp + (vn - vp) * F.try_divide(dp, dp + dn)


def either(a: Column, b: Column) -> Column:
    """Mean of the values that are present."""
    return F.coalesce((a + b) / 2, a, b)


def count_in_window(is_known: Column, half: int, by) -> Column:
    return F.count(F.when(is_known, 1)).over(around(by, half))


def islands(df: DataFrame, keys, day: str = "day", gap: int = 0) -> DataFrame:
    """Numbers runs of flagged rows (the input holds only flagged ones); runs at most ``gap`` days apart merge."""
    w = Window.partitionBy(*keys).orderBy(day)
    start = F.when(F.col(day) - F.lag(day).over(w) <= gap + 1, 0).otherwise(1)
    return df.withColumn("_new", start).withColumn(
        "island", F.sum("_new").over(w.rowsBetween(UNBOUNDED, 0))).drop("_new")


def runs(df: DataFrame, keys, day: str = "day", gap: int = 0) -> DataFrame:
    return (islands(df, keys, day, gap).groupBy(*keys, "island")
            .agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("n")))


def point_episodes(df: DataFrame, flag: Column, keys=("pid", "year"), day: str = "day") -> DataFrame:
    """Numbers groups of consecutive flagged points; an unflagged point ends a group, whatever the distance."""
    w = Window.partitionBy(*keys).orderBy(day)
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    new = F.when(F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False)), 1).otherwise(0)
    return (d.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w.rowsBetween(UNBOUNDED, 0)))
            .filter("_f").drop("_f", "_new"))


def calendar_grid(df: DataFrame, keys, lo: str, hi: str) -> DataFrame:
    """All days from ``lo`` to ``hi`` (day numbers) for each row of ``df``."""
    return df.select(*keys, F.explode(F.sequence(lo, hi)).alias("day"))


def densify(df: DataFrame, keys, cols) -> DataFrame:
    """Complete daily grid per key between its first and last day; missing days hold NULL.

    Every row emits the empty days up to the next one, so no join with a calendar is needed.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    nxt = F.lead("day").over(w)
    d = df.select(*keys, "day", *cols, nxt.alias("_next"))
    d = d.withColumn("_d", F.explode(F.sequence(F.col("day"), F.coalesce(F.col("_next") - 1, F.col("day")))))
    real = F.col("_d") == F.col("day")
    return d.select(*keys, F.col("_d").alias("day"), *[F.when(real, F.col(c)).alias(c) for c in cols])


def interpolate_inside(grid: DataFrame, keys, cols, limit: int = 3) -> DataFrame:
    """Linear fill between known days of a daily grid: the first ``limit`` days of a gap, never past the ends."""
    out = {}
    for c in cols:
        item, have = F.struct("day", c), F.col(c).isNotNull()
        p, n = last_before(have, item, keys), first_after(have, item, keys)
        gone = F.col("day") - p["day"]
        out[c] = F.coalesce(F.col(c), F.when((gone <= limit) & n["day"].isNotNull(),
                                             p[c] + (n[c] - p[c]) * gone / (n["day"] - p["day"])))
    return grid.withColumns(out)


def rolling(c: str, how, lo: int, hi: int, least: int, keys, day: str = "day") -> Column:
    """Calendar-time window over days ``lo..hi`` around the row, NULL below ``least`` known values."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(lo, hi)
    return F.when(F.count(c).over(w) >= least, how(c).over(w))


def strict_sum(c: Column, days: int, keys, day: str = "day") -> Column:
    """Sum over the last ``days`` calendar days, NULL if any of them is missing."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-(days - 1), 0)
    return F.when(F.count(c).over(w) == days, F.sum(c).over(w))


def cumulative_strict(c: Column, start: Column, keys, day: str = "day") -> Column:
    """Running sum from day ``start`` that stays NULL from the first missing day on.

    A day without a row counts as missing too: the sum holds only while the known values fill every day since start.
    """
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(UNBOUNDED, 0)
    return F.when(F.count(c).over(w) == F.col(day) - start + 1, F.sum(c).over(w))


def longest_run(df: DataFrame, keys, flag: Column, day: str = "day") -> DataFrame:
    """Longest run of flagged consecutive days per key; of equal runs the earliest."""
    r = runs(df.filter(F.coalesce(flag, F.lit(False))), keys, day)
    best = F.max_by(F.struct("n", "start", "end"), F.struct("n", (-F.col("start")).alias("s")))
    return r.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.n", "b.start", "b.end")


def thin(df: DataFrame, keys, order, limit: int) -> DataFrame:
    """At most ``limit`` evenly spaced rows per key, always with the first and the last."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"_j": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    i = F.floor((F.col("_j") * limit + F.col("_n") - 1) / F.col("_n"))
    keep = ((F.col("_n") <= limit) | (F.col("_j") == F.col("_n") - 1)
            | ((i < limit - 1) & (F.floor(i * F.col("_n") / limit) == F.col("_j"))))
    return d.filter(keep).drop("_j", "_n")

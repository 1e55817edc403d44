"""Exact order statistics and quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. That is fine for calendar-bounded groups, but a
whole-table or per-category quantile must not do it. Here a mergeable sketch over all rows cuts the values into cells
of about equal numbers of rows, cells are counted by group, and only the distinct values of the few cells that hold a
wanted rank are ordered. A cell holds a fixed share of *all* rows at most, so the largest group is spread like any
other and no group's size selects another way. The answer is exact: a rank is read from counts, never from the sketch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.sources.io import cut_lineage

CELLS = 1024      # ranges of values, a power of two; the table of their ends is one row
SHARPNESS = 4     # the sketch's rank error is a cell's share over this
CUTS = 128        # ranges of a whole-table running count
GOALS = 50_000    # wanted cells of all groups that every task may know, 5 MB or so


def cell_of(cuts: Column, value: Column, cells: int) -> Column:
    """Number of the sorted ``cuts`` below ``value``, by bisection; ``cells`` is a power of two above their number."""
    steps = F.array(*[F.lit(cells >> i) for i in range(1, cells.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def cell_cuts(df: DataFrame, value: str) -> DataFrame:
    """One row: the CELLS - 1 values that cut all rows into cells of about equal size (NULL for an empty table)."""
    shares = F.expr(f"array({', '.join(f'{i / CELLS}D' for i in range(1, CELLS))})")  # one expression, not one call a share
    return df.agg(F.percentile_approx(value, shares, F.lit(CELLS * SHARPNESS)).alias("_cuts"))


def order_statistics(df: DataFrame, keys, value: str, wants: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at exact 1-based ranks per group; ``wants`` maps names to the rank as a function of the group's size n.

    NULL values are left out; a group of NULL keys is a group; a rank outside 1..n is NULL.
    """
    key = keys or ["_all"]
    base = (df if keys else df.withColumn("_all", F.lit(1))).filter(F.col(value).isNotNull())
    base = base.select(*key, F.col(value).alias("_v"))
    cuts = cut_lineage(cell_cuts(base, "_v"))  # read twice, and a sketch needn't come out the same twice
    base = (base.crossJoin(F.broadcast(cuts))  # one row
            .select(*key, "_v", cell_of(F.col("_cuts"), F.col("_v"), CELLS).alias("_cell"), F.lit(1).cast("long").alias("_c")))
    by_key = Window.partitionBy(*key)  # CELLS rows at most
    cells = base.groupBy(*key, "_cell").agg(F.sum("_c").alias("_c")).select(
        *key, "_cell", "_c", F.sum("_c").over(by_key).alias("n"), F.sum("_c").over(by_key.orderBy("_cell")).alias("_upto"))
    before = F.col("_upto") - F.col("_c")
    ranks = {f"_r{i}": rank(F.col("n")) for i, rank in enumerate(wants.values())}
    here = {c: F.when((r > before) & (r <= F.col("_upto")), r - before) for c, r in ranks.items()}
    goals = cells.select(*[F.col(k).alias(f"_g_{k}") for k in key], F.col("_cell").alias("_g_cell"), "n", (before == 0).alias("_first"),
                         *[r.alias(c) for c, r in here.items()])
    goals = goals.filter(reduce(Column.__or__, [F.col(c).isNotNull() for c in here], F.col("_first")))  # each group keeps a row
    few = not keys
    if keys:
        goals = cut_lineage(goals)
        few = goals.limit(GOALS + 1).count() <= GOALS
    if few:  # every task knows the wanted cells: rows of others go no further, where they are read
        goals = F.broadcast(goals)
    else:  # equal values meet before the join by cell, since one value may fill a cell
        base = base.groupBy(*key, "_cell", "_v").agg(F.sum("_c").alias("_c"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in key], F.col("_cell") == F.col("_g_cell"))
    held = base.join(goals, same).groupBy(*key, "_cell", "_v").agg(
        F.sum("_c").alias("_c"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in here])
    last = F.sum("_c").over(Window.partitionBy(*key, "_cell").orderBy("_v"))
    held = held.withColumn("_last", last)
    hit = lambda c: (F.col(c) > F.col("_last") - F.col("_c")) & (F.col(c) <= F.col("_last"))
    return held.groupBy(*keys, "n").agg(*[F.max(F.when(hit(c), F.col("_v"))).alias(name) for c, name in zip(here, wants)])


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group; ``probs`` maps output columns to probabilities."""
    wants, out = {}, []
    for name, p in probs.items():
        at = lambda n, p=p: (n - 1) * F.lit(float(p))
        wants[f"_{name}_lo"] = lambda n, at=at: F.floor(at(n)) + 1
        wants[f"_{name}_hi"] = lambda n, at=at: F.ceil(at(n)) + 1
        lo, hi, pos = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), at(F.col("n"))
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return order_statistics(df, keys, value, wants).select(*keys, "n", *out)


def exact_median(df: DataFrame, keys, value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic from counts per distinct value.

    Distinct values are cut into ranges by a sketch; the running counts are taken inside the ranges and shifted by the
    totals of the earlier ranges.
    """
    both = (a.select(F.col(value).alias("_v"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.select(F.col(value).alias("_v"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))
            .filter("_v IS NOT NULL").groupBy("_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")))
    probs = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = both.agg(F.percentile_approx("_v", probs, F.lit(CUTS * 16)).alias("_cuts")).withColumn("_all", F.lit(1))
    binned = (both.withColumn("_all", F.lit(1)).join(F.broadcast(cuts), "_all")  # one row
              .withColumn("_bin", F.size(F.filter("_cuts", lambda s: s < F.col("_v")))).drop("_all", "_cuts"))
    w = Window.orderBy("_bin")
    bins = (binned.groupBy("_bin").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
            .select("_bin", (F.sum("_na").over(w) - F.col("_na")).alias("_oa"),
                    (F.sum("_nb").over(w) - F.col("_nb")).alias("_ob"),
                    F.sum("_na").over(Window.partitionBy()).alias("_ta"),
                    F.sum("_nb").over(Window.partitionBy()).alias("_tb")))
    inside = Window.partitionBy("_bin").orderBy("_v")
    gap = F.abs((F.col("_oa") + F.sum("_a").over(inside)) / F.col("_ta")
                - (F.col("_ob") + F.sum("_b").over(inside)) / F.col("_tb"))
    return (binned.join(F.broadcast(bins), "_bin")
            .select(gap.alias("_gap"), "_ta", "_tb")
            .agg(F.max("_gap").alias("ks"), F.max("_ta").alias("n_a"), F.max("_tb").alias("n_b")))

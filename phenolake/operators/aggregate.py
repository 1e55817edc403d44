"""Descriptive aggregates of a panel."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.operators.quantiles import exact_quantiles


def share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def presence(df: DataFrame, keys, cols) -> DataFrame:
    """Share of rows in which each column is known."""
    return df.groupBy(*keys).agg(*[share(F.col(c).isNotNull()).alias(c) for c in cols], F.count("*").alias("n"))


def share_by(df: DataFrame, keys, cond: Column) -> DataFrame:
    """Share of rows that meet ``cond``, one row for each combination of keys in the data."""
    return df.groupBy(*keys).agg(F.avg(F.when(cond, 1.0).otherwise(0.0)).alias("share"))


def grid_regime(df: DataFrame, rows: int = C.SEASON_ROWS) -> DataFrame:
    """Entity-years with an incomplete daily grid. The row counts are small whole numbers, so ``median`` is cheap."""
    per = df.groupBy("pid", "year").agg(F.count("*").alias("n"))
    part = F.col("n") < rows
    return per.agg(F.count("*").alias("seasons"), F.count(F.when(part, 1)).alias("partial"),
                   F.count_distinct(F.when(part, F.col("pid"))).alias("entities_partial"),
                   F.median(F.when(part, F.col("n"))).alias("partial_rows_median"))


def shared_series(df: DataFrame, entity: str, at: str, value: Column) -> DataFrame:
    """Groups of entities whose whole series (one rounded value per ``at``) is identical."""
    point = F.concat_ws("=", F.col(at).cast("string"), F.coalesce(value.cast("string"), F.lit("-")))
    sig = df.groupBy(entity).agg(F.md5(F.concat_ws(",", F.array_sort(F.collect_list(point)))).alias("signature"))
    return (sig.groupBy("signature").agg(F.count("*").alias("n_entities"), F.min(entity).alias("first_entity"))
            .filter("n_entities > 1"))


def doy_profile(df: DataFrame, cols) -> DataFrame:
    """Share known by day of year, smoothed over 7 rows; the table has at most 366 rows."""
    by = presence(df, ["doy"], cols)
    w = Window.orderBy("doy").rowsBetween(-3, 3)
    return by.select("doy", *[F.when(F.count(c).over(w) == 7, F.avg(c).over(w)).alias(c) for c in cols])


def seasonal_curve(df: DataFrame, keys, value: str = "value") -> DataFrame:
    return exact_quantiles(df, keys, value, {"p25": 0.25, "median": 0.5, "p75": 0.75})


def peak_bin(curve: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Bin of the largest value per key; of equal values the smallest bin."""
    return curve.groupBy(key).agg(F.max_by(at, F.struct(value, -F.col(at))).alias("peak"), F.max(value).alias("top"))


def crosstab_share(df: DataFrame, row: str, col: str, values) -> DataFrame:
    counts = [F.count(F.when(F.col(col) == v, 1)).alias(v) for v in values]
    d = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row).agg(*counts, F.count("*").alias("_n"))
    return d.select(row, *[(F.col(v) / F.col("_n")).alias(v) for v in values])


def value_shares(df: DataFrame, col: str) -> DataFrame:
    n = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a value: the input is read once


def source_agreement(df: DataFrame, cols=C.SOURCES) -> DataFrame:
    """One pass: count, bias, RMSE and Pearson r of each pair of sources on the same row."""
    stats = []
    for a, b in combinations(cols, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        stats.append(F.struct(F.lit(f"{a}_{b}").alias("pair"), F.count(x).alias("n"), F.avg(y - x).alias("bias"),
                              F.sqrt(F.avg((y - x) * (y - x))).alias("rmse"), F.corr(x, y).alias("r")).alias(f"{a}{b}"))
    one = df.agg(*stats)
    return one.select(F.explode(F.array(*[F.col(c) for c in one.columns])).alias("p")).select("p.*")


def source_offsets(df: DataFrame, cols=C.SOURCES) -> DataFrame:
    """Mean difference of each source from the first on shared rows."""
    return df.agg(*[F.coalesce(F.avg(F.col(c) - F.col(cols[0])), F.lit(None)).alias(c) for c in cols])


def shrunk_offsets(df: DataFrame, k: int = C.OFFSET_SHRINK, offsets=C.SOURCE_OFFSET, cols=C.SOURCES) -> DataFrame:
    """Offsets per entity, pulled to the global ones when an entity has few shared days."""
    aggs = []
    for c in cols[1:]:
        aggs += [F.count(F.col(c) - F.col(cols[0])).alias(f"n_{c}"), F.avg(F.col(c) - F.col(cols[0])).alias(f"m_{c}")]
    d = df.groupBy("pid").agg(*aggs)
    out = [shrink(F.col(f"n_{c}"), F.col(f"m_{c}"), k, offsets[i + 1]).alias(f"off_{c}") for i, c in enumerate(cols[1:])]
    return d.select("pid", *[f"n_{c}" for c in cols[1:]], *out)


def shrink(n: Column, local: Column, k: int, overall: float) -> Column:
    return (n * F.coalesce(local, F.lit(overall)) + F.lit(k * overall)) / (n + k)


def entity_bias(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Mean and count of each value per entity and per entity-year, in one row per entity-year."""
    aggs = []
    for name, c in values.items():
        aggs += [F.count(c).alias(f"{name}_y_n"), F.sum(c).alias(f"_{name}_s")]
    y = df.groupBy("pid", "year").agg(*aggs)
    w = Window.partitionBy("pid")
    cols = {}
    for name in values:
        n, s = F.sum(f"{name}_y_n").over(w), F.sum(f"_{name}_s").over(w)
        cols[f"{name}_n"] = n
        cols[name] = F.try_divide(s, n)
        cols[f"{name}_y"] = F.try_divide(F.col(f"_{name}_s"), F.col(f"{name}_y_n"))
    return y.withColumns(cols).drop(*[f"_{n}_s" for n in values])


def outlier_context(df: DataFrame, value: Column, n: int = 4, half: int = 30) -> DataFrame:
    """Rows within ``half`` days of the ``n`` lowest values of the whole table (ties by entity and day)."""
    worst = (df.withColumn("_v", value).orderBy("_v", "pid", "day").limit(n)
             .select("pid", F.col("day").alias("worst_day"), F.col("_v").alias("worst_value")))
    near = df.join(F.broadcast(worst), "pid")  # n rows
    return near.filter(F.abs(F.col("day") - F.col("worst_day")) <= half)


def entity_kind(df: DataFrame, trained: Column) -> DataFrame:
    d = df.groupBy("pid").agg(F.bool_or(trained).alias("_t"), F.count_distinct("year").alias("n_years"))
    return d.select("pid", "n_years", F.when(F.col("_t"), "old").when(F.col("n_years") <= 1, "new_single")
                    .otherwise("new_hist").alias("kind"))


def weekly_drivers(df: DataFrame, keys, day_keys, amount: str, level: str, weeks: int = 31) -> DataFrame:
    """Weekly sum of the amount (negatives as 0) and mean of the level; empty weeks stay as rows."""
    week = F.least(F.greatest(F.floor((F.col("doy") - C.SEASON_DOY[0]) / 7).cast("int"), F.lit(0)), F.lit(weeks - 1))
    d = df.withColumn("week", week).groupBy(*keys, *day_keys, "week").agg(
        F.sum(F.greatest(F.col(amount), F.lit(0.0))).alias("amount"), F.avg(level).alias("level"))
    # the skeleton carries no values, so one aggregate fills it instead of an outer join
    grid = (d.select(*keys, *day_keys).distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
            .withColumns({"amount": F.lit(None).cast("double"), "level": F.lit(None).cast("double")}))
    return d.unionByName(grid).groupBy(*keys, *day_keys, "week").agg(
        F.max("amount").alias("amount"), F.max("level").alias("level"))


def duplicates(df: DataFrame, cols) -> DataFrame:
    """Rows beyond the first of each combination of ``cols``."""
    return (df.filter(" AND ".join(f"{c} IS NOT NULL" for c in cols)).groupBy(*cols).agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")))


def per_source(df: DataFrame, cols=C.SOURCES, keep=("pid", "day")) -> DataFrame:
    """One row per known value of each source column: source number, value."""
    values = F.array(*[F.struct(F.lit(i).alias("source"), F.col(c).alias("value")) for i, c in enumerate(cols)])
    return df.select(*keep, F.explode(values).alias("_v")).select(*keep, "_v.*").filter("value IS NOT NULL")


def duplicates_by_source(df: DataFrame, cols=C.SOURCES) -> DataFrame:
    """Per source column: values, distinct (day, value) pairs and values beyond the first of each; a source without values has no row."""
    seen = per_source(df, cols, ("day",)).groupBy("source", "day", "value").agg(F.count("*").alias("n"))
    return seen.groupBy("source").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def target_quantiles(df: DataFrame, probs: dict[str, float], source: str = "source", value: str = "value") -> DataFrame:
    """Exact quantiles of the value by source, and over all sources in the row whose source is NULL."""
    twice = df.select(value, F.explode(F.array(F.col(source), F.lit(None))).alias(source))
    return exact_quantiles(twice, [source], value, probs)

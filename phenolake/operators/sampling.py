"""Exact, repeatable selection by hash rank without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_HEX = 3  # 4096 bins: the table of bin sizes has a fixed bound and can be broadcast


def hash_key(seed, cols) -> Column:
    """md5 of seed and columns; a seed of None leaves it to the first column."""
    return F.md5(F.concat_ws("|", *([] if seed is None else [F.lit(str(seed))]), *[F.col(c) for c in cols]))


def bin_offsets(bins: DataFrame) -> DataFrame:
    """Rows before each bin and the total; ``bins`` has at most 16**BIN_HEX rows (_b, _n)."""
    w = Window.orderBy("_b")
    return bins.select("_b", (F.sum("_n").over(w) - F.col("_n")).alias("_before"),
                       F.sum("_n").over(Window.partitionBy()).alias("_total"))


def hash_rank(df: DataFrame, cols, seed, by: list[str] | None = None) -> DataFrame:
    """Adds ``_rank`` (1-based position in md5 order) and ``_total``.

    The hash prefix is uniform, so each (group, prefix) window is a small share of the rows whatever the keys are.
    """
    by = by or []
    d = df.withColumn("_h", hash_key(seed, cols)).withColumn("_b", F.substring("_h", 1, BIN_HEX)).withColumn("_h", F.unhex("_h"))  # bytes: half as long, same order
    bins = d.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    if by:
        w = Window.partitionBy(*by)
        off = bins.select(*by, "_b", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_before"),
                          F.sum("_n").over(w).alias("_total"))
        d = d.join(off, [*by, "_b"])
    else:
        d = d.join(F.broadcast(bin_offsets(bins)), "_b")
    rn = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h"))
    return d.withColumn("_rank", F.col("_before") + rn).drop("_h", "_b", "_before")


def exact_share(df: DataFrame, cols, share: float, seed, flag: str, by: list[str] | None = None) -> DataFrame:
    """Flags the first ``round(n * share)`` rows in hash order, of each group of ``by``."""
    d = hash_rank(df, cols, seed, by)
    return d.withColumn(flag, F.col("_rank") <= F.round(F.col("_total") * share)).drop("_rank", "_total")


def weighted_sample(df: DataFrame, cols, weight: Column, n: int, seed) -> DataFrame:
    """n rows without replacement, probability proportional to weight: smallest exponential keys win."""
    u = (F.conv(F.substring(hash_key(seed, cols), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16 ** 12 + 1))
    return df.withColumn("sample_key", -F.log(u) / weight).orderBy("sample_key", *cols).limit(n)

"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket, a source's budget falls into one bucket of its histogram, and only that bucket is summed
again by the next digits of the hash. What is left is one threshold for each source, so rows are chosen by a comparison, unsorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage

DIGITS, LEVELS = 3, 4  #: hex digits a level (4096 buckets) and levels: 48 bits, so a bucket of the last holds one row, or equal rows
MOST = 3  #: times that a mix may use a source


def source_key(source: Column) -> Column:
    """A key that tells a null source from every name and sorts it last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def hash_key(id_col: Column, text: Column) -> Column:
    """First 48 bits of a digest of id and text: reruns agree, and copies under other ids differ."""
    key = F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(key.cast("binary")), 1, DIGITS * LEVELS)


def targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source_size) -> also ``target``: shares of all words by weight 1, 2, 3, repeating in code point order (null last);
    a source stops at MOST times its size, and what is left is shared again by weight.

    With sources in the order of size per weight those that stop are the first ones, so sums over that order replace rounds. This is one
    row for each source, so it may run in one task."""
    by_name = Window.orderBy(F.col("source_key").cast("binary"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "source_key")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = sizes.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1)
    d = d.withColumns({"before": F.coalesce(F.sum("source_size").over(upto), F.lit(0)), "weights": F.sum("w").over(rest),
                       "total": F.sum("source_size").over(Window.partitionBy())})
    # a source stops if the level that it and all later ones would share lies above its own stop
    d = d.withColumn("stops", (F.col("total") - MOST * F.col("before")) * F.col("w") > MOST * F.col("source_size") * F.col("weights"))
    left = F.min(F.when(~F.col("stops"), F.struct(F.col("before").alias("b"), F.col("weights").alias("w")))).over(Window.partitionBy())
    share = (F.col("total") - MOST * left["b"]) * F.col("w") / left["w"]
    return d.select("source_key", "source_size", F.when(F.col("stops"), (MOST * F.col("source_size")).cast("double"))
                    .otherwise(F.coalesce(share, F.lit(0.0))).cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, size, source_size, target, times): every row of ``docs`` as a struct, and how often the mix takes it.

    All rows are taken ``floor(target / source_size)`` times, and those below the source's threshold once more, where the row on the
    border is taken if that comes nearer. Null or blank texts have size 0 and are taken as often as their hash says (no words); a null
    source is a source; rows that agree in id and text stand or fall together. No rows give no rows."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", source_key(F.col(f"row.`{source_col}`")).alias("source_key"),
        n_words(F.col(f"row.`{text_col}`")).alias("size"), hash_key(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")).alias("key"))
    slim = cut_lineage(keyed.select("source_key", "key", F.col("size").alias("words")))  # no shuffle: the histograms add up in each task first
    goal = cut_lineage(targets(slim.groupBy("source_key").agg(F.sum("words").alias("source_size"))))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.col("target") - times * F.col("source_size")
    state = goal.select("source_key", F.lit("").alias("prefix"), budget.alias("budget"))
    for level in range(LEVELS):
        state = cut_lineage(_refine(slim, state, level))
    final = goal.join(state, "source_key").select("source_key", "source_size", "target", times.alias("base"), (budget > 0).alias("more"), "prefix")
    # one row for each source: left to the optimizer, which knows the written size
    out = keyed.join(final, "source_key").withColumn("times", F.col("base") + (F.col("more") & (F.col("key") <= F.col("prefix"))).cast("long"))
    return out.select("row", "size", "source_size", "target", "times")


def _refine(slim: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Adds a level's digits to each source's threshold; ``budget`` becomes what is left for the bucket on the border."""
    end = DIGITS * (level + 1)
    hist = (slim.join(state, "source_key").filter(F.substring("key", 1, DIGITS * level) == F.col("prefix"))
            .groupBy("source_key", "budget", F.substring("key", 1, end).alias("bucket")).agg(F.sum("words").alias("words")))
    run = Window.partitionBy("source_key").orderBy("bucket")  # at most 16 ** DIGITS rows a source
    hist = hist.withColumn("upto", F.sum("words").over(run))
    left = F.col("budget") - (F.col("upto") - F.col("words"))
    if level + 1 < LEVELS:
        # the first bucket that the budget doesn't fill; the last one if it fills all
        return hist.groupBy("source_key").agg(F.coalesce(
            F.min(F.when(F.col("upto") > F.col("budget"), F.struct(F.col("bucket").alias("prefix"), left.alias("budget")))),
            F.max(F.struct(F.col("bucket").alias("prefix"), left.alias("budget")))).alias("s")).select("source_key", "s.*")
    # if the border bucket stays out, its own start: no whole key is as small, and those of the buckets before are smaller
    taken = F.max(F.when(2 * left >= F.col("words"), F.col("bucket")))
    return hist.groupBy("source_key").agg(F.coalesce(taken, F.substring(F.min("bucket"), 1, DIGITS * level)).alias("prefix"), F.lit(0.0).alias("budget"))


def mixed_rows(docs: DataFrame, **names) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mix(docs, **names).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_again")).select("row.*")

"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.sources.io import cut_lineage

__all__ = ["cut_lineage", "let", "parts_of", "pieces", "table", "components", "give_back", "small_enough"]

PIECE_BYTES = 3 << 20  #: text bytes that Python code holds at once; one longer text is a piece of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Returns freed memory to the system: an executor keeps its Python workers between stages, and counts what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` text bytes, or one row: memory doesn't depend on the batch size of the session."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        if not len(column):
            continue
        off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        del batch, column, off
        give_back()


def parts_of(spark: SparkSession, times: int = 2) -> int:
    """Number of key ranges that packed rows are dealt to; follows the session's shuffle partitions."""
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def components(edges: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, comp): the smallest node that links lead to. Smallest label of the neighbours, then the label's own label, until
    nothing changes; each round is a join and a partial aggregate over written tables, whatever a node's degree."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
    while True:
        near = (both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("m")))
        step = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        step = cut_lineage(step)
        own = step.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        jumped = cut_lineage(step.join(own, "comp", "left").select(
            "node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), (F.least("comp", F.coalesce("up", "comp")) != F.col("old")).alias("moved")))
        labels = jumped.select("node", "comp")
        if jumped.filter("moved").isEmpty():
            return labels

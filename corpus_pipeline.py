"""A pipeline over documents: toxic texts go, one text of each group of near copies stays, contaminated texts go, sources are mixed to their
target weights, and what is left is dealt to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage, table
from phenolake.llm.contamination import drop_contaminated
from phenolake.llm.jaccard import one_of_each
from phenolake.llm.mixing import mixed_rows
from phenolake.llm.sharding import shard
from phenolake.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score doesn't reach the threshold. The model learns from the labelled ones among its input."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; documents without words stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs).select("row.*", F.col("shard"), F.col("slot"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The first stage learns from labels, which SQL can't express; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs

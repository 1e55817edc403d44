"""Query of document fingerprints."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.llm.common import table
from phenolake.llm.fingerprints import fingerprint

NAME = "op12_fingerprints"
SQL = None  # shingle hashes modulo 2^64; tests hold the query against a plain version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return fingerprint(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")

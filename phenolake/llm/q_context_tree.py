"""Query of language-model scoring. No SQL form; tests hold word counts and tree against brute force."""

from pyspark.sql import DataFrame, SparkSession

from phenolake.llm.common import table
from phenolake.llm.context_tree import score

NAME, SQL = "op5_context_tree", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

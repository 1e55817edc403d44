"""Query of language identification. No SQL form: the parse is tested against brute force, and predictions on held-out labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.llm.common import table
from phenolake.llm.language import fit, identify
from phenolake.llm.toxicity import held_out

NAME, SQL = "op9_language_id", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "language.lang_pred", "language.score")

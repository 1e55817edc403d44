"""Query of toxicity. No SQL form: the scan is tested against brute force and the scores on held-out labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.llm.common import table
from phenolake.llm.toxicity import THRESHOLD, fit, held_out, score

NAME, SQL = "op7_toxicity", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "row.doc_id", held_out(F.col("row.doc_id"), 3, 1).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"), F.size("toxicity.passages").cast("long").alias("n_passages"))

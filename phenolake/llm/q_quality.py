"""Query of the quality rules. The estimation is iterative, so there is no SQL; tests hold the counts against plain Python."""

from pyspark.sql import DataFrame, SparkSession

from phenolake.llm.common import table
from phenolake.llm.quality import judge

NAME, SQL = "op6_quality_rules", None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))

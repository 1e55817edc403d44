"""Query of repeated passages."""

from pyspark.sql import DataFrame, SparkSession

from phenolake.llm.common import table
from phenolake.llm.repeats import repeated_passages
from phenolake.llm.sql import lower, spaced

NAME = "op8_repeated_passages"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


SQL = f"""WITH d AS (SELECT doc_id, {spaced(lower('text'))} AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY 1 HAVING count(*) > 1)),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM r),
t AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s)
SELECT doc_id, min(i)::BIGINT AS first_word, (max(i) + 50 - min(i))::BIGINT AS n_words FROM t WHERE doc_id IS NOT NULL GROUP BY doc_id, run"""

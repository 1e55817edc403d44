"""Query of mixing sources to target weights."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.llm.common import table
from phenolake.llm.mixing import mix
from phenolake.llm.sql import spaced

NAME = "op2_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def ctes(documents: str) -> str:
    """Table expressions ending in ``mixed`` (the columns of ``documents`` and size, source_size, target, times)."""
    return f"""m0 AS (SELECT *, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk, len({spaced("coalesce(text, '')")})::BIGINT AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12) AS k FROM {documents}),
m1 AS (SELECT sk, sum(size)::BIGINT AS source_size FROM m0 GROUP BY 1),
m2 AS (SELECT *, (row_number() OVER (ORDER BY encode(sk)) - 1) % 3 + 1 AS w FROM m1),
m3 AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
    sum(w) OVER (ORDER BY source_size / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS ws, sum(source_size) OVER ()::BIGINT AS total FROM m2),
m4 AS (SELECT *, (total - 3 * b) * w > 3 * source_size * ws AS stops FROM m3),
m5 AS (SELECT sk, source_size, CASE WHEN stops THEN 3.0 * source_size
    ELSE (total - 3 * min(b) FILTER (WHERE NOT stops) OVER ()) * w / (max(ws) FILTER (WHERE NOT stops) OVER ()) END::DOUBLE AS target FROM m4),
m6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM m5),
m7 AS (SELECT m0.*, source_size, target, base, target - base * source_size AS budget,
    sum(size) OVER (PARTITION BY sk ORDER BY k) - sum(size) OVER (PARTITION BY sk, k) AS lower_words, sum(size) OVER (PARTITION BY sk, k) AS tie
    FROM m0 JOIN m6 USING (sk)),
mixed AS (SELECT * EXCLUDE (sk, k, base, budget, lower_words, tie),
    base + CASE WHEN budget > 0 AND 2 * (budget - lower_words) >= tie THEN 1 ELSE 0 END AS times FROM m7)"""


SQL = f"""WITH {ctes('documents')} SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken FROM mixed"""

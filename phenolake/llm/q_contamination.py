"""Query of benchmark decontamination."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.llm.common import table
from phenolake.llm.contamination import contaminated, mark
from phenolake.llm.sql import alnum, lower

NAME = "op1_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, table(spark, sf_dir, "benchmark")).select(
        "row.doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = f"""WITH d AS (SELECT doc_id, {alnum(lower('text'))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {alnum(lower('text'))} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item FROM grams JOIN win USING (k, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)"""

"""Query of the license scan."""

from pyspark.sql import DataFrame, SparkSession

from phenolake.llm.common import table
from phenolake.llm.licenses import PHRASES, TEMPLATES, needed, plain, scan
from phenolake.llm.sql import alnum, lower

NAME = "op3_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PHRASES = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"({_list(t)}, '{label}', {len(t)}, {needed(len(t))})" for label, t in ((label, plain(text)) for label, text in TEMPLATES))
SQL = f"""WITH d AS (SELECT doc_id, {alnum(lower('text'))} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p(p, label) AS (VALUES {_PHRASES}),
hits AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, p WHERE len(w) >= len(p))
         WHERE list_slice(w, i, i + len(p) - 1) = p),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY 1),
t(t, label, m, need) AS (VALUES {_TEMPLATES}),
blocks AS (SELECT doc_id, list_distinct({alnum(lower('line'))}) AS b FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
finds AS (SELECT doc_id, label, len(list_intersect(t, b)) / m AS share FROM blocks, t WHERE len(list_intersect(t, b)) >= need),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
  SELECT doc_id, label FROM finds UNION ALL SELECT doc_id, label FROM hits) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS share FROM finds GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""

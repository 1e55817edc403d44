"""Query of the Merkle manifest: all documents, a tree for each language, with some rows tampered with."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.llm.common import table
from phenolake.llm.merkle import FIELDS, leaf_digest, manifest

NAME = "op11_merkle"
TAMPERED = 7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    more = leaf_digest(list((fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}).values()))
    leaves = d.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), leaf_digest(list(fields.values())).alias("leaf"),
                      F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, more).alias("changed"))
    return manifest(leaves).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
                                   F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _field(column: str, n_chars: str = "n_chars") -> str:
    text = f"CAST({n_chars if column == 'n_chars' else column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h : ('0x' || h)::BIGINT)),
  lambda c, x : list_reduce(list_prepend(xor(c, x), range(8)), lambda b, i : xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)"""
#: levels by recursion: each keeps every node, and a proof walks up through them
SQL = f"""WITH RECURSIVE rows0 AS (SELECT doc_id, lang, sha256({' || '.join(_field(c) for c in FIELDS)}) AS leaf,
  CASE WHEN {_CRC} % {TAMPERED} = 0 THEN sha256({' || '.join(_field(c, '(n_chars::HUGEINT + 1)') for c in FIELDS)}) END AS changed FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows0),
low AS (SELECT lang, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM ranked UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(h || coalesce(sib, '')), (n + 1) // 2 FROM (
    SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY pos) AS sib FROM low WHERE n > 1) WHERE pos % 2 = 0),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, h, n FROM subroots UNION ALL
  SELECT lvl + 1, pos // 2, sha256(h || coalesce(sib, '')), (n + 1) // 2 FROM (
    SELECT *, lead(h) OVER (ORDER BY pos) AS sib FROM top WHERE n > 1) WHERE pos % 2 = 0),
nodes AS (SELECT lang, lvl, pos, h, n FROM low WHERE n > 1
  UNION ALL SELECT s.lang, 1000 + t.lvl, t.pos, t.h, t.n FROM subroots s, top t WHERE t.n > 1),
heights AS (SELECT lang, max(lvl) AS height FROM low GROUP BY 1),
steps AS (SELECT r.doc_id, r.lang, r.pos AS leaf_pos, m.lvl, m.n, (m.at % 2 = 0) AS is_left, s.h AS sib
  FROM ranked r JOIN subroots u ON u.lang IS NOT DISTINCT FROM r.lang
  JOIN LATERAL (SELECT lvl, n, CASE WHEN lvl < 1000 THEN r.pos >> lvl ELSE u.pos >> (lvl - 1000) END AS at
    FROM nodes WHERE lang IS NOT DISTINCT FROM r.lang GROUP BY lvl, n) m ON true
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM r.lang AND s.lvl = m.lvl AND s.pos = xor(m.at, 1)),
ways AS (SELECT lang, leaf_pos, list(CASE WHEN sib IS NULL THEN '.' WHEN is_left THEN '>' || sib ELSE '<' || sib END ORDER BY lvl) AS path,
  sha256(coalesce(string_agg(sib, '' ORDER BY lvl), '')) AS proof_sha256 FROM steps GROUP BY 1, 2),
done AS (SELECT r.*, coalesce(path, []) AS path, coalesce(proof_sha256, sha256('')) AS proof_sha256 FROM ranked r
  LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM r.lang AND leaf_pos = pos)
SELECT doc_id, leaf, u.h AS subroot, t.h AS root, proof_sha256, list_reduce(list_prepend(coalesce(changed, leaf), path), lambda a, s :
  CASE WHEN s[1] = '<' THEN sha256(s[2:] || a) WHEN s = '.' THEN sha256(a) ELSE sha256(a || s[2:]) END) AS folded_root, folded_root = root AS verified
FROM done JOIN subroots u ON u.lang IS NOT DISTINCT FROM done.lang CROSS JOIN (SELECT h FROM top WHERE n = 1) t"""

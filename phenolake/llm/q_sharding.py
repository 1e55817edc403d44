"""Query of sharding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.llm.common import table
from phenolake.llm.sharding import SHARDS, shard

NAME = "op4_sharding"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("row.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def ctes(documents: str, shards: int = SHARDS) -> str:
    """Table expressions ending in ``placed`` (the columns of ``documents`` and shard, slot, grown_shard)."""
    return f"""j0 AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS key FROM {documents}),
jumps AS (SELECT doc_id, key::UHUGEINT AS key, 0::BIGINT AS place FROM j0 UNION ALL
  SELECT doc_id, k, floor((place + 1)::DOUBLE * 2147483648.0 / ((k // 8589934592) + 1)::DOUBLE)::BIGINT FROM (
    SELECT doc_id, place, (key * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS k FROM jumps WHERE place <= {shards})),
j1 AS (SELECT doc_id, max(place) FILTER (WHERE place < {shards})::INTEGER AS shard, max(place) FILTER (WHERE place <= {shards})::INTEGER AS grown_shard FROM jumps GROUP BY 1),
placed AS (SELECT d.*, shard, grown_shard, row_number() OVER (PARTITION BY shard ORDER BY
  md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || coalesce(text, ''))) - 1 AS slot
  FROM {documents} d JOIN j1 ON d.doc_id IS NOT DISTINCT FROM j1.doc_id)"""


_BIT = "list_reduce(list_prepend({0}, range(8)), lambda b, i : xor(b >> 1, 3988292384 * (b & 1)))"
_CRC = f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h : ('0x' || h)::BIGINT)),
  lambda c, x : {_BIT.format('xor(c, x)')}), 4294967295)"""
#: the bitwise definition of the checksum, over the bytes of each distinct text
SQL = f"""WITH RECURSIVE texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents), crc AS (SELECT t, {_CRC}::BIGINT AS c FROM texts), {ctes('documents')}
SELECT doc_id, (octet_length(encode(t)) + 16)::BIGINT AS size, c AS text_crc32, 'key' AS law, shard, slot, grown_shard
FROM placed JOIN crc ON t = coalesce(text, '')"""

"""Sharding by jump consistent hashing: a row's key alone decides its path of shards, and one more shard takes rows only into itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage

SHARDS = 40
_WRAP = 1 << 64
_STEP = 2862933555777941757  #: fixed value of the published method: the multiplier of its 64-bit generator
_SPREAD = 3  #: hex digits of a row digest: slots of a shard are counted in 4096 groups


def hash_key(id_col: Column) -> Column:
    """64 bits of the id's digest, as an unsigned decimal; a null id has the key of an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard among ``shards``, and among one more. The jumps don't depend on the number of shards: a row sits
    at the last jump below it. Generator steps wrap at 64 bits, in exact decimals (a product has at most 38 digits)."""
    start = F.struct(key.alias("key"), F.lit(0).cast("long").alias("next"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"))

    def step(s, _):
        k = ((s["key"] * F.lit(str(_STEP)).cast("decimal(19,0)") + 1) % F.lit(str(_WRAP)).cast("decimal(20,0)")).cast("decimal(20,0)")
        upper = F.floor(k / F.lit(str(1 << 33)).cast("decimal(10,0)")).cast("long")
        moved = F.struct(k.alias("key"), F.floor((s["next"] + 1).cast("double") * F.lit(float(1 << 31)) / (upper + 1).cast("double")).cast("long").alias("next"),
                         F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"), s["next"].alias("grown"))
        return F.when(s["next"] <= shards, moved).otherwise(s)

    # every step moves on by one shard at least
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step,
                       lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(row, size, text_crc32, shard, grown_shard, slot): every row of ``docs`` as a struct, with its place.

    Slots are gapless from 0: rows are numbered within small groups of a shard, and a group begins where the counts of the groups before
    it end, so no task holds a shard. Groups go by id and text, so one id with many texts is spread; rows equal in both are
    numbered together. Null texts have no bytes, null ids share a key; no rows give no rows."""
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ident = F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit(""))
    d = d.select("row", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                 jump(hash_key(F.col(f"row.`{id_col}`")), shards).alias("at"),
                 F.md5(F.concat_ws("|", ident, text).cast("binary")).alias("digest"))
    d = d.select("row", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"), "digest",
                 F.substring("digest", 1, _SPREAD).alias("grp"))
    counts = cut_lineage(d.groupBy("shard", "grp").agg(F.count("*").alias("n")))  # at most shards * 16 ** _SPREAD rows
    starts = counts.select("shard", "grp", (F.sum("n").over(Window.partitionBy("shard").orderBy("grp")) - F.col("n")).alias("start"))
    numbered = d.withColumn("at", F.row_number().over(Window.partitionBy("shard", "grp").orderBy("digest", F.col(f"row.`{id_col}`"))))
    return numbered.join(F.broadcast(starts), ["shard", "grp"]).select(
        "row", "size", "text_crc32", "shard", "grown_shard", (F.col("start") + F.col("at") - 1).alias("slot"))

"""The feature matrix of hidden rows: blocks that are worked out by themselves, brought together by one shuffle of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.operators import frames
from phenolake.operators.sampling import exact_share

KEY = ("pid", "day")


def masked(known: DataFrame, seeds, share: float = C.GAP_SHARE) -> DataFrame:
    """Known rows once for every seed, each copy with its own hidden share. A copy of an entity is an entity of its own (``pid``; ``entity`` is the
    real one), and ``mask`` keeps copies apart where entities meet, so one plan serves all masks."""
    d = known.drop("is_gap").select("*", F.posexplode(F.array(*[F.lit(str(s)) for s in seeds])).alias("mask", "seed"))
    d = exact_share(d, ["seed", "pid", "date"], share, None, "is_gap", ["seed"])
    return d.withColumns({"entity": F.col("pid"), "pid": F.col("pid").cast("long") * len(seeds) + F.col("mask")})


def raw_neighbors(marked: DataFrame, k: int = 2, max_days: int = C.MAX_NEIGHBOR_DAYS, sources=C.SOURCES, parts: int | None = None) -> DataFrame:
    """The ``k`` nearest values each side of every raw source column, chosen as the day's source or not, and the line between the nearest two.

    One stream of (source column, value) rows: a single as-of pass serves all columns. It stays partitioned by entity, so bringing the columns of
    a hidden row together needs no further shuffle. ``parts`` is the number of its tasks (none: the session's)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("src"), F.when(~F.col("is_gap"), F.col(c)).alias("v")) for c in sources]))
    d = marked.select("pid", "day", "is_gap", each.alias("x")).select("pid", "day", "is_gap", "x.*").filter(F.col("is_gap") | F.col("v").isNotNull())
    d = frames.k_neighbors(d.repartition(parts, "pid") if parts else d.repartition("pid"), ["pid", "src"], F.col("is_gap"), F.col("v").isNotNull(), k, max_days, ["v"], "n")
    vp, vn = F.col("n_p1_v"), F.col("n_n1_v")
    d = d.withColumn("interp", F.coalesce(frames.interpolate(vp, vn, F.col("n_p1_days"), F.col("n_n1_days")), vp, vn))
    names = {f"n_{s}{i + 1}_{c}": f"{s}{i + 1}_{out}" for s in "pn" for i in range(k) for c, out in (("days", "days"), ("v", "value"))} | {"interp": "interp"}
    return d.groupBy(*KEY).agg(*[F.max(F.when(F.col("src") == c, F.col(a))).alias(f"raw_{c}_{b}") for c in sources for a, b in names.items()])


def merged(blocks: list[DataFrame], keys=KEY) -> DataFrame:
    """One row a key with the columns of all blocks. Every block sends its row as one struct, all go through a single exchange by entity, and
    one aggregate puts them side by side: no chain of joins, and what follows may window by entity without another shuffle. A key that a block
    doesn't have gets NULLs."""
    stream = None
    for i, b in enumerate(blocks):
        d = b.select(*keys, F.struct(*[c for c in b.columns if c not in keys]).alias(f"_b{i}"))
        stream = d if stream is None else stream.unionByName(d, allowMissingColumns=True)
    d = stream.repartition(keys[0]).groupBy(*keys).agg(*[F.first(f"_b{i}", ignorenulls=True).alias(f"_b{i}") for i in range(len(blocks))])
    return d.select(*keys, *[F.col(f"_b{i}.{c}").alias(c) for i, b in enumerate(blocks) for c in b.columns if c not in keys])


def biases(values: dict[str, Column]) -> dict[str, Column]:
    """Mean and count of each value over the entity and over its year, as windows of a frame that is partitioned by entity."""
    out = {}
    for name, v in values.items():
        for suffix, w in (("", Window.partitionBy("pid")), ("_y", Window.partitionBy("pid", "year"))):
            out |= {f"{name}{suffix}": F.avg(v).over(w), f"{name}{suffix}_n": F.count(v).over(w)}
    return out

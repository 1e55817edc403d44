"""Merkle manifest of a table as a persistent tree that is dealt out in aligned blocks.

Rows are leaves of one tree for each value of a column, and the roots of these trees are leaves of a top tree. A block holds an aligned run of
2^HEIGHT nodes of one level, its tree lies in one task, and the roots of the blocks are the nodes of the next level, so a tree of any size is a few
levels of blocks. A changed leaf makes a version: only its ancestors are copied, all other nodes are shared with the version before. Inside
a block the copies are made by path copying, above it the version goes on with the siblings that the upper blocks hand down."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage, parts_of

HEIGHT = 8  #: levels of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_LEFT, _RIGHT, _ALONE = "<", ">", "."  #: a step of a path: the sibling stands left, right, or there is none


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: each value as its byte count, a colon and the value; a null as a dash."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


class PersistentTree:
    """A block's nodes, append-only: a version is the number of its root, and shares every node that it didn't copy."""

    def __init__(self, leaves: list[str], height: int):
        self.height, self.digests, self.kids = height, list(leaves), [()] * len(leaves)
        level = list(range(len(leaves)))
        for _ in range(height):
            level = [self._node(*level[i:i + 2]) for i in range(0, len(level), 2)]
        self.root = level[0]

    def _node(self, *kids: int) -> int:
        self.digests.append(digest(*[self.digests[k] for k in kids]))
        self.kids.append(kids)
        return len(self.kids) - 1

    def _way(self, at: int, root: int) -> list[tuple[int, int]]:
        """(node, side taken) from the root down to leaf ``at``."""
        out, node = [], root
        for level in reversed(range(self.height)):
            side = at >> level & 1
            out.append((node, side))
            node = self.kids[node][side]
        return out

    def changed(self, at: int, leaf: str, root: int | None = None) -> tuple[int, list[str]]:
        """(root of the version where leaf ``at`` is another, digests of the copied nodes, upwards)."""
        self.digests.append(leaf)
        self.kids.append(())
        node, copies = len(self.kids) - 1, [leaf]
        for parent, side in reversed(self._way(at, self.root if root is None else root)):
            kids = list(self.kids[parent])
            kids[side] = node
            node = self._node(*kids)
            copies.append(self.digests[node])
        return node, copies

    def path(self, at: int, root: int | None = None) -> list[str]:
        """Steps from leaf ``at`` upwards."""
        out = []
        for node, side in reversed(self._way(at, self.root if root is None else root)):
            kids = self.kids[node]
            out.append(_ALONE if len(kids) == 1 else (_LEFT if side else _RIGHT) + self.digests[kids[1 - side]])
        return out


def climb(leaf: str, path: list[str]) -> list[str]:
    """Digests from ``leaf`` up to the root."""
    out = [leaf]
    for step in path:
        out.append(digest(step[1:], out[-1]) if step[0] == _LEFT else digest(out[-1], step[1:]))
    return out


def siblings(path: list[str]) -> list[str]:
    return [s[1:] for s in path if s != _ALONE]


def _few(batches: Iterator[pa.RecordBatch], rows: int = 16) -> Iterator[pa.RecordBatch]:
    """Slices of a few blocks: what a task holds doesn't depend on the session's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos (gapless from 0 within ``tree``, by ``order``) and n (nodes of the tree). Rows are sorted by ranges that may
    lie anywhere in a tree, each task counts its own, and a table of counts (one row a task, or a tree) tells where it begins."""
    kind = nodes.schema.simpleString()[len("struct<"):-1]
    keys = ["tree", *order]

    def run(batches: Iterator[pa.RecordBatch]):
        part, tree, at = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            places = []
            for t in b.column("tree").to_pylist():
                at = at + 1 if t == tree else 0
                tree = t
                places.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], [*b.schema.names, "part", "place"])

    spread = cut_lineage(nodes.withColumn("spread", F.monotonically_increasing_id()))  # equal rows may stand in any order
    dealt = spread.repartitionByRange(parts_of(nodes.sparkSession, 1), *keys, "spread").sortWithinPartitions(*keys, "spread").drop("spread")
    placed = cut_lineage(dealt.mapInArrow(run, ", ".join([kind, "part: int", "place: bigint"])))
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("tree")
    starts = counts.select(F.col("tree").alias("t"), F.col("part").alias("p"), (F.sum("rows").over(w.orderBy("part")) - F.col("rows")).alias("start"),
                           F.sum("rows").over(w).alias("n"))
    return (placed.join(starts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
            .select(*nodes.columns, (F.col("start") + F.col("place")).alias("pos"), "n"))


def _height(n: int, height: int) -> int:
    """Of a block in a level of ``n`` nodes: a tree ends where one node remains."""
    return height if n > 1 << height else (n - 1).bit_length()


def blocks(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, block, n, rows): the nodes of each aligned block, at most 2^height, in order."""
    rest = [c for c in nodes.columns if c not in ("tree", "n")]
    return (nodes.groupBy("tree", F.shiftright("pos", height).alias("block"), "n")
            .agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("rows")))


def levels(nodes: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of every level, (tree, digest) of the roots) for nodes (tree, pos, n, digest, ...)."""
    out = []
    while True:
        packed = cut_lineage(blocks(nodes, height))
        out.append(packed)

        def roots(batches: Iterator[pa.RecordBatch]):
            for b in _few(batches):
                tops = [PersistentTree(leaves, _height(n, height)) for leaves, n in zip(b.column("leaves").to_pylist(), b.column("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), pa.array([(n - 1 >> height) + 1 for n in b.column("n").to_pylist()], pa.int64()),
                                                  pa.array([t.digests[t.root] for t in tops], pa.string())], ["tree", "pos", "n", "digest"])

        kind = nodes.schema["tree"].dataType.simpleString()
        nodes = cut_lineage(packed.select("tree", "block", "n", F.col("rows.digest").alias("leaves")).mapInArrow(roots, f"tree {kind}, pos long, n long, digest string"))
        if nodes.filter("n > 1").isEmpty():
            return out, nodes.select("tree", "digest")


def _under(packed: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with what the node that each one is has got from above: (path, ...)."""
    above = above.withColumnsRenamed({"tree": "t", "pos": "p"})
    return packed.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("p"))).drop("t", "p")


def paths(stack: list[DataFrame], top: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, pos, path) of the blocks of the lowest level, handed down from ``top`` (tree, pos = 0, path) of each tree."""
    for packed in reversed(stack[1:]):
        top = _handed_down(packed, top, height)
    return top


def _handed_down(packed: DataFrame, above: DataFrame, height: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in _few(batches):
            tree, pos, path = [], [], []
            for i, (n, leaves, up) in enumerate(zip(b.column("n").to_pylist(), b.column("rows").to_pylist(), b.column("path").to_pylist())):
                block = PersistentTree([r["digest"] for r in leaves], _height(n, height))
                tree += [i] * len(leaves)
                pos += [r["pos"] for r in leaves]
                path += [block.path(k) + up for k in range(len(leaves))]
            yield pa.RecordBatch.from_arrays([b.column("tree").take(pa.array(tree, pa.int64())), pa.array(pos, pa.int64()), pa.array(path, pa.list_(pa.string()))], ["tree", "pos", "path"])

    kind = packed.schema["tree"].dataType.simpleString()
    return cut_lineage(_under(packed, above).select("tree", "n", "rows", "path").mapInArrow(run, f"tree {kind}, pos long, path array<string>"))


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """For leaves (tree, key, leaf, changed): (tree, subroot, root, key, leaf, proof, version, folded).

    ``changed`` is the digest of a row as it stands now, null if it is the one that was recorded. ``proof``: the siblings up to the root;
    ``version``: the copied nodes of the version that the changed leaf makes, from the leaf to its root, null without a change; ``folded``: the
    root that the present leaf and the recorded siblings lead to. Trees and keys stand in ascending order, nulls first; rows
    with the same key by digest; equal rows are leaves of their own. No rows give no rows. A block has at most 2^height rows, so a frequent tree value
    is many blocks."""
    key, tree = (leaves.schema[c].dataType.simpleString() for c in ("key", "tree"))
    nodes = numbered(leaves.withColumnRenamed("leaf", "digest"), ["key", "digest"])
    stack, subroots = levels(nodes, height)

    tops = numbered(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    top_nodes = cut_lineage(tops)
    top_stack, root = levels(top_nodes, height)
    start = root.select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"))
    top_paths = _handed_down(top_stack[0], paths(top_stack, start, height), height)
    ends = cut_lineage(top_nodes.select("tree", "name", "pos", F.col("digest").alias("subroot")).join(top_paths, ["tree", "pos"])
                       .join(root.select("tree", F.col("digest").alias("root")), "tree")
                       .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"))
    names = ends.select(F.col("tree").alias("t0"), "subroot", "root")
    above = paths(stack, ends.select("tree", "pos", "path"), height)
    above = above.join(names, F.col("tree").eqNullSafe(F.col("t0"))).drop("t0")  # one row a block

    def run(batches: Iterator[pa.RecordBatch]):
        for b in _few(batches):
            rows, at = [], []
            for i, (n, members, up) in enumerate(zip(b.column("n").to_pylist(), b.column("rows").to_pylist(), b.column("path").to_pylist())):
                block = PersistentTree([r["digest"] for r in members], _height(n, height))
                at += [i] * len(members)
                for k, r in enumerate(members):
                    path = block.path(k)
                    copies = None
                    if r["changed"] is not None:
                        _, copies = block.changed(k, r["changed"])
                        copies += climb(copies[-1], up)[1:]
                    rows.append((r["key"], r["digest"], siblings(path + up), copies, copies[-1] if copies else climb(r["digest"], path + up)[-1]))
            cols = list(zip(*rows))
            kinds = (b.schema.field("rows").type.value_type.field("key").type, pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("tree", "subroot", "root")], *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                             ["tree", "subroot", "root", "key", "leaf", "proof", "version", "folded"])

    return _under(stack[0], above).select("tree", "n", "rows", "path", "subroot", "root").mapInArrow(
        run, f"tree {tree}, subroot string, root string, key {key}, leaf string, proof array<string>, version array<string>, folded string")

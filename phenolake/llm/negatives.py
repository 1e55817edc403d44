"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

Split points come from a bounded sample; a row goes down to its nearest split point, level by level, to a leaf. For every split point the tree keeps
the smallest and largest distance to the rows of each sibling subtree, over all rows. A window of scores is an annulus of distances
around the anchor, so a subtree goes if, seen from any split point beside it, no row in its range can lie in the annulus. Rows of the leaves
that remain are compared exactly, in blocks: a leaf of any size is many blocks, and anchors visit blocks in packets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage

FAN = 8  #: split points of a node
SAMPLE = 4096  #: rows, by digest, that split points are taken from
LEAF_SAMPLE = 64  #: a node with fewer sampled rows is a leaf
BLOCK = 1024  #: rows of a leaf that are compared at once
PACKET = 256  #: anchors that are compared at once
POSITIVES, NEGATIVES = 5, 3
SCALE = 256
_EXACT = float(1 << 53)


class Tree:
    """``nodes[k]``: split points (rows of integers as doubles) and the children, a node number each, or -1 - leaf number."""

    def __init__(self, sample: np.ndarray, fan: int = FAN, least: int = LEAF_SAMPLE):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        self.top = self._grow(np.unique(sample, axis=0), fan, least)
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a node: smallest and largest distance, split point x child
        self.norms: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of a node: smallest and largest squared length of each child's rows

    def _grow(self, rows: np.ndarray, fan: int, least: int) -> int:
        if len(rows) < max(least, 2 * fan):
            self.leaves += 1
            return -self.leaves
        points = rows[self._far_apart(rows, fan)]
        near = squared(points, rows).argmin(axis=0)
        at = len(self.nodes)
        self.nodes.append((points, []))
        self.nodes[at][1].extend(self._grow(rows[near == k], fan, least) for k in range(fan))
        return at

    @staticmethod
    def _far_apart(rows: np.ndarray, fan: int) -> list[int]:
        """Rows far from each other: each next one is the farthest from those taken."""
        taken = [0]
        gap = squared(rows[:1], rows)[0]
        while len(taken) < fan:
            taken.append(int(gap.argmax()))
            gap = np.minimum(gap, squared(rows[taken[-1:]], rows)[0])
        return taken

    def down(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        leaf, todo = np.zeros(len(rows), np.int64), [(self.top, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                leaf[own] = -1 - node
                continue
            points, kids = self.nodes[node]
            near = squared(points, rows[own]).argmin(axis=0)
            todo += [(kid, own[near == child]) for child, kid in enumerate(kids) if (near == child).any()]
        return leaf

    def ways(self) -> dict[int, list[tuple[int, int]]]:
        """(node, child) on the way to each leaf."""
        out, todo = {}, [(self.top, [])]
        while todo:
            node, way = todo.pop()
            if node < 0:
                out[-1 - node] = way
            else:
                todo += [(kid, [*way, (node, child)]) for child, kid in enumerate(self.nodes[node][1])]
        return out

    def seen(self, rows: np.ndarray, way: list[tuple[int, int]]) -> list[tuple]:
        """(node, point, child, smallest, largest distance, smallest, largest squared length) that rows at the end of ``way`` show."""
        length, found = (rows * rows).sum(axis=1), []
        for node, child in way:
            d = squared(self.nodes[node][0], rows)
            found += [(node, p, child, float(x.min()), float(x.max()), float(length.min()), float(length.max())) for p, x in enumerate(d)]
        return found

    def know(self, rows: list) -> None:
        """Ranges over all rows; a child without rows has none and is never entered."""
        for node, (points, kids) in enumerate(self.nodes):
            self.ranges[node] = np.full((len(points), len(kids)), np.inf), np.full((len(points), len(kids)), -np.inf)
            self.norms[node] = np.full(len(kids), np.inf), np.full(len(kids), -np.inf)
        for node, p, child, lo, hi, least, most in rows:
            self.ranges[node][0][p, child], self.ranges[node][1][p, child] = lo, hi
            self.norms[node][0][child], self.norms[node][1][child] = least, most

    def reach(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(anchors by number, leaf): leaves where a row may have a score from ``low`` to ``high`` with the anchor; a little distance is
        left for rounding."""
        length, out = (anchors * anchors).sum(axis=1), []
        todo = [(self.top, np.arange(len(anchors)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out.append((own, -1 - node))
                continue
            points, kids = self.nodes[node]
            (lo, hi), (least, most) = self.ranges[node], self.norms[node]
            d = np.sqrt(squared(points, anchors[own]))
            for child, kid in enumerate(kids):
                if most[child] < 0:
                    continue
                # score = (own length + row length - squared distance) / 2: the annulus of distances
                inner = np.sqrt(np.maximum(0.0, length[own] + least[child] - 2 * high[own])) * (1 - 1e-9) - 1
                outer = np.sqrt(np.maximum(0.0, length[own] + most[child] - 2 * low[own])) * (1 + 1e-9) + 1
                near, far = np.sqrt(lo[:, child])[:, None], np.sqrt(hi[:, child])[:, None]
                nearest = np.maximum(np.maximum(near - d, d - far), 0).max(axis=0)
                farthest = (d + far).min(axis=0)
                stay = (nearest <= outer) & (farthest >= inner) & (length[own] + most[child] - 2 * low[own] >= 0)
                if stay.any():
                    todo.append((kid, own[stay]))
        return out


def squared(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances, points x rows."""
    return np.maximum((points * points).sum(axis=1)[:, None] + (rows * rows).sum(axis=1)[None, :] - 2.0 * points @ rows.T, 0.0)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if len(anchors) and len(rows) and np.abs(anchors).max() * np.abs(rows).max() * anchors.shape[1] >= _EXACT:
        return np.einsum("ij,kj->ik", anchors.astype(np.int64), rows.astype(np.int64))
    return (anchors @ rows.T).astype(np.int64)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null or not finite."""
    fine = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


_MEMBERS = ("array<struct<row: bigint, id: bigint, label: bigint, v: binary, leaf: bigint, low: double, "
            "caps: array<struct<positive: int, low: bigint, high: bigint>>>>")
_FOUND = "row bigint, positive int, score bigint, id bigint, other bigint"
_FOUND_ARROW = pa.schema([("row", pa.int64()), ("positive", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("other", pa.int64())])


def _matrix(raw: list[bytes], kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), width).astype(float)


def _dense(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column; components missing at the end are 0."""
    n, out = np.diff(lists.offsets.to_numpy()), np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _sample(rows: DataFrame, distinct: int, width: int) -> np.ndarray:
    """At most ``SAMPLE`` distinct vectors, by digest, however often one stands there."""
    scale = 1 << 30
    few = rows.select(F.xxhash64("v").alias("h"), "v").filter(F.pmod("h", F.lit(scale)) < int(min(1.0, 2 * SAMPLE / max(1, distinct)) * scale))
    got = few.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(SAMPLE).collect()
    return np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in got], float).reshape(len(got), width)


def _assigned(rows: DataFrame, tree: Tree, kind: str, width: int) -> DataFrame:
    """Vectors as bytes, and the leaf that each goes down to."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            m = _dense(b.column("v"), width)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "id", "label", "anchor")], pa.array([r.tobytes() for r in m.astype(kind)], pa.binary()),
                                              pa.array(tree.down(m))], ["row", "id", "label", "anchor", "v", "leaf"])
    return rows.select("row", "id", "label", "anchor", "v").mapInArrow(run, "row long, id long, label long, anchor boolean, v binary, leaf long")


def _ranges(blocks: DataFrame, tree: Tree, kind: str, width: int) -> list:
    """What all rows show of every split point and every subtree beside it: as many rows as the tree has such pairs."""
    ways = tree.ways()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for leaf, rows in zip(b.column("leaf").to_pylist(), b.column("rows")):
                found = tree.seen(_matrix([r["v"] for r in rows.as_py()], kind, width), ways[leaf])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [pa.int32()] * 3 + [pa.float64()] * 4)],
                                                     ["node", "point", "child", "lo", "hi", "least", "most"])
    told = blocks.select("leaf", "rows").mapInArrow(run, "node int, point int, child int, lo double, hi double, least double, most double")
    return [tuple(r) for r in told.groupBy("node", "point", "child").agg(F.min("lo"), F.max("hi"), F.min("least"), F.max("most")).collect()]


def _packets(members: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(members): about ``PACKET`` anchors each, of one leaf or neighbouring ones. ``counts``: anchors of each leaf."""
    starts = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist()))
    by_leaf = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("leaf")]
    packet = F.floor((by_leaf(starts) + F.pmod(F.xxhash64("row"), by_leaf(counts))) / PACKET)
    return members.groupBy(packet.alias("packet")).agg(F.collect_list(F.struct("row", "id", "label", "v", "leaf", "low", "caps")).alias("members"))


def _compared(packets: DataFrame, blocks: DataFrame, tree: Tree, kind: str, width: int, compare: Callable, home: bool = False) -> DataFrame:
    """(row, positive, score, id, other): what ``compare`` finds between anchors and the blocks of the leaves they reach; ``home``: only
    of their own leaves."""
    def send(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for packet in b.column("members"):
                members = packet.as_py()
                if home:
                    leaves = np.array([m["leaf"] for m in members])
                    reached = [(np.flatnonzero(leaves == k), int(k)) for k in np.unique(leaves)]
                else:
                    low = np.array([m["low"] for m in members], float)
                    high = np.array([np.inf if m["caps"] is None else max((c["high"] for c in m["caps"]), default=-np.inf) for m in members], float)
                    reached = tree.reach(_matrix([m["v"] for m in members], kind, width), low, high)
                for own, leaf in reached:
                    yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([[members[k] for k in own]], packet.type)], ["at", "members"])

    def meet(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for members, rows in zip(b.column("members"), b.column("rows")):
                members, rows = members.as_py(), rows.as_py()
                rows.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["row"]))  # ties: the smaller id first
                s = scores(_matrix([m["v"] for m in members], kind, width), _matrix([r["v"] for r in rows], kind, width))
                labels, own = np.array([r["label"] for r in rows]), np.array([r["row"] for r in rows])
                found = [(m["row"], positive, int(s[k, j]), rows[j]["id"], rows[j]["row"]) for k, m in enumerate(members) for positive, j in compare(m, s[k], labels, own)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _FOUND_ARROW)], schema=_FOUND_ARROW)

    sent = packets.select("members").mapInArrow(send, f"at bigint, members {_MEMBERS}")
    return sent.join(blocks, F.col("at") == F.col("leaf")).select("members", "rows").mapInArrow(meet, _FOUND)


def first_of(s: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores among ``able`` places, the earlier first in a tie."""
    if len(able) > k:
        able = able[s[able] >= np.partition(s[able], len(able) - k)[len(able) - k]]
    return able[np.argsort(-s[able], kind="stable")][:k]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``anchors`` (over the columns of ``vectors``) holds.

    Components are rounded down after scaling, scores are integer inner products (exact below 2^63). An anchor's positives are the rows with its label and
    the highest scores, itself excepted; for each, the highest rows of other labels with a score between the two percentages of
    the positive's. Ties: the smaller id, then the earlier row; a row without an id comes last. Rows with a null label or vector, or a null or
    not finite component, take no part; shorter vectors end in zeros; repeated rows are rows of their own. No rows, or no anchors, give
    no rows. Other columns aren't looked at."""
    spark = vectors.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole_numbers(F.col(f"`{vector_col}`")).alias("v"),
                          F.coalesce(anchors, F.lit(False)).alias("anchor")).filter("label IS NOT NULL AND v IS NOT NULL")
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    width, peak, distinct = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.approx_count_distinct(F.xxhash64("v"))).first()
    if width is None:
        return spark.createDataFrame([], out)
    width, peak = max(width, 1), peak or 0
    kind = "<i2" if peak < 1 << 15 else "<i4" if peak < 1 << 31 else "<i8"
    tree = Tree(_sample(rows, distinct, width))
    assigned = cut_lineage(_assigned(rows, tree, kind, width))
    sizes = {r["leaf"]: (r["n"], r["anchors"]) for r in assigned.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).collect()}  # a row a leaf
    counts = {leaf: n for leaf, (_, n) in sorted(sizes.items()) if n}
    if not counts:
        return spark.createDataFrame([], out)
    parts = F.create_map(*[F.lit(x) for leaf, (n, _) in sizes.items() for x in (leaf, -(-n // BLOCK))])
    blocks = cut_lineage(assigned.groupBy("leaf", F.pmod(F.xxhash64("row"), parts[F.col("leaf")]).alias("block"))
                         .agg(F.collect_list(F.struct("id", "row", "label", "v")).alias("rows")).select("leaf", "rows"))
    tree.know(_ranges(blocks, tree, kind, width))
    members = assigned.filter("anchor").drop("anchor")
    no_caps = F.lit(None).cast("array<struct<positive: int, low: bigint, high: bigint>>").alias("caps")

    def nearest(m, s, labels, own):
        return [(0, j) for j in first_of(s, np.flatnonzero((labels == m["label"]) & (own != m["row"]) & (s >= m["low"])), positives)]

    def inside(m, s, labels, own):
        able = np.flatnonzero((labels != m["label"]) & (s >= m["low"]))
        return [(c["positive"], j) for c in m["caps"] for j in first_of(s, able[(s[able] >= c["low"]) & (s[able] <= c["high"])], negatives)]

    start = members.select("*", F.lit(float("-inf")).alias("low"), no_caps)
    home = _ranked(_compared(_packets(start, counts), blocks, tree, kind, width, nearest, home=True), positives)
    bound = cut_lineage(home.filter(F.col("rank") == positives).select("row", F.col("score").cast("double").alias("low")))
    wide = members.join(bound, "row", "left").select(*members.columns, F.coalesce("low", F.lit(float("-inf"))).alias("low"), no_caps)
    best = cut_lineage(_ranked(_compared(_packets(wide, counts), blocks, tree, kind, width, nearest), positives)
                       .select("row", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    caps = (best.filter("positive_score >= 0")  # below 0 the window is empty
            .select("row", F.struct(F.col("positive").cast("int").alias("positive"), F.expr(f"(CAST(positive_score AS DECIMAL(20)) * {share[0]} + 99) div 100").alias("low"),
                                    F.expr(f"(CAST(positive_score AS DECIMAL(20)) * {share[1]}) div 100").alias("high")).alias("cap"))
            .groupBy("row").agg(F.min("cap.low").cast("double").alias("low"), F.collect_list("cap").alias("caps")))
    sought = members.join(caps, "row").select(*members.columns, "low", "caps")
    found = _ranked(_compared(_packets(sought, counts), blocks, tree, kind, width, inside), negatives)
    return (found.select("row", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["row", "positive"])
            .join(members.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))

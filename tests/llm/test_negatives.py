"""Hard negatives against brute force, and what the tree leaves out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenolake.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, leaf int, v string, score double"


def plain(rows, is_anchor):
    """Lists of (id, whole numbers, label); ties by id, then by order."""
    fine = [(i, [int(np.floor(256 * x)) for x in v], k) for i, v, k in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for n, (i, v, k) in enumerate(fine):
        if i is None or not is_anchor(i):
            continue
        near = sorted([(j, dot(v, w)) for m, (j, w, c) in enumerate(fine) if c == k and m != n], key=order)[:5]
        other = sorted([(j, dot(v, w)) for j, w, c in fine if c != k], key=order)
        for j, p in near:
            out += [(i, j, r + 1, m, p, s) for r, (m, s) in enumerate([x for x in other if 50 * p <= 100 * x[1] <= 95 * p][:3])]
    return out


@pytest.mark.parametrize("clusters,scale", [(1, 1.0), (12, 1.0), (12, 3e5)])
def test_mine(spark, clusters, scale, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF_SAMPLE", 16)
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "PACKET", 7)
    monkeypatch.setattr(negatives.Tree.__init__, "__defaults__", (4, 16))
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(clusters)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        rows.append((i, [scale * (x + rng.gauss(0, 0.2)) for x in c], rng.randrange(4)))
    same = rows[30][1]
    rows += [(1000 + i, same, i % 2) for i in range(90)]  # a group of copies, with ties
    rows += [(1200, None, 1), (1201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1202, [float("nan")] + [0.0] * 5, 1), (1203, [float("inf")] * 6, 1), (1204, [1.0] * 6, None),
             (1205, [0.0] * 6, 2), (1210, [0.0] * 6, 2), (1206, [scale], 3), (1207, [], 3), (None, same, 0), (None, [-x for x in same], 1), rows[10], rows[10]]
    d = spark.createDataFrame([(*r, "r", 1, "v", 2.0) for r in rows], SCHEMA).repartition(4)
    got = negatives.mine(d, F.col("vec_id") % 10 == 0).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, lambda i: i % 10 == 0), key=key) and len(got) > 100
    for nothing in (d.limit(0), d.filter("vec_id = 1204")):
        assert negatives.mine(nothing, F.lit(True)).count() == 0
    assert negatives.mine(d, F.lit(None).cast("boolean")).count() == 0


def test_ranges_leave_out_subtrees():
    """On separated groups most leaves are left out, and none that holds a row of the window."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 400, (30, 8))
    rows = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(0, 10, (3000, 8)))
    tree = negatives.Tree(rows[:1000], 5, 30)
    leaf, ways = tree.down(rows), tree.ways()
    seen = {}
    for k in np.unique(leaf):
        for node, p, child, *x in tree.seen(rows[leaf == k], ways[int(k)]):
            lo, hi, least, most = seen.get((node, p, child), (np.inf, -np.inf, np.inf, -np.inf))
            seen[node, p, child] = min(lo, x[0]), max(hi, x[1]), min(least, x[2]), max(most, x[3])
    tree.know([(*k, *v) for k, v in seen.items()])
    anchors = rows[:60]
    s = anchors @ rows.T
    top = np.sort(s, axis=1)[:, -6]
    visited = 0
    for low, high in ((top, np.full(60, np.inf)), (0.5 * top, 0.95 * top)):
        met = np.zeros((60, tree.leaves), bool)
        for own, k in tree.reach(anchors, low, high):
            met[own, k] = True
        needed = (s >= low[:, None]) & (s <= high[:, None])
        for a, r in zip(*np.nonzero(needed)):
            assert met[a, leaf[r]]
        visited += met.mean()
    assert visited / 2 < 0.35

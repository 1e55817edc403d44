"""Merkle manifest against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from phenolake.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def plain(level):
    """(root, siblings of each leaf), run by run."""
    at, proofs = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 2 * 2:a // 2 * 2 + 2]
            proofs[k] += [("<" if a % 2 else ">", x) for i, x in enumerate(run) if i != a % 2] or [(".", "")]
            at[k] = a // 2
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def fold(leaf, proof):
    for side, x in proof:
        leaf = H(x, leaf) if side == "<" else H(leaf, x)
    return leaf


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, height):
    rows = [(f"t{k % 3}" if k % 11 else None, k, f"{k}") for k in range(150)] + [("alone", 5, "x"), ("é", 1, "y"), ("é", 2, "y"), ("t0", 3, "3"), ("t0", 3, "3"), ("t0", 3, "z"), ("t0", None, "n")]
    rows = [(t, k, H(x), H(x, "!") if i % 7 == 0 else None) for i, (t, k, x) in enumerate(rows)]
    d = spark.createDataFrame(rows, "tree string, key long, leaf string, changed string").repartition(5)
    got = merkle.manifest(d, height).collect()
    trees = {}
    for t, k, leaf, changed in rows:
        trees.setdefault(t, []).append(((k is not None, k or 0), leaf, k, changed))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    own = {t: (sorted(trees[t], key=lambda r: r[:2]),) for t in names}
    own = {t: (m, *plain([r[1] for r in m])) for t, (m,) in own.items()}
    root, tops = plain([own[t][1] for t in names])
    want = []
    for t, top in zip(names, tops):
        members, subroot, proofs = own[t]
        for (_, leaf, k, changed), proof in zip(members, proofs):
            path = proof + top
            want.append((t, k, leaf, subroot, root, [x for _, x in path if x], fold(changed or leaf, path), changed is None))
    have = [(r["tree"], r["key"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded"], r["version"] is None) for r in got]
    # of equal rows one may be changed and the other not: they are told apart by what they fold to
    key = lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2], "".join(r[5]) if r[1] != 3 else "", r[6])
    assert sorted((r for r in have if r[1] != 3), key=key) == sorted((r for r in want if r[1] != 3), key=key)
    assert sorted("".join(r[5]) for r in have) == sorted("".join(r[5]) for r in want) and len(have) == len(want)
    for r in got:
        if r["version"] is not None:
            assert r["version"][0] != r["leaf"] and r["version"][-1] == r["folded"] != r["root"]
        else:
            assert r["folded"] == r["root"]
    assert merkle.manifest(d.limit(0), height).count() == 0


def test_versions_share_nodes():
    leaves = [H(str(i)) for i in range(21)]
    tree = merkle.PersistentTree(leaves, 5)
    before = len(tree.digests)
    first, copies = tree.changed(20, H("new"))
    assert len(copies) == 6 and len(tree.digests) == before + 6 and tree.digests[tree.root] == plain(leaves)[0]
    second, _ = tree.changed(3, H("other"), first)
    changed = [*leaves[:20], H("new")]
    assert tree.digests[first] == plain(changed)[0]
    changed[3] = H("other")
    assert tree.digests[second] == plain(changed)[0]
    assert merkle.climb(H("new"), tree.path(20, first))[-1] == tree.digests[first]


def test_leaf_digest(spark):
    d = spark.createDataFrame([(1, None, "é", 12, ""), (None, "s", None, None, "a:b")], "a long, b string, c string, d int, e string")
    got = [r[0] for r in d.select(merkle.leaf_digest([F.col(c) for c in d.columns])).collect()]
    assert got == [H("1:1", "-", "2:é", "2:12", "0:"), H("-", "1:s", "-", "-", "3:a:b")]

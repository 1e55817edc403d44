"""Document fingerprints against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from phenolake.llm import fingerprints as fp
from phenolake.llm.words import Words, gram_hashes

SCHEMA = "doc_id long, text string, part int, place int, tie string, fingerprint string, n_chars long, spread long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(text, order):
    """Codes of all bins, one shingle and one bin at a time."""
    best = {}
    for s in shingles(text):
        h = int(gram_hashes(Words(pa.array([" ".join(s)])).hash, len(s))[0])
        b, v = h >> 56, h & ((1 << 56) - 1)
        best[b] = min(best.get(b, v), v)
    if not best:
        return None
    return [(best[b] if b in best else best[next(t for t in order[b] if t in best)]) & 15 for b in range(fp.BINS)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["ba", "ko", "Ti", "mé", "zu", "lo", "日本", "naïve"]) + str(rng.randrange(60)) for _ in range(n))
    return [say(200), None, "", "one", " \n ", "One  two", say(5), say(5000), "𝒳" * 9, *[say(rng.randint(1, 90)) for _ in range(40)]]


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints(spark, texts, partitions):
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (3, "another text"), (None, texts[6]), (None, None)]
    d = spark.createDataFrame([(*r, 1, 2, "t", "f", 3, 4) for r in rows], SCHEMA).repartition(partitions)
    got = fp.fingerprint(d).collect()
    assert len(got) == len(rows)
    order = fp.probe_order(fp.BINS)
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(line):
        t, after = t or "", line[(k + 1) % len(line)][1] or ""
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        a, b, c = plain(t, order), plain(edited, order), plain(after, order)

        def near(x, y):
            if x is None or y is None:
                return 1.0 if x is y else 0.0
            return min(1.0, max(0.0, (float(np.mean([p == q for p, q in zip(x, y)])) - 1 / 16) / (15 / 16)))

        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, c), 9)))
    unpack = lambda x: None if not x else [sum(v << k for k, v in enumerate(bits)) for bits in np.unpackbits(np.frombuffer(x, np.uint8)).reshape(-1, fp.BITS).tolist()]
    have = [(r["id"], r["n_chars"], r["edited_sha256"], unpack(r["fingerprint"]), unpack(r["edited_fingerprint"]), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))


def test_estimates():
    """Bias and spread of the estimate over pairs with known similarity, sparse ones included."""
    rng, order = random.Random(1), fp.probe_order(fp.BINS)
    for n, share in ((1000, 0.8), (1000, 0.3), (60, 0.5), (1000, 0.0)):
        errors = []
        for _ in range(60):
            base = [f"w{rng.getrandbits(60)}" for _ in range(n)]
            keep = round(2 * n * share / (1 + share)) if share else 0
            other = base[:keep] + [f"w{rng.getrandbits(60)}" for _ in range(n - keep)]
            sets = [np.unique(Words(pa.array([" ".join(x)])).hash) for x in (base, other)]
            codes = [fp.densify(fp.bins_of(s, np.zeros(len(s), int), 1), order)[0] & np.uint64(15) for s in sets]
            true = keep / (2 * n - keep)
            errors.append((np.mean(codes[0] == codes[1]) - 1 / 16) / (15 / 16) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fp.fingerprint(empty).count() == 0
    alone = fp.fingerprint(spark.createDataFrame([(1, "a b c d e f g h", 1, 2, "t", "f", 3, 4)], SCHEMA)).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"a b c d e f " + b"a b").hexdigest()
    same = fp.fingerprint(spark.createDataFrame([(i, "same text for all", 1, 2, "t", "f", 3, 4) for i in range(500)], SCHEMA).repartition(9)).collect()
    assert len(same) == 500 and len({bytes(r["fingerprint"]) for r in same}) == 1 and {r["near_next"] for r in same} == {1.0}

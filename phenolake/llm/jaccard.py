"""N-gram Jaccard join by T-occurrence search over inverted lists of shingles.

Documents with equal shingle sets are one class. A set of n shingles links only with sets that share at least T = ceil(0.8 n)
of them. As in DivideSkip, the long lists of a document (shingles that are frequent in the corpus) are left for probing, and only its
n - T + 1 rarest shingles are looked up in the merge: any partner must occur in one of those lists. Candidates pass length and
positional filters, and then all lists are probed for the exact overlap.

Lists longer than ``LONG`` never meet in one task as pairs: their members are compared with the list's first document, and only
members that stay outside its component are joined with the rest of the list."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolake.llm.common import components, cut_lineage, give_back, parts_of, pieces, small_enough
from phenolake.llm.words import Words, gram_hashes

WIDTH, SHARE = 5, (80, 100)
FREQUENT = 4  #: a shingle in more documents is placed by its frequency; others, by hash
FREQUENT_KEPT = 1 << 20  #: the most frequent shingles that every task knows (16 MB); the order is free, so others cost time only
LONG = 64  #: a list up to this length is compared pair by pair
BROADCAST_ROWS = 1 << 20

_TOKEN_BITS = np.uint64(16)  # candidates are sought with the upper 48 bits, overlaps counted with all 64
_LIST = pa.list_(pa.int64())


def shingle_sets(column, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` are one shingle, none are none."""
    w = Words(column)
    grams, out = w.grams(width), []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a:b - width + 1]))
        else:
            out.append(gram_hashes(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[bytes | None, int | None]:
    if not len(s):
        return None, None
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return d, int.from_bytes(d[:8], "little", signed=True)


def least_overlap(n: np.ndarray, share=SHARE) -> np.ndarray:
    """T: no partner of any size shares fewer."""
    return -(-share[0] * n // share[1])


def summaries(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), digest (of the set; null without words), short (64 bits of it)."""
    def run(batches):
        for b in pieces(batches):
            sets = shingle_sets(b.column("text"), width)
            keys = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int64())],
                                             ["doc_id", "n", "digest", "short"])
    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, digest binary, short long")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _dealt(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, part bounds) of 48-bit tokens by range."""
    order = np.argsort(tokens, kind="stable")
    cuts = (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts) << np.uint64(16)
    return order, np.concatenate([[0], np.searchsorted(tokens[order], cuts), [len(tokens)]])


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, over: int = FREQUENT) -> DataFrame:
    """(token, n): 48-bit tokens in more than ``over`` documents, counted over all documents. Rows of the exchange are sorted
    distances, so a shingle costs four bytes; within a piece equal shingles are counted first."""
    parts = parts_of(docs.sparkSession)

    def pack(batches):
        for b in pieces(batches):
            t, n = np.unique(np.concatenate([s >> _TOKEN_BITS for s in shingle_sets(b.column("text"), width)] or [np.zeros(0, np.uint64)]),
                             return_counts=True)
            _, at = _dealt(t, parts)
            rows = []
            for p in range(parts):
                mine = t[at[p]:at[p + 1]]
                if len(mine):
                    step = np.diff(mine)
                    wide = len(step) and int(step.max()) >> 32
                    more = np.flatnonzero(n[at[p]:at[p + 1]] > 1)
                    rows.append((p, int(mine[0]), bool(wide), step.astype(np.uint64 if wide else np.uint32).tobytes(),
                                 more.astype(np.uint32).tobytes(), n[at[p]:at[p + 1]][more].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (
                pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["part", "first", "wide", "step", "at", "n"]) \
                if rows else pa.RecordBatch.from_pylist([], pa.schema([("part", pa.int32()), ("first", pa.int64()), ("wide", pa.bool_()), (
                    "step", pa.binary()), ("at", pa.binary()), ("n", pa.binary())]))

    def count(group: pa.Table) -> pa.Table:
        give_back()
        tokens, counts = [], []
        for r in group.to_pylist():
            step = np.frombuffer(r["step"], np.uint64 if r["wide"] else np.uint32).astype(np.uint64)
            tokens.append(np.concatenate([[np.uint64(r["first"])], np.uint64(r["first"]) + np.cumsum(step, dtype=np.uint64)]))
            n = np.ones(len(tokens[-1]), np.int64)
            n[np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["n"], np.uint32)
            counts.append(n)
        t, n = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        total = np.add.reduceat(n, starts)
        keep = total > over
        return pa.table({"token": t[starts][keep].astype(np.int64), "n": total[keep]})

    packed = _plain(docs, id_col, text_col).mapInArrow(pack, "part int, first long, wide boolean, step binary, at binary, n binary")
    return packed.groupBy("part").applyInArrow(count, "token long, n long")


def candidates(docs: DataFrame, id_col: str, text_col: str, frequent: tuple[np.ndarray, np.ndarray], width: int = WIDTH, share=SHARE,
               long: int = LONG) -> DataFrame:
    """Rows (x, y) of candidate pairs by short digest, and rows (token, x, n, pos, rare) for members of long lists; ``rare``: shingles
    of the document that are in no long list."""
    parts, (known, often) = parts_of(docs.sparkSession), frequent
    schema = "x long, y long, token long, n long, pos long, rare long"

    def entries(batches):
        for k, b in enumerate(pieces(batches)):
            rows, seen = [], set()
            for s in shingle_sets(b.column("text"), width):
                digest, short = _digest(s)
                if digest is None or digest in seen:
                    continue
                seen.add(digest)
                t = s >> _TOKEN_BITS
                at = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1))
                rank = np.where(known[at] == t, often[at], 0) if len(known) else np.zeros(len(t), np.int64)
                order = np.lexsort((t, rank))[:len(s) - int(least_overlap(np.int64(len(s)), share)) + 1]
                rows.append((t[order], np.full(len(order), short), np.full(len(order), len(s)), np.arange(len(order)),
                             np.full(len(order), np.count_nonzero(rank <= long)), rank[order] > long))
            if not rows:
                continue
            t, d, n, pos, rare, far = (np.concatenate(c) for c in zip(*rows))
            out = []
            for is_long in (False, True):
                m = far == is_long
                # members of long lists go to any part: they aren't compared there
                order, at = _dealt(t[m], parts) if not is_long else (np.arange(int(m.sum())), np.linspace(0, int(m.sum()), 9).astype(int))
                tt, dd, nn, pp, rr = (c[m][order] for c in (t, d, n, pos, rare))
                for p in range(len(at) - 1):
                    a, z = at[p], at[p + 1]
                    if z > a:
                        six = np.ascontiguousarray(tt[a:z].view(np.uint16).reshape(-1, 4)[:, :3])
                        small = np.uint16 if nn[a:z].max() < 65536 else np.uint32
                        out.append((p if not is_long else (int(tt[a]) + k) % parts, is_long, six.tobytes(), dd[a:z].tobytes(),
                                    nn[a:z].astype(small).tobytes(), pp[a:z].astype(small).tobytes(), rr[a:z].astype(small).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (
                pa.int32(), pa.bool_(), *[pa.binary()] * 5))], ["part", "far", "t", "d", "n", "pos", "rare"])

    def meet(group: pa.Table) -> pa.Table:
        give_back()
        cols = [[], [], [], [], []], [[], [], [], [], []]
        for r in group.to_pylist():
            c = cols[r["far"]]
            six = np.frombuffer(r["t"], np.uint16).reshape(-1, 3)
            t = np.zeros((len(six), 4), np.uint16)
            t[:, :3] = six
            c[0].append(t.view(np.uint64).ravel())
            c[1].append(np.frombuffer(r["d"], np.int64))
            small = np.uint16 if len(r["n"]) == 2 * len(six) else np.uint32
            c[2].append(np.frombuffer(r["n"], small).astype(np.int64))
            c[3].append(np.frombuffer(r["pos"], small).astype(np.int64))
            c[4].append(np.frombuffer(r["rare"], small).astype(np.int64))
        near, far = ([np.concatenate(c) if c else np.zeros(0, np.int64) for c in side] for side in cols)
        t, d, n, pos, rare = near
        order = np.lexsort((d, t))
        t, d, n, pos, rare = (c[order] for c in near)
        if len(t):
            keep = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
            t, d, n, pos, rare = (c[keep] for c in (t, d, n, pos, rare))
        size = np.diff(np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))) if len(t) else np.zeros(0, int)
        big = np.repeat(size > long, size)
        far = [np.concatenate([a, b[big]]) for a, b in zip(far, (t, d, n, pos, rare))]
        t, d, n, pos = t[~big], d[~big], n[~big], pos[~big]
        xs, ys = [], []
        for k in range(1, int(min(long, size.max(initial=1)))):
            i = np.flatnonzero(t[k:] == t[:-k]) if len(t) > k else np.zeros(0, int)
            if not len(i):
                break
            j = i + k
            ok = passes(n[i], pos[i], n[j], pos[j], share)
            xs.append(d[i[ok]]), ys.append(d[j[ok]])
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (xs, ys))
        if len(x):
            pair = np.unique(np.stack([x, y], 1), axis=0)
            x, y = pair[:, 0], pair[:, 1]
        none, gap = pa.nulls(len(x), pa.int64()), pa.nulls(len(far[0]), pa.int64())
        names = ["x", "y", "token", "n", "pos", "rare"]
        return pa.concat_tables([pa.table([pa.array(x), pa.array(y), none, none, none, none], names), pa.table(
            [pa.array(far[1].astype(np.int64)), gap, *(pa.array(far[i].astype(np.int64)) for i in (0, 2, 3, 4))], names)])

    packed = _plain(docs, id_col, text_col).mapInArrow(entries, "part int, far boolean, t binary, d binary, n binary, pos binary, rare binary")
    return packed.groupBy("part").applyInArrow(meet, schema)


def passes(n, p, m, q, share=SHARE):
    """Length and positional filter: sizes n, m with a common shingle at places p, q of the global order."""
    a, b = share
    lo, hi = np.minimum(n, m), np.maximum(n, m)
    need = -(-a * (n + m) // (a + b))
    return (b * lo >= a * hi) & (1 + np.minimum(n - p, m - q) - 1 >= need)


def _passes_sql(share) -> str:
    a, b = share
    return (f"{b} * least(n, m) >= {a} * greatest(n, m) AND least(n - pos, m - qos) >= ceil({a} * (n + m) / {a + b}.0)")


def probe(pairs: DataFrame, docs: DataFrame, sums: DataFrame, id_col: str, text_col: str, width: int = WIDTH, share=SHARE) -> DataFrame:
    """The pairs (x, y) of short digests that link, as pairs of digests, with their exact overlap."""
    need = pairs.select(F.col("x").alias("short")).union(pairs.select("y")).distinct()
    first = cut_lineage(sums.filter("digest IS NOT NULL").join(need, "short", "left_semi").groupBy("digest", "short").agg(F.min("doc_id").alias("doc_id")))
    ids = first.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_ROWS) else ids

    def sets(batches: Iterator[pa.RecordBatch]):
        for b in pieces(batches):
            found = [s for s in shingle_sets(b.column("text"), width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s)[0] for s in found], pa.binary()),
                                              pa.array([s.view(np.int64) for s in found], _LIST)], ["digest", "tokens"])

    rows = _plain(docs, id_col, text_col)
    full = rows.join(ids, "doc_id", "left_semi").mapInArrow(sets, "digest binary, tokens array<long>")
    # classes that no row with an id belongs to
    nameless = rows.filter("doc_id IS NULL").mapInArrow(sets, "digest binary, tokens array<long>")
    full = full.unionByName(nameless.join(first.filter("doc_id IS NULL").select("digest"), "digest", "left_semi"))
    full = cut_lineage(full.groupBy("digest").agg(F.first("tokens").alias("tokens")).join(first.select("digest", "short"), "digest"))
    a, b = share
    left = full.select(F.col("digest").alias("x_digest"), F.col("tokens").alias("x_tokens"), F.col("short").alias("x"))
    right = full.select(F.col("digest").alias("y_digest"), F.col("tokens").alias("y_tokens"), F.col("short").alias("y"))
    both = pairs.join(left, "x").join(right, "y")
    both = both.withColumn("common", F.size(F.array_intersect("x_tokens", "y_tokens")))
    return both.filter(b * F.col("common") >= a * (F.size("x_tokens") + F.size("y_tokens") - F.col("common"))).select(
        F.col("x_digest").alias("x"), F.col("y_digest").alias("y"), "common")


def class_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share=SHARE,
                     over: int = FREQUENT, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(rows of ``summaries``, classes): a class is (digest, first_id, component_id), with the smallest ids of equal sets and of the
    component."""
    spark = docs.sparkSession
    sums = cut_lineage(summaries(docs, id_col, text_col, width))
    top = frequent_shingles(docs, id_col, text_col, width, over).orderBy(F.desc("n"), "token").limit(FREQUENT_KEPT).toArrow()
    known, often = top.column("token").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(known)
    found = cut_lineage(candidates(docs, id_col, text_col, (known[order], often[order]), width, share, long))
    members = found.filter("token IS NOT NULL").select("token", "x", "n", "pos", "rare").distinct()
    # the head of a list is the member that most of it resembles: the one with the fewest shingles of its own
    heads = members.groupBy("token").agg(F.min(F.struct("rare", "n", "x", "pos")).alias("h"))
    star = (members.join(heads, "token").select("x", "n", "pos", F.col("h.x").alias("y"), F.col("h.n").alias("m"), F.col("h.pos").alias("qos"))
            .filter("x <> y").filter(_passes_sql(share)))
    ordered = lambda d: d.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = cut_lineage(ordered(found.filter("token IS NULL").select("x", "y").unionByName(star.select("x", "y"))))
    links = cut_lineage(probe(pairs, docs, sums, id_col, text_col, width, share))
    comps = components(links)
    if not members.isEmpty():
        # what the first document of a long list didn't gather meets the rest of the list
        shorts = sums.filter("digest IS NOT NULL").select("digest", "short").distinct()
        placed = shorts.join(comps.withColumnRenamed("node", "digest"), "digest", "left").select("short", F.coalesce("comp", "digest").alias("comp"))
        placed = placed.groupBy("short").agg(F.min("comp").alias("comp"))
        whole = cut_lineage(members.join(placed.withColumnRenamed("short", "x"), "x"))
        head = whole.join(heads.select("token", F.col("h.x").alias("x")), ["token", "x"]).select("token", F.col("comp").alias("head_comp"))
        rest = whole.join(head, "token").filter("comp <> head_comp").select("token", F.col("x").alias("y"), F.col("n").alias("m"),
                                                                           F.col("pos").alias("qos"), F.col("comp").alias("y_comp"))
        cross = whole.join(rest, "token").filter("comp <> y_comp").filter(_passes_sql(share)).select("x", "y")
        more = cut_lineage(ordered(cross).join(pairs, ["x", "y"], "left_anti"))
        if not more.isEmpty():
            links = cut_lineage(links.unionByName(probe(more, docs, sums, id_col, text_col, width, share)))
            comps = components(links)
    classes = sums.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    classes = classes.join(comps.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    classes = cut_lineage(classes)
    least = classes.groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest")).alias("h"))
    return sums, classes.join(least, "comp").select("digest", "first_id", F.col("h.first_id").alias("component_id"),
                                                    (F.col("h.digest") == F.col("digest")).alias("leads"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Null or wordless texts have no shingles and are their own component; equal texts (and repeated rows) are one class; a row
    without an id takes part, but never names a component. Empty input gives no rows; other columns are not looked at."""
    sums, classes = class_components(docs, id_col, text_col, **options)
    return sums.join(classes.select("digest", "component_id"), "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, or one of those if rows repeat it with the same words.
    Rows without words are no copies, and stay."""
    _, classes = class_components(docs, id_col, text_col, width, **options)
    chosen = classes.filter("leads").select("digest", F.col("first_id").alias("chosen_id"))
    has_words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def tag(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text_col)], ["row", "text"])
            for b in pieces([flat]):
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([_digest(s)[0] for s in shingle_sets(b.column("text"), width)], pa.binary())],
                                                 ["row", "digest"])

    rows = docs.filter(has_words).select(whole)
    tagged = rows.mapInArrow(tag, T.StructType([*rows.schema.fields, T.StructField("digest", T.BinaryType())]))
    same = F.col("digest") == F.col("of_digest"), F.col(f"row.`{id_col}`").eqNullSafe(F.col("chosen_id"))
    kept = tagged.join(chosen.withColumnRenamed("digest", "of_digest"), same[0] & same[1]).groupBy("digest").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(docs.filter(~has_words))

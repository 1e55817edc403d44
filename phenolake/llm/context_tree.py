"""Language-model scoring by context-tree weighting.

A byte is coded as eight binary decisions; each decision has a Krichevsky-Trofimov estimator in every context of 0 to LENGTH preceding bytes, and
a node of the tree mixes its own estimate half and half with the product of its children's. The tree is learned from counts of byte
sequences over all training texts. Every counted context is kept, however rare: sequences, nodes and the log of each sequence's last byte
are tables dealt by key. Only the nodes of 0 and 1 bytes, whose number the alphabet bounds, meet at the driver."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage, give_back, parts_of, pieces
from phenolake.llm.exchange import grouped, restored, round_trip, squeezed, told
from phenolake.llm.words import Words, mix, text_bytes

LENGTH = 5  #: bytes of the longest contexts
TOP = 3  #: nodes of this many bytes and more are worked out beside their sequences, shorter ones from these
DEPTH = 3  #: of ``Tree``, the plain form for contexts that fit in memory
CHUNK = 1 << 16  #: sequences that a task works out at once, or those of one context of TOP bytes
END = 0  #: byte that ends a text, and stands before it
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_END_TOKEN = mix(np.array([1], np.uint64))[0]  # hashes of words are mixed from other values


def sequences(data: np.ndarray, offsets: np.ndarray, use: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(one number for each coded byte, text of each): the bytes of the chosen texts, lower-cased, and an end. The byte before is the
    first digit, then the one before that, and the coded byte is the last: contexts that agree in their last bytes are neighbours."""
    size = np.diff(offsets)[use]
    text = np.flatnonzero(use)
    flat = np.full(int(size.sum()) + length * (len(size) + 1), END, np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + length)[:-1]]) + length if len(size) else np.zeros(0, np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(begin, size) + inner] = _LOWER[data[np.repeat(offsets[:-1][use], size) + inner]]
    long = size + 1
    at = np.repeat(begin, long) + np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    key = np.zeros(len(at), np.uint64)
    for k in (*range(1, length + 1), 0):
        key = key << np.uint64(8) | flat[at - k]
    return key, np.repeat(text, long)


def spread(seq: np.ndarray, length: int) -> np.ndarray:
    """Even keys, one for each sequence (words have odd ones): contexts of TOP bytes lie all over the range, their sequences side by side."""
    below = np.uint64(8 * (length + 1 - TOP))
    group = (seq >> below) * np.uint64(0x9E3779B1) & np.uint64((1 << 8 * TOP) - 1)
    return group << np.uint64(64 - 8 * TOP) | (seq & (np.uint64(1) << below) - np.uint64(1)) << np.uint64(64 - 8 * TOP) - below


def trained(ids: list, mod: int, rest: int) -> np.ndarray:
    """Which rows are learned from: crc32 of the id as text, mod ``mod``, isn't ``rest``; a null id counts as an empty one."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod != rest for i in ids], bool)


def count_sequences(docs: DataFrame, mod: int, rest: int, length: int = LENGTH) -> DataFrame:
    """(seq, n) over all texts, with the count in training texts; a task sums its own pieces first."""
    def run(batches: Iterator[pa.RecordBatch]):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in pieces(batches):
            data, offsets = text_bytes(b.column("text"))
            train = trained(b.column("doc_id").to_pylist(), mod, rest)
            k, n = np.unique(sequences(data, offsets, train, length)[0], return_counts=True)
            other = np.unique(sequences(data, offsets, ~train, length)[0])
            keys, counts = _summed(np.concatenate([keys, k, other]), np.concatenate([counts, n, np.zeros(len(other), np.int64)]))
            if len(keys) > 1 << 20:
                yield _pairs(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield _pairs(keys, counts)
    return docs.mapInArrow(run, "seq long, n long").groupBy("seq").agg(F.sum("n").alias("n"))


def _pairs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["seq", "n"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, start = grouped(keys)
    return keys[order][start], np.add.reduceat(counts[order], start) if len(keys) else counts


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary decisions (heap order from column 1) of rows of 256 byte counts."""
    zeros, ones = (np.zeros((len(counts), 256)) for _ in range(2))
    level = counts
    for depth in range(7, -1, -1):
        pair = level.reshape(len(counts), 1 << depth, 2)
        zeros[:, 1 << depth:2 << depth], ones[:, 1 << depth:2 << depth] = pair[..., 0], pair[..., 1]
        level = pair.sum(2)
    return zeros, ones


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps up."""
    shift = np.ones_like(z)
    for k in range(7):
        shift *= z + k
    y = z + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(shift)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to any sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)


@dataclass
class Tree:
    """Compiled model: the leaf that each context of DEPTH bytes ends in, and log10 of each next byte there."""

    contexts: list[np.ndarray]  #: by depth, sorted
    logs: np.ndarray  #: [leaf, byte]; leaves: the rest below each context by depth, then the contexts of full depth

    @classmethod
    def of(cls, contexts: list[np.ndarray], counts: list[np.ndarray]) -> Tree:
        """``counts[d]``: rows of byte counts for ``contexts[d]``; every context's shorter ones are there."""
        bits = [decisions(c) for c in counts]
        parent = [None] + [np.searchsorted(contexts[d - 1], contexts[d] & np.uint32((1 << 8 * (d - 1)) - 1)) for d in range(1, DEPTH + 1)]
        rest, own, mixed = [None] * DEPTH, [None] * (DEPTH + 1), [None] * (DEPTH + 1)
        mixed[DEPTH] = kt_log(*bits[DEPTH])
        for d in range(DEPTH - 1, -1, -1):
            below = [b.copy() for b in bits[d]]
            children = np.zeros_like(below[0])
            for part, child in zip(below, bits[d + 1]):
                np.subtract.at(part, parent[d + 1], child)
            np.add.at(children, parent[d + 1], mixed[d + 1])
            rest[d] = below
            estimate = kt_log(*bits[d])
            mixed[d] = np.logaddexp(estimate, children + kt_log(*below)) + np.log(0.5)
            own[d] = np.exp(estimate + np.log(0.5) - mixed[d])
        rows, weight, so_far = [], np.ones_like(bits[0][0]), np.zeros_like(bits[0][0])
        for d in range(DEPTH):
            so_far = so_far + weight * own[d] * _one(*bits[d])
            weight = weight * (1 - own[d])
            rows.append(_bytes(so_far + weight * _one(*rest[d])))
            so_far, weight = so_far[parent[d + 1]], weight[parent[d + 1]]
        rows.append(_bytes(so_far + weight * _one(*bits[DEPTH])))
        return cls(contexts, np.concatenate(rows))

    def leaves(self) -> np.ndarray:
        """Leaf of each number of DEPTH bytes: that of the longest context known."""
        out, at = np.zeros(1 << 8 * DEPTH, np.uint16 if len(self.logs) < 1 << 16 else np.uint32), 1
        for d in range(1, DEPTH + 1):
            view = out.reshape(1 << 8 * (DEPTH - d), 1 << 8 * d)
            view[:, self.contexts[d]] = np.arange(at, at + len(self.contexts[d]), dtype=out.dtype)
            at += len(self.contexts[d])
        return out


def _one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _bytes(one: np.ndarray) -> np.ndarray:
    """log10 of the 256 bytes from the probabilities of their decisions."""
    logs = np.zeros((len(one), 1))
    for depth in range(8):
        p = one[:, 1 << depth:2 << depth]
        logs = np.stack([logs + np.log10(1 - p), logs + np.log10(p)], 2).reshape(len(one), 2 << depth)
    return logs.astype(np.float32)


@dataclass
class Level:
    """Nodes of one depth: ``ids`` are context and decision (heap order from 1) as one number, sorted."""

    ids: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    mixed: np.ndarray
    own: np.ndarray
    up: np.ndarray | None = None  #: of the level below: the node here that each of its nodes belongs to

    @classmethod
    def of(cls, ids, zeros, ones, children: np.ndarray | None, up=None) -> Level:
        estimate = kt_log(zeros, ones)
        if children is None:
            return cls(ids, zeros, ones, estimate, np.ones(len(ids)), up)
        mixed = np.logaddexp(estimate, children) + np.log(0.5)
        return cls(ids, zeros, ones, mixed, np.exp(estimate + np.log(0.5) - mixed), up)

    def above(self) -> Level:
        ids, up = np.unique(_parent(self.ids), return_inverse=True)
        return Level.of(ids, *(np.bincount(up, x, len(ids)) for x in (self.zeros, self.ones, self.mixed)), up)

    def down(self, so_far: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What nodes hand to those below: the probability of a one as far as it is settled, and the weight left."""
        return so_far + weight * self.own * _one(self.zeros, self.ones), weight * (1 - self.own)


def _parent(ids):
    """Without the oldest byte of the context."""
    return ids >> 16 << 8 | ids & 255


_STEP = np.arange(8, dtype=np.int64)


def levels(seq: np.ndarray, n: np.ndarray, length: int, top: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """(levels from ``length`` to ``top`` bytes, deepest node of each decision of each sequence, its bit). An untrained node is even, and
    changes nothing above it."""
    byte = (seq & 255)[:, None]
    bit = byte >> (7 - _STEP) & 1
    ids, node = np.unique((seq >> 8 << 8)[:, None] | 1 << _STEP | byte >> (8 - _STEP), return_inverse=True)
    node = node.reshape(len(seq), 8)
    zeros, ones = (np.bincount(node.ravel(), (n[:, None] * x).ravel(), len(ids)) for x in (1 - bit, bit))
    out = [Level.of(ids, zeros, ones, None)]
    for _ in range(length - top):
        out.append(out[-1].above())
    return out, node, bit


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by g, cut between values of g only."""
    kept, size = [], 0
    for b in batches:
        kept.append(b)
        size += b.num_rows
        if size >= CHUNK:
            t = pa.Table.from_batches(kept)
            g = t.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield t.slice(0, cut)
                give_back()
            kept, size = t.slice(cut).to_batches(), len(g) - cut
    if size:
        yield pa.Table.from_batches(kept)


def learn(docs: DataFrame, mod: int, rest: int, length: int = LENGTH) -> DataFrame:
    """log10 of the last byte of every sequence in ``docs`` after the ones before it, told to the ranges of ``spread``."""
    if not TOP <= length <= 6:
        raise ValueError(f"contexts of {length} bytes: {TOP} to 6 fit in a key")
    spark = docs.sparkSession
    counts = cut_lineage(count_sequences(docs, mod, rest, length))
    seqs = counts.select(F.shiftright("seq", 8 * (length - TOP + 1)).alias("g"), F.lit(1).alias("kind"), F.col("seq").alias("key"), F.col("n").cast("double").alias("n"),
                         F.lit(None).cast("double").alias("so_far"), F.lit(None).cast("double").alias("weight"))
    dealt = lambda d: d.repartition(parts_of(spark), "g").sortWithinPartitions("g", "kind", "key")

    def bottom_up(batches: Iterator[pa.RecordBatch]):
        for t in _chunks(batches):
            x = levels(t.column("key").to_numpy(), t.column("n").to_numpy(), length, TOP)[0][-1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x.ids, x.zeros, x.ones, x.mixed)], ["id", "zeros", "ones", "mixed"])

    def two_bytes(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = Level.of(*(b.column(c).to_numpy() for c in ("id", "zeros", "ones", "mixed")))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x.ids, x.zeros, x.ones, x.mixed, x.own)], ["id", "zeros", "ones", "mixed", "own"])

    above = lambda d: d.groupBy(_above("id").alias("id")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "mixed")])
    third = cut_lineage(dealt(seqs.select("g", "kind", "key", "n")).mapInArrow(bottom_up, "id long, zeros double, ones double, mixed double"))
    second = cut_lineage(above(third).mapInArrow(two_bytes, "id long, zeros double, ones double, mixed double, own double"))
    found = above(second).orderBy("id").toArrow()  # 256 contexts of 255 decisions at most
    first = Level.of(*(found.column(c).to_numpy() for c in ("id", "zeros", "ones", "mixed")))
    root = first.above()
    so_far, weight = root.down(np.zeros(len(root.ids)), np.ones(len(root.ids)))
    so_far, weight = first.down(so_far[root.up], weight[root.up])
    start = spark.createDataFrame(pa.table({"up": first.ids.astype(np.int64), "so_far": so_far, "weight": weight}).cast(
        pa.schema([("up", pa.int64()), ("so_far", pa.float64()), ("weight", pa.float64())])))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    start = second.withColumn("up", _above("id")).join(F.broadcast(start), "up").select(
        F.col("id").alias("up"), (F.col("so_far") + F.col("weight") * F.col("own") * one).alias("so_far"), (F.col("weight") * (1 - F.col("own"))).alias("weight"))
    nodes = third.select("id", _above("id").alias("up")).join(start, "up").select(
        F.shiftright("id", 8).alias("g"), F.lit(0).alias("kind"), F.col("id").alias("key"), F.lit(None).cast("double").alias("n"), "so_far", "weight")

    def top_down(batches: Iterator[pa.RecordBatch]):
        for t in _chunks(batches):
            kind, key = t.column("kind").to_numpy(), t.column("key").to_numpy()
            seq, above = kind == 1, kind == 0
            known, node, bit = levels(key[seq], t.column("n").to_numpy()[seq], length, TOP)
            so_far, weight = (t.column(c).to_numpy()[above] for c in ("so_far", "weight"))
            for k in range(len(known) - 1, 0, -1):
                so_far, weight = (x[known[k].up] for x in known[k].down(so_far, weight))
            ones = (so_far + weight * _one(known[0].zeros, known[0].ones))[node]
            logs = np.log10(np.where(bit == 1, ones, 1 - ones)).sum(1).astype(np.float32)
            keys = spread(key[seq].astype(np.uint64), length)
            order = np.argsort(keys)
            yield keys[order], logs[order].view(np.uint32)

    return told(dealt(seqs.unionByName(nodes)), top_down)


def _above(column: str):
    return F.shiftleft(F.shiftright(column, 16), 8).bitwiseOR(F.col(column).bitwiseAND(255))


def merged_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of two sorted arrays without common values in their sorted union."""
    at = np.searchsorted(b, a)
    other = np.ones(len(a) + len(b), bool)
    other[at + np.arange(len(a))] = False
    return at + np.arange(len(a)), np.flatnonzero(other)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2, length: int = LENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row.

    ``base_score`` is the smoothed word model, ``score`` log10 of the tree's probability of the lower-cased text and its end. Null and empty
    texts are an end alone; a null id counts as an empty one; repeated rows are learned and scored as often as they stand; other
    columns aren't looked at. Without training rows all estimates are even."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def asked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(keys of the words and ends, text of each, keys of the sequences, text of each)."""
        n = len(offsets) - 1
        w = Words(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        seq, text = sequences(data, offsets, np.ones(n, bool), length)
        doc = np.concatenate([np.repeat(np.arange(n), w.counts()), np.arange(n)])
        return np.concatenate([w.hash, np.full(n, _END_TOKEN)]) | np.uint64(1), doc, spread(seq, length), text

    def send(b: pa.RecordBatch):
        data, offsets = text_bytes(b.column("text"))
        data, offsets, ids = np.ascontiguousarray(data), np.ascontiguousarray(offsets, np.int64), b.column("doc_id").to_pylist()
        train = trained(ids, mod, rest)
        words, doc, seq, _ = asked(data, offsets)
        words, which = np.unique(words, return_inverse=True)
        seq = np.unique(seq)
        at_words, at_seq = merged_places(words, seq)
        keys, count = np.empty(len(words) + len(seq), np.uint64), np.zeros(len(words) + len(seq), np.uint32)
        keys[at_words], keys[at_seq] = words, seq
        count[at_words] = np.bincount(which, weights=train[doc], minlength=len(words))
        return pickle.dumps((ids, train, squeezed(data), offsets)), keys, count

    def answer(keys: np.ndarray, count: np.ndarray, seqs: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Of a sequence, the log of its last byte; of a word, twice its count, and one more for the first piece that asks, which counts the
        word as distinct."""
        out, word = np.empty(len(keys), np.uint64), np.flatnonzero(keys & np.uint64(1))
        order, start = grouped(keys[word])
        if len(word):
            total = np.add.reduceat(count[word][order].astype(np.uint64), start) * np.uint64(2)
            out[word[order]] = np.repeat(total, np.diff(np.append(start, len(word))))
            out[word[order[start]]] += np.uint64(1)
        rest = np.flatnonzero(keys & np.uint64(1) == 0)
        order = np.argsort(seqs)
        out[rest] = logs[order][np.searchsorted(seqs[order], keys[rest])]
        return out

    def finish(head: bytes, answers: np.ndarray) -> pa.RecordBatch:
        ids, train, data, offsets = pickle.loads(head)
        words, doc, seq, text = asked(restored(data, np.uint8), offsets)
        words, which = np.unique(words, return_inverse=True)
        seq, inverse = np.unique(seq, return_inverse=True)
        at_words, at_seq = merged_places(words, seq)
        told = answers[at_words]
        first = np.zeros(len(ids), np.int64)
        first[:1] = np.count_nonzero((told & np.uint64(1) > 0) & (told > 1))
        c = (told >> np.uint64(1)).astype(np.int64)[which]
        logs = answers[at_seq].astype(np.uint32).view(np.float32)[inverse]
        model = np.add.reduceat(logs, np.flatnonzero(np.diff(text, prepend=-1)), dtype=np.float64) if len(ids) else np.zeros(0)
        tokens = np.bincount(doc, minlength=len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(~train), pa.array(tokens), pa.array(np.bincount(doc, c > 0, len(ids)).astype(np.int64)),
            pa.array(np.bincount(doc, np.log10(c + 1.0), len(ids))), pa.array(model), pa.array(np.diff(offsets)), pa.array(first)],
            ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "size", "first_seen"])

    found = cut_lineage(round_trip(d, send, answer, finish,
                                   "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, size long, first_seen long",
                                   known=learn(d, mod, rest, length)))
    # tokens in training rows, and distinct ones
    n, v = found.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)), F.coalesce(F.sum("first_seen"), F.lit(0))).first()
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("size") + 1)).alias("bits_per_byte"))

"""Repeated passages by sparse suffix arrays.

Only suffixes at content-selected places are kept: the minimisers of windows of shingles, of which every passage of ``LEAST`` words
holds at least one, the same one in each copy. Those whose first shingle occurs once in the corpus are dropped. Around the
others, suffixes are extended to the left as far as the place may lie in a passage, sorted by their first ``LEAST`` words, and compared
with their neighbours; equal ones, joined where they overlap, are the maximal repeated passages."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage
from phenolake.llm.exchange import grouped, round_trip
from phenolake.llm.words import Words, gram_hashes

LEAST, SHINGLE = 50, 8
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i:i + width], by doubling."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = f(out[:-step], out[step:])
        have += step
    return out


def anchors(words: Words, least: int = LEAST, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(places, shingle hashes) of minimisers: the smallest hashes of every ``least - shingle + 1`` shingles of a text in a row."""
    n, width = len(words.hash), least - shingle + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.full(n, _MOST)
    g[:n - shingle + 1] = gram_hashes(words.hash, shingle) >> np.uint64(1)
    stop = np.repeat(words.first[1:], words.counts())
    whole = np.arange(n) + least <= stop  # a passage begins here and stays in its text
    low = np.where(whole, _sliding(g, width, np.minimum), 0)
    high = low.copy()  # the largest of the windows that reach a place
    have = 1
    while have < width:
        step = min(have, width - have)
        high[step:] = np.maximum(high[step:], high[:-step].copy())
        have += step
    at = np.flatnonzero((high == g) & (np.arange(n) + shingle <= stop))
    return at, g[at]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return d.withColumn("row_key", F.xxhash64("doc_id", "text"))  # a null id leaves the key to the text


def sparse_suffixes(docs: DataFrame, least: int, shingle: int) -> DataFrame:
    """doc_id, row_key, places of the kept suffixes whose first shingle begins another kept suffix too."""
    def send(b: pa.RecordBatch):
        w = Words(b.column("text"))
        at, g = anchors(w, least, shingle)
        doc = np.searchsorted(w.first, at, "right") - 1
        keys, which, count = np.unique(g, return_inverse=True, return_counts=True)
        head = pickle.dumps((b.column("doc_id"), b.column("row_key").to_numpy(), doc.astype(np.int32),
                             (at - w.first[doc]).astype(np.int32), which.astype(np.int32)))
        return head, keys, count

    def finish(head: bytes, answers: np.ndarray) -> pa.RecordBatch:
        ids, row_keys, doc, place, which = pickle.loads(head)
        again = answers[which] > 0 if len(which) else np.zeros(0, bool)
        doc, place = doc[again], place[again]
        rows, first = np.unique(doc, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(place))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(row_keys[rows], pa.int64()), lists], ["doc_id", "row_key", "places"])

    return round_trip(docs, send, repeated, finish, "doc_id long, row_key long, places array<int>")


def repeated(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sorts what a range got and compares neighbours: 1 for keys that stand there more than once."""
    order, start = grouped(keys)
    total = np.add.reduceat(count[order].astype(np.int64), start)
    out = np.empty(len(keys), np.uint64)
    out[order] = np.repeat(total > 1, np.diff(np.append(start, len(keys))))
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, first_word, n_words of each maximal run of words that are all in passages of ``least`` words (lower-cased, between white
    space) found at two places or more of the corpus, the same text included.

    Null and short texts have none; repeated rows repeat each other; rows without an id count as copies, but have no rows of their own, as
    nothing could name them; other columns aren't looked at."""
    d = _keyed(docs, id_col, text_col)
    places = cut_lineage(sparse_suffixes(d, least, shingle).groupBy("doc_id", "row_key").agg(F.first("places").alias("places")))
    at = places.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "places")
    near = d.join(at, (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_key")  # lists of places have no size bound, so nothing is broadcast by hint

    def send(b: pa.RecordBatch):
        w = Words(b.column("text"))
        n = len(w.hash)
        reach = np.zeros(n + 1, np.int64)
        lists = b.column("places")
        doc = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        at = w.first[doc] + lists.flatten().to_numpy()
        np.add.at(reach, np.maximum(at - (least - shingle), w.first[doc]), 1)
        np.add.at(reach, at + 1, -1)
        begins = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        doc = np.searchsorted(w.first, begins, "right") - 1
        ok = begins + least <= w.first[doc + 1]
        begins, doc = begins[ok], doc[ok]
        keys, which, count = np.unique(gram_hashes(w.hash, least)[begins] if len(begins) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        head = pickle.dumps((b.column("doc_id"), doc.astype(np.int32), (begins - w.first[doc]).astype(np.int32), which.astype(np.int32)))
        return head, keys, count

    def finish(head: bytes, answers: np.ndarray) -> pa.RecordBatch:
        ids, doc, begin, which = pickle.loads(head)
        again = answers[which] > 0 if len(which) else np.zeros(0, bool)
        doc, begin = doc[again], begin[again]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + least)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(doc)) - 1
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[first], pa.int64())), pa.array(begin[first].astype(np.int64)),
                                           pa.array((begin[last] + least - begin[first]).astype(np.int64) if len(first) else np.zeros(0, np.int64))],
                                          ["doc_id", "first_word", "n_words"])

    return round_trip(near, send, repeated, finish, "doc_id long, first_word long, n_words long").filter("doc_id IS NOT NULL")

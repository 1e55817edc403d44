"""Document fingerprints: one-permutation MinHash with optimal densification, low-order bits packed, likeness corrected for chance hits.

Each shingle is hashed once: the high bits name its bin, the rest is its value, and a bin keeps the smallest value. An empty bin copies the
bin that its own fixed, random order of bins reaches first (the same order for every document, so equal sets stay equal), which makes
any two documents agree in a bin with the probability of their Jaccard similarity. Only the lowest bits of each value are stored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage, give_back, parts_of, pieces
from phenolake.llm.words import Words, gram_hashes, mix

BINS = 256  #: a power of two
BITS = 4  #: stored of each bin: 1, 2, 4 or 8
WIDTH = 5  #: words of a shingle
_ROWS = 2048  #: texts whose bins are held at once
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_FIRST, _LAST = 1, 2  #: rows at the ends of a task, whose neighbour is in another one


def probe_order(bins: int) -> np.ndarray:
    """Row j: the fixed order in which bin j, if empty, tries all bins."""
    return np.argsort(mix(np.arange(1, bins * bins + 1, dtype=np.uint64).reshape(bins, bins) * np.uint64(0x9E3779B97F4A7C15)), axis=1, kind="stable")


def shingle_hashes(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle; fewer words than ``width`` are one shingle, no words none."""
    w = Words(texts)
    n = w.counts()
    of = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(of)) + width <= w.first[of + 1]
    grams = w.grams(width)
    at = np.flatnonzero(whole[:len(grams)])
    hashes, owners = [grams[at]], [of[at]]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            rows = w.hash[w.first[short][:, None] + np.arange(k)].reshape(-1)
            hashes.append(gram_hashes(rows, k)[::k])
            owners.append(short)
    return np.concatenate(hashes), np.concatenate(owners)


def bins_of(hashes: np.ndarray, owners: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n x bins: the smallest value of each bin, all ones if it is empty."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    out = np.full(n * bins, _NONE)
    np.minimum.at(out, owners * bins + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    return out.reshape(n, bins)


def densify(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fills empty bins; a document without any shingle keeps all of them empty."""
    empty, out = values == _NONE, values.copy()
    doc, bin_ = np.nonzero(empty & ~empty.all(axis=1, keepdims=True))
    turn = 0
    while len(doc):  # each order holds every bin, so it ends at a filled one
        source = order[bin_, turn]
        hit = ~empty[doc, source]
        out[doc[hit], bin_[hit]] = values[doc[hit], source[hit]]
        doc, bin_, turn = doc[~hit], bin_[~hit], turn + 1
    return out


def sketches(texts: pa.Array, order: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Packed fingerprints; of a text without words no bytes."""
    out, bins = [], len(order)
    for at in range(0, len(texts), _ROWS):
        part = texts.slice(at, _ROWS)
        values = bins_of(*shingle_hashes(part), len(part), bins)
        low = (densify(values, order) & np.uint64((1 << bits) - 1)).astype(np.uint8)
        packed = np.packbits((low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1, axis=None).reshape(len(part), -1)
        out += [b"" if none else row.tobytes() for row, none in zip(packed, (values == _NONE).all(axis=1))]
    return out


def likeness(a: list[bytes], b: list[bytes], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarities of pairs of fingerprints: the share of equal bins less what unlike values share by chance.
    Two empty fingerprints are alike, an empty one and another are not."""
    width = bins * bits // 8
    raw = lambda x: np.frombuffer(b"".join(v or bytes(width) for v in x), np.uint8).reshape(len(x), width)
    unlike = np.unpackbits(raw(a) ^ raw(b), axis=1).reshape(len(a), bins, bits).any(axis=2)
    chance = 2.0 ** -bits
    out = np.clip((1.0 - unlike.mean(axis=1) - chance) / (1.0 - chance), 0.0, 1.0)
    bare = np.array([(not x) + (not y) for x, y in zip(a, b)])
    return np.where(bare == 2, 1.0, np.where(bare == 1, 0.0, out))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the following one."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


_DONE = ("n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")
_SCHEMA = "part int, place int, id {0}, text string, " + _DONE


def _finished(ids, texts: list[str], prints: list[bytes], following: list[str], following_prints: list[bytes], order: np.ndarray, bits: int) -> dict:
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    own = sketches(pa.array(edited, pa.string()), order, bits)
    bins = len(order)
    return {"id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": prints, "edited_fingerprint": own, "near_edited": likeness(prints, own, bins, bits),
            "near_next": likeness(prints, following_prints, bins, bits)}


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row; other columns are left out.

    The next document is the next one by id (null ids first; of one id by the digest of the text, equal rows in any order); the first
    follows the last, so a single row follows itself. Rows are sorted once by ranges and read as streams: a task finishes all rows but its last,
    and the ends of all tasks, two rows each, are finished afterwards. Null and empty texts have an empty fingerprint. A long text is held
    alone, by the task that reads it. No rows give no rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumns(
        {"tie": F.md5(F.col("text").cast("binary")), "spread": F.monotonically_increasing_id()})
    keys = ["id", "tie", "spread"]  # rows equal in id and text are spread over ranges too
    dealt = rows.repartitionByRange(parts_of(docs.sparkSession, 1), *keys).sortWithinPartitions(*keys).select("id", "text")
    schema = _SCHEMA.format(kind)

    def run(batches: Iterator[pa.RecordBatch]):
        order, part, tail = probe_order(bins), TaskContext.get().partitionId(), None
        arrow = None

        def emit(cols: dict, place: int, texts: list | None = None):
            n = len(cols["id"])
            full = {"part": [part] * n, "place": [place] * n, "text": texts or [None] * n} | cols
            return pa.RecordBatch.from_arrays([pa.array(full[f.name], f.type) if f.name in full else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        for piece in pieces(batches):
            arrow = arrow or pa.schema([("part", pa.int32()), ("place", pa.int32()), ("id", piece.schema.field("id").type), ("text", pa.string()), ("n_chars", pa.int64()),
                                        ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
            ids, texts, prints = piece.column("id").to_pylist(), piece.column("text").to_pylist(), sketches(piece.column("text"), order, bits)
            if tail is None:
                yield emit({"id": ids[:1], "fingerprint": prints[:1]}, _FIRST, texts[:1])
            else:
                ids, texts, prints = [tail[0], *ids], [tail[1], *texts], [tail[2], *prints]
            tail = ids[-1], texts[-1], prints[-1]
            if len(ids) > 1:
                yield emit(_finished(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:], order, bits), 0)
            del ids, texts, prints
            give_back()
        if tail is not None:
            yield emit({"id": [tail[0]], "fingerprint": [tail[2]]}, _LAST, [tail[1]])

    told = cut_lineage(dealt.mapInArrow(run, schema))
    firsts = told.filter(F.col("place") == _FIRST).select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    numbers = firsts.select("part")  # one row a task
    after = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    lasts = (told.filter(F.col("place") == _LAST).select("part", "id", "text", "fingerprint").join(after, "part")
             .join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("id", "text", "fingerprint", "next_text", "next_print"))
    names = ["id", *[c.strip().split()[0] for c in _DONE.split(",")]]

    def close(batches: Iterator[pa.RecordBatch]):
        order = probe_order(bins)
        for b in batches:
            c = b.to_pydict()
            done = _finished(c["id"], c["text"], c["fingerprint"], c["next_text"], c["next_print"], order, bits)
            yield pa.RecordBatch.from_arrays([pa.array(done["id"], b.schema.field("id").type), pa.array(done["n_chars"], pa.int64()), pa.array(done["edited_sha256"], pa.string()),
                                              pa.array(done["fingerprint"], pa.binary()), pa.array(done["edited_fingerprint"], pa.binary()),
                                              pa.array(done["near_edited"]), pa.array(done["near_next"])], names=names)

    return told.filter(F.col("place") == 0).select(*names).unionByName(lasts.mapInArrow(close, f"id {kind}, {_DONE}"))

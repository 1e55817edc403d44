"""Questions that pieces of the corpus ask all others about hashed keys, as two shuffles of packed rows.

A piece sends each of its distinct keys once to the range that the key falls in, and what it needs to use the answers (its head) on
the way to itself; ranges answer key by key; answers and head meet again. A key that every document holds is one number a piece, so
no task sees the rows of a frequent key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame

from phenolake.llm.common import give_back, parts_of, pieces

_SCHEMA = "part int, piece long, place int, keys binary, data binary"
_ARROW = pa.schema([("part", pa.int32()), ("piece", pa.int64()), ("place", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())])
_HEAD, _KNOWN = -1, -2


def squeezed(x: np.ndarray, steps: bool = False) -> bytes:
    """Numbers (of sorted ones the ``steps`` between them) byte by byte place, compressed: near keys and equal counts cost little on disk."""
    x = np.diff(x, prepend=x.dtype.type(0)) if steps else x
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def restored(raw: bytes, kind: type, steps: bool = False) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"), np.uint8)
    x = np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if steps else x


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the ``parts`` key ranges in sorted keys."""
    cuts = (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts) << np.uint64(32)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


def told(df: DataFrame, tell: Callable, times: int = 1) -> DataFrame:
    """What ranges know besides the questions, for ``round_trip``: ``tell(batches)`` yields (sorted unique uint64 keys, uint32 data)."""
    parts = parts_of(df.sparkSession, times)

    def run(batches: Iterator[pa.RecordBatch]):
        for keys, data in tell(batches):
            at = ranges(keys, parts)
            rows = [(p, 0, _KNOWN, squeezed(keys[at[p]:at[p + 1]], True), squeezed(data[at[p]:at[p + 1]])) for p in range(parts) if at[p + 1] > at[p]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            give_back()

    return df.mapInArrow(run, _SCHEMA)


def round_trip(df: DataFrame, send: Callable, answer: Callable, finish: Callable, schema: str, times: int = 1, known: DataFrame | None = None) -> DataFrame:
    """With ``known`` (of ``told``), ``answer`` also gets the keys and the data told to the range, and what travels is squeezed.

    ``send(piece) -> (head bytes, sorted unique uint64 keys, uint32 data)``; ``answer(keys, data) -> uint64 answers`` for the keys of a range
    with the data of all pieces, repeated keys included; ``finish(head, answers) -> RecordBatch`` with ``answers`` along the piece's keys."""
    parts, informed = parts_of(df.sparkSession, times), known is not None

    pack = (lambda x, steps=False: squeezed(x, steps)) if informed else (lambda x, steps=False: x.tobytes())
    read = (lambda x, kind, steps=False: restored(x, kind, steps)) if informed else (lambda x, kind, steps=False: np.frombuffer(x, kind))

    def sending(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get().partitionId() << 32  # a task that is run again reads the same split, so its pieces keep their numbers
        for k, b in enumerate(pieces(batches)):
            head, keys, data = send(b)
            at = ranges(keys, parts)
            rows = [((task >> 32) % parts, task + k, _HEAD, b"", head)]
            rows += [(p, task + k, p, pack(keys[at[p]:at[p + 1]], True), pack(data[at[p]:at[p + 1]].astype(np.uint32)))
                     for p in range(parts) if at[p + 1] > at[p]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def answering(group: pa.Table) -> pa.Table:
        give_back()
        head = group.filter(pa.compute.equal(group.column("place"), _HEAD))
        asked = group.filter(pa.compute.greater_equal(group.column("place"), 0))
        more = group.filter(pa.compute.equal(group.column("place"), _KNOWN))
        if not len(asked):
            return head
        asked = asked.sort_by("piece")  # the order of the answers doesn't depend on that of the fetches
        keys = [read(x, np.uint64, True) for x in asked.column("keys").to_pylist()]
        data = [read(x, np.uint32) for x in asked.column("data").to_pylist()]
        more = [np.concatenate([read(x, kind, steps) for x in more.column(c).to_pylist()] or [np.zeros(0, kind)])
                for c, kind, steps in (("keys", np.uint64, True), ("data", np.uint32, False)) if informed]
        found = answer(np.concatenate(keys), np.concatenate(data), *more)
        ends = np.cumsum([len(k) for k in keys])
        wide = [bool(found[e - len(k):e].max() >> np.uint64(32)) for e, k in zip(ends, keys)]
        replies = [pack(found[e - len(k):e].astype(np.uint64 if w else np.uint32)) for e, k, w in zip(ends, keys, wide)]
        out = pa.Table.from_arrays([asked.column("part"), asked.column("piece"), asked.column("place"),
                                    pa.array([b"w" if w else b"" for w in wide], pa.binary()), pa.array(replies, pa.binary())], schema=_ARROW)
        return pa.concat_tables([head.cast(_ARROW), out])

    def finishing(group: pa.Table) -> pa.Table:
        give_back()
        order = np.argsort(group.column("place").to_numpy())
        data, wide = group.column("data").to_pylist(), group.column("keys").to_pylist()
        head, rest = data[order[0]], [read(data[i], np.uint64 if wide[i] else np.uint32).astype(np.uint64) for i in order[1:]]
        return pa.Table.from_batches([finish(head, np.concatenate(rest) if rest else np.zeros(0, np.uint64))])

    sent = df.mapInArrow(sending, _SCHEMA)
    return (sent if known is None else sent.unionByName(known)).groupBy("part").applyInArrow(answering, _SCHEMA).groupBy("piece").applyInArrow(finishing, schema)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each run of equal keys) of keys once sorted."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)

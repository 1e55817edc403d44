"""Words of whole Arrow text columns as NumPy arrays: one pass over the bytes of a batch, no loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = bytes([0x20, *range(0x09, 0x0E)])  #: separators of ``[^\x20\x09-\x0D]+``
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])  #: of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, once lower-cased

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a batch: ``hash``, byte ``start`` and ``end`` of each, and ``first[i]:first[i + 1]`` for text i."""

    def __init__(self, column, separators: bytes = SPACE):
        data, self.offsets = text_bytes(column)
        self.data = _LOWER[data]
        is_word = np.ones(256, bool)
        is_word[list(separators)] = False
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = is_word[self.data]
        fresh = inside[:-1].copy()
        fresh[1:] &= ~inside[:-2]
        cuts = self.offsets[1:-1][self.offsets[1:-1] < len(data)]
        fresh[cuts] = inside[cuts]  # a text begins a word even where the one before ended in one
        self.start = np.flatnonzero(fresh)
        stop = ~inside[1:]
        stop[self.offsets[1:][self.offsets[1:] > 0] - 1] = True
        self.end = np.flatnonzero(inside[:-1] & stop) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hashes(len(data))

    def _hashes(self, n: int, chunk: int = 1 << 22) -> np.ndarray:
        """Polynomial of the bytes of each word, mixed; sums over chunks of the batch keep the memory small."""
        out, s, e = np.zeros(len(self.start), np.uint64), self.start, self.end
        longest = int((e - s).max()) if len(s) else 0
        power = powers(min(longest, 64))
        if longest <= 64:
            for k in range(longest):  # words by length: the k-th byte of each that has one
                has = np.flatnonzero(e - s > k) if k else np.arange(len(s))
                out[has] += (self.data[s[has] + k].astype(np.uint64) + np.uint64(1)) * power[k]
        else:
            short = np.flatnonzero(e - s <= 64)
            for k in range(64):
                has = short[e[short] - s[short] > k]
                out[has] += (self.data[s[has] + k].astype(np.uint64) + np.uint64(1)) * power[k]
            for i in np.flatnonzero(e - s > 64):
                w = self.data[s[i]:e[i]].astype(np.uint64) + np.uint64(1)
                out[i] = (w * powers(len(w) - 1)).sum()
        return mix(out + (e - s).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the caller leaves out those that leave their text."""
        if len(self.hash) < k:
            return np.zeros(0, np.uint64)
        return gram_hashes(self.hash, k)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    n, out = len(h) - k + 1, np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = out * _BASE + h[j:j + n]
    return mix(out)

"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items scans each text once.

Text is normalised to its words with one blank on either side, so that a match is a match of whole words; hits are mapped back to
word numbers, and to character offsets of the original text."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolake.llm.common import pieces
from phenolake.llm.words import NOT_ALNUM

WINDOW = 13
BLOCK_BYTES = 1 << 19  #: item text for one automaton (a trie of about WINDOW times that many nodes); a larger benchmark takes several

_TABLE = bytes(0x20 if c in NOT_ALNUM else c for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                     T.StructField("items", T.ArrayType(T.StringType())),
                     T.StructField("spans", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in (
                         "first_word", "n_words", "start", "end")])))])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct(
    [(k, pa.int64()) for k in ("first_word", "n_words", "start", "end")])))])


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes beyond ASCII belong to words, so UTF-8 needs no decoding."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


@dataclass
class Matcher:
    """Windows of items, by normalised text."""

    windows: dict[str, list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, str]], width: int) -> Matcher:
        found: dict[str, dict[str, None]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - width + 1) if w else 0):
                found.setdefault(_joined(w[i:i + width]), {})[item] = None
        return cls({k: list(v) for k, v in found.items()})

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for window in self.windows:
            a.add_word(window, window)
        if self.windows:
            a.make_automaton()
        return a


def _joined(w: list[bytes]) -> str:
    return (b" " + b" ".join(w) + b" ").decode("latin-1")


def scan(text: str, automaton, matcher: Matcher, before: dict | None) -> dict:
    """Hits in one text, added to those that earlier automata found."""
    w = words(text)
    out = before or {"n_words": len(w), "n_hit": 0, "items": [], "spans": []}
    if not w or not matcher.windows:
        return out
    line = _joined(w)
    matches = list(automaton.iter(line))
    if not matches:
        return out
    blanks, at = [], line.find(" ")
    while at >= 0:
        blanks.append(at)
        at = line.find(" ", at + 1)
    runs = [(s["first_word"], s["first_word"] + s["n_words"]) for s in out["spans"]]
    items = set(out["items"])
    for end, window in matches:
        stop = bisect.bisect_left(blanks, end)
        runs.append((stop - window.count(" ") + 1, stop))
        items.update(matcher.windows[window])
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    places = [m.span() for m in _WORD.finditer(text)]
    return {"n_words": len(w), "n_hit": sum(b - a for a, b in merged), "items": sorted(items), "spans": [
        {"first_word": a, "n_words": b - a, "start": places[a][0], "end": places[b - 1][1]} for a, b in merged]}


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, hits): every row of ``docs`` as a struct, with n_words, n_hit, items and spans of its text.

    Null or wordless texts have no words and no hits; items without an id or a word match nothing; items with one id are one item, and
    repeated windows count once. Rows aren't moved or merged, so repeated rows and clashing column names do no harm."""
    sized = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(None).cast(HITS).alias("hits"))
    for k in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(
            [(i.as_py(), t.as_py()) for i, t in zip(part.column("item"), part.column("text"))])
        out = out.mapInArrow(_scanner(sent, text_col, width), out.schema)
    return out


def _scanner(sent, text_col: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        matcher = Matcher.of(sent.value, width)
        automaton = matcher.automaton()
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text_col), batch.column("hits")], ["row", "text", "hits"])
            for b in pieces([flat]):
                hits = [scan(t or "", automaton, matcher, h) for t, h in zip(b.column("text").to_pylist(), b.column("hits").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(hits, _ARROW)], ["row", "hits"])
    return run


def contaminated(hits: str = "hits"):
    return (F.col(f"{hits}.n_hit") > 0) & (20 * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    return mark(docs, items, **names).filter(~contaminated()).select("row.*")

"""Language identification by cross-parsing: a suffix automaton of labelled text for each language parses a text into longest matches, and
the language whose phrases cost least wins: a phrase names a place in the language's sample, so its cost is the logarithm of the sample's
size."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolake.llm.common import pieces
from phenolake.llm.toxicity import held_out

SAMPLE_BYTES = 32_000  #: of labelled text that each language's automaton is built from
SAMPLE_ROWS, STRETCH = 1024, 2000  #: distinct labelled texts a language that may be gathered for that, at most, and characters of each
FIRST_LOOK = 64  #: rows of a language that the first pass is expected to see
STRIDE = 256  #: a text is parsed in stretches of so many bytes, all of a piece at once
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def plain(text: str | None) -> bytes:
    """Lower-cased letters with one blank between words, in UTF-8."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_OTHER).split())


def automaton(text: bytes, classes: np.ndarray) -> np.ndarray:
    """Transitions [state, class] of the suffix automaton of ``text``; -1 where no occurrence goes on, state 0 is the empty match."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in classes[np.frombuffer(text, np.uint8)].tolist():
        new = len(steps)
        steps.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(steps), int(classes.max()) + 1), -1, np.int32)
    for s, to in enumerate(steps):
        for c, t in to.items():
            out[s, c] = t
    return out


@dataclass
class Parsers:
    languages: list[str]
    classes: np.ndarray  #: class of each byte; 0 is in no sample
    tables: np.ndarray  #: transitions of all languages one after the other
    roots: np.ndarray
    bits: np.ndarray  #: of a phrase, by language: the logarithm of the sample's size

    @classmethod
    def of(cls, samples: dict[str, bytes]) -> Parsers:
        languages = sorted(samples)
        classes = np.zeros(256, np.uint8)
        seen = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8))
        classes[seen] = np.arange(1, len(seen) + 1)
        tables, roots, at = [], [], 0
        for name in languages:
            t = automaton(samples[name], classes)
            width = int(classes.max()) + 1
            t = np.pad(t, ((0, 0), (0, width - t.shape[1])), constant_values=-1)
            t[:, 0] = -1
            tables.append(np.where(t >= 0, t + at, -1)), roots.append(at)
            at += len(t)
        return cls(languages, classes, np.concatenate(tables) if tables else np.zeros((0, 1), np.int32), np.array(roots, np.int64),
                   np.log2([len(samples[k]) + 2 for k in languages]) if languages else np.zeros(0))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: phrases of the greedy parse, stretch by stretch; a byte of no sample is a phrase of its own."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        size = np.array([len(t) for t in texts])
        per = -(-size // STRIDE)
        if not per.sum():
            return out
        data = np.zeros(int(per.sum()) * STRIDE, np.uint8)
        start = np.concatenate([[0], np.cumsum(per)[:-1]]) * STRIDE
        flat = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        data[np.arange(len(flat)) + np.repeat(start - (np.cumsum(size) - size), size)] = flat
        grid = np.ascontiguousarray(data.reshape(-1, STRIDE).T)
        owner = np.repeat(np.arange(len(texts)), per)
        used = np.minimum(STRIDE, np.repeat(size, per) - (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE)
        order = np.argsort(-used, kind="stable")
        grid, used = grid[:, order], used[order]
        width, steps = self.tables.shape[1], self.tables.ravel()
        for k, root in enumerate(self.roots):
            state = np.full(len(used), root, np.int64)
            count = np.ones(len(used), np.int64)
            live = np.searchsorted(-used, -np.arange(STRIDE), "left")
            for i in range(STRIDE):
                n = live[i]
                if not n:
                    break
                c = grid[i, :n]
                to = steps[state[:n] * width + c]
                missed = np.flatnonzero(to < 0)
                if len(missed):
                    again = steps[root * width + c[missed]]
                    to[missed] = np.where(again < 0, root, again)
                    count[missed] += state[missed] != root  # a phrase ends, unless none has begun
                    count[missed] += again < 0
                state[:n] = to
            np.add.at(out[:, k], owner[order], count)
        return out

    def predict(self, texts: list[str | None]) -> list[dict]:
        found = self.phrases([plain(t) for t in texts])
        out = []
        for t, row in zip(texts, found):
            if not self.languages or not _LETTER.search(t or ""):
                out.append({"lang_pred": UNKNOWN, "score": 0.0})
                continue
            cost = row * self.bits  # a phrase costs the bits that name its place in the sample
            best = int(cost.argmin())
            rest = np.delete(cost, best)
            gap = (rest.min() - cost[best]) / math.sqrt((rest.min() + cost[best]) * float(self.bits.max())) if len(rest) else math.inf
            out.append({"lang_pred": self.languages[best], "score": 1 / (1 + math.exp(-min(gap, 700.0)))})
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, rest: int = 2) -> Parsers:
    """Automata from labelled rows whose crc32(id) mod ``mod`` isn't ``rest``, SAMPLE_BYTES a language.

    Distinct texts are drawn by a digest of language and text, so neither a repeated id nor a repeated text fills a sample, until every language has
    its bytes or all of its texts: the share of the digests that is looked at grows eightfold a pass, and what comes back is at most SAMPLE_ROWS stretches of
    STRETCH characters a language. A long text gives the stretch that its digest points to, from anywhere in it."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").filter(~held_out(F.col("id"), mod, rest))
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Parsers.of({})
    digest = F.md5(F.concat_ws("|", "lang", "text").cast("binary"))
    part = lambda at: F.conv(F.substring("digest", at, 12), 16, 10).cast("double") / float(16 ** 12)
    spare = F.greatest(F.length("text") - STRETCH, F.lit(0))
    keyed = d.select("lang", "text", digest.alias("digest")).select(
        "lang", "digest", part(1).alias("rank"), "text", spare.alias("spare"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    share = {k: min(1.0, FIRST_LOOK / n) for k, n in counts.items()}
    while True:
        seen = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
        few = keyed.filter(F.col("rank") < seen).withColumn("stretch", F.substring("text", F.floor(part(13) * (F.col("spare") + 1)).cast("int") + 1, F.lit(STRETCH)))
        few = few.groupBy("lang", "digest").agg(F.first("stretch").alias("stretch"))
        got: dict[str, list[bytes]] = {k: [] for k in counts}
        for r in few.withColumn("place", place).filter(F.col("place") <= SAMPLE_ROWS).orderBy("lang", "place").collect():
            got[r["lang"]].append(plain(r["stretch"]))
        samples = {k: b" ".join(v)[:SAMPLE_BYTES] for k, v in got.items()}
        short = [k for k, v in samples.items() if len(v) < SAMPLE_BYTES and len(got[k]) < SAMPLE_ROWS and share[k] < 1.0]
        if not short:
            return Parsers.of({k: v for k, v in samples.items() if v})
        share |= {k: min(1.0, share[k] * 8) for k in short}


def identify(docs: DataFrame, parsers: Parsers, text_col: str = "text") -> DataFrame:
    """(row, language): every row of ``docs`` as a struct with lang_pred and score. Null texts, and texts without a letter, are ``und`` with
    score 0; ties go to the first language by name; rows stay as they are, so repeats and clashing names do no harm."""
    sent = docs.sparkSession.sparkContext.broadcast(parsers)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text_col)], ["row", "text"])
            for b in pieces([flat]):
                found = sent.value.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))],
                                                 ["row", "language"])

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField("language", RESULT)]))

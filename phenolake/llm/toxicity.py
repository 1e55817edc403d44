"""Toxicity by maximum-scoring segments.

Tokens get log-odds of toxic against clean documents under an informative Dirichlet prior; a scan in linear time finds all maximal
scoring segments of a text (toxic passages), whose scores extreme-value statistics make comparable between lengths; a logistic
curve on other labelled rows turns them into a probability."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolake.llm.common import cut_lineage, let, pieces

LABELLED = 24_000  #: labelled rows that the classifier is fitted on, at most; the first ones by digest of their id
PRIOR, LEAST_PRIOR = 200.0, 0.5  #: weight of the prior, in incidences of all tokens, and of one token at least
LEAST_Z, LEAST_SEEN, LEAST_ODDS = 4.7, 3, 1.0  #: evidence of a token that scores above the drift
LEAST_DRIFT = 0.002  #: what a token without evidence takes off a segment, at least
HIGHEST = 7.0  #: log-odds of one token, at most
FIT_TASKS = 64  #: tasks that share the sample: it is written in few files, but its texts hold all pairs of words that are counted
PREFIX, PREFIX_WORDS = (3, 4, 5, 6, 7, 8), 4  #: beginnings of words count as tokens if so many words share them
THRESHOLD = 0.7
_CACHE = 300_000

_WORD = re.compile(r"[^\W\d_]+")
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(T.StructType([
    T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])))])
_ARROW = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct(
    [("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])))])


def segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence that is ``-drift`` but for the given places, in time linear in
    those. Candidates keep the sum before and after them; a new one swallows those that it can raise."""
    kept: list[tuple[int, int, float, float]] = []
    total, last = 0.0, -1
    for i, s in zip(at, scores):
        total -= drift * (i - last - 1)
        first, before, after = i, total, total + s
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][2] >= before:
                k -= 1
            if k < 0 or kept[k][3] >= after:
                break
            first, before = kept[k][0], kept[k][2]
            del kept[k:]
        kept.append((first, i, before, after))
        total, last = total + s, i
    return [(a, b, z - y) for a, b, y, z in kept]


@dataclass
class Model:
    odds: dict[str, tuple[float, float]]  #: token, or beginning followed by "*" -> (log-odds, z)
    drift: float = 0.02  #: minus the log-odds of a token without evidence
    decay: float = 1.0  #: lambda of the extreme-value law of clean text
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)  #: logistic coefficients
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def token(self, word: str) -> float:
        """Log-odds of the best supported of a word and its beginnings; 0 without evidence."""
        s = self._known.get(word)
        if s is None:
            found = [self.odds[k] for k in (word, *(word[:n] + "*" for n in PREFIX if n <= len(word))) if k in self.odds]
            s = max(found, key=lambda x: x[1])[0] if found else 0.0
            if len(self._known) >= _CACHE:
                self._known.clear()
            self._known[word] = s
        return s

    def hits(self, text: str | None) -> tuple[int, list[int], list[float]]:
        """(words, places and scores of those with evidence)."""
        words = _WORD.findall((text or "").lower())
        scores = [self._known[w] if w in self._known else self.token(w) for w in words]
        at = [i for i, s in enumerate(scores) if s > 0]
        return len(words), at, [scores[i] for i in at]

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        n, at, scores = self.hits(text)
        return n, segments(at, scores, self.drift)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Significance of the passages for a text of this length, all together and of those that clean text wouldn't show; 0 without any."""
        bits = [self.decay * s - math.log(n + 1.0) for _, _, s in found]
        return float(np.logaddexp.reduce([0.0, *bits])), math.log1p(sum(b for b in bits if b > 0))

    def probability(self, n: int, found) -> float:
        best, total = self.evidence(n, found)
        x = self.curve[0] + self.curve[1] * best + self.curve[2] * total
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x))))

    def score(self, text: str | None) -> dict:
        n, found = self.passages(text)
        return {"score": self.probability(n, found), "passages": [{"first_word": a, "n_words": b - a + 1, "score": s} for a, b, s in found]}


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        labelled: int = LABELLED, mod: int = 3, rest: int = 1) -> Model:
    """Model from labelled rows whose crc32(id) mod ``mod`` isn't ``rest``; three quarters give the log-odds, the others the curve.
    Rows without an id, a label or a text teach nothing. Without both classes there is no evidence, and every score is the base rate."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(F.col(id_col), mod, rest))
             .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")))
    known = known.withColumn("h", F.md5(F.col(id_col).cast("string").cast("binary"))).orderBy("h").limit(labelled)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    part = F.substring("h", 32, 1).isin(*"048c")
    # copies of a text teach once; at most ``labelled`` rows are left
    sample = cut_lineage(rows.join(F.broadcast(known), id_col).select("text", "label", part.alias("other")).groupBy(F.md5(F.col("text").cast("binary")).alias("t"))
                         .agg(F.max("label").alias("label"), F.first("other").alias("other"), F.first("text").alias("text")))
    # a word is counted once after each other word, so that near copies and common lines don't add up
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))
    after = let(words, lambda w: F.array_distinct(F.transform(w, lambda x, i: F.struct(F.coalesce(F.get(w, i - 1), F.lit("")).alias("before"), x.alias("word")))))
    by_word = (sample.filter(~F.col("other")).repartition(FIT_TASKS, "t").select("label", F.explode(after).alias("p"))
               .select("label", "p.*").distinct().groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")))
    by_word = cut_lineage(by_word)
    starts = by_word.select("word", "a", "b", F.explode(F.array(*map(F.lit, PREFIX))).alias("n")).filter(F.char_length("word") >= F.col("n"))
    starts = (starts.groupBy(F.concat(F.col("word").substr(F.lit(1), F.col("n")), F.lit("*")).alias("word"))
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")).filter(F.col("n") >= PREFIX_WORDS).drop("n"))
    sums = by_word.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not sums[0] or not sums[1]:
        odds: dict[str, tuple[float, float]] = {}
    else:
        odds = {r["word"]: (min(HIGHEST, r["d"]), r["z"]) for r in log_odds(by_word.unionByName(starts), sums[0], sums[1]).collect()}
    model = Model(odds)
    shown = sample.filter("other").mapInArrow(_rows(docs, model), "label int, n long, places array<long>, scores array<double>").collect()
    _calibrate(model, shown)
    return model


def log_odds(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(word, d, z) of words with evidence for toxic: log-odds with a Dirichlet prior in the proportions of all text; evidence is the root of
    the likelihood ratio, which holds for rare words too."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    prior = PRIOR * (a + b) / float(toxic + clean) + LEAST_PRIOR
    d = (F.log((a + prior) / (toxic + PRIOR - a - prior)) - F.log((b + prior) / (clean + PRIOR - b - prior)))

    def part(x: Column, n: int) -> Column:
        return F.when(x > 0, x * F.log(x * float(toxic + clean) / ((a + b) * float(n)))).otherwise(0.0)

    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(a, toxic) + part(b, clean))))
    return (counts.filter(a >= LEAST_SEEN).select("word", d.alias("d"), z.alias("z"))
            .filter((F.col("z") >= LEAST_Z) & (F.col("d") >= LEAST_ODDS)))


def _rows(docs: DataFrame, model: Model):
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = sent.value
        for b in pieces(batches):
            n, places, scores = zip(*map(m.hits, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int64())),
                                              pa.array(scores, pa.list_(pa.float64()))], ["label", "n", "places", "scores"])
    return run


def _calibrate(model: Model, rows: list) -> None:
    """Drift from the shares of tokens with evidence in both classes, decay of the extreme-value law from the token scores of clean rows,
    then the logistic curve; all from a bounded sample."""
    parts = {y: [r for r in rows if r["label"] == y] for y in (0, 1)}
    share = {y: (sum(len(r["scores"]) for r in part) + 1.0) / (sum(r["n"] for r in part) + 1000.0) for y, part in parts.items()}
    model.drift = max(LEAST_DRIFT, math.log((1 - share[0]) / (1 - min(0.9, share[1]))))
    n, hits = sum(r["n"] for r in parts[0]), [x for r in parts[0] for x in r["scores"]]
    miss = max(n - len(hits), 1)

    def excess(lam: float) -> float:  # expectation of exp(lam * score), less one
        return (miss * math.exp(-lam * model.drift) + sum(math.exp(lam * x) for x in hits or [HIGHEST]) ) / (miss + max(len(hits), 1)) - 1.0

    lo, hi = 1e-3, 8.0
    if excess(lo) < 0 < excess(hi):
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
        model.decay = lo
    y = np.array([r["label"] for r in rows], float)
    if not len(y):
        return
    ev = [model.evidence(r["n"], segments(r["places"], r["scores"], model.drift)) for r in rows]
    x = np.array([[1.0, a, t] for a, t in ev])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    model.curve = tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, toxicity): every row of ``docs`` as a struct with its score and passages; null and empty texts score as text without
    evidence. Repeated rows score alike; clashing names do no harm, as rows stay structs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = sent.value
        for batch in batches:
            flat = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text_col)], ["row", "text"])
            for b in pieces([flat]):
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([m.score(t) for t in b.column("text").to_pylist()], _ARROW)],
                                                 ["row", "toxicity"])

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField("toxicity", RESULT)]))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, model, text_col).filter(F.col("toxicity.score") < threshold).select("row.*")

"""Quality rules as weak supervision: each rule votes for good or bad or abstains; expectation-maximisation estimates how often each is
right from their agreement alone, and a text stays if its posterior probability of being good does."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenolake.llm.common import cut_lineage, let

BAD, GOOD, ABSTAIN = 0, 1, 2
LEAST_WORDS, REPEATED_SHARE, KEEP = 10, 20, 0.5
WINDOW, ROUNDS = 5, 60
#: Where expectation-maximisation starts, and the prior that holds it there with FIRM times the weight of the rows: rules do better than
#: chance, and few good texts get a bad vote. Without it the classes could be any two kinds of text.
FIRST_GOOD, FIRM = 0.85, 0.2
FIRST_RATES = ((0.4, 0.3, 0.3), (0.02, 0.68, 0.3))  #: by class, of the votes bad, good, abstain

_BLANK = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def features(text: Column) -> dict[str, Column]:
    """Counts of one text; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(_WORD))
    words = F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))
    count = lambda pattern: F.char_length(F.regexp_replace(t, pattern, "")).cast("long")  # noqa: E731  characters outside of a pattern
    return {"words": let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                                                    _repeated(w).alias("n_repeat_words"))),
            "word_chars": count(_BLANK), "n_symbols": count("[^#*$%&|<>]+"), "n_capitals": count(r"[^\p{Lu}]+"),
            "n_letters": count(r"[^\p{L}]+"), "n_bars": count("[^|\t]+"), "n_stops": count("[^.!?]+"),
            "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                                   (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))}


def _repeated(words: Column) -> Column:
    """Words in windows that occur at least twice: windows as hashes, sorted with their places only if two are equal."""
    hashes = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])))
        places = F.array_sort(F.transform(twice, lambda e: e["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), x + WINDOW) - x)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def votes() -> dict[str, Column]:
    """Rules over the counted columns. Most see one kind of junk and abstain from all else, as its absence says little; three also know
    prose."""
    n, c = F.col("n_words"), F.col("word_chars")

    def rule(bad: Column, good: Column | None = None) -> Column:
        vote = F.when(bad, F.lit(BAD))
        return (vote if good is None else vote.when(good, F.lit(GOOD))).otherwise(F.lit(ABSTAIN))

    return {
        "length": rule(n < LEAST_WORDS, n >= 40),
        "symbols": rule(5 * F.col("n_symbols") > n),
        "table": rule(5 * F.col("n_bars") > n),
        "letters": rule(5 * F.col("n_letters") < 4 * c),
        "lines": rule(3 * F.col("n_dup_lines") > F.col("n_lines")),
        "repeats": rule(100 * F.col("n_repeat_words") > REPEATED_SHARE * n),
        "variety": rule((5 * F.col("n_distinct") < n) & (n >= 40)),
        "capitals": rule(3 * F.col("n_capitals") > c),
        "word_length": rule((c < 2 * n) | (c > 15 * n), (2 * c >= 7 * n) & (c <= 9 * n)),
        "sentences": rule((200 * F.col("n_stops") < n) | (2 * F.col("n_stops") > n), (40 * F.col("n_stops") >= n) & (3 * F.col("n_stops") <= n)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> tuple[float, list[list[list[float]]]]:
    """(share of good texts, rates[rule][class][vote]) by expectation-maximisation over vote patterns and their counts."""
    firm = FIRM * max(1, sum(n for _, n in patterns))
    share, rates = FIRST_GOOD, [[list(row) for row in FIRST_RATES] for _ in range(rules)]
    for _ in range(ROUNDS):
        weight = [firm * (1 - FIRST_GOOD), firm * FIRST_GOOD]
        sums = [[[firm * x for x in row] for row in FIRST_RATES] for _ in range(rules)]
        for pattern, n in patterns:
            good = posterior(pattern, share, rates) * n
            for cls, part in ((0, n - good), (1, good)):
                weight[cls] += part
                for j, v in enumerate(pattern):
                    sums[j][cls][v] += part
        share = weight[1] / (weight[0] + weight[1])
        rates = [[[x / sum(row) for x in row] for row in rule] for rule in sums]
    return share, rates


def posterior(pattern: tuple[int, ...], share: float, rates) -> float:
    """Probability of good; an abstention says nothing."""
    x = math.log(share / (1 - share))
    for j, v in enumerate(pattern):
        if v != ABSTAIN:
            x += math.log(rates[j][1][v] / rates[j][0][v])
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior) and kept, for every row.

    Null and wordless texts have zero counts and fail; ids may be null or repeat; other columns aren't looked at. The votes of all
    rows are counted by pattern, and these at most 3 ** rules counts are all that leaves the executors."""
    f = features(F.col("text"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", *[c.alias(k) for k, c in f.items()])
    d = d.select("doc_id", "words.n_words", "word_chars", "n_symbols", "lines.n_dup_lines", "words.n_repeat_words", "words.n_distinct",
                 "lines.n_lines", "n_capitals", "n_letters", "n_bars", "n_stops")
    rules = votes()
    code = F.lit(0)
    for rule in rules.values():
        code = code * 3 + rule
    d = cut_lineage(d.withColumn("code", code))
    counts = [(_pattern(r["code"], len(rules)), r["count"]) for r in d.groupBy("code").count().collect()]
    share, rates = estimate(counts, len(rules))
    odds = F.lit(math.log(share / (1 - share)))
    for j, row in enumerate(rates):
        vote = (F.col("code") / F.lit(3 ** (len(rates) - 1 - j))).cast("int") % 3
        odds = odds + F.when(vote == BAD, math.log(row[1][BAD] / row[0][BAD])).when(vote == GOOD, math.log(row[1][GOOD] / row[0][GOOD])).otherwise(0.0)
    d = d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words")))
    d = d.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("quality") >= KEEP)).alias("kept"), "quality")


def _pattern(code: int, rules: int) -> tuple[int, ...]:
    out = []
    for _ in range(rules):
        code, v = divmod(code, 3)
        out.append(v)
    return tuple(reversed(out))

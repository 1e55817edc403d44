"""License scan as an exact set-similarity join of text blocks with license templates.

A block is any stretch of ``span`` words in a row, across line ends too: licenses are wrapped. A template of m distinct tokens is found in a
block that contains at least ``SHARE`` of them, with the words that tell the license from others among them, and no word that
belongs to another license. Tokens are ordered by their frequency in the whole corpus, rarest first: such a block
holds at least one of a template's first m - needed + 1 tokens, so only the words around one of these are joined."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenolake.llm.common import let

SHARE = 0.8
SLACK = 1.25  #: words of a block for each word of its template

#: Phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Sentences by which public licenses are granted or referred to.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("reserved", "All rights reserved"),
)

#: By label, the words that tell a license from others. Those of them that a template has must all stand in a block.
MARKS = {"apache": ("apache",), "gpl": ("gnu", "general", "public"), "mit": ("mit", "permission", "granted", "obtaining"),
         "bsd": ("redistribution", "source", "binary", "forms"), "mpl": ("mozilla", "public"), "cc-by": ("creative", "commons", "attribution"),
         "cc-by-nc": ("cc", "by", "nc"), "reserved": ("all", "rights", "reserved")}

#: Words that make another license of it. None of them may stand in a block.
OTHERS = {"gpl": ("lesser", "library", "affero"), "cc-by-nc": ("sa", "nd"),
          "cc-by": ("noncommercial", "commercial", "sharealike", "share", "noderivatives", "noderivs", "derivatives", "nc", "sa", "nd")}

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    tokens: tuple[str, ...]  #: distinct, in global order
    span: int  #: words of a block

    @property
    def marks(self) -> tuple[str, ...]:
        return tuple(t for t in MARKS.get(self.label, ()) if t in self.tokens)

    @property
    def others(self) -> tuple[str, ...]:
        return OTHERS.get(self.label, ())

    @property
    def needed(self) -> int:
        return needed(len(self.tokens))

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[:len(self.tokens) - self.needed + 1]


def needed(m: int, share: float = SHARE) -> int:
    """Smallest count of common tokens with containment of at least ``share``."""
    return -int(-m * share // 1)


def plain(text: str) -> tuple[str, ...]:
    """Distinct words of a template."""
    return tuple(dict.fromkeys(re.sub(_GAP, " ", text.lower()).split()))


def span(text: str) -> int:
    """Words of the blocks that a template is sought in: its own, repeated ones too, and some between them."""
    return math.ceil(SLACK * len(re.sub(_GAP, " ", text.lower()).split()))


def normal(text: Column) -> Column:
    """Words, each between two blanks of its own, and one more blank at either end. Only A-Z may change: the letters beyond ASCII whose lower case is or holds an ASCII letter are replaced first."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")), F.lit("\u0130"), F.lit("\u0131"))
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(t), F.lit(" ")), _GAP, "  ")


def tokens_of(words: Column) -> Column:
    """Array of the words of normalised text."""
    return F.split(F.trim(words), "  ")


def _blanks(t: Column) -> Column:
    return (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))).cast("long")


def base(words: Column) -> dict[str, Column]:
    """Counts and places of the phrases in normalised text."""
    n = _blanks(words) / 2 - 1
    beside = lambda part: (_blanks(part) - 1) / 2  # noqa: E731  words before or after a phrase
    out, labels, first, last, places = {}, [], [], [], F.lit(0).cast("long")
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        key = "".join(f" {p} " for p in parts)
        found = F.contains(words, F.lit(key))
        count = (F.octet_length(words) - F.octet_length(F.replace(words, F.lit(key), F.lit("")))) / len(key)
        places = places + F.when(found, count).otherwise(0).cast("long")
        first.append(F.when(found, beside(F.substring_index(words, key, 1))).cast("long"))
        last.append(F.when(found, n - beside(F.substring_index(words, key, -1)) - len(parts)).cast("long"))
        labels.append(F.when(found, F.lit(label)))
    out["n_words"] = n.cast("long")
    out["n_base"] = places
    out["first_word"], out["last_word"] = F.least(*first), F.greatest(*last)
    out["base_labels"] = F.array_compact(F.array(*labels))
    return out


def templates_in_order(docs: DataFrame, text_col: str, templates=TEMPLATES) -> list[Template]:
    """Templates with their tokens by document frequency over all of ``docs``, ties by name. Only the counts of the templates' own tokens
    come to the driver."""
    plain_tokens = [(label, plain(text), span(text)) for label, text in templates]
    vocabulary = sorted({t for _, tokens, _ in plain_tokens for t in tokens})
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), tokens_of(normal(F.col(text_col))))
    found = docs.select(F.explode(held).alias("token")).groupBy("token").count()
    seen = dict.fromkeys(vocabulary, 0) | {r["token"]: r["count"] for r in found.collect()}
    return [Template(i, label, tuple(sorted(tokens, key=lambda t: (seen[t], t))), words) for i, (label, tokens, words) in enumerate(plain_tokens)]


def found_blocks(docs: DataFrame, ordered: list[Template]) -> DataFrame:
    """(key, word, label, share) for the rows (key, text) of ``docs``: of the blocks around each rare token, the best one of each template that
    has it, and its first word. Texts that hold no rare token, not even inside of a word, are left out before they are split."""
    spark = docs.sparkSession
    words_sql = lambda words: f"cast(array({', '.join(repr(t) for t in words)}) AS array<string>)"
    rows = ", ".join(f"({x.number}, '{x.label}', {len(x.tokens)}, {x.needed}, {x.span}, {words_sql(x.tokens)}, {words_sql(x.marks)}, {words_sql(x.others)})" for x in ordered)
    known = spark.sql(f"SELECT * FROM VALUES {rows} AS t(number, label, m, needed, span, wanted, marks, others)")
    index = known.select("*", F.explode(F.slice("wanted", F.lit(1), F.col("m") - F.col("needed") + 1)).alias("token"))
    rare = sorted({t for x in ordered for t in x.prefix})
    some = let(F.lower("text"), lambda low: F.exists(F.array(*map(F.lit, rare)), lambda t: F.contains(low, t)))
    wide = max(x.span for x in ordered)
    around = lambda words, i: F.struct(  # noqa: E731  the words of all blocks that hold word i
        F.greatest(i - (wide - 1), F.lit(0)).alias("first"), F.least(i, F.lit(wide - 1)).alias("at"),
        F.slice(words, F.greatest(i - (wide - 1), F.lit(0)) + 1, F.lit(2 * wide - 1)).alias("near"))
    places = let(tokens_of(normal(F.col("text"))), lambda words: F.transform(
        F.array_compact(F.transform(words, lambda t, i: F.when(t.isin(rare), i))), lambda i: around(words, i)))
    met = docs.filter(some).select("key", F.explode(places).alias("x")).select("key", "x.*").withColumn("token", F.col("near")[F.col("at")])
    met = met.join(F.broadcast(index), "token")  # a row for each template of a rare token's place
    block = lambda s: let(F.slice("near", s + 1, F.col("span")), lambda w: F.when(
        (F.size(F.array_except("marks", w)) == 0) & (F.size(F.array_intersect("others", w)) == 0),
        F.struct(F.size(F.array_intersect("wanted", w)).alias("held"), (-s).alias("s"))))
    best = F.array_max(F.transform(F.sequence(F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)), "at"), block))
    return (met.withColumn("best", best).filter(F.col("best.held") >= F.col("needed"))
            .select("key", (F.col("first") - F.col("best.s")).alias("word"), "label", (F.col("best.held") / F.col("m")).alias("share")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks (first word, label, share of each find) for every
    row.

    ``score`` is the best containment of a template that was found, and 1 where a base phrase stands. Null and wordless texts have no
    words, labels or finds; rows that agree in id and text are scanned alike; other columns aren't looked at."""
    ordered = templates_in_order(docs, text_col, templates)
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("key", key)
    finds = found_blocks(d, ordered).distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("word", "label", "share"))).alias("blocks"))
    d = d.withColumn("words", normal(F.col("text")))
    d = d.select("doc_id", "key", *[c.alias(k) for k, c in base(F.col("words")).items()]).join(finds, "key", "left")
    labels = F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union("base_labels", labels)), ",").alias("labels"),
                    F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "blocks")

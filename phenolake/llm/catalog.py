"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from phenolake.llm import (q_contamination, q_context_tree, q_fingerprints, q_jaccard, q_language, q_licenses, q_merkle, q_mixing, q_negatives, q_quality, q_repeats,
                           q_sharding, q_toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _q in (q_contamination, q_mixing, q_licenses, q_sharding, q_context_tree, q_quality, q_toxicity, q_repeats, q_language, q_jaccard, q_merkle, q_fingerprints, q_negatives):
    QUERIES[_q.NAME] = _q.query
    if _q.SQL:
        SQL[_q.NAME] = _q.SQL
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

"""Registry of queries: a Spark function, the output columns, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phenolake.functions.expr import TIE_SHIFT, shape
from phenolake.plans.ctes import with_clause
from phenolake.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BODIES: dict[str, str] = {}  # the SQL before rounding, with its references

_SQL_TYPES = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "d": "VARCHAR"}


def sql_columns(spec: str) -> str:
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        cols.append(f'round(CAST("{name}" AS DOUBLE) + {TIE_SHIFT}, {kind[1:] or 6}) + 0.0 AS "{name}"' if kind[0] == "f"
                    else f'CAST("{name}" AS {_SQL_TYPES[kind]}) AS "{name}"')
    return ", ".join(cols)


def query(name: str, spec: str, sql: str | None = None):
    """Registers ``fn(tables)``; ``{name}`` references in ``sql`` pull in shared table expressions."""
    def wrap(fn):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return shape(fn(Tables(spark, path)), spec)
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            BODIES[name] = sql
            body, clause = with_clause(sql)
            SQL[name] = f"{clause} SELECT {sql_columns(spec)} FROM ({body}) q"
        return fn
    return wrap

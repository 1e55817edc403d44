"""Registered queries against their SQL on the smallest tables (a cross-section; ``check_queries.py`` runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from phenolake.sources import tables

SF = "/root/testdata/sf0.001"
NAMES = ["load_sources", "exact_share", "weighted_sample", "quantiles", "source_agreement", "weekly_drivers", "rolling_anomaly", "gdd",
         "interpolate_inside", "loyo_norm", "point_episodes", "neighbors", "k_neighbors", "pair_statistics", "method_metrics", "constraint_audit",
         "scene_change", "find_episodes", "curve_features", "region_context", "audit_quantiles", "audit_duplicates", "audit_pairs", "field_facts"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    idx = [[d[0] for d in cur.description].index(c) for c in cols]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in idx) for r in cur.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", ["same_source_neighbors", "cycle_features", "raw_source_neighbors", "assemble_sources"])
def test_tasks_by_entity_grow_with_the_input(spark, monkeypatch, name):
    """The exchange before an entity's windows has a number of tasks in proportion to the rows, whatever the session's number is."""
    monkeypatch.setattr(tables, "ROWS", 131)
    n = tables.Tables(spark, SF).parts
    assert n == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 131) > 20
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan and f", {n}" in plan


def test_norms_are_worked_out_once(spark):
    plan = lambda name: entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("value_shares").count("l_returnflag#") and "scalar-subquery" not in plan("value_shares")
    assert "l_suppkey" not in plan("calendar_shift")

"""What keeps a query's cost in proportion to its input: what it reads, and how often rows are shuffled or multiplied."""

import math

import pytest
from pyspark.sql import functions as F

from phenolake.operators import season as S
from phenolake.operators import smooth
from phenolake.plans import catalog  # noqa: F401  query modules refer to each other's SQL
from phenolake.plans.q_features import own_blocks
from phenolake.plans.q_join import same_source
from phenolake.plans.q_season import plan
from phenolake.plans.registry import QUERIES
from phenolake.plans.season import SeasonPlan
from phenolake.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_source_probabilities_fit_on_written_rows(spark):
    read = QUERIES["source_probabilities"](spark, SF).inputFiles()
    assert read and not any("lineitem" in f for f in read)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_z_needs_one_shuffle_of_the_points(spark):
    t = Tables(spark, SF)
    p = SeasonPlan(t.season, t.categories, parts=3)
    # the points of a season by entity; curves, norms and z stay where they are
    assert physical(p.z).count("Exchange hashpartitioning") == 1
    assert not {"weight", "slope", "date", "z", "deficit"} & set(spark.read.parquet(*p.saved_z.inputFiles()).columns)


def test_episodes_of_written_islands_are_those_of_z(spark):
    p = plan(Tables(spark, SF))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(p.saved_episodes) == rows(p.episodes) != []


def test_fits_make_no_row_of_a_pair(spark):
    points = [(1, i, None if i % 7 == 0 else math.sin(i), i % 5 == 0) for i in range(0, 90, 2)] + [(2, 5, 1.0, True)]
    d = spark.createDataFrame(points, "pid int, day int, v double, t boolean")
    fits = {"a": (F.col("v"), None, 6.0), "b": (F.col("v"), F.col("day") % 4 == 0, 15.0)}
    loo, at = smooth.loo_fit(d, ["pid"], "v", 8.0), smooth.fit_at_targets(d, ["pid"], F.col("t"), fits)
    assert "Generate" not in physical(loo) + physical(at)

    def weight(pid, day, bw, ok):
        near = [x for x in points if x[0] == pid and x[2] is not None and ok(x) and abs(x[1] - day) <= 3 * bw]
        return sum(math.exp(-0.5 * ((x[1] - day) / bw) ** 2) for x in near)

    for r in loo.collect():
        assert r.fit_weight == pytest.approx(weight(r.pid, r.day, 8.0, lambda x: x[1] != r.day), abs=1e-9)
    for r in at.collect():
        assert r.a_weight == pytest.approx(weight(r.pid, r.day, 6.0, lambda x: not x[3]), abs=1e-9)
        assert r.b_weight == pytest.approx(weight(r.pid, r.day, 15.0, lambda x: not x[3] and x[1] % 4 == 0), abs=1e-9)


def test_own_blocks_are_narrow_and_hold_hidden_rows(spark):
    t = Tables(spark, SF)
    blocks = own_blocks(t.marked)
    names = [c for b in blocks for c in b.columns if c not in ("pid", "day")]
    assert len(blocks) > 1 and len(names) == len(set(names))
    keys = sorted(map(tuple, t.targets.select("pid", "day").collect()))
    assert all(sorted(map(tuple, b.select("pid", "day").collect())) == keys for b in blocks)


def test_neighbors_of_all_sources_share_their_windows(spark):
    t = Tables(spark, SF)
    sorts = lambda d: physical(d).count("Sort [")
    assert sorts(same_source(t.marked, every=True)) - sorts(t.marked) <= 4  # counts, chains of the source, and the nearest of each source before and after


def test_phenology_reads_the_days_once(spark):
    """The own curve and the norm are worked out from one reading of z, with the values that two readings give."""
    p = plan(Tables(spark, SF))
    assert not set(p.phenology.inputFiles()) & set(p.saved_z.inputFiles())
    own = S.phenology(p.saved_z, ok=F.col("sure") & F.col("value").isNotNull())
    norm = S.phenology(p.saved_z, "norm_mean", F.col("norm_mean").isNotNull())
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(p.phenology) == rows(S.phenology_deviation(own, norm)) != []

"""Rows of the fitted models, on the smallest tables."""

import pytest

from phenolake.operators import model as M
from phenolake.plans import catalog  # noqa: F401  query modules refer to each other's SQL
from phenolake.plans.q_features import FEATURES, Fitted, build_features
from phenolake.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    return Fitted(Tables(spark, SF)).scored()


def test_every_hidden_row_is_scored(spark, scored):
    gaps = Tables(spark, SF).targets
    assert scored.count() == gaps.count() == scored.join(gaps, ["pid", "date"]).count()
    bad = scored.filter("pred IS NULL OR scale IS NULL OR scale < 0.015 OR scale > 0.15 OR size(probs) <> 3 OR abs(aggregate(probs, 0D, (a, x) -> a + x) - 1) > 1e-6")
    assert bad.isEmpty()


def test_fit_is_shared(spark, scored):
    again = Fitted(Tables(spark, SF))
    assert again.used == {k: list(v) for k, v in again.used.items()} and set(again.used) == {"value", "scale", "source"}


def test_packed_rows_are_filled_with_the_known_means(spark):
    d = spark.createDataFrame([(1, 2.0, None, 5), (2, None, None, 7), (3, 6.0, None, None)], "k int, a double, b double, c int")
    x = M.packed(d, ["a", "b", "c"], ["k"]).repartition(3)
    assert x.columns == ["k", "x"] and M.known_means(x) == [4.0, None, 6.0]
    got = {r.k: r.v.toArray().tolist() for r in x.select("k", M.vector([0, 2], [4.0, 6.0]).alias("v")).collect()}
    assert got == {1: [2.0, 5.0, 0.0, 0.0], 2: [4.0, 7.0, 1.0, 0.0], 3: [6.0, 6.0, 0.0, 1.0]}


def test_models_matrix_has_no_windows_that_no_feature_reads(spark):
    d = build_features(Tables(spark, SF), spatial=False, cycles=False)
    assert set(FEATURES) <= set(d.columns) and not any(c.startswith("cy_") for c in d.columns)

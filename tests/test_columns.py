import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenolake.functions import expr as E
from phenolake.operators import context as X
from phenolake.operators import report as R
from phenolake.operators import season as S


def one(df):
    return [tuple(r) for r in df.collect()]


def test_status_and_phase(spark):
    d = spark.createDataFrame([(0.0, 100), (-1.5, 150), (-2.5, 400), (None, 180)], "z double, doy int")
    got = one(d.select(E.status_from_z(F.col("z")), E.status_from_z(F.col("z"), True), E.phase_of(F.col("doy"))))
    assert got == [("normal", "normal", "spring"), ("depressed", "depressed", "peak"), ("critical", "critical", "out_of_season"),
                   (None, "normal", "ripening")]


def test_year_in_text(spark):
    rows = [("what of 2021 or 2023?", 2023), ("2023", 2023), ("12023, 20231, x2023", None), ("1899 2100 2050", None), ("2022-05-01 and 2023", 2022),
            ("сезон 2022, год2023", 2022), ("", None), (None, None), ("2023 " * 5000 + "2022", 2023)]
    d = spark.createDataFrame([(a, [2022, 2023], b) for a, b in rows] + [("2023", None, None), ("2023", [], None)], "q string, known array<int>, want int")
    for q, got, want in one(d.select("q", E.year_in_text(F.col("q"), F.col("known")), "want")):
        assert got == want, q


def test_asked_seasons_keeps_each_question(spark):
    q = spark.createDataFrame([(1, "2020?"), (1, "2021?"), (2, "2020?"), (None, "2020?"), (1, "2020?")], "pid long, question string")
    s = spark.createDataFrame([(1, 2020), (1, 2020), (1, None), (3, 2021)], "pid long, year int")
    got = sorted(one(R.asked_seasons(q, s).select("pid", "question", "season")), key=str)
    assert got == sorted([(1, "2020?", 2020), (1, "2020?", 2020), (1, "2021?", None), (2, "2020?", None), (None, "2020?", None)], key=str)


def test_plural_follows_the_last_digits(spark):
    want = {0: "m", 1: "o", 2: "f", 4: "f", 5: "m", 11: "m", 12: "m", 14: "m", 21: "o", 22: "f", 101: "o", 111: "m", 112: "m", 122: "f", -1: "o", -13: "m"}
    d = spark.createDataFrame([(n,) for n in want] + [(None,)], "n long")
    got = dict(one(d.select("n", E.counted(F.col("n"), "o", "f", "m"))))
    assert got == {n: f"{n} {w}" for n, w in want.items()} | {None: None}


def test_nan_becomes_null_and_clip_keeps_null(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,), (None,)], "v double")
    assert one(d.select(E.denan(F.col("v")))) == [(None,), (None,), (2.0,), (None,)]
    assert one(d.select(E.clip(E.denan(F.col("v")), -1.0, 1.0))) == [(None,), (None,), (1.0,), (None,)]


def test_source_priority(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 2.0, 3.0), (None, None, 3.0), (None, None, None)], "s1 double, s2 double, s3 double")
    assert one(d.select(E.source_code())) == [(0,), (1,), (2,), (-1,)]


def test_bounded_score(spark):
    d = spark.createDataFrame([(0.10,), (0.08,), (0.05,), (0.02,), (0.0,)], "r double")
    assert [r[0] for r in d.select(E.bounded_score(F.col("r"))).collect()] == [0.0, 6.0, 15.0, 24.0, 30.0]


def test_episode_rule(spark):
    d = spark.createDataFrame([(20, -1.3, -1.4, 3), (8, -1.1, -1.8, 2), (8, -1.1, -1.2, 2), (20, -1.5, -2.0, 1), (88, -1.1, -1.3, 9)],
                              "days int, mean_z double, min_z double, n_obs int")
    c = [F.col(x) for x in ("days", "mean_z", "min_z", "n_obs")]
    assert one(d.select(S.is_episode(*c))) == [(True,), (True,), (False,), (False,), (True,)]
    assert one(d.select(S.is_episode(*c, strict=False))) == [(True,), (True,), (True,), (False,), (True,)]


def test_severity(spark):
    d = spark.createDataFrame([(-2.1, 5), (-2.1, 4), (-1.9, 9)], "z double, n int")
    assert one(d.select(X.severity(F.col("z"), F.col("n")))) == [("critical",), ("moderate",), ("moderate",)]


def test_bins(spark):
    d = spark.createDataFrame([(3,), (4,), (31,), (0,)], "v int")
    edges, labels = [0, 3, 7, 15, 30], ["a", "b", "c", "d", "e"]
    assert one(d.select(E.bin_edges(F.col("v"), edges, labels), E.bin_edges(F.col("v"), edges, labels, right_closed=False))) == [
        ("a", "b"), ("b", "b"), ("e", "e"), (None, "a")]


def test_qa_and_index(spark):
    d = spark.createDataFrame([(0, 0.6, 0.2), (1, 0.6, 0.2), (8, 0.6, 0.2), (64, -0.1, 0.2)], "qa int, a double, b double")
    got = one(d.select(E.qa_clear(F.col("qa"), (3,)), E.normalized_difference(F.col("a"), F.col("b"), E.qa_clear(F.col("qa"), (3,)))))
    assert got[0] == (False, None) and got[1][0] and abs(got[1][1] - 0.5) < 1e-12 and got[2] == (False, None) and got[3] == (True, None)


def test_median_of_others_matches_brute_force(spark):
    rows = [(d, e, float((e * 7 + d * 3) % 11)) for d in range(1, 7) for e in range(d)]
    z = spark.createDataFrame(rows, "day int, pid int, z double")
    got = z.join(X.day_medians(z), "day").withColumn("m", X.median_of_others(F.col("z"))).select("day", "pid", "m").collect()
    for r in got:
        other = sorted(v for d, e, v in rows if d == r.day and e != r.pid)
        want = None if not other else (other[(len(other) - 1) // 2] + other[len(other) // 2]) / 2
        assert r.m == want


def test_interval_numbers_are_gapless(spark):
    d = spark.range(X.SEASON_DAYS).selectExpr("CAST(id AS int) AS s").crossJoin(spark.range(X.SEASON_DAYS).selectExpr("CAST(id AS int) AS e")).filter("s <= e")
    got = [r.n for r in d.select("s", "e", X.interval_number(F.col("s"), F.col("e")).alias("n")).orderBy("s", "e").collect()]
    assert got == list(range(X.SEASON_DAYS * (X.SEASON_DAYS + 1) // 2))


@pytest.mark.parametrize("held", [256, 1])
def test_region_context_matches_brute_force(spark, monkeypatch, held):
    """One region and several (one of them NULL, one too small), days without z, an entity on the edge of -1, tables of counts that are sent early."""
    monkeypatch.setattr(X, "HELD", held)
    rng, lo = np.random.default_rng(3), {y: (datetime.date(y, 4, 1) - datetime.date(2000, 1, 1)).days for y in (2019, 2020)}
    region = lambda pid: None if pid % 3 == 0 else ("few" if pid in (1, 2) else f"r{pid % 3}")
    z = [(pid, y, lo[y] + at, None if rng.random() < 0.2 else (-1.0 if pid == 5 else float(rng.normal(-1, 0.6))), region(pid))
         for pid in range(14) for y in lo for at in [0, 1, 2, 3, 100, 101, 102, 211, 212]]
    known = {(p, d): v for p, _, d, v, _ in z if v is not None}
    ep = []
    for pid in range(14):
        for y in lo:
            for a, b in ((1, 2), (2, 101), (211, 212), (0, 212)):
                own = [known[pid, d] for d in range(lo[y] + a, lo[y] + b + 1) if (pid, d) in known]
                if own:
                    ep.append((pid, y, lo[y] + a, lo[y] + b, sum(own) / len(own)))
    zd = spark.createDataFrame(z, "pid int, year int, day int, z double, region string")
    ed = spark.createDataFrame(ep, "pid int, year int, start int, end int, mean_z double")
    for within in ((), ("region",)):
        got = {(r.pid, r.start, r.end): r for r in X.region_context(ed, zd, within).collect()}
        assert len(got) == len(ep)
        for pid, _, a, b, _ in ep:
            others = [q for q in range(14) if q != pid and (not within or region(q) == region(pid))]
            inside = {q: [known[q, d] for d in range(a, b + 1) if (q, d) in known] for q in others}
            means = [np.mean(v) for v in inside.values() if v]
            days = [np.median(v) for d in range(a, b + 1) if (pid, d) in {(p, e) for p, _, e, _, _ in z} and (v := [known[q, d] for q in others if (q, d) in known])]
            r = got[pid, a, b]
            if len(means) < 3:
                assert (r.region_z, r.n_entities, r.share_low) == (None, None, None)
            else:
                assert r.n_entities == len(means) and r.share_low == pytest.approx(np.mean([round(m, 9) < -1 for m in means]))
                assert r.region_z == pytest.approx(np.mean(days))


def test_classifier_order(spark):
    base = dict(n_obs=5, artifacts_near=0, peak_ratio=0.9, peak_shift=0, sos_shift=0, decline_shift=0, valid=True, peak=0.6, start_doy=160, end_doy=190,
                region_z=0.0, share_low=0.1, n_entities=5, c_n_days=40, c_amount=50.0, c_amount_norm=60.0, c_deficit_pct=10.0, c_level=20.0,
                c_level_anomaly=0.0, c_hot_days=0, c_max_dry_spell=3, index_anomaly=None, index_n=None)
    cases = [({"n_obs": 2, "artifacts_near": 2}, "data_suspect", 0.4), ({"peak_shift": 25}, "crop_rotation", 0.7),
             ({"peak_shift": -25}, "crop_rotation", 0.65), ({"peak": 0.3}, "unsown_or_changed", 0.8), ({"decline_shift": -15}, "early_decline", 0.6),
             ({"decline_shift": -15, "c_deficit_pct": 45.0}, "weather_drought", 0.55), ({"sos_shift": 15, "start_doy": 120}, "late_start", 0.6),
             ({"c_deficit_pct": 85.0}, "weather_drought", 0.7), ({"region_z": -0.8}, "weather_drought", 0.5),
             ({"c_max_dry_spell": 25, "c_deficit_pct": -100.0}, "weak_season", 0.45), ({"peak_ratio": 0.65}, "weak_season", 0.6)]
    schema = ("k int, n_obs int, artifacts_near int, peak_ratio double, peak_shift int, sos_shift int, decline_shift int, valid boolean, peak double, "
              "start_doy int, end_doy int, region_z double, share_low double, n_entities int, c_n_days int, c_amount double, c_amount_norm double, "
              "c_deficit_pct double, c_level double, c_level_anomaly double, c_hot_days int, c_max_dry_spell int, index_anomaly double, index_n int")
    rows = [tuple({"k": i, **base, **c[0]}[f.split()[0]] for f in schema.split(", ")) for i, c in enumerate(cases)]
    got = X.classify(spark.createDataFrame(rows, schema)).orderBy("k").collect()
    assert [(r.cause, r.confidence) for r in got] == [(c, v) for _, c, v in cases]


def test_trend_statuses(spark):
    cases = {"worsening": (-1.5, -3.0), "easing": (-3.0, -1.5), "recovered": (-1.5, -0.5), "stable": (-2.0, -2.1), "within": (0.5, 0.0)}
    rows = []
    for i, (b, a) in enumerate(cases.values()):
        for day, z in ((3, b), (10, b), (17, a), (24, a)):
            rows.append((i, 2024, day, 0, 0.6 + 0.1 * z, False, 0.6, 0.1))
        rows.append((i, 2024, 24, 1, 0.9, False, 0.6, 0.1))   # second source on one day
        rows.append((i, 2024, 20, 0, 0.0, True, 0.6, 0.1))    # artifact
    d = spark.createDataFrame(rows, "pid int, year int, day int, source int, h double, artifact boolean, norm_mean double, norm_std double")
    got = R.deviation_trend(d).orderBy("pid").collect()
    assert [r.status for r in got] == list(cases) and all((r.n_before, r.n_after) == (2, 2) for r in got)


def test_arguments_and_plurals(spark):
    """Typed arguments in reading order, and their sentences with singular and plural forms."""
    from phenolake.operators import context as X
    d = spark.sql("""SELECT 2 AS n_obs, 3 AS artifacts_near, 1.0D AS peak_ratio, 30 AS peak_shift, 0 AS sos_shift, -20 AS decline_shift, true AS valid, 0.8D AS peak, 200 AS start_doy, 230 AS end_doy,
        -1.0D AS region_z, 0.6D AS share_low, 5 AS n_entities, 30 AS c_n_days, 10.0D AS c_amount, 40.0D AS c_amount_norm, 75.0D AS c_deficit_pct, 20.0D AS c_level, 0.2D AS c_level_anomaly,
        1 AS c_hot_days, 16 AS c_max_dry_spell, 0.1D AS index_anomaly, 1 AS index_n, 5.0D AS b_amount, 20.0D AS b_amount_norm, 75.0D AS b_deficit_pct,
        CAST(NULL AS DOUBLE) AS d_amount, CAST(NULL AS DOUBLE) AS d_amount_norm, CAST(NULL AS DOUBLE) AS d_deficit_pct""")
    few = X.classify(d).first()
    assert [a["code"] for a in few["arguments"]] == ["few_obs", "region_low", "dry", "dry_spell", "before", "second_index"]
    assert few["reasons"][0] == "only 2 observations inside, 3 artifacts near" and few["reasons"][-1] == "second index off its norm by 0.10 (1 point)"
    drought = X.classify(d.withColumn("artifacts_near", F.lit(0))).first()
    assert drought["cause"] == "weather_drought" and [a["code"] for a in drought["arguments"]] == ["dry", "dry_spell", "before", "decline", "region_low", "second_index"]
    assert drought["reasons"][3] == "peak at the norm (100 %) but the decline began 20 days early" and drought["reasons"][1] == "dry run of 16 days"


def test_driver_fallback_leaves_no_entity_without_facts(spark):
    from phenolake.operators import drivers as D
    own = spark.createDataFrame([(k, day, 1.0 + k, float(day % 7)) for k in (1, 2) for day in range(0, 40) if day not in (10, 11)], "region int, day int, precip double, temp double")
    grid = D.regional_grid(own, ["precip", "temp"])
    got = {r.day: (r.precip, r.temp) for r in grid.collect()}
    assert sorted(got) == list(range(40)) and got[0] == (2.5, 0.0) and got[10][0] == 2.5 and got[11][1] is not None
    mapping, series = D.with_fallback(spark.createDataFrame([(1,), (7,)], "region int"), own, grid, "region", ["precip", "temp"])
    assert {(r.region, r.driver_key, r.origin) for r in mapping.collect()} == {(1, 1, "own"), (7, D.REGION_KEY, "region")}
    assert series.filter(F.col("driver_key") == D.REGION_KEY).count() == 40

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.functions.expr import add_calendar
from phenolake.operators import aggregate as A
from phenolake.operators import drivers as D
from phenolake.operators import frames, norms, pairs, pixels, quantiles, sampling, smooth
from phenolake.operators import season as S
from phenolake.plans.season import SeasonPlan
from phenolake.sources import io


def days(spark, rows, schema="pid int, day int, v double"):
    return spark.createDataFrame(rows, schema)


def test_runs_merge(spark):
    flags = [0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 1]
    d = days(spark, [(1, i, 1.0) for i, f in enumerate(flags) if f])
    runs = lambda g: sorted((r.start, r.end) for r in frames.runs(d, ["pid"], gap=g).collect())
    assert runs(0) == [(1, 2), (5, 5), (9, 10)] and runs(2) == [(1, 5), (9, 10)]


def test_interpolate_first_three(spark):
    d = days(spark, [(1, 0, 1.0), (1, 6, 7.0)])
    g = frames.interpolate_inside(frames.densify(d, ["pid"], ["v"]), ["pid"], ["v"]).orderBy("day").collect()
    assert [r.v for r in g] == [1.0, 2.0, 3.0, 4.0, None, None, 7.0]


def test_kernel_recovers_line_and_ignores_own_point(spark):
    x = list(range(0, 60, 3))
    line = [(1, i, 0.1 + 0.02 * i, False) for i in x] + [(1, 10, None, True), (1, 31, None, True)]
    d = spark.createDataFrame(line, "pid int, day int, v double, t boolean")
    got = {r.day: r for r in smooth.fit_at_targets(d, ["pid"], F.col("t"), {"f": (F.col("v"), None, 8.0)}).collect()}
    for t in (10, 31):
        assert got[t].f == pytest.approx(0.1 + 0.02 * t, abs=1e-9) and got[t].f_slope == pytest.approx(0.02, abs=1e-9)
    flat = days(spark, [(1, i, 0.9 if i == 30 else 0.5) for i in x])
    loo = {r.day: r.fit for r in smooth.loo_fit(flat, ["pid"], "v", 8.0).collect()}
    assert loo[30] == pytest.approx(0.5, abs=1e-9)
    lone = spark.createDataFrame([(1, 0, None, True)], "pid int, day int, v double, t boolean")
    r = smooth.fit_at_targets(lone, ["pid"], F.col("t"), {"f": (F.col("v"), None, 8.0)}).first()
    assert r.f is None and r.f_weight == 0


def panel(spark, rows):
    """rows of (pid, date, value): first source only."""
    d = spark.createDataFrame(rows, "pid int, d string, value double").select("pid", F.to_date("d").alias("date"), "value")
    return add_calendar(d).withColumns({"s1": F.col("value"), "s2": F.lit(None).cast("double"), "s3": F.lit(None).cast("double"), "source": F.lit(0)})


def by_doy(spark, year, doys, values, pid=1):
    import datetime as dt
    return [(pid, (dt.date(year, 1, 1) + dt.timedelta(days=d - 1)).isoformat(), v) for d, v in zip(doys, values)]


def test_cloud_is_an_artifact_and_harvest_is_not(spark):
    doys = [140, 145, 150, 155, 160, 165, 174, 179, 184, 189]
    harvest = [.58, .57, .57, .56, .56, .56, .27, .28, .28, .30]
    cloud = [.58, .57, .57, .56, .27, .56, .56, .57, .56, .55]
    bad = lambda v: [r.doy for r in S.harmonize(panel(spark, by_doy(spark, 2020, doys, v))).filter("artifact").collect()]
    assert bad(harvest) == [] and bad(cloud) == [160]


def test_curve_only_inside_the_observed_span(spark):
    doys = list(range(140, 161, 4))
    series = S.harmonize(panel(spark, by_doy(spark, 2021, doys, [0.5] * len(doys))))
    got = S.daily_curve(series).collect()
    assert len(got) == C.SEASON_ROWS
    assert sorted(r.doy for r in got if r.value is not None) == list(range(138, 163))
    assert all(r.weight == 0 for r in got if r.value is None)


def bell(spark):
    rows = []
    for year in (2018, 2019, 2020):
        doys = [int(95 + 5 * i) for i in range(40)]
        v = [0.2 + 0.6 * math.exp(-((d - 140) / 35) ** 2) - (0.3 if year == 2020 and d > 152 else 0) for d in doys]
        rows += by_doy(spark, year, doys, v)
    return panel(spark, rows)


def test_episode_only_in_the_drop_year(spark):
    cats = spark.createDataFrame([(1, 7)], "pid int, category int")
    p = SeasonPlan(bell(spark), cats)
    z = S.z_series(S.curve_norm(p.saved_curves).withColumn("norm_source", F.lit("own")))
    ep = S.find_episodes(z, p.saved_series).collect()
    assert {r.year for r in ep} == {2020} and min(r.min_z for r in ep) < -1.5 and min(r.start_doy for r in ep) >= 140


def test_norm_excludes_own_year(spark):
    d = panel(spark, by_doy(spark, 2018, [150], [0.4]) + by_doy(spark, 2019, [152], [0.6]) + by_doy(spark, 2020, [151], [0.9]))
    got = {r.year: r for r in norms.loyo_norm(d).collect()}
    assert got[2020].norm_mean == pytest.approx(0.5) and got[2020].norm_years == 2 and got[2018].norm_mean == pytest.approx(0.75)


def test_order_and_partitioning_do_not_matter(spark):
    """z may differ in its last digits: a norm's std comes from sums whose terms arrive in another order."""
    d = bell(spark)
    rows = lambda x: {(r.pid, r.day): r.z for r in norms.loyo_norm(x).collect()}
    a, b = rows(d), rows(d.orderBy(F.rand(1)).repartition(5))
    assert a.keys() == b.keys() and all(
        (b[k] is None) if v is None else b[k] == pytest.approx(v, rel=1e-6) for k, v in a.items())


@pytest.mark.parametrize("level", [0.0, 1e8])
def test_norm_equals_exact_sums(spark, level):
    from fractions import Fraction
    d = bell(spark).withColumn("value", F.col("value") + level)
    rows = [(r.year, r.doy, r.value, r.norm_n, r.norm_mean, r.norm_std) for r in norms.loyo_norm(d).collect()]
    for year, doy, _, n, mean, std in rows:
        v = [Fraction(x) for y, t, x, *_ in rows if y != year and abs(t - doy) <= C.NORM_WINDOW]
        assert n == len(v) > 0
        m = sum(v) / n
        assert mean == pytest.approx(float(m), rel=1e-15)
        exact = math.sqrt(sum((x - m) ** 2 for x in v) / n)
        assert std == pytest.approx(exact, rel=1e-9, abs=1e-9 if level else 1e-24)
    same = d.withColumn("value", F.lit(0.1) + level)
    assert {r.norm_std for r in norms.loyo_norm(same).collect()} == {0.0}


def test_exact_quantiles_with_hot_value_and_brackets(spark, monkeypatch):
    rows = [(i % 2, 5.0 if i % 3 == 0 else float((i * 7919) % 1000)) for i in range(4000)]
    d = spark.createDataFrame(rows, "g int, v double").repartition(4)
    want = {r.g: (r.q, r.m) for r in d.groupBy("g").agg(F.percentile("v", F.lit(0.1)).alias("q"), F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    for cells in (1024, 8):   # hardly a value a cell, then many
        monkeypatch.setattr(quantiles, "CELLS", cells)
        got = quantiles.exact_quantiles(d, ["g"], "v", {"q": 0.1, "m": 0.5}).collect()
        assert {r.g: (r.q, r.m) for r in got} == want
        whole = quantiles.exact_quantiles(d, [], "v", {"m": 0.5}).first()
        assert whole.n == 4000 and whole.m == d.agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_order_statistics_edges(spark):
    """Null values, a null group, an empty table, a rank that a group doesn't have, repeated values."""
    wants = {"first": lambda n: F.lit(1), "third": lambda n: F.lit(3), "last": lambda n: n}
    rows = [(1, 2.0), (1, None), (1, 2.0), (1, -1.5), (2, 7.0), (None, 4.0), (None, 3.0), (3, None)]
    d = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.n, r["first"], r.third, r.last) for r in quantiles.order_statistics(d, ["g"], "v", wants)
           .collect()}
    assert got == {1: (3, -1.5, 2.0, 2.0), 2: (1, 7.0, None, 7.0), None: (2, 3.0, None, 4.0)}
    assert quantiles.order_statistics(d.filter("false"), ["g"], "v", wants).collect() == []
    assert quantiles.order_statistics(d.filter("false"), [], "v", wants).collect() == []


def test_one_group_is_spread_over_cells(spark):
    """The median of one group that holds nearly all rows orders a few rows only, and no task gets the group whole."""
    n = 300_000
    d = spark.range(n).select(F.when(F.col("id") % 1000 == 0, 1).otherwise(0).alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    got = {r.g: r.m for r in quantiles.exact_quantiles(d, ["g"], "v", {"m": 0.5}).collect()}
    want = {r.g: r.m for r in d.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want
    cuts = quantiles.cell_cuts(d, "v").first()[0]
    per_cell = d.select(quantiles.cell_of(F.array(*map(F.lit, cuts[15::16])), F.col("v"), 64).alias("c")).groupBy("c").count()
    assert per_cell.agg(F.max("count")).first()[0] < 2 * n / 64
    assert per_cell.count() == 64


def test_hash_share_is_exact_and_depends_on_the_seed(spark):
    d = spark.range(1000).withColumnRenamed("id", "k")
    take = lambda seed: {r.k for r in sampling.exact_share(d, ["k"], 0.15, seed, "f").filter("f").collect()}
    a, b = take(1), take(2)
    assert len(a) == 150 and a == take(1) and a != b


def test_pair_sums_match_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 2)
    monkeypatch.setattr(pairs.n_blocks, "__defaults__", ("pid", 2))
    rows = [(p, k, float((p * 13 + k * 7) % 10)) for p in range(7) for k in range(12) if (p + k) % 3]
    d = spark.createDataFrame(rows, "pid long, key long, v double")
    got = {(r.a, r.b): (r.n, r.sa, r.sb, r.saa, r.sbb, r.sab) for r in pairs.pair_sums(d, "v").collect()}
    val = {(p, k): v for p, k, v in rows}
    for a in range(7):
        for b in range(a + 1, 7):
            both = [(val[a, k], val[b, k]) for k in range(12) if (a, k) in val and (b, k) in val]
            want = (len(both), sum(x for x, _ in both), sum(y for _, y in both), sum(x * x for x, _ in both), sum(y * y for _, y in both),
                    sum(x * y for x, y in both))
            if both:
                assert got.pop((a, b)) == pytest.approx(want)
    assert not got


def test_dry_run_and_window_facts(spark):
    rain = [0, .9, 1, 0, None, 0, .2, 0, 2]
    start = 9222  # 2025-04-01
    d = spark.createDataFrame([("r", start + i, None if v is None else float(v)) for i, v in enumerate(rain)], "region string, day int, amount double")
    r = D.dry_spell(D.with_calendar(d), "amount").first()
    assert (r.days, r.start - start, r.end - start, r.complete) == (3, 5, 7, False)


def test_gdd_profiles(spark):
    d = spark.createDataFrame([(5.0, 35.0)], "lo double, hi double")
    r = d.select(*[D.gdd(F.col("lo"), F.col("hi"), p, 10.0).alias(p) for p in ("corn", "sunflower", "custom")]).first()
    assert r.corn == 10 and r.sunflower == pytest.approx(20 - 20 / 3) and r.custom == 10


def test_strict_windows(spark):
    d = days(spark, [(1, i, -2.0) for i in range(40) if i != 5])
    got = {r.day: r.s for r in d.withColumn("s", frames.strict_sum(F.col("v"), 30, ["pid"])).collect()}
    assert got[34] is None and got[35] == -60.0 and got[36] == -60.0
    heat = days(spark, [(1, 0, 8.0), (1, 1, 8.0), (1, 3, 8.0)])
    h = {r.day: r.s for r in heat.withColumn("s", frames.cumulative_strict(F.col("v"), F.lit(0), ["pid"])).collect()}
    assert h == {0: 8.0, 1: 16.0, 3: None}


def test_leap_day_has_no_partner(spark):
    d = spark.createDataFrame([("2020-02-29", 2021), ("2020-02-29", 2024), ("2020-05-01", 2021)], "d string, y int")
    got = d.select(D.shifted_day(F.datediff(F.to_date("d"), F.lit("2000-01-01").cast("date")), F.col("y")).alias("s")).collect()
    assert got[0].s is None and got[1].s is not None and got[2].s is not None


def test_load_precedence(spark):
    sch = "pid string, date string, v double, is_gap boolean"
    train = spark.createDataFrame([("A", "05-01", .3, False), ("A", "05-06", .4, False)], sch)
    test = spark.createDataFrame([("B", "05-01", .2, False), ("B", "05-06", None, True), ("B", "05-11", .45, False)], sch)
    extra = spark.createDataFrame([("B", "05-11", .9, False), ("B", "05-16", None, True), ("B", "05-21", .5, False)], sch)
    g = io.load_sources([(train, "train"), (test, "test"), (extra, "extra")], ["pid", "date"])
    rows = {(r.pid, r.date): r for r in g.collect()}
    obs, grid, gaps = io.split_panel(g, "v")
    assert len(rows) == 7 and rows["B", "05-11"].v == .45 and gaps.count() == 2 and gaps.filter("split = 'test'").count() == 1
    assert io.load_sources([(train, "train"), (test, "test"), (None, "extra")], ["pid", "date"]).filter("v IS NOT NULL").count() == 4


def test_prediction_contract(spark, tmp_path):
    gaps = spark.createDataFrame([(1, "a"), (2, "b")], "pid int, date string")
    bad = spark.createDataFrame([(1, "a", 0.1), (1, "a", 0.2), (3, "c", float("nan"))], "pid int, date string, pred double")
    v = io.prediction_violations(bad, gaps).first().asDict()
    assert v == {"n_rows": 3, "n_gaps": 2, "n_duplicates": 1, "n_not_finite": 1, "n_missing": 1, "n_unexpected": 1}
    with pytest.raises(ValueError):
        io.write_predictions(bad, gaps, str(tmp_path / "bad"))
    good = spark.createDataFrame([(1, "a", 1.7), (2, "b", 0.2)], "pid int, date string, pred double")
    io.write_predictions(good, gaps, str(tmp_path / "good"))
    assert sorted(r.pred for r in spark.read.csv(str(tmp_path / "good"), header=True, schema="pid int, date string, pred double").collect()) == [0.2, 1.0]


def test_multi_line_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pid": 1,\n "years": [2020]}')
    (tmp_path / "b.json").write_text('{"pid": 2,\n "years": []}')
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("years", T.ArrayType(T.IntegerType()))])
    assert io.read_reports(spark, str(tmp_path), schema).count() == 2


def test_pixel_change(spark):
    prev, now = [.7, .7, None, .7, .7, .7], [.4, .6, .2, None, .7, .8]
    rows = [(1, s, i, v) for s, vals in (("2024-05-01", prev), ("2024-06-01", now)) for i, v in enumerate(vals)]
    d = spark.createDataFrame(rows, "zone int, s string, px int, v double").withColumn("scene", F.to_date("s"))
    r = pixels.scene_change(d, "v").first()
    assert (r.area_ha, r.drop_area_ha, r.drop_share, r.clear_share) == (0.16, 0.08, 0.5, 0.6667)


def test_thin_keeps_ends(spark):
    d = days(spark, [(1, i, float(i)) for i in range(100)])
    got = sorted(r.day for r in frames.thin(d, ["pid"], ["day"], 40).collect())
    assert len(got) == 40 and got[0] == 0 and got[-1] == 99


def test_drivers_take_the_years_of_their_series(spark):
    """Episodes outside of any fixed span have facts, and a norm of all other years."""
    grid = spark.sql("""SELECT 'r' AS region, datediff(d, DATE'2000-01-01') AS day, CAST(year(d) - 1990 AS DOUBLE) AS precip, 10.0D AS temp
                        FROM (SELECT explode(sequence(DATE'1994-01-01', DATE'2005-12-31')) AS d)""")
    ep = spark.sql("""SELECT 'r' AS region, 1L AS pid, y AS year, datediff(make_date(y, 6, 1), DATE'2000-01-01') AS ep,
                      datediff(make_date(y, 6, 1), DATE'2000-01-01') AS start, datediff(make_date(y, 6, 20), DATE'2000-01-01') AS end
                      FROM VALUES (1994), (2000), (2005) AS t(y)""")
    got = {(r.year, r.win): r for r in D.episode_drivers(ep, grid, "region", ["pid", "year", "ep"]).collect()}
    assert len(got) == 9
    for y in (1994, 2000, 2005):
        r = got[y, "during"]
        others = [x - 1990 for x in range(1994, 2006) if x != y]
        assert (r.n_days, r.norm_years) == (20, 11) and r.amount == 20.0 * (y - 1990)
        assert r.amount_norm == pytest.approx(20 * sum(others) / len(others))


def test_norm_does_not_depend_on_the_level(spark):
    rows = [(1, y, doy, math.sin(doy * y) / 3) for y in range(2000, 2006) for doy in range(100, 160, 5)]
    out = []
    for level in (0.0, 1e8):
        d = spark.createDataFrame([(p, y, doy, v + level) for p, y, doy, v in rows], "pid int, year int, doy int, value double")
        out.append({(r.year, r.doy): (r.norm_std, r.z) for r in norms.loyo_norm(d).collect()})
    for k, want in out[0].items():
        assert out[1][k] == pytest.approx(want, rel=1e-6, abs=1e-6)
    flat = spark.createDataFrame([(1, y, 100, 1e8) for y in range(2000, 2004)], "pid int, year int, doy int, value double")
    assert {(r.norm_std, r.z) for r in norms.loyo_norm(flat).collect()} == {(0.0, None)}


def test_shared_folder(spark):
    class Conf:
        def __init__(self, folder):
            self.folder, self.set = folder, lambda k, v: None

        def get(self, key, default=None):
            return self.folder or default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext, _jvm, _jsc = Conf(None), Context(), spark._jvm, spark._jsc

    with pytest.raises(ValueError):
        io.shared_dir(Session())
    Session.conf = Conf("/tmp/somewhere/")
    assert io.shared_dir(Session()).startswith("/tmp/somewhere/phenolake/")
    Session.conf, Context.master = Conf(None), "local[2]"
    assert "/phenolake/" in io.shared_dir(Session())


def test_donors_and_day_effects_cover_every_target(spark):
    known = spark.createDataFrame([(p, k, math.sin(p + k) + p * 0.1 * k) for p in range(5) for k in range(20) if (p + k) % 4], "pid long, key long, v double")
    targets = spark.createDataFrame([(0, 3), (1, 2), (9, 3), (2, 99)], "pid long, key long")
    got = {(r.pid, r.key): r for r in pairs.donor_transfer(known, targets).collect()}
    assert len(got) == 4 and got[9, 3].w_all == 0 and got[2, 99].pred_all is None
    effects = {(r.pid, r.key): r for r in pairs.weighted_day_effects(known, targets).collect()}
    val = {(r.pid, r.key): r.v for r in known.collect()}

    def corr(a, b):
        both = [(val[a, k], val[b, k]) for k in range(20) if (a, k) in val and (b, k) in val]
        n, ma, mb = len(both), sum(x for x, _ in both) / len(both), sum(y for _, y in both) / len(both)
        c = sum((x - ma) * (y - mb) for x, y in both)
        return n, c / math.sqrt(sum((x - ma) ** 2 for x, _ in both) * sum((y - mb) ** 2 for _, y in both))

    table = {(a, b): corr(a, b) for a in range(5) for b in range(5) if a != b}
    mean = sum(r for _, r in table.values()) / len(table)
    for (pid, key), r in effects.items():
        weights = {b: max((table[pid, b][0] * table[pid, b][1] + 30 * mean) / (table[pid, b][0] + 30), 0) if (pid, b) in table else max(mean, 0)
                   for b in range(5) if b != pid and (b, key) in val}
        assert r.wsum == pytest.approx(sum(weights.values()))
        if r.wsum > 1e-6:
            assert r.effect == pytest.approx(sum(w * val[b, key] for b, w in weights.items()) / r.wsum)
        others = [val[b, key] for b in range(5) if b != pid and (b, key) in val]
        assert r.lowest == (min(others) if others else None)
        assert r.low_share == (pytest.approx(sum(v < pairs.LOW_RESIDUAL for v in others) / len(others)) if others else None)


@pytest.mark.parametrize("block", [256, 3])
def test_donors_in_blocks_and_parts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pairs.n_blocks, "__defaults__", ("pid", block))
    rows = [(g, p, k, math.sin(k / 3 + g) * (1 + p % 3) + 0.01 * ((p * 31 + k * 17) % 13)) for g in (0, 1) for p in range(8) for k in range(30) if (p + k + g) % 5]
    known = spark.createDataFrame(rows, "part long, pid long, key long, v double")
    asked = [(g, p, k) for g in (0, 1) for p in (0, 3, 7, 50) for k in (0, 4, 11, 99)]
    targets = spark.createDataFrame(asked, "part long, pid long, key long")
    edges = {}
    for r in pairs.pair_statistics(pairs.pair_sums(known.filter("part = 0").drop("part"), "v")).collect():
        edges[0, r.a, r.b] = r
    for r in pairs.pair_statistics(pairs.pair_sums(known.filter("part = 1").drop("part"), "v")).collect():
        edges[1, r.a, r.b] = r
    val = {(g, p, k): v for g, p, k, v in rows}
    for residuals in (False, True):
        got = {(r.part, r.pid, r.key): r for r in pairs.donor_transfer(known, targets, residuals=residuals).collect()}
        assert sorted(got) == sorted(asked)
        for g, p, k in asked:
            donors = sorted((-e.score, b, (e.beta * val[g, b, k]) if residuals else e.mean_a + e.beta * (val[g, b, k] - e.mean_b))
                            for (q, a, b), e in edges.items() if (q, a) == (g, p) and e.score > 0 and (g, b, k) in val)
            for name, n in (("1", 1), ("3", 3), ("8", 8), ("all", 99)):
                w = sum(-s for s, _, _ in donors[:n])
                assert got[g, p, k]["w_" + name] == pytest.approx(w)
                assert got[g, p, k]["pred_" + name] == (pytest.approx(sum(-s * y for s, _, y in donors[:n]) / w) if w else None)
    top = {}
    for r in pairs.top_edges(known, 2).collect():
        top.setdefault((r.part, r.a), []).append((-r.score, r.b))
    for (g, p), best in top.items():
        want = sorted((-e.score, b) for (q, a, b), e in edges.items() if (q, a) == (g, p) and e.score > 0)[:2]
        assert [b for _, b in sorted(best)] == [b for _, b in want] and [w for w, _ in sorted(best)] == pytest.approx([w for w, _ in want])
    assert len(top) == 16


@pytest.mark.parametrize("block", [256, 3])
def test_best_pairs_equal_brute_force(spark, monkeypatch, block):
    """Ties by ids, pairs with too few shared days, a constant entity, a part of one entity."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "n_blocks", lambda df, entity="pid": 1 if block == 256 else 4)
    rng = np.random.default_rng(1)
    rows = [(part, pid, day, 0.5 if pid == 4 else float(rng.integers(0, 9)) / 8)
            for part in (0, 1) for pid in range(11) for day in range(30) if rng.random() < 0.6 and (part == 0 or pid > 2)]
    rows += [(0, 20 + i, day, v) for i in range(3) for p, pid, day, v in rows if (p, pid) == (0, 1)]  # copies: r = 1 several times
    rows += [(2, 1, day, float(day)) for day in range(20)]
    d = spark.createDataFrame(rows, "part int, pid int, key int, v double")
    want = {}
    by = {}
    for part, pid, day, v in rows:
        by.setdefault((part, pid), {})[day] = v
    for (pa_, a), x in by.items():
        for (pb, b), y in by.items():
            both = sorted(set(x) & set(y))
            if pa_ == pb and a < b and len(both) >= 8 and 4 not in (a, b):
                r = np.corrcoef([x[k] for k in both], [y[k] for k in both])[0, 1]
                want.setdefault(pa_, []).append((-round(r, 9), a, b, len(both)))
    got = {}
    for r in pairs.best_pairs(d, 5, 8).orderBy("part", "place").collect():
        got.setdefault(r.part, []).append((-r.r, r.a, r.b, r.n))
    assert got.keys() == want.keys()
    for part, found in got.items():
        best = sorted(want[part])[:5]
        assert [x[1:] for x in found] == [x[1:] for x in best] and [x[0] for x in found] == pytest.approx([x[0] for x in best])


def test_target_quantiles_by_source_and_over_all(spark):
    d = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, None), (2, None)], "source int, value double")
    got = {r.source: (r.n, r.lo, r.mid, r.hi) for r in A.target_quantiles(d, {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert got == {0: (2, 1.0, 2.0, 3.0), 1: (1, 5.0, 5.0, 5.0), None: (3, 1.0, 3.0, 5.0)}
    assert A.target_quantiles(d.filter("value > 9"), {"lo": 0.0}).count() == 0


def test_blocks_grow_before_their_number(spark):
    """A packed row is copied once a block: 60 000 entities must not take a block for every 256 of them."""
    many = spark.range(60000).withColumnRenamed("id", "pid")
    assert pairs.n_blocks(many) == 15 and pairs.n_blocks(many.limit(1000)) == 4 and pairs.n_blocks(many.limit(6000)) == 8


@pytest.mark.parametrize("block", [256, 4])
def test_slices_of_a_block_give_what_whole_blocks_give(spark, monkeypatch, block):
    monkeypatch.setattr(pairs.n_blocks, "__defaults__", ("pid", block))
    known = spark.createDataFrame([(p, k, math.sin(p + k) + p * 0.1 * k) for p in range(11) for k in range(24) if (p + k) % 4], "pid long, key long, v double")
    targets = spark.createDataFrame([(p, k) for p in (0, 1, 5, 10, 99) for k in (2, 3, 4, 99)], "pid long, key long")

    def rows(size):
        monkeypatch.setattr(pairs, "SLICE", size)
        got = {"sums": pairs.pair_sums(known, "v"), "best": pairs.best_pairs(known, 6, 8), "edges": pairs.top_edges(known, 3, 8),
               "donors": pairs.donor_transfer(known, targets), "effects": pairs.weighted_day_effects(known, targets)}
        return {name: sorted(tuple(-9.0 if v is None else round(float(v), 7) for v in r) for r in d.collect()) for name, d in got.items()}
    whole, sliced = rows(1024), rows(2)
    for name in whole:
        assert len(whole[name]) == len(sliced[name]) > 0 and all(a == pytest.approx(b, abs=1e-6) for a, b in zip(whole[name], sliced[name])), name


def test_copies_of_a_packed_row_do_not_grow(spark):
    """Pairs, their statistics and day effects: eight copies of a row for 6 000 entities and for 360 000."""
    many = spark.range(360000).withColumnRenamed("id", "pid")
    assert [pairs.vast_blocks(many.limit(n)) for n in (1000, 6000, 60000, 360000)] == [4, 8, 8, 8]


def test_pairs_are_handed_on_slice_by_slice(spark, monkeypatch):
    """Six entities in one block, two a slice: six batches of at most four pairs, never all 15 at once."""
    monkeypatch.setattr(pairs, "SLICE", 2)
    known = spark.createDataFrame([(p, k, float((p * k) % 7)) for p in range(6) for k in range(10)], "pid long, key long, v double")
    sizes, real = [], type(known.groupBy("pid")).applyInPandas

    def traced(self, func, schema):
        packed = self._df.toPandas()
        sizes.extend(len(d) for d in func(iter([packed.iloc[:2], packed.iloc[2:]])))
        return real(self, func, schema)
    monkeypatch.setattr(type(known.groupBy("pid")), "applyInPandas", traced)
    got = pairs.pair_sums(known, "v")
    assert sizes == [1, 4, 4, 1, 4, 1] and got.count() == 15


def test_day_effects_shuffle_packed_rows_once(spark):
    """Mean correlation and weights read one exchange of the copies; own residuals are left out of the extremes."""
    known = spark.createDataFrame([(p, k, math.sin(p * k) - 0.1) for p in range(5) for k in range(12)], "pid long, key long, v double")
    asked = spark.createDataFrame([(p, k) for p in (0, 3) for k in (1, 2, 99)], "pid long, key long")
    d = pairs.weighted_day_effects(known, asked)
    rows = {(r.pid, r.key): r for r in d.collect()}
    assert len(rows) == 6 and rows[0, 99].lowest is None and rows[0, 99].wsum == 0
    for p in (0, 3):
        for k in (1, 2):
            others = [math.sin(q * k) - 0.1 for q in range(5) if q != p]
            assert rows[p, k].lowest == min(others) and rows[p, k].low_share == pytest.approx(sum(v < pairs.LOW_RESIDUAL for v in others) / 4)
    plan = d._jdf.queryExecution().executedPlan()
    d._jdf.collect()
    assert "ReusedExchange" in plan.toString()


def test_an_episode_with_two_driver_series_has_one_norm_of_both(spark):
    """Facts are each series' own; norms, dry spells and the number of norm years are the episode's."""
    first = {y: (np.datetime64(f"{y}-05-01") - np.datetime64(C.EPOCH)).astype(int) for y in range(2001, 2005)}
    rows = [(region, int(day) + i, amount, 10.0 * region) for y, day in first.items() for i in range(40) for region, amount in ((1, 2.0), (2, 0.5))]
    grid = D.with_calendar(spark.createDataFrame(rows, "region int, day int, precip double, temp double"))
    start = int(first[2004]) + 30
    ep = spark.createDataFrame([(1, 7, 2004, start, start, start + 9), (2, 7, 2004, start, start, start + 9)], "region int, pid int, year int, ep int, start int, end int")
    got = {r.region: r for r in D.episode_drivers(ep, grid, "region", ["pid", "year", "ep"]).filter("win = 'during'").collect()}
    assert {k: (r.n_days, r.amount, r.level) for k, r in got.items()} == {1: (10, 20.0, 10.0), 2: (10, 5.0, 20.0)}
    assert all((r.norm_years, r.amount_norm, r.level_norm, r.max_dry_spell) == (3, 25.0, 15.0, 10) for r in got.values())


def test_an_interval_does_not_lose_digits_to_the_days_before_it(spark):
    """The level of a late week is the plain mean of its days, however much lies before it."""
    level = lambda i: 1e6 + i / 3 if i < 2000 else 1e-3 * math.sin(i)
    grid = spark.createDataFrame([(1, i, level(i), level(i)) for i in range(2100)], "region int, day int, precip double, temp double")
    iv = spark.createDataFrame([(1, 2050, 2056)], "region int, a int, b int")
    r = D.interval_totals(iv, D.driver_sums(grid, "region", "precip", "temp"), "region").first()
    want = math.fsum(level(i) for i in range(2050, 2057))
    assert r.x_level == pytest.approx(want, rel=1e-9) and r.x_amount == pytest.approx(want, rel=1e-9) and r.x_days == 7


def test_a_filter_on_z_does_not_copy_the_norm(spark):
    """The norm's array is worked out once a row, whatever is filtered on; a norm of the norm replaces its columns."""
    rows = [(1, y, doy, math.sin(doy * y)) for y in range(2000, 2005) for doy in range(100, 130, 5)]
    d = spark.createDataFrame(rows, "pid int, year int, doy int, value double")
    z = norms.loyo_norm(norms.loyo_norm(d))
    assert z.columns == ["pid", "year", "doy", "value", "norm_n", "norm_years", "norm_mean", "norm_std", "z"]
    low = norms.loyo_norm(d).filter((F.col("z") < -1) | (F.col("z") > 1))
    plan = low._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") == 1 and "array_min" not in plan and "array_sort" not in plan
    for r in z.collect():
        others = [v for _, y, doy, v in rows if y != r.year and abs(doy - r.doy) <= C.NORM_WINDOW]
        assert (r.norm_n, r.norm_years) == (len(others), 4)
        assert (r.norm_mean, r.norm_std) == pytest.approx((np.mean(others), np.std(others)))
        assert r.z == pytest.approx((r.value - np.mean(others)) / np.std(others))


def test_donors_of_wide_blocks_meet_by_slices(spark, monkeypatch):
    """Slices and blocks decide nothing: the best donors and sums are those of one block, and blocks stay few as entities grow."""
    rows = [(p, k, round(math.sin(p * k) + (p % 3) * math.cos(k), 1)) for p in range(40) for k in range(60) if (p * 7 + k) % 5]
    known = spark.createDataFrame(rows, "pid long, key long, v double")
    targets = spark.createDataFrame([(p, k) for p in range(40) for k in range(60) if (p * 7 + k) % 5 == 0], "pid long, key long")
    out = []
    for patched in ({}, {"BLOCK": 2, "WIDE": 4, "VAST": 50, "SLICE": 3, "TARGETS": 5}):
        for name, size in patched.items():
            monkeypatch.setattr(pairs, name, size)
        d = pairs.donor_transfer(known, targets)
        out.append({(r.pid, r.key): r.asDict() for r in d.collect()})
    assert "42), 8) as int) AS _b" in d._jdf.queryExecution().optimizedPlan().toString()  # 10 blocks of WIDE entities otherwise
    assert len(out[0]) == targets.count() and any(r["pred_8"] is not None for r in out[0].values())
    for k, r in out[0].items():
        for c, want in r.items():
            assert out[1][k][c] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-9))


def test_order_statistics_send_on_wanted_cells_only(spark, monkeypatch):
    """While every task may know the wanted cells, rows of others leave no task; without that the same values come out."""
    rows = [(g, float(i * 37 % 101) if i % 3 else 5.0) for g in (1, 2, None) for i in range(400 if g == 1 else 30)] + [(3, None)]
    d = spark.createDataFrame(rows, "g int, v double")
    wants = {"low": lambda n: F.lit(1), "mid": lambda n: F.floor(n / 2), "last": lambda n: n, "none": lambda n: n + 1}
    out = []
    for goals in (quantiles.GOALS, 0):
        monkeypatch.setattr(quantiles, "GOALS", goals)
        got = quantiles.order_statistics(d, ["g"], "v", wants)
        out.append(got.collect())
        if goals:
            assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    want = []
    for g in (1, 2, None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        want.append((g, len(v), v[0], v[len(v) // 2 - 1], v[-1], None))
    for got in out:
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)

"""Queries: reconstruction G1..G25 and its scores."""

from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.functions import expr as E
from phenolake.operators import aggregate as A
from phenolake.operators import frames
from phenolake.operators import gapfill as G
from phenolake.operators import pairs
from phenolake.operators import drivers as D
from phenolake.operators.norms import loyo_norm
from phenolake.plans.ctes import cte
from phenolake.plans.q_join import day_source, same_source
from phenolake.plans.q_scan import DIST_EDGES, DIST_LABELS
from phenolake.plans.q_season import fit_sql, sums_sql
from phenolake.plans.q_window import composite_windows, filled
from phenolake.plans.registry import query
from phenolake.operators.smooth import loo_fit
from phenolake.operators.sampling import exact_share
from phenolake.sources.io import cut_lineage, shared_dir, write_predictions

METHODS = list(G.METHODS)

# ---------------------------------------------------------------- baselines
cte("clim", """SELECT t.pid, t.day, avg(k.value) FILTER (abs(k.doy - t.doy) <= 7) AS own_clim, avg(k.value) AS norm8 FROM {targets} t
LEFT JOIN {known} k ON k.pid = t.pid AND k.year <> t.year AND abs(k.doy - t.doy) <= 8 GROUP BY t.pid, t.day""")
cte("base", """SELECT *, coalesce((linear_time + climatology) / 2, linear_time, climatology) AS blend FROM (SELECT n.*, m AS nearest_mean,
coalesce(val_prev + (val_next - val_prev) * days_prev / (days_prev + days_next), m) AS linear_time,
CASE WHEN coalesce(days_prev, 1000000) <= coalesce(days_next, 1000000) THEN val_prev ELSE val_next END AS nearest_one,
coalesce(norm8, m) AS climatology, coalesce(own_clim, m) AS doy_entity_mean
FROM (SELECT *, coalesce((val_prev + val_next) / 2, val_prev, val_next) AS m FROM {nb}) n JOIN {clim} USING (pid, day))""")


@query("baseline_predictions", "pid:i date:d " + " ".join(f"{m}:f6" for m in METHODS), "SELECT * FROM {base}")
def _(t):
    return G.baseline_predictions(t.marked)


cte("long", " UNION ALL ".join(f"SELECT pid, date, year, source, min_dist, source_prev, source_next, value AS truth, '{m}' AS method, {m} AS pred FROM {{base}}" for m in METHODS))


def long(t):
    b = G.baseline_predictions(t.marked)
    return G.unpivot(b, ["pid", "date", "year", "source", "min_dist", "source_prev", "source_next"], "value", METHODS)


SCORE = "round(30 * greatest(0, 1 - rmse / 0.1e0) + 1.234567e-10, 2)"
METRIC_SQL = "count(pred) AS n, sqrt(avg((pred - truth) * (pred - truth))) AS rmse, avg(abs(pred - truth)) AS mae, count(*) FILTER (pred IS NULL) AS n_null"


@query("method_metrics", "method:s n:i rmse:f6 mae:f6 n_null:i score:f2",
       f"SELECT *, {SCORE} AS score FROM (SELECT method, {METRIC_SQL} FROM {{long}} GROUP BY method)")
def _(t):
    return G.method_metrics(long(t))


BINS = "CASE WHEN min_dist > 0 AND min_dist <= 3 THEN '1-3' WHEN min_dist <= 7 THEN '4-7' WHEN min_dist <= 15 THEN '8-15' WHEN min_dist <= 30 THEN '16-30' WHEN min_dist > 30 THEN '>30' END"


@query("grouped_rmse", "method:s dist:s n:i rmse:f6 mae:f6 n_null:i", f"SELECT method, {BINS} AS dist, {METRIC_SQL} FROM {{long}} GROUP BY method, {BINS}")
def _(t):
    return G.method_metrics(long(t).withColumn("dist", E.bin_edges(F.col("min_dist"), DIST_EDGES, DIST_LABELS)), ["dist"])


MATCH = """CASE WHEN coalesce(source_prev = source, true) AND coalesce(source_next = source, true) THEN 'both' WHEN NOT coalesce(source_prev = source, true)
AND NOT coalesce(source_next = source, true) THEN 'none' ELSE 'one' END"""


@query("rmse_by_source_match", "method:s match:s n:i rmse:f6", f"SELECT method, {MATCH} AS match, {METRIC_SQL} FROM {{long}} GROUP BY method, {MATCH}")
def _(t):
    p = F.coalesce(F.col("source_prev") == F.col("source"), F.lit(True))
    n = F.coalesce(F.col("source_next") == F.col("source"), F.lit(True))
    return G.method_metrics(long(t).withColumn("match", F.when(p & n, "both").when(~p & ~n, "none").otherwise("one")), ["match"])


@query("error_concentration", "method:s share_points:f6 share_sse:f6", """SELECT method, avg(CASE WHEN abs(pred - truth) > 0.2e0 THEN 1.0 WHEN pred IS NOT NULL THEN 0.0 END)
AS share_points, sum(CASE WHEN abs(pred - truth) > 0.2e0 THEN pow(pred - truth, 2) ELSE 0 END) / sum(pow(pred - truth, 2)) AS share_sse FROM {long} GROUP BY method""")
def _(t):
    return G.error_concentration(long(t))


@query("stratified_rmse", "method:s rmse:f6 n_strata:i", """SELECT method, sqrt(sum(w * mse) / sum(w)) AS rmse, count(*) AS n_strata FROM (
SELECT method, avg(pow(pred - truth, 2)) AS mse, CASE source WHEN 0 THEN 3.0e0 WHEN 1 THEN 1.0e0 END AS w FROM {long} WHERE source < 2 AND abs(pred - truth) <= 0.5e0
GROUP BY method, source) GROUP BY method""")
def _(t):
    d = long(t).withColumn("stratum", E.source_label(F.col("source")))
    return G.stratified_rmse(d, "stratum", {"s1": 3.0, "s2": 1.0}, trim=0.5)


def seeds_long(t):
    """Hidden rows of three masks at once: the mask is a column of the panel and part of every key, so one plan serves all of them."""
    d = t.panel.withColumn("seed", F.explode(F.array(*map(F.lit, ("777", "999", "2026")))))
    m = exact_share(d, ["seed", "pid", "date"], C.GAP_SHARE, None, "is_gap", ["seed"])
    d = frames.neighbors(m, ["seed", "pid"], G.gap(), G.known()).withColumns({
        "nearest_mean": frames.either(F.col("val_prev"), F.col("val_next")), "prev_only": F.col("val_prev")})
    return G.unpivot(d.withColumn("stratum", E.source_label(F.col("source"))), ["seed", "stratum"], "value", ["nearest_mean", "prev_only"])


def _seed_sql(seed):
    return f"""SELECT '{seed}' AS seed, source, value AS truth, coalesce((p + n) / 2, p, n) AS nearest_mean, p AS prev_only FROM (SELECT *,
last_value(CASE WHEN NOT g THEN value END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
first_value(CASE WHEN NOT g THEN value END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', pid, date))) <= round(count(*) OVER () * 0.15) AS g FROM {{panel}})) WHERE g"""


cte("seeds", " UNION ALL ".join(_seed_sql(s) for s in ("777", "999", "2026")))
cte("seeds_long", "SELECT seed, source, truth, 'nearest_mean' AS method, nearest_mean AS pred FROM {seeds} UNION ALL SELECT seed, source, truth, 'prev_only', prev_only FROM {seeds}")


@query("holdout_report", "method:s stratum:s n_runs:i mean_rmse:f6 spread:f6", """SELECT method, stratum, count(*) AS n_runs, avg(rmse) AS mean_rmse,
max(rmse) - min(rmse) AS spread FROM (SELECT method, seed, coalesce('s' || (source + 1), 'all') AS stratum, sqrt(avg(pow(pred - truth, 2))) AS rmse
FROM {seeds_long} GROUP BY GROUPING SETS ((method, seed, source), (method, seed))) GROUP BY method, stratum""")
def _(t):
    return G.holdout_report(seeds_long(t), "seed", "stratum")


@query("score_holdout", "seed:s method:s n:i rmse:f6 target_rmse:f6 score:f2", f"""SELECT *, round(30 * greatest(0, 1 - target_rmse / 0.1e0) + 1.234567e-10, 2) AS score FROM (
SELECT seed, method, count(pred) AS n, sqrt(avg(pow(pred - truth, 2))) AS rmse, sqrt(avg(pow(pred - truth, 2)) FILTER (source = 0)) AS target_rmse FROM {{seeds_long}} GROUP BY ALL)""")
def _(t):
    e = F.pow(F.col("pred") - F.col("truth"), 2)
    g = seeds_long(t).groupBy("seed", "method").agg(F.count("pred").alias("n"), F.sqrt(F.avg(e)).alias("rmse"),
                                                    F.sqrt(F.avg(F.when(F.col("stratum") == "s1", e))).alias("target_rmse"))
    return g.withColumn("score", E.bounded_score(F.col("target_rmse")))


GAP_COLS = ("n:i prev_q50:f6 next_q50:f6 dist_q25:f6 dist_q50:f6 dist_q75:f6 dist_q90:f6 le3:f6 le7:f6 le15:f6 no_prev:f6 no_next:f6 no_any:f6 "
            "n15_median:f6 zero15:f6 nearest_s1:i nearest_s2:i nearest_s3:i nearest_none:i")


@query("gap_summary", GAP_COLS, """SELECT count(*) AS n, quantile_cont(days_prev, 0.5) AS prev_q50, quantile_cont(days_next, 0.5) AS next_q50,
quantile_cont(min_dist, 0.25) AS dist_q25, quantile_cont(min_dist, 0.5) AS dist_q50, quantile_cont(min_dist, 0.75) AS dist_q75, quantile_cont(min_dist, 0.9) AS dist_q90,
avg(CASE WHEN min_dist <= 3 THEN 1.0 ELSE 0.0 END) AS le3, avg(CASE WHEN min_dist <= 7 THEN 1.0 ELSE 0.0 END) AS le7, avg(CASE WHEN min_dist <= 15 THEN 1.0 ELSE 0.0 END) AS le15,
avg((days_prev IS NULL)::INT) AS no_prev, avg((days_next IS NULL)::INT) AS no_next, avg((min_dist IS NULL)::INT) AS no_any, median(n15) AS n15_median,
avg((n15 = 0)::INT) AS zero15, count(*) FILTER (src = 0) AS nearest_s1, count(*) FILTER (src = 1) AS nearest_s2, count(*) FILTER (src = 2) AS nearest_s3,
count(*) FILTER (src IS NULL) AS nearest_none FROM (SELECT *, CASE WHEN coalesce(days_prev, 1000000) <= coalesce(days_next, 1000000) THEN source_prev ELSE source_next END AS src,
(SELECT count(*) FROM {known} k WHERE k.pid = t.pid AND abs(k.day - t.day) <= 15) AS n15 FROM {nb_season} t)""")
def _(t):
    """Distances are whole days within a season, so their quantile buffers hold a few hundred values at most."""
    d = t.marked.withColumn("n15", frames.count_in_window(G.known(), 15, ["pid"]))
    d = frames.neighbors(d, ["pid", "year"], G.gap(), G.known())
    far = F.lit(1 << 20)
    src = F.when(F.coalesce("days_prev", far) <= F.coalesce("days_next", far), F.col("source_prev")).otherwise(F.col("source_next"))
    m, q = F.col("min_dist"), lambda c, p: F.percentile(c, F.lit(p))
    return d.withColumn("src", src).agg(
        F.count("*").alias("n"), q("days_prev", 0.5).alias("prev_q50"), q("days_next", 0.5).alias("next_q50"),
        *[q("min_dist", p / 100).alias(f"dist_q{p}") for p in (25, 50, 75, 90)], *[A.share(F.coalesce(m <= k, F.lit(False))).alias(f"le{k}") for k in (3, 7, 15)],
        A.share(F.col("days_prev").isNull()).alias("no_prev"), A.share(F.col("days_next").isNull()).alias("no_next"), A.share(m.isNull()).alias("no_any"),
        q("n15", 0.5).alias("n15_median"), A.share(F.col("n15") == 0).alias("zero15"),
        *[F.count(F.when(F.col("src") == i, 1)).alias(f"nearest_s{i + 1}") for i in range(3)], F.count(F.when(F.col("src").isNull(), 1)).alias("nearest_none"))


# ---------------------------------------------------------------- source guess
def guess_sql(loo):
    own1, own2 = (" - (NOT is_gap AND s1 IS NOT NULL)::INT", " - (NOT is_gap AND s2 IS NOT NULL)::INT") if loo else ("", "")
    return f"""SELECT *, CASE WHEN c1 > 0 THEN 0 WHEN c2 > 0 THEN 1 WHEN doy % 16 = 1 THEN 2 ELSE -1 END AS guess FROM (SELECT *,
count(*) FILTER (NOT is_gap AND s1 IS NOT NULL) OVER (PARTITION BY pid, year, ((day % 5) + 5) % 5){own1} AS c1,
count(*) FILTER (NOT is_gap AND s2 IS NOT NULL) OVER (PARTITION BY pid, year, ((day % 8) + 8) % 8){own2} AS c2 FROM {{marked}})"""


cte("guess_loo", guess_sql(True))
cte("guess", guess_sql(False))


@query("guess_source", "pid:i date:d guess:i", "SELECT pid, date, guess FROM {guess} WHERE is_gap")
def _(t):
    return G.guess_source(t.marked).filter(G.gap())


@query("confusion", "source:i g0:i g1:i g2:i gn:i", "SELECT source, " + ", ".join(f"count(*) FILTER (guess = {g}) AS {n}" for g, n in ((0, "g0"), (1, "g1"), (2, "g2"), (-1, "gn"))) +
       " FROM {guess_loo} WHERE NOT is_gap GROUP BY source")
def _(t):
    d = G.guess_source(t.marked, loo=True).filter(G.known())
    return d.groupBy("source").agg(*[F.count(F.when(F.col("guess") == g, 1)).alias(n) for g, n in ((0, "g0"), (1, "g1"), (2, "g2"), (-1, "gn"))])


@query("guess_accuracy_by_year", "year:i accuracy:f6", "SELECT year, avg((guess = source)::INT) AS accuracy FROM {guess_loo} WHERE NOT is_gap GROUP BY year")
def _(t):
    return G.guess_source(t.marked, loo=True).filter(G.known()).groupBy("year").agg(A.share(F.col("guess") == F.col("source")).alias("accuracy"))


def fill_known_answers(marked, answers):
    """Hidden rows take the answer as the value of the guessed source (the first one when there is no guess)."""
    d = G.guess_source(marked).join(answers.select("pid", "date", "answer"), ["pid", "date"], "left")
    use = G.gap() & F.col("answer").isNotNull()
    code = F.when(F.col("guess") >= 0, F.col("guess")).otherwise(F.lit(0))
    cols = {s: F.when(use & (code == i), F.col("answer")).when(use | G.gap(), F.lit(None).cast("double")).otherwise(F.col(s)) for i, s in enumerate(C.SOURCES)}
    return d.withColumns({**cols, "filled": use})


@query("fill_known_answers", "pid:i date:d s1:f9 s2:f9 s3:f9 filled:b", "SELECT pid, date, " + ", ".join(
    f"CASE WHEN NOT is_gap THEN s{i + 1} WHEN greatest(guess, 0) = {i} AND value > 0.4e0 THEN value END AS s{i + 1}" for i in range(3)) +
       ", is_gap AND value > 0.4e0 AS filled FROM {guess}")
def _(t):
    return fill_known_answers(t.marked, t.targets.filter(F.col("value") > 0.4).withColumnRenamed("value", "answer"))


cte("koff", "SELECT avg(s2 - s1) AS o2, avg(s3 - s1) AS o3 FROM {known}")


def aware_sql(code):
    o = lambda c: f"CASE {c} WHEN 0 THEN 0 WHEN 1 THEN o2 WHEN 2 THEN o3 END"
    vp, vn = f"(val_prev - {o('source_prev')})", f"(val_next - {o('source_next')})"
    return (f"coalesce({vp} + ({vn} - {vp}) * days_prev / (days_prev + days_next), ({vp} + {vn}) / 2, {vp}, {vn}) + coalesce({o(code)}, 0)")


@query("source_aware", "pid:i date:d guessed:f6 oracle:f6",
       f"SELECT n.pid, n.date, {aware_sql('guess')} AS guessed, {aware_sql('n.source')} AS oracle FROM {{nb}} n JOIN (SELECT pid, date, guess FROM {{guess}}) USING (pid, date) CROSS JOIN {{koff}}")
def _(t):
    off = A.source_offsets(t.known)
    d = frames.neighbors(G.guess_source(t.marked), ["pid"], G.gap(), G.known())
    return d.withColumns({"guessed": G.source_aware(d, off, F.col("guess")), "oracle": G.source_aware(d, off, F.col("source"))})


@query("interpolate_time", "pid:i date:d interp:f6", "SELECT pid, date, linear_time AS interp FROM {base}")
def _(t):
    d = frames.neighbors(t.marked, ["pid"], G.gap(), G.known())
    vp, vn = F.col("val_prev"), F.col("val_next")
    return d.withColumn("interp", F.coalesce(frames.interpolate(vp, vn, F.col("days_prev"), F.col("days_next")), frames.either(vp, vn)))


# ---------------------------------------------------------------- features
CY = [f"cy_{s}_{k}" for s, ps in (("s1", (5,)), ("s2", (8, 16))) for p in ps for k in (f"r{p}_year", f"r{p}_win", f"r{p}_prev", f"r{p}_next")] + [
    f"cy_{s}_{k}" for s in ("s1", "s2", "s3") for k in ("year", "win")] + ["cy_s3_r16_prev", "cy_s3_r16_next"]


def _cy_sql():
    cols, mod = [], lambda c, p: f"(({c}.day % {p}) + {p}) % {p}"
    for s, ps, w in (("s1", (5,), 30), ("s2", (8, 16), 40), ("s3", (16,), 40)):
        src = f"k.source = {int(s[1]) - 1}"
        cols += [f"count(*) FILTER ({src} AND k.year = t.year) AS cy_{s}_year", f"count(*) FILTER ({src} AND abs(k.day - t.day) <= {w}) AS cy_{s}_win"]
        for p in ps:
            same = f"{src} AND {mod('k', p)} = {mod('t', p)}"
            cols += [f"count(*) FILTER ({same} AND k.year = t.year) AS cy_{s}_r{p}_year", f"count(*) FILTER ({same} AND abs(k.day - t.day) <= {w}) AS cy_{s}_r{p}_win",
                     f"min(t.day - k.day) FILTER ({same} AND k.day < t.day) AS cy_{s}_r{p}_prev", f"min(k.day - t.day) FILTER ({same} AND k.day > t.day) AS cy_{s}_r{p}_next"]
    return "SELECT t.pid, t.date, " + ", ".join(cols) + " FROM {targets} t LEFT JOIN {known} k ON k.pid = t.pid GROUP BY t.pid, t.date"


@query("cycle_features", "pid:i date:d " + " ".join(f"{c}:i" for c in CY), _cy_sql())
def _(t):
    return G.cycle_features(t.by_entity(t.marked)).filter(G.gap())


FITS = {"sl_6": ("b.source <> 2", 6), "sl_15": ("b.source <> 2", 15), "md_15": ("b.source = 2", 15), "all_6": ("true", 6), "all_15": ("true", 15)}


def _curves_sql():
    sums = ", ".join(sums_sql(bw, cond=cond).replace(" AS s", f" AS {n}_s").replace(" AS t", f" AS {n}_t").replace("sum(", "coalesce(sum(").replace(f") AS {n}", f"), 0) AS {n}")
                     for n, (cond, bw) in FITS.items())
    cols = []
    for n in FITS:
        v, s, w = fit_sql(f"{n}_")
        cols += [f"{v} AS {n}", f"{s} AS {n}_slope", f"{w} AS {n}_weight"]
    return f"SELECT *, sl_15 - md_15 AS sl_minus_md FROM (SELECT pid, day, date, {', '.join(cols)} FROM (SELECT a.pid, a.day, a.date, {sums} FROM {{targets}} a LEFT JOIN {{known_h}} b ON a.pid = b.pid AND abs(b.day - a.day) <= 45 GROUP BY a.pid, a.day, a.date))"


@query("curve_features", "pid:i day:i " + " ".join(f"{n}:f4 {n}_slope:f4 {n}_weight:f6" for n in FITS) + " sl_minus_md:f4", _curves_sql())
def _(t):
    return G.curve_features(t.marked)


_lv, _, _lw = fit_sql("", loo=True)
cte("gres", " UNION ALL ".join(f"""SELECT pid, day, year, source, CASE WHEN n >= 3 AND {_lw} >= 0.5 THEN y - ({_lv}) END AS res FROM (
SELECT a.pid, a.day, a.year, a.source, a.n, any_value(a.h) AS y, {sums_sql(bw)} FROM (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM {{known_h}} WHERE {c}) a
JOIN (SELECT * FROM {{known_h}} WHERE {c}) b ON a.pid = b.pid AND abs(b.day - a.day) <= {3 * bw} GROUP BY ALL)""" for c, bw in (("source <> 2", 8), ("source = 2", 15))))


@query("loo_residuals", "pid:i day:i source:i res:f4", "SELECT pid, day, source, res FROM {gres}")
def _(t):
    return G.loo_residuals(t.known)


cte("dtab", """SELECT day, year, source, sum(res) AS sum, count(res) AS cnt, count(*) AS n_obs, any_value(active) AS active FROM {gres}
JOIN (SELECT year, count(DISTINCT pid) AS active FROM {gres} GROUP BY year) USING (year) GROUP BY day, year, source""")


@query("day_tables", "day:i source:i sum:f4 cnt:i n_obs:i active:i", "SELECT * FROM {dtab}")
def _(t):
    return G.day_tables(G.loo_residuals(t.known))


DE = [(s, o) for s in (1, 2, 3) for o in G.DAY_OFFSETS]


@query("day_effects", "pid:i date:d active:i " + " ".join(f"de_s{s}_{o}:f4 de_s{s}_{o}_n:i" for s, o in DE) + " " + " ".join(f"xp_s{s}_n:i xp_s{s}_share:f6" for s in (1, 2, 3)),
       "SELECT t.pid, t.date, any_value(y.active) AS active, " + ", ".join(
           f"sum(d.sum) FILTER (d.source = {s - 1} AND d.day - t.day IN {str(G.DAY_OFFSETS[o]).replace(',)', ')')}) / nullif(sum(d.cnt) FILTER (d.source = {s - 1} AND d.day - t.day IN {str(G.DAY_OFFSETS[o]).replace(',)', ')')}), 0) AS de_s{s}_{o}, "
           f"coalesce(sum(d.cnt) FILTER (d.source = {s - 1} AND d.day - t.day IN {str(G.DAY_OFFSETS[o]).replace(',)', ')')}), 0) AS de_s{s}_{o}_n" for s, o in DE) + ", " + ", ".join(
           f"coalesce(sum(d.n_obs) FILTER (d.source = {s - 1} AND d.day = t.day), 0) AS xp_s{s}_n, coalesce(sum(d.n_obs) FILTER (d.source = {s - 1} AND d.day = t.day), 0) / CAST(any_value(y.active) AS DOUBLE) AS xp_s{s}_share" for s in (1, 2, 3)) +
       " FROM {targets} t LEFT JOIN {dtab} d ON abs(d.day - t.day) <= 3 LEFT JOIN (SELECT DISTINCT year, active FROM {dtab}) y ON y.year = t.year GROUP BY t.pid, t.date")
def _(t):
    return G.day_effects(t.targets, G.day_tables(G.loo_residuals(t.known)))


@query("others_effect", "pid:i day:i source:i others_n:i others_effect:f4", """SELECT pid, day, source, n - k AS others_n, CASE WHEN n > k THEN (s - coalesce(res, 0)) / (n - k) END AS others_effect
FROM (SELECT pid, day, source, res, CASE WHEN res IS NULL THEN 0 ELSE 1 END AS k, sum(res) OVER w AS s, count(res) OVER w AS n FROM {gres} WINDOW w AS (PARTITION BY day, source))""")
def _(t):
    res = cut_lineage(G.loo_residuals(t.known))
    return G.others_effect(res, G.day_tables(res))


@query("predictions_round_trip", "pid:i date:d pred:f9",
       "SELECT pid, date, least(1.0e0, greatest(-0.2e0, coalesce((val_prev + val_next) / 2, val_prev, val_next, 0.0e0))) AS pred FROM {nb}")
def _(t):
    """The nearest-mean baseline through the checked sink, and read again."""
    n = frames.neighbors(t.marked, ["pid"], G.gap(), G.known())
    pred = n.select("pid", "date", F.coalesce(frames.either(F.col("val_prev"), F.col("val_next")), F.lit(0.0)).alias("pred"))
    path = shared_dir(t.spark)
    write_predictions(cut_lineage(pred), t.targets, path)
    return t.spark.read.schema("pid long, date date, pred double").option("header", True).option("mode", "FAILFAST").csv(path)


@query("residual_bias", "pid:i year:i " + " ".join(f"r{s}:f4 r{s}_n:i r{s}_y:f4 r{s}_y_n:i" for s in (1, 2, 3)), "SELECT pid, year, " + ", ".join(
    f"r{s}_y, r{s}_y_n, sum(r{s}_s) OVER p / nullif(sum(r{s}_y_n) OVER p, 0) AS r{s}, sum(r{s}_y_n) OVER p AS r{s}_n" for s in (1, 2, 3)) + " FROM (SELECT pid, year, " + ", ".join(
    f"avg(res) FILTER (source = {s - 1}) AS r{s}_y, sum(res) FILTER (source = {s - 1}) AS r{s}_s, count(res) FILTER (source = {s - 1}) AS r{s}_y_n" for s in (1, 2, 3)) +
       " FROM {gres} GROUP BY pid, year) WINDOW p AS (PARTITION BY pid)")
def _(t):
    return A.entity_bias(G.loo_residuals(t.known), {f"r{s}": F.when(F.col("source") == s - 1, F.col("res")) for s in (1, 2, 3)})


cte("clim_ctx", """SELECT k.pid, k.year, k.day, CASE WHEN count(b.h) >= 3 THEN k.h - avg(b.h) END AS an FROM {known_h} k LEFT JOIN {known_h} b
ON k.pid = b.pid AND k.year <> b.year AND abs(k.doy - b.doy) <= 7 GROUP BY k.pid, k.year, k.day, k.h""")
CL = "clim_mean:f6 clim_std:f5 clim_n:i anom_30:f6 anom_30_n:i anom_60:f6 anom_60_n:i clim_plus_anom:f6"


@query("climatology_features", "pid:i date:d " + CL, """SELECT c.*, clim_mean + coalesce(anom_30, 0) AS clim_plus_anom, anom_30, anom_30_n, anom_60, anom_60_n FROM (
SELECT t.pid, t.date, t.day, avg(b.h) AS clim_mean, CASE WHEN count(b.h) > 1 THEN CASE WHEN stddev_pop(b.h) < 1e-6 THEN 0 ELSE stddev_pop(b.h) END END AS clim_std,
count(b.h) AS clim_n FROM {targets} t LEFT JOIN {known_h} b ON t.pid = b.pid AND t.year <> b.year AND abs(t.doy - b.doy) <= 7 GROUP BY t.pid, t.date, t.day) c JOIN (
SELECT t.pid, t.day, avg(an) FILTER (abs(x.day - t.day) <= 30) AS anom_30, count(an) FILTER (abs(x.day - t.day) <= 30) AS anom_30_n, avg(an) AS anom_60, count(an) AS anom_60_n
FROM {targets} t LEFT JOIN {clim_ctx} x ON x.pid = t.pid AND x.year = t.year AND abs(x.day - t.day) <= 60 GROUP BY t.pid, t.day) a USING (pid, day)""")
def _(t):
    return G.climatology_features(t.marked).filter(G.gap())


def driver_features(t):
    """Drivers of the entity's region on the target's day and accumulated before it."""
    w = D.driver_windows(filled(t), ["region"], "precip", "temp").withColumnRenamed("region", "category").drop("date", "year", "doy")
    return t.targets.join(t.categories, "pid").join(w, ["category", "day"], "left")


@query("driver_features", "pid:i date:d precip:f6 temp:f6 amount_7:f6 level_7:f6", """SELECT t.pid, t.date, f.precip, f.temp, amount_7, level_7 FROM {targets} t
JOIN supplier ON s_suppkey = t.pid LEFT JOIN (SELECT region, day, precip, temp, CASE WHEN count(precip) OVER w >= 4 THEN sum(precip) OVER w END AS amount_7,
CASE WHEN count(temp) OVER w >= 4 THEN avg(temp) OVER w END AS level_7 FROM {filled} WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)) f
ON f.region = s_nationkey AND f.day = t.day""")
def _(t):
    return driver_features(t)


# ---------------------------------------------------------------- pairs of entities
cte("pst_u", """SELECT a.pid AS a, b.pid AS b, count(*) AS n, avg(a.s1) AS mean_a, avg(b.s1) AS mean_b, greatest(avg(a.s1 * a.s1) - pow(avg(a.s1), 2), 0) AS va,
greatest(avg(b.s1 * b.s1) - pow(avg(b.s1), 2), 0) AS vb, avg(a.s1 * b.s1) - avg(a.s1) * avg(b.s1) AS cov
FROM {known} a JOIN {known} b ON a.day = b.day AND a.pid <> b.pid WHERE a.s1 IS NOT NULL AND b.s1 IS NOT NULL GROUP BY ALL""")
cte("pst", """SELECT a, b, n, mean_a, mean_b, least(2, greatest(0, cov / (vb + 0.002e0))) AS beta, CASE WHEN n >= 12 THEN
pow(least(1, greatest(0, cov / sqrt(greatest(va * vb, 1e-8)))), 4) * n / (n + 40) ELSE 0 END AS score FROM {pst_u}""")


def s1_rows(df):
    return df.filter("s1 IS NOT NULL").select("pid", F.col("day").cast("long").alias("key"), F.col("s1").alias("v"))


@query("pair_statistics", "a:i b:i n:i mean_a:f6 mean_b:f6 beta:f5 score:f6", "SELECT * FROM {pst}")
def _(t):
    return pairs.pair_statistics(pairs.pair_sums(s1_rows(t.known), "v"))


#: series that donors are compared on: values of each source, and their residuals from the source's own curve
KINDS = [(i, kind) for i in (1, 2, 3) for kind in ("value", "res")]
RAW_BW = {1: 8, 2: 8, 3: 15}
KS = ((1, "1"), (3, "3"), (8, "8"), (1000000000, "all"))
_rv, _, _rw = fit_sql("", loo=True, min_points="2")
for _i, _kind in KINDS:
    if _kind == "value":
        cte(f"dv{_i}value", f"SELECT pid, day, s{_i} AS v FROM {{known}} WHERE s{_i} IS NOT NULL")
    else:
        cte(f"dv{_i}res", f"""SELECT pid, day, greatest(-0.3e0, least(0.3e0, y - ({_rv}))) AS v FROM (SELECT a.pid, a.day, any_value(a.v) AS y, {sums_sql(RAW_BW[_i], y="b.v")}
FROM {{dv{_i}value}} a JOIN {{dv{_i}value}} b ON a.pid = b.pid AND abs(b.day - a.day) <= {3 * RAW_BW[_i]} GROUP BY a.pid, a.day) WHERE {_rw} >= 0.5""")
    _y = "p.mean_a + p.beta * (k.v - p.mean_b)" if _kind == "value" else "p.beta * k.v"
    cte(f"dp{_i}{_kind}", f"""SELECT a, b, n, ma AS mean_a, mb AS mean_b, least(2, greatest(0, cov / (vb + 0.002e0))) AS beta, CASE WHEN n >= 12 THEN
pow(least(1, greatest(0, cov / sqrt(greatest(va * vb, 1e-8)))), 4) * n / (n + 40) ELSE 0 END AS score FROM (SELECT a.pid AS a, b.pid AS b, count(*) AS n, avg(a.v) AS ma, avg(b.v) AS mb,
greatest(avg(a.v * a.v) - pow(avg(a.v), 2), 0) AS va, greatest(avg(b.v * b.v) - pow(avg(b.v), 2), 0) AS vb, avg(a.v * b.v) - avg(a.v) * avg(b.v) AS cov
FROM {{dv{_i}{_kind}}} a JOIN {{dv{_i}{_kind}}} b ON a.day = b.day AND a.pid <> b.pid GROUP BY ALL)""")
    cte(f"dn{_i}{_kind}", "SELECT pid, day, " + ", ".join(
        f"sum(w * y) FILTER (r <= {k}) / sum(w) FILTER (r <= {k}) AS sp_s{_i}_{_kind}_{n}, sum(w) FILTER (r <= {k}) AS sp_s{_i}_{_kind}_{n}_w" for k, n in KS) + f"""
FROM (SELECT t.pid, t.day, p.score AS w, {_y} AS y, row_number() OVER (PARTITION BY t.pid, t.day ORDER BY p.score DESC, k.pid) AS r
FROM {{targets}} t JOIN {{dv{_i}{_kind}}} k ON k.day = t.day AND k.pid <> t.pid JOIN {{dp{_i}{_kind}}} p ON p.a = t.pid AND p.b = k.pid WHERE p.score > 0) GROUP BY pid, day""")


def _part(d, i):
    """Number of the source, apart for every mask of the panel."""
    return (F.col("mask").cast("long") * 4 if "mask" in d.columns else F.lit(0).cast("long")) + i


def is_source(i):
    return F.pmod("part", F.lit(4)) == i


def raw_rows(known):
    """Rows of every raw source column, the chosen source or not; ``part`` tells the source."""
    each = F.explode(F.array(*[F.struct(_part(known, i).alias("part"), F.col(f"s{i}").alias("v")) for i in (1, 2, 3)]))
    return known.select("*", each.alias("x")).select("pid", "day", "x.part", "x.v").filter("v IS NOT NULL")


def raw_residuals(rows):
    """Residual of each raw row from the curve of its own entity and source, clipped; rows that the curve can't judge are left out."""
    out = None
    for i, bw in RAW_BW.items():
        f = loo_fit(rows.filter(is_source(i)), ["pid"], "v", float(bw), min_points=2.0)
        f = f.filter("fit_weight >= 0.5").select("pid", "day", "part", E.clip(F.col("v") - F.col("fit"), -0.3, 0.3).alias("v"))
        out = f if out is None else out.unionByName(f)
    return out


def keyed(d):
    return d.withColumn("key", F.col("day").cast("long"))


def by_source(targets):
    """Each target once for every source."""
    return targets.select("pid", F.col("day").cast("long").alias("key"), F.explode(F.array(*[_part(targets, i) for i in (1, 2, 3)])).alias("part"))


def donors(known, targets):
    """One row a target: donors' values and residuals of the three sources, by the best 1, 3, 8 and by all."""
    rows, targets = cut_lineage(raw_rows(known)), cut_lineage(targets.select(*[c for c in ("mask",) if c in targets.columns], "pid", "day"))
    series = {"value": rows, "res": cut_lineage(raw_residuals(rows))}
    names = [n for _, n in KS]
    wide = []
    for kind, d in series.items():
        got = pairs.donor_transfer(keyed(d), by_source(targets), residuals=kind == "res")
        wide.append(got.select("pid", F.col("key").alias("day"), "part", F.lit(kind).alias("kind"), *[c for n in names for c in (f"pred_{n}", f"w_{n}")]))
    at = lambda i, kind: is_source(i) & (F.col("kind") == kind)
    return wide[0].unionByName(wide[1]).groupBy("pid", "day").agg(*[
        F.max(F.when(at(i, kind), F.col(c))).alias(f"sp_s{i}_{kind}_{n}{'_w' if c[0] == 'w' else ''}") for i, kind in KINDS for n in names for c in (f"pred_{n}", f"w_{n}")])


SP = [f"sp_s{i}_{kind}_{n}" for i, kind in KINDS for _, n in KS]


@query("donor_transfer", "pid:i day:i " + " ".join(f"{c}:f5 {c}_w:f6" for c in SP),
       "SELECT t.pid, t.day, " + ", ".join(f"{c}, coalesce({c}_w, 0) AS {c}_w" for c in SP) + " FROM {targets} t " + " ".join(
           f"LEFT JOIN {{dn{i}{kind}}} d{i}{kind} ON d{i}{kind}.pid = t.pid AND d{i}{kind}.day = t.day" for i, kind in KINDS))
def _(t):
    return donors(t.known, t.targets)


AN = [f"an_s{i}_bw{b}_k{k}" for i in (1, 2, 3) for b in (15, 35) for k in (1, 3, 10)]
_av, _, _aw = fit_sql("", min_points="2")
for _i in (1, 2, 3):
    cte(f"top10_{_i}", f"SELECT a, b, score FROM {{dp{_i}value}} WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 10")
    cte(f"deltas{_i}", f"""SELECT a, b, day, y - CASE WHEN pd IS NULL THEN nv WHEN nd IS NULL THEN pv WHEN nd = pd THEN pv ELSE pv + (nv - pv) * (day - pd) / (nd - pd) END AS delta FROM (
SELECT e.a, e.b, o.day, o.v AS y, p.day AS pd, p.v AS pv, n.day AS nd, n.v AS nv FROM {{top10_{_i}}} e JOIN {{dv{_i}value}} o ON o.pid = e.a
ASOF LEFT JOIN {{dv{_i}value}} p ON p.pid = e.b AND o.day >= p.day ASOF LEFT JOIN {{dv{_i}value}} n ON n.pid = e.b AND o.day <= n.day)
WHERE least(day - pd, nd - day) <= 12""")
    for _bw in (15, 35):
        cte(f"an{_i}_{_bw}", f"""SELECT pid, day, b, w, v + ({_av}) AS pred FROM (SELECT t.pid, t.day, e.b, e.score AS w, any_value(k.v) AS v, {sums_sql(_bw, y="d.delta", e="t.day", p="d.day")}
FROM {{targets}} t JOIN {{top10_{_i}}} e ON e.a = t.pid JOIN {{dv{_i}value}} k ON k.pid = e.b AND k.day = t.day JOIN {{deltas{_i}}} d ON d.a = e.a AND d.b = e.b AND abs(d.day - t.day) <= {3 * _bw}
GROUP BY t.pid, t.day, e.b, e.score) WHERE {_aw} > 0.5""")
        cte(f"an{_i}_{_bw}k", "SELECT pid, day, " + ", ".join(
            f"CASE WHEN sum(w) FILTER (r <= {k}) > 1e-9 THEN sum(w * pred) FILTER (r <= {k}) / sum(w) FILTER (r <= {k}) END AS an_s{_i}_bw{_bw}_k{k}, sum(w) FILTER (r <= {k}) AS an_s{_i}_bw{_bw}_k{k}_w" for k in (1, 3, 10)) +
            f" FROM (SELECT *, row_number() OVER (PARTITION BY pid, day ORDER BY w DESC, b) AS r FROM {{an{_i}_{_bw}}}) GROUP BY pid, day")


def analogs(known, targets):
    """One row a target: the donors' own values on the hidden day plus the smooth difference to each, for the three sources."""
    rows, asked = cut_lineage(raw_rows(known)), cut_lineage(targets.select("pid", "day"))
    edges, out = cut_lineage(pairs.top_edges(keyed(rows), 10)), asked
    for i in (1, 2, 3):
        own = lambda d, i=i: d.filter(is_source(i)).drop("part")
        found = pairs.donor_analog(own(rows), asked, own(edges))
        out = out.join(found.withColumnsRenamed({c: f"an_s{i}_{c}" for c in found.columns if c[:2] == "bw"}), ["pid", "day"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in out.columns if c.endswith("_w")})


@query("donor_analog", "pid:i day:i " + " ".join(f"{c}:f5 {c}_w:f6" for c in AN), "SELECT t.pid, t.day, " + ", ".join(f"{c}, coalesce({c}_w, 0) AS {c}_w" for c in AN) +
       " FROM {targets} t " + " ".join(f"LEFT JOIN {{an{i}_{b}k}} a{i}_{b} ON a{i}_{b}.pid = t.pid AND a{i}_{b}.day = t.day" for i in (1, 2, 3) for b in (15, 35)))
def _(t):
    return analogs(t.known, t.targets)


cte("rp", "SELECT a.pid AS a, b.pid AS b, count(*) AS n, corr(a.res, b.res) AS r FROM {gres} a JOIN {gres} b ON a.day = b.day AND a.source = b.source AND a.pid <> b.pid AND a.res IS NOT NULL AND b.res IS NOT NULL GROUP BY ALL")
cte("rw", """SELECT a, b, greatest((n * coalesce(CASE WHEN n >= 8 THEN r END, g) + 30 * g) / (n + 30), 0) AS w FROM (
SELECT p.a, q.b, coalesce(n, 0) AS n, r, (SELECT avg(r) FROM {rp} WHERE n >= 8) AS g FROM (SELECT DISTINCT pid AS a FROM {marked}) p CROSS JOIN (SELECT DISTINCT pid AS b FROM {marked}) q
LEFT JOIN {rp} x ON x.a = p.a AND x.b = q.b WHERE p.a <> q.b)""")


@query("weighted_day_effects", "pid:i key:i effect:f4 wsum:f5 lowest:f4 low_share:f4", """SELECT t.pid, t.day * 4 + s.source AS key, CASE WHEN sum(w) > 1e-6 THEN sum(w * res) / sum(w) END AS effect,
coalesce(sum(w), 0) AS wsum, min(res) AS lowest, count(*) FILTER (res < -0.15) / CAST(nullif(count(res), 0) AS DOUBLE) AS low_share FROM {targets} t CROSS JOIN (SELECT unnest([0, 1, 2]) AS source) s
LEFT JOIN {gres} k ON k.day = t.day AND k.source = s.source AND k.res IS NOT NULL AND k.pid <> t.pid LEFT JOIN {rw} ON a = t.pid AND b = k.pid GROUP BY t.pid, t.day, s.source""")
def _(t):
    m = cut_lineage(t.marked.select("pid", "day", "source", "value", "is_gap"))  # known and hidden rows read one ranking
    res = G.loo_residuals(m.filter(G.known())).filter("res IS NOT NULL")
    asked = m.filter(G.gap()).select("pid", F.explode(F.array(*[(F.col("day") * 4 + s).cast("long") for s in range(3)])).alias("key"))
    return pairs.weighted_day_effects(day_source(res, "res"), asked)


# ---------------------------------------------------------------- blend and audit
@query("blend_weights", "n:i weight:f6 rmse:f6", """WITH w AS (SELECT count(*) AS n, least(1, greatest(0, sum((linear_time - climatology) * (value - climatology)) / sum(pow(linear_time - climatology, 2)))) AS weight
FROM {base} WHERE linear_time IS NOT NULL AND climatology IS NOT NULL) SELECT any_value(n) AS n, any_value(weight) AS weight,
sqrt(avg(pow(weight * linear_time + (1 - weight) * climatology - value, 2))) AS rmse FROM {base} CROSS JOIN w""")
def _(t):
    b = G.baseline_predictions(t.marked)
    w = G.blend_weights(b, "value", "linear_time", "climatology")
    mix = F.col("_w") * F.col("linear_time") + (1 - F.col("_w")) * F.col("climatology") - F.col("value")
    return b.withColumn("_w", w.select("weight").scalar()).agg(
        F.count("*").alias("n"), F.max("_w").alias("weight"), F.sqrt(F.avg(mix * mix)).alias("rmse"))


@query("prediction_correlation", "r_linear_clim:f5 r_linear_mean:f5", "SELECT corr(linear_time, climatology) AS r_linear_clim, corr(linear_time, nearest_mean) AS r_linear_mean FROM {base}")
def _(t):
    return G.baseline_predictions(t.marked).agg(F.corr("linear_time", "climatology").alias("r_linear_clim"), F.corr("linear_time", "nearest_mean").alias("r_linear_mean"))


cte("pub", "SELECT a.pid, a.day, avg(b.value) AS pub_mean FROM {marked} a JOIN {marked} b ON a.pid = b.pid AND a.year <> b.year AND abs(a.doy - b.doy) <= 8 GROUP BY a.pid, a.day")


@query("constraint_audit", "pid:i day:i n_window:i n_hidden:i residual:f6 solved_day:i solved_value:f6", """SELECT pid, day, n_window, n_hidden,
CASE WHEN n_hidden = 0 THEN (n_window * pub_mean - s) / n_window END AS residual, CASE WHEN n_hidden = 1 THEN hd END AS solved_day,
CASE WHEN n_hidden = 1 THEN n_window * pub_mean - s END AS solved_value FROM (SELECT a.pid, a.day, count(*) AS n_window, count(*) FILTER (b.is_gap) AS n_hidden,
coalesce(sum(b.value) FILTER (NOT b.is_gap), 0) AS s, sum(b.day) FILTER (b.is_gap) AS hd FROM {known} a JOIN {marked} b ON a.pid = b.pid AND a.year <> b.year
AND abs(a.doy - b.doy) <= 8 GROUP BY a.pid, a.day) JOIN {pub} USING (pid, day)""")
def _(t):
    return G.constraint_audit(t.marked, loyo_norm(t.marked).select("pid", "day", F.col("norm_mean").alias("pub_mean")))

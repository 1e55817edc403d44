"""Queries: the season pipeline D1..D30 and what reads its results."""

from pyspark.sql import functions as F

from phenolake.operators import season as S
from phenolake.operators.smooth import loo_fit
from phenolake.plans.ctes import cte
from phenolake.plans.registry import query
from phenolake.plans.season import SeasonPlan


def plan(t, strict=True) -> SeasonPlan:
    return SeasonPlan(t.season, t.categories, strict, parts=t.parts)


def fit_sql(s, loo=False, min_points="0"):
    """SQL of the fit from five sums named with prefix ``s``."""
    s0, t0 = (f"({s}s0 - 1)", f"({s}t0 - y)") if loo else (f"{s}s0", f"{s}t0")
    s1, s2, t1 = f"{s}s1", f"{s}s2", f"{s}t1"
    det = f"({s0} * {s2} - {s1} * {s1})"
    ok = f"({det} > 1e-9 AND {s0} >= {min_points})"
    value = f"CASE WHEN {s0} < 1e-6 THEN NULL WHEN {ok} THEN ({s2} * {t0} - {s1} * {t1}) / {det} ELSE {t0} / greatest({s0}, 1e-9) END"
    slope = f"CASE WHEN {s0} < 1e-6 THEN NULL WHEN {ok} THEN ({s0} * {t1} - {s1} * {t0}) / {det} ELSE 0 END"
    return value, slope, s0


def sums_sql(bw, cond="true", y="b.h", e="a.day", p="b.day"):
    w = f"CASE WHEN {cond} AND abs({p} - {e}) <= {3 * bw} THEN exp(-0.5e0 * pow(({p} - {e}) / {bw}e0, 2)) ELSE 0 END"
    return (f"sum({w}) AS s0, sum({w} * ({p} - {e})) AS s1, sum({w} * ({p} - {e}) * ({p} - {e})) AS s2, "
            f"sum({w} * {y}) AS t0, sum({w} * ({p} - {e}) * {y}) AS t1")


# ---------------------------------------------------------------- kernel regression and harmonised series
_v, _s, _w = fit_sql("", loo=True)
cte("loo", f"""SELECT pid, date, day, {_v} AS fit, {_w} AS weight FROM (SELECT a.pid, a.date, a.day, any_value(a.value) AS y,
{sums_sql(8, y="b.value")} FROM {{season}} a JOIN {{season}} b ON a.pid = b.pid AND abs(b.day - a.day) <= 24 GROUP BY a.pid, a.date, a.day)""")


@query("local_linear_loo", "pid:i date:d fit:f5 weight:f6", "SELECT pid, date, fit, weight FROM {loo}")
def _(t):
    return loo_fit(t.season, ["pid"], "value", 8.0).withColumnRenamed("fit_weight", "weight")


cte("offs", """SELECT s.*, CASE source WHEN 0 THEN 0.0e0 WHEN 1 THEN off_s2 ELSE off_s3 END AS "offset",
value - CASE source WHEN 0 THEN 0.0e0 WHEN 1 THEN off_s2 ELSE off_s3 END AS h FROM {season} s JOIN {offsets} USING (pid)""")
cte("hres", f"""SELECT o.*, CASE WHEN weight >= 0.5 THEN h - fit END AS res FROM {{offs}} o JOIN (
SELECT pid, day, {_v} AS fit, {_w} AS weight FROM (SELECT a.pid, a.day, any_value(a.h) AS y, {sums_sql(8)}
FROM {{offs}} a JOIN {{offs}} b ON a.pid = b.pid AND abs(b.day - a.day) <= 24 GROUP BY a.pid, a.day)) f USING (pid, day)""")
cte("suspects", """SELECT *, coalesce(abs(res) > greatest(0.15e0, 3 * mad), false) AS suspect FROM (SELECT *,
coalesce(1.4826e0 * median(abs(res - m)) OVER (PARTITION BY pid), 0.05e0) AS mad FROM (SELECT *, median(res) OVER (PARTITION BY pid) AS m FROM {hres}))""")
cte("hseries", """SELECT *, suspect AND (coalesce(day - pday <= 11 AND abs(h - ph) <= 0.10e0, false) OR coalesce(nday - day <= 11
AND abs(h - nh) <= 0.10e0, false)) AS confirmed, suspect AND NOT (coalesce(day - pday <= 11 AND abs(h - ph) <= 0.10e0, false)
OR coalesce(nday - day <= 11 AND abs(h - nh) <= 0.10e0, false)) AS artifact FROM (SELECT *,
last_value(CASE WHEN NOT suspect THEN day END IGNORE NULLS) OVER b AS pday, last_value(CASE WHEN NOT suspect THEN h END IGNORE NULLS) OVER b AS ph,
first_value(CASE WHEN NOT suspect THEN day END IGNORE NULLS) OVER a AS nday, first_value(CASE WHEN NOT suspect THEN h END IGNORE NULLS) OVER a AS nh
FROM {suspects} WINDOW b AS (PARTITION BY pid ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
a AS (PARTITION BY pid ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""")


@query("harmonize", "pid:i date:d h:f6 offset:f6 res:f5 mad:f5 artifact:b",
       'SELECT pid, date, h, "offset", res, mad, artifact FROM {hseries}')
def _(t):
    return plan(t).series


@query("confirmed_by_neighbor", "pid:i date:d suspect:b confirmed:b", """
WITH s AS (SELECT pid, date, day, value AS h, value < 0.3e0 AS suspect FROM {season}),
n AS (SELECT *, last_value(CASE WHEN NOT suspect THEN day END IGNORE NULLS) OVER b AS pday,
last_value(CASE WHEN NOT suspect THEN h END IGNORE NULLS) OVER b AS ph, first_value(CASE WHEN NOT suspect THEN day END IGNORE NULLS) OVER a AS nday,
first_value(CASE WHEN NOT suspect THEN h END IGNORE NULLS) OVER a AS nh FROM s
WINDOW b AS (PARTITION BY pid ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
a AS (PARTITION BY pid ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT pid, date, suspect, suspect AND (coalesce(day - pday <= 11 AND abs(h - ph) <= 0.10e0, false)
OR coalesce(nday - day <= 11 AND abs(h - nh) <= 0.10e0, false)) AS confirmed FROM n""")
def _(t):
    d = t.season.withColumns({"h": F.col("value"), "suspect": F.col("value") < 0.3})
    return S.confirmed_by_neighbor(d)


# ---------------------------------------------------------------- curves, norms, z
_v2, _s2, _w2 = fit_sql("", min_points="2")
cte("clean", "SELECT pid, year, day, h FROM {hseries} WHERE NOT artifact")
cte("curve_grid", """SELECT pid, year, n_obs, lo, hi, CAST(d AS DATE) AS date, dayofyear(CAST(d AS DATE)) AS doy, datediff('day', DATE '2000-01-01', CAST(d AS DATE)) AS day
FROM (SELECT pid, year, count(*) AS n_obs, min(day) AS lo, max(day) AS hi,
unnest(generate_series(make_date(year, 4, 1), make_date(year, 10, 30), INTERVAL 1 DAY)) AS d FROM {clean} GROUP BY pid, year HAVING count(*) >= 5)""")
cte("curves", f"""SELECT pid, year, day, date, doy, n_obs, CASE WHEN ins THEN greatest(-0.1e0, least(1.0e0, v)) END AS value,
CASE WHEN ins THEN s END AS slope, CASE WHEN ins THEN s0 ELSE 0 END AS weight FROM (
SELECT *, day BETWEEN lo - 2 AND hi + 2 AS ins, {_v2} AS v, {_s2} AS s FROM (SELECT a.pid, a.year, a.day, a.date, a.doy, a.n_obs, a.lo, a.hi,
{sums_sql(8).replace("sum(", "0.0e0 + sum(")} FROM {{curve_grid}} a LEFT JOIN {{clean}} b ON a.pid = b.pid AND a.year = b.year GROUP BY ALL))""")


@query("daily_curve", "pid:i date:d value:f5 slope:f5 weight:f5 n_obs:i", "SELECT pid, date, value, slope, weight, n_obs FROM {curves}")
def _(t):
    return plan(t).curves


cte("own_norm", """SELECT c.*, norm_n, norm_mean, CASE WHEN norm_n > 1 THEN greatest(sd, 0.04e0) END AS norm_std FROM {curves} c JOIN (
SELECT a.pid, a.year, a.doy, count(b.value) AS norm_n, avg(b.value) AS norm_mean, stddev_pop(b.value) AS sd FROM {curves} a
LEFT JOIN {curves} b ON a.pid = b.pid AND a.doy = b.doy AND a.year <> b.year AND b.weight >= 0.8e0 GROUP BY a.pid, a.year, a.doy) n USING (pid, year, doy)""")


@query("curve_norm", "pid:i date:d norm_n:i norm_mean:f5 norm_std:f5", "SELECT pid, date, norm_n, norm_mean, norm_std FROM {own_norm}")
def _(t):
    return S.curve_norm(plan(t).curves)


cte("cats", "SELECT s_suppkey AS pid, s_nationkey AS category FROM supplier")
cte("cat_norm", """SELECT category, doy, count(v) AS cat_n, CASE WHEN count(v) > 2 THEN avg(v) END AS cat_mean,
CASE WHEN count(v) > 2 THEN greatest(stddev_pop(v), 0.04e0) END AS cat_std FROM (SELECT category, doy, CASE WHEN weight >= 0.8e0 THEN value END AS v
FROM {curves} JOIN {cats} USING (pid)) WHERE category IN (SELECT category FROM {cats} WHERE pid IN (SELECT pid FROM {curves})
GROUP BY category HAVING count(*) >= 3) GROUP BY category, doy""")


@query("category_norm", "category:i doy:i cat_n:i cat_mean:f5 cat_std:f5", "SELECT * FROM {cat_norm}")
def _(t):
    return S.category_norm(plan(t).curves, t.categories)


cte("chosen", """SELECT pid, year, day, date, doy, value, slope, weight, norm_source, CASE norm_source WHEN 'category' THEN cat_mean ELSE norm_mean END AS norm_mean,
CASE norm_source WHEN 'category' THEN cat_std ELSE norm_std END AS norm_std, CASE norm_source WHEN 'category' THEN cat_n ELSE norm_n END AS norm_n
FROM (SELECT o.*, cat_mean, cat_std, cat_n, CASE WHEN count(CASE WHEN norm_n >= 3 THEN 1 END) OVER (PARTITION BY pid, year) >= 60 THEN 'own'
WHEN bool_or(cat_n IS NOT NULL) OVER (PARTITION BY pid, year) THEN 'category' ELSE 'none' END AS norm_source
FROM {own_norm} o LEFT JOIN {cats} USING (pid) LEFT JOIN {cat_norm} USING (category, doy))""")


@query("choose_norm", "norm_source:s n_seasons:i n_days:i mean:f5", """SELECT norm_source, count(DISTINCT (pid, year)) AS n_seasons,
count(*) AS n_days, avg(norm_mean) AS mean FROM {chosen} GROUP BY norm_source""")
def _(t):
    return plan(t).normed.groupBy("norm_source").agg(F.count_distinct("pid", "year").alias("n_seasons"),
                                                     F.count("*").alias("n_days"), F.avg("norm_mean").alias("mean"))


@query("choose_norm_short", "norm_source:s n_seasons:i n_days:i mean:f5", """
WITH own AS (SELECT pid, year, doy, NULL::DOUBLE AS norm_mean, 0 AS norm_n FROM {curves} WHERE year = 1998)
SELECT norm_source, count(DISTINCT pid) AS n_seasons, count(*) AS n_days, avg(CASE norm_source WHEN 'category' THEN cat_mean END) AS mean FROM (
SELECT o.*, cat_mean, CASE WHEN bool_or(cat_n IS NOT NULL) OVER (PARTITION BY pid) THEN 'category' ELSE 'none' END AS norm_source FROM own o
LEFT JOIN {cats} USING (pid) LEFT JOIN {cat_norm} USING (category, doy)) GROUP BY norm_source""")
def _(t):
    """Entities with one season only: the category norm takes over where it exists."""
    p = plan(t)
    own = S.curve_norm(p.saved_curves.filter("year = 1998"))
    d = S.choose_norm(own, S.category_norm(p.saved_curves, t.categories), t.categories)
    return d.groupBy("norm_source").agg(F.count_distinct("pid", "year").alias("n_seasons"), F.count("*").alias("n_days"),
                                        F.avg("norm_mean").alias("mean"))


cte("zs", """SELECT *, CASE WHEN ok THEN (value - norm_mean) / norm_std END AS z, CASE WHEN ok THEN value - norm_mean END AS deficit FROM (
SELECT *, weight >= 0.8e0 AND norm_mean IS NOT NULL AND norm_std IS NOT NULL AS ok FROM {chosen}
QUALIFY count(norm_mean) OVER (PARTITION BY pid, year) >= 30)""")


@query("z_series", "pid:i date:d z:f4 deficit:f5", "SELECT pid, date, z, deficit FROM {zs}")
def _(t):
    return plan(t).z


# ---------------------------------------------------------------- episodes
PHASE = """CASE WHEN {0} BETWEEN 91 AND 135 THEN 'spring' WHEN {0} BETWEEN 136 AND 175 THEN 'peak' WHEN {0} BETWEEN 176 AND 220 THEN 'ripening'
WHEN {0} BETWEEN 221 AND 260 THEN 'after_harvest' WHEN {0} BETWEEN 261 AND 304 THEN 'autumn' ELSE 'out_of_season' END"""
cte("zruns", """SELECT pid, year, min(day) AS start, max(day) AS "end" FROM (SELECT *, sum(nw) OVER (PARTITION BY pid, year ORDER BY day) AS g FROM (
SELECT pid, year, day, CASE WHEN day - lag(day) OVER (PARTITION BY pid, year ORDER BY day) <= 6 THEN 0 ELSE 1 END AS nw FROM {zs} WHERE z < -1))
GROUP BY pid, year, g""")
cte("ep_facts", f"""SELECT *, {PHASE.format("start_doy")} AS phase, {PHASE.format("end_doy")} AS phase_end FROM (
SELECT r.pid, r.year, r.start, r."end", count(*) AS days, min(z) AS min_z, avg(z) AS mean_z, count(*) FILTER (z < -2) AS critical_days,
min(deficit) AS max_deficit, avg(deficit) AS mean_deficit, arg_min(day, (z, day)) FILTER (z IS NOT NULL) AS worst_day,
arg_min(value, (z, day)) FILTER (z IS NOT NULL) AS value_at_worst, arg_min(norm_mean, (z, day)) FILTER (z IS NOT NULL) AS norm_at_worst,
min(doy) AS start_doy, max(doy) AS end_doy, max(norm_source) AS norm_source FROM {{zruns}} r JOIN {{zs}} z
ON r.pid = z.pid AND r.year = z.year AND z.day BETWEEN r.start AND r."end" GROUP BY r.pid, r.year, r.start, r."end")""")
cte("ep_obs", """SELECT e.*, (SELECT count(*) FROM {hseries} h WHERE h.pid = e.pid AND h.year = e.year AND NOT artifact AND h.day BETWEEN e.start AND e."end") AS n_obs,
(SELECT count(*) FROM {hseries} h WHERE h.pid = e.pid AND h.year = e.year AND artifact AND h.day BETWEEN e.start - 10 AND e."end" + 10) AS artifacts_near
FROM {ep_facts} e""")
cte("eps", """SELECT * FROM {ep_obs} WHERE days >= 7 AND n_obs >= 2 AND ((days >= 14 AND mean_z <= -1.2e0) OR min_z <= -1.5e0
OR (days >= 30 AND mean_z <= -0.9e0))""")
cte("eps_loose", "SELECT * FROM {ep_obs} WHERE days >= 7 AND n_obs >= 2")
EP_COLS = ("pid:i year:i start:i end:i days:i n_obs:i artifacts_near:i min_z:f4 mean_z:f4 critical_days:i max_deficit:f5 mean_deficit:f5 "
           "worst_day:i value_at_worst:f5 norm_at_worst:f5 phase:s phase_end:s")


@query("find_episodes", EP_COLS, "SELECT * FROM {eps}")
def _(t):
    return plan(t).episodes


@query("find_episodes_loose", EP_COLS, "SELECT * FROM {eps_loose}")
def _(t):
    return plan(t, strict=False).episodes


PH = "pid:i year:i valid:b peak:f5 peak_doy:i base:f5 amplitude:f5 sos_doy:i half_decline_doy:i integral:f3 covered_days:i"


def pheno_sql(source, value):
    return f"""SELECT pid, year, valid, covered_days, CASE WHEN valid THEN peak END AS peak, CASE WHEN valid THEN peak_doy END AS peak_doy,
CASE WHEN valid THEN base END AS base, CASE WHEN valid THEN peak - base END AS amplitude, CASE WHEN valid THEN sos END AS sos_doy,
CASE WHEN valid THEN hd END AS half_decline_doy, CASE WHEN valid THEN integral END AS integral FROM (
SELECT c.pid, c.year, any_value(n) AS covered_days, any_value(n) >= 30 AND any_value(nm) >= 20 AS valid, any_value(peak) AS peak,
any_value(peak_doy) AS peak_doy, any_value(base) AS base,
coalesce(min(CASE WHEN doy <= 243 AND v >= base + 0.2e0 * (peak - base) THEN doy END), min(CASE WHEN doy <= 243 THEN doy END)) AS sos,
min(CASE WHEN doy > peak_doy AND v <= peak - 0.5e0 * (peak - base) THEN doy END) AS hd, sum((v + pv) / 2 * (doy - pd)) AS integral
FROM (SELECT pid, year, doy, {value} AS v, lag({value}) OVER w AS pv, lag(doy) OVER w AS pd FROM {source} WINDOW w AS (PARTITION BY pid, year ORDER BY doy)) c
JOIN (SELECT pid, year, count(*) AS n, count(*) FILTER (doy <= 243) AS nm, max({value}) FILTER (doy <= 243) AS peak,
 arg_max(doy, ({value}, -doy)) FILTER (doy <= 243) AS peak_doy, quantile_cont({value}, 0.05) AS base FROM {source} GROUP BY pid, year) p
ON c.pid = p.pid AND c.year = p.year GROUP BY c.pid, c.year)"""


cte("ok_days", "SELECT * FROM {zs} WHERE weight >= 0.8e0 AND value IS NOT NULL")
cte("norm_days", "SELECT * FROM {zs} WHERE norm_mean IS NOT NULL")
cte("pheno", pheno_sql("{ok_days}", "value"))
cte("npheno", pheno_sql("{norm_days}", "norm_mean"))
cte("dev", """SELECT p.*, p.peak / greatest(n.peak, 1e-6) AS peak_ratio, p.peak_doy - n.peak_doy AS peak_shift, p.sos_doy - n.sos_doy AS sos_shift,
p.integral / greatest(n.integral, 1e-6) AS integral_ratio, p.half_decline_doy - n.half_decline_doy AS decline_shift
FROM {pheno} p LEFT JOIN {npheno} n ON p.pid = n.pid AND p.year = n.year""")


@query("phenology", PH, "SELECT * FROM {pheno}")
def _(t):
    return S.phenology(plan(t).z)


DEV = "pid:i year:i peak_ratio:f5 peak_shift:i sos_shift:i integral_ratio:f5 decline_shift:i"


@query("phenology_deviation", DEV, "SELECT * FROM {dev}".replace("{dev}", "{dev}"))
def _(t):
    return deviation(t)


def deviation(t, p=None):
    return (p or plan(t)).phenology

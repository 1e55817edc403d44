"""Queries: episode context and everything that reads episodes."""

from pyspark.sql import functions as F

from phenolake.functions.expr import TIE_SHIFT, day_num
from phenolake.operators import context as X
from phenolake.operators.drivers import shifted_day
from phenolake.plans.ctes import cte
from phenolake.plans.q_season import plan
from phenolake.plans.q_window import filled, z_episodes
from phenolake.plans.registry import query
from phenolake.sources.io import cut_lineage

# ---------------------------------------------------------------- drivers of an episode
# categories with at least the mean number of driver days have a series of their own, the others read the regional median
cte("dense", "SELECT region FROM {drivers} GROUP BY region HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM {drivers} GROUP BY region))")
cte("median_day", "SELECT day, median(precip) AS precip, median(temp) AS temp FROM {filled} WHERE region IN (SELECT region FROM {dense}) GROUP BY day")
cte("median_grid", "SELECT g.day, precip, temp FROM (SELECT unnest(range(min(day), max(day) + 1)) AS day FROM {median_day}) g LEFT JOIN {median_day} USING (day)")
cte("driven", "SELECT region, day, date, precip, temp FROM {filled} WHERE region IN (SELECT region FROM {dense}) UNION ALL SELECT -1, day, DATE '2000-01-01' + CAST(day AS INTEGER), " + ", ".join(
    f"coalesce({c}, CASE WHEN day - last_value(CASE WHEN {c} IS NOT NULL THEN day END IGNORE NULLS) OVER b <= 3 THEN last_value({c} IGNORE NULLS) OVER b + (first_value({c} IGNORE NULLS) OVER a "
    f"- last_value({c} IGNORE NULLS) OVER b) * (day - last_value(CASE WHEN {c} IS NOT NULL THEN day END IGNORE NULLS) OVER b) / (first_value(CASE WHEN {c} IS NOT NULL THEN day END IGNORE NULLS) OVER a "
    f"- last_value(CASE WHEN {c} IS NOT NULL THEN day END IGNORE NULLS) OVER b) END) AS {c}" for c in ("precip", "temp")) +
    " FROM {median_grid} WINDOW b AS (ORDER BY day ROWS UNBOUNDED PRECEDING), a AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


def driver_grid(t):
    """Daily grids of the categories that have enough driver days."""
    n = t.drivers.groupBy("region").agg(F.count("*").alias("c"))
    return filled(t).join(n.filter(F.col("c") >= n.agg(F.avg("c")).scalar()).select("region"), "region", "left_semi")


cte("wins", """SELECT e.pid, e.year, e.start AS ep, coalesce(d.region, -1) AS region, win, a, b FROM (
SELECT pid, year, start, 'before' AS win, start - 30 AS a, start - 1 AS b FROM {eps} UNION ALL
SELECT pid, year, start, 'during', start, "end" FROM {eps} UNION ALL SELECT pid, year, start, 'combined', start - 30, "end" FROM {eps}) e
LEFT JOIN supplier ON s_suppkey = e.pid LEFT JOIN {dense} d ON d.region = s_nationkey""")
cte("win_own", """SELECT w.*, count(*) AS n_days, count(precip) AS n_known, sum(precip) AS amount, avg(temp) AS level,
count(*) FILTER (precip < 1) AS dry_days, count(*) FILTER (temp > 27) AS hot_days FROM {wins} w JOIN {driven} f
ON f.region = w.region AND f.day BETWEEN w.a AND w.b GROUP BY ALL""")
cte("region_years", """SELECT region, unnest(range(min(year(DATE '2000-01-01' + CAST(day AS INTEGER))),
max(year(DATE '2000-01-01' + CAST(day AS INTEGER))) + 1)) AS y FROM {driven} GROUP BY region""")
cte("win_years", """SELECT w.pid, w.year, w.ep, w.win, w.y, avg(temp) AS t, sum(precip) AS p FROM (SELECT w.*, y,
 datediff('day', DATE '2000-01-01', try_cast(concat(y, '-', strftime(DATE '2000-01-01' + CAST(a AS INTEGER), '%m-%d')) AS DATE)) AS a2,
 datediff('day', DATE '2000-01-01', try_cast(concat(y, '-', strftime(DATE '2000-01-01' + CAST(b AS INTEGER), '%m-%d')) AS DATE)) AS b2
 FROM {wins} w JOIN {region_years} r USING (region) WHERE y <> year(DATE '2000-01-01' + CAST(a AS INTEGER))) w
JOIN {driven} f ON f.region = w.region AND f.day BETWEEN a2 AND b2 GROUP BY w.pid, w.year, w.ep, w.win, w.y, w.a, w.b
HAVING count(*) >= 0.8e0 * (w.b - w.a) + 1 AND count(precip) / CAST(count(*) AS DOUBLE) > 0.8""")
cte("win_norm", """SELECT pid, year, ep, win, count(*) AS norm_years, avg(p) AS amount_norm, avg(t) AS level_norm FROM {win_years}
GROUP BY pid, year, ep, win""")
cte("dry_runs", """SELECT region, day, day - min(day) OVER (PARTITION BY region, g) + 1 AS len FROM (SELECT region, day,
day - row_number() OVER (PARTITION BY region ORDER BY day) AS g FROM {driven} WHERE precip < 1)""")
cte("win_spell", """SELECT w.pid, w.year, w.ep, w.win, max(least(len, d.day - w.a + 1)) AS max_dry_spell FROM {wins} w JOIN {dry_runs} d
ON d.region = w.region AND d.day BETWEEN w.a AND w.b GROUP BY ALL""")
cte("win_facts", """SELECT o.*, CASE WHEN region = -1 THEN 'region' ELSE 'own' END AS driver_source, coalesce(norm_years, 0) AS norm_years, CASE WHEN norm_years >= 3 THEN amount_norm END AS amount_norm,
CASE WHEN norm_years >= 3 THEN 100.0e0 * (1 - amount / greatest(amount_norm, 1e-6)) END AS deficit_pct,
CASE WHEN norm_years >= 3 THEN level - level_norm END AS level_anomaly, coalesce(max_dry_spell, 0) AS max_dry_spell
FROM {win_own} o LEFT JOIN {win_norm} USING (pid, year, ep, win) LEFT JOIN {win_spell} USING (pid, year, ep, win) WHERE n_known > 0""")
WIN = ("pid:i year:i ep:i win:s driver_source:s n_days:i amount:f5 level:f5 dry_days:i hot_days:i norm_years:i amount_norm:f5 deficit_pct:f4 "
       "level_anomaly:f5 max_dry_spell:i")


@query("episode_drivers", WIN, "SELECT * FROM {win_facts}")
def _(t):
    return plan(t).driver_facts(driver_grid(t))


cte("zepisodes_day", "SELECT pid, year, datediff('day', DATE '2000-01-01', start) AS start FROM {zepisodes}")


@query("calendar_shift", "pid:i year:i start:i other:i shifted:i", """SELECT pid, year, start, y AS other, datediff('day', DATE '2000-01-01',
try_cast(concat(y, '-', strftime(DATE '2000-01-01' + CAST(start AS INTEGER), '%m-%d')) AS DATE)) AS shifted FROM {zepisodes_day}
CROSS JOIN (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM {zepisodes_day}) r WHERE y <> year""")
def _(t):
    ep = cut_lineage(z_episodes(t).select("pid", "year", day_num("start").alias("start")))  # read twice
    first, last = ep.agg(F.min("year"), F.max("year")).first()
    d = ep.withColumn("other", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return d.filter("other <> year").withColumn("shifted", shifted_day(F.col("start"), F.col("other")))



# ---------------------------------------------------------------- region, second index, cause
cte("reg_day", """SELECT pid, year, start, avg(m) AS rz FROM (SELECT e.pid, e.year, e.start, z.day, median(z.z) AS m FROM {eps} e JOIN {zs} z
ON z.pid <> e.pid AND z.day BETWEEN e.start AND e."end" AND z.z IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
cte("reg_ent", """SELECT pid, year, start, count(*) AS n, avg(CASE WHEN m < -1 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT e.pid, e.year, e.start,
z.pid AS other, avg(z.z) AS m FROM {eps} e JOIN {zs} z ON z.pid <> e.pid AND z.day BETWEEN e.start AND e."end" AND z.z IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
cte("reg", """SELECT e.*, CASE WHEN n >= 3 THEN rz END AS region_z, CASE WHEN n >= 3 THEN n END AS n_entities, CASE WHEN n >= 3 THEN share END AS share_low
FROM {eps} e LEFT JOIN {reg_day} USING (pid, year, start) LEFT JOIN {reg_ent} USING (pid, year, start)""")


@query("region_context", "pid:i year:i start:i region_z:f4 n_entities:i share_low:f5", "SELECT * FROM {reg}")
def _(t):
    p = plan(t)
    return X.region_context(p.saved_episodes, p.saved_z)


cte("idx", """SELECT pid, year, day, doy, source, artifact, CASE source WHEN 0 THEN x1 WHEN 1 THEN x2 END AS idx FROM {hseries}""")
cte("idx_a", """SELECT a.pid, a.year, a.day, a.source, a.artifact, CASE WHEN count(b.idx) >= 3 THEN a.idx - avg(b.idx) END AS an FROM {idx} a
LEFT JOIN {idx} b ON a.pid = b.pid AND a.source = b.source AND a.year <> b.year AND abs(a.doy - b.doy) <= 8 AND b.idx IS NOT NULL
WHERE a.idx IS NOT NULL AND NOT a.artifact GROUP BY a.pid, a.year, a.day, a.source, a.artifact, a.idx""")
cte("idx_ep", """SELECT pid, year, start, sum(s) / sum(n) AS index_anomaly, sum(n) AS index_n FROM (SELECT e.pid, e.year, e.start, i.source,
count(*) AS p, count(an) AS n, sum(an) AS s FROM {eps} e JOIN {idx_a} i ON i.pid = e.pid AND i.year = e.year AND i.day BETWEEN e.start AND e."end"
GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL HAVING sum(n) >= 2""")


@query("index_anomaly", "pid:i year:i start:i index_anomaly:f6 index_n:i", "SELECT * FROM {idx_ep}")
def _(t):
    p = plan(t)
    return X.index_anomaly(p.saved_episodes, p.saved_series)


SEV = "CASE WHEN min_z < -2 AND critical_days >= 5 THEN 'critical' ELSE 'moderate' END"


@query("severity", "pid:i year:i start:i severity:s", f"SELECT pid, year, start, {SEV} AS severity FROM {{eps}}")
def _(t):
    return plan(t).saved_episodes.withColumn("severity", X.severity(F.col("min_z"), F.col("critical_days")))


cte("ep_all", """SELECT r.*, d.valid, d.peak, peak_ratio, peak_shift, sos_shift, decline_shift, w.n_days, w.deficit_pct, w.level_anomaly,
w.hot_days, w.max_dry_spell, w.amount, w.amount_norm, w.level, coalesce(w.driver_source, b.driver_source, u.driver_source) AS driver_source, b.amount AS b_amount, b.amount_norm AS b_norm, b.deficit_pct AS b_deficit,
u.amount AS d_amount, u.amount_norm AS d_norm, u.deficit_pct AS d_deficit, i.index_anomaly, i.index_n FROM {reg} r LEFT JOIN {idx_ep} i ON i.pid = r.pid AND i.year = r.year AND i.start = r.start
LEFT JOIN (SELECT * FROM {win_facts} WHERE win = 'before') b ON b.pid = r.pid AND b.year = r.year AND b.ep = r.start
LEFT JOIN (SELECT * FROM {win_facts} WHERE win = 'during') u ON u.pid = r.pid AND u.year = r.year AND u.ep = r.start LEFT JOIN {dev} d ON d.pid = r.pid AND d.year = r.year
LEFT JOIN (SELECT * FROM {win_facts} WHERE win = 'combined') w ON w.pid = r.pid AND w.year = r.year AND w.ep = r.start""")
cte("signals", """SELECT *, dry OR hot OR spell AS stress, 0.20e0 * dry::INT + 0.15e0 * coalesce(known AND deficit_pct >= 80, false)::INT + 0.15e0 * hot::INT
+ 0.10e0 * coalesce(known AND level_anomaly >= 2, false)::INT + 0.05e0 * spell::INT AS strength,
CASE WHEN region_z IS NULL THEN 'unknown' WHEN region_z <= -0.7e0 OR share_low >= 0.5e0 THEN 'regional' WHEN region_z >= -0.3e0 THEN 'local' ELSE 'mixed' END AS scope
FROM (SELECT *, coalesce(known AND deficit_pct >= 40, false) AS dry, coalesce(known AND level_anomaly >= 1 AND hot_days >= 5, false) AS hot,
coalesce(known AND max_dry_spell >= 20 AND deficit_pct > 0, false) AS spell FROM (SELECT *, coalesce(deficit_pct IS NOT NULL AND n_days >= 20, false) AS known FROM {ep_all}))""")
cte("rules", """SELECT *, CASE WHEN n_obs <= 2 AND artifacts_near >= 2 THEN 1
WHEN peak_ratio >= 0.85e0 AND coalesce(peak_shift, 0) >= 25 AND end_doy <= 200 THEN 2
WHEN peak_ratio >= 0.85e0 AND coalesce(peak_shift, 0) <= -25 AND start_doy >= 150 AND NOT stress THEN 3
WHEN valid AND (peak < 0.35e0 OR coalesce(peak_ratio < 0.6e0, false)) AND start_doy <= 165 THEN 4
WHEN peak_ratio >= 0.85e0 AND coalesce(decline_shift, 0) <= -15 AND start_doy <= 243 THEN CASE WHEN stress THEN 5 ELSE 6 END
WHEN coalesce(sos_shift, 0) >= 15 AND start_doy <= 150 AND coalesce(peak_ratio, 0) >= 0.7e0 THEN 7
WHEN stress THEN 5 WHEN scope = 'regional' THEN 8 WHEN peak_ratio < 0.7e0 THEN 9 ELSE 10 END AS rule FROM {signals}""")
cte("caused", f"""SELECT *, {SEV} AS severity, CASE rule WHEN 1 THEN 'data_suspect' WHEN 2 THEN 'crop_rotation' WHEN 3 THEN 'crop_rotation'
WHEN 4 THEN 'unsown_or_changed' WHEN 5 THEN 'weather_drought' WHEN 6 THEN 'early_decline' WHEN 7 THEN 'late_start' WHEN 8 THEN 'weather_drought'
ELSE 'weak_season' END AS cause, CASE rule WHEN 1 THEN 0.4e0 WHEN 2 THEN 0.7e0 WHEN 3 THEN 0.65e0 WHEN 4 THEN 0.8e0
WHEN 5 THEN round(least(0.85e0, greatest(0.40e0, 0.45e0 + strength + CASE scope WHEN 'regional' THEN 0.1e0 WHEN 'local' THEN -0.1e0 ELSE 0 END)) + 1e-9, 2)
WHEN 6 THEN 0.6e0 WHEN 7 THEN 0.6e0 WHEN 8 THEN 0.5e0 WHEN 9 THEN CASE WHEN scope = 'local' THEN 0.6e0 ELSE 0.55e0 END
ELSE CASE WHEN scope = 'local' THEN 0.45e0 ELSE 0.4e0 END END AS confidence FROM {{rules}}""")


def _arg(when, code, *numbers):
    return f"CASE WHEN coalesce({when}, false) THEN {{'code': '{code}', 'n': [{', '.join(f'CAST({x} AS DOUBLE)' for x in numbers)}]::DOUBLE[]}} END"


_MAIN = [_arg("rule = 1", "few_obs", "n_obs", "artifacts_near"), _arg("rule = 2", "late_peak", "peak_ratio", "peak_shift"), _arg("rule = 3", "early_peak", "peak_ratio", "-peak_shift"),
         _arg("rule = 4", "flat", "peak", "CASE WHEN peak_ratio > 0 THEN peak / greatest(peak_ratio, 1e-6) END"), _arg("is_early", "decline", "peak_ratio", "-decline_shift"),
         _arg("rule = 7", "late_start", "sos_shift", "peak_ratio"), _arg("rule = 8", "no_deficit"), _arg("rule = 9", "low_peak", "peak_ratio"), _arg("rule = 10", "no_signal")]
_REGION = [_arg("scope = 'regional'", "region_low", "region_z", "share_low", "n_entities"), _arg("scope = 'local'", "region_normal", "region_z", "share_low", "n_entities"),
           _arg("scope = 'mixed'", "region_mixed", "region_z")]
_DRIVERS = [_arg("dry", "dry", "amount", "amount_norm", "deficit_pct"), _arg("hot", "hot", "level_anomaly", "level", "level - level_anomaly", "hot_days"),
            _arg("known AND max_dry_spell >= 15 AND NOT deficit_pct <= 0", "dry_spell", "max_dry_spell"), _arg("stress AND abs(b_deficit) >= 40", "before", "b_amount", "b_norm"),
            _arg("stress AND abs(d_deficit) >= 40", "during", "d_amount", "d_norm")]
_INDEX = [_arg("abs(index_anomaly) >= 0.05e0", "second_index", "index_anomaly", "index_n")]
cte("argued", f"""SELECT *, list_filter(CASE WHEN rule = 5 THEN [{', '.join(_DRIVERS + _MAIN + _REGION + _INDEX)}] ELSE [{', '.join(_MAIN + _REGION + _DRIVERS + _INDEX)}] END, lambda x : x IS NOT NULL) AS args
FROM (SELECT *, rule IN (5, 6) AND coalesce(peak_ratio >= 0.85e0 AND coalesce(decline_shift, 0) <= -15 AND start_doy <= 243, false) AS is_early FROM {{caused}})""")


def _fixed(x, digits=0):
    return f"CAST(CAST(round(CAST({x} AS DOUBLE) + {TIE_SHIFT}, {digits}) AS DECIMAL(18,{digits})) AS VARCHAR)"


def _counted(x, one, many):
    return f"{_fixed(x)} || CASE WHEN abs({x}) = 1 THEN ' {one}' ELSE ' {many}' END"


def _texts():
    n = lambda i: f"a.n[{i + 1}]"
    pct = lambda i: f"{_fixed(n(i) + ' * 100')} || ' %'"
    days = lambda i: _counted(n(i), "day", "days")
    join = lambda *p: " || ".join(p)
    region = lambda word: join(f"'other entities are {word} (median z '", _fixed(n(0), 1), "', '", pct(1), "' of '", _fixed(n(2)), "' low)'")
    return {
        "few_obs": join("'only '", _counted(n(0), "observation", "observations"), "' inside, '", _counted(n(1), "artifact", "artifacts"), "' near'"),
        "late_peak": join("'peak reached ('", pct(0), "' of the norm) but '", days(1), "' late: another crop, not stress'"),
        "early_peak": join("'peak reached ('", pct(0), "' of the norm) but '", days(1), "' early: another crop, not stress'"),
        "flat": join("'peak of the main season is only '", _fixed(n(0), 2), f"coalesce(' against a norm of ' || {_fixed(n(1), 2)}, '')", "': flat from spring on'"),
        "decline": join("'peak at the norm ('", pct(0), "') but the decline began '", days(1), "' early'"),
        "late_start": join("'growth began '", days(0), "' late, but the peak was reached ('", pct(1), "' of the norm)'"),
        "no_deficit": "'no clear deficit in the drivers, but the whole region is low'", "low_peak": join("'peak at '", pct(0), "' of the norm without a clear driver signal'"), "no_signal": "'no driver signal'",
        "region_low": region("low too"), "region_normal": region("normal"), "region_mixed": join("'other entities are slightly low (median z '", _fixed(n(0), 1), "')'"),
        "dry": join("'amount '", _fixed(n(0)), "' against a norm of '", _fixed(n(1)), "' (deficit '", _fixed(n(2)), "' %)'"),
        "hot": join("'level above the norm by '", _fixed(n(0), 1), "' ('", _fixed(n(1), 1), "' against '", _fixed(n(2), 1), "'), '", _counted(n(3), "hot day", "hot days")),
        "dry_spell": join("'dry run of '", days(0)), "before": join("'in the 30 days before: amount '", _fixed(n(0)), "' against a norm of '", _fixed(n(1))),
        "during": join("'during the episode: amount '", _fixed(n(0)), "' against a norm of '", _fixed(n(1))),
        "second_index": join("'second index off its norm by '", _fixed(n(0), 2), "' ('", _counted(n(1), "point", "points"), "')'")}


_RENDER = "CASE a.code " + " ".join(f"WHEN '{c}' THEN {x}" for c, x in _texts().items()) + " END"
_day = lambda c: f"strftime(DATE '2000-01-01' + CAST({c} AS INTEGER), '%Y-%m-%d')"
cte("described", f"""SELECT *, pid || ', season ' || year || ': ' || severity || ' anomaly from ' || {_day('start')} || ' to ' || {_day('"end"')} || ' (' || {_counted('days', 'day', 'days')} || ', ' ||
{_counted('n_obs', 'observation', 'observations')} || '), phase ' || coalesce(phase, 'none') || '. Value on the worst day ' || {_day('worst_day')} || ': ' || {_fixed('value_at_worst', 2)} || ' against a norm of ' ||
{_fixed('norm_at_worst', 2)} || ' (z = ' || {_fixed('min_z', 1)} || '). Probable cause: ' || cause || ' (confidence ' || {_fixed('confidence * 100')} || ' %).' ||
CASE WHEN len(args) > 0 THEN ' Arguments: ' || array_to_string(list_transform(args, lambda a : {_RENDER}), '; ') || '.' ELSE '' END || ' Norm: ' || norm_source || '.' AS text FROM {{argued}}""")
ARGS_SQL = "array_to_string(list_transform(args, lambda a : a.code || '(' || array_to_string(list_transform(a.n, lambda x : coalesce(CAST(CAST(floor(x * 100 + 0.5e0 + 1e-6) AS BIGINT) AS VARCHAR), '-')), ',') || ')'), ' ')"


def run(t, strict=True):
    return plan(t, strict).run(driver_grid(t))


@query("classify", "pid:i year:i start:i cause:s confidence:f2 stress:b scope:s strength:f3 args:s", f"SELECT * EXCLUDE (args), {ARGS_SQL} AS args FROM {{argued}}")
def _(t):
    number = lambda x: F.coalesce(F.floor(x * 100 + 0.5 + 1e-6).cast("bigint").cast("string"), F.lit("-"))
    one = lambda a: F.concat(a["code"], F.lit("("), F.array_join(F.transform(a["n"], number), ","), F.lit(")"))
    return run(t).withColumn("args", F.array_join(F.transform("arguments", one), " "))


@query("run_anomaly", "pid:i year:i start:i end:i days:i n_obs:i min_z:f4 mean_z:f4 severity:s cause:s confidence:f2 region_z:f4 norm_source:s driver_source:s",
       "SELECT * FROM {caused}")
def _(t):
    return run(t)


@query("describe", "pid:i year:i start:i text:s", "SELECT * FROM {described}")
def _(t):
    return run(t)

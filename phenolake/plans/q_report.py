"""Queries: reports over seasons and episodes."""

from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.functions import expr as E
from phenolake.operators import aggregate as A
from phenolake.operators import report as R
from phenolake.operators.context import severity
from phenolake.operators import sampling
from phenolake.operators.norms import loyo_norm
from phenolake.plans.ctes import cte, variant
from phenolake.plans.q_aggregate import with_status
from phenolake.plans.q_context import driver_grid, run
from phenolake.plans.q_join import inside_episode
from phenolake.plans.q_season import plan
from phenolake.plans.registry import query
from phenolake.plans.season import SeasonPlan
from phenolake.sources.io import cut_lineage


@query("filter_episodes", "pid:i year:i start:i severity:s cause:s", "SELECT * FROM {caused} WHERE year = 1998 AND lower(cause) LIKE '%season%' AND severity = 'moderate'")
def _(t):
    return R.filter_episodes(run(t), 1998, "SEASON", "moderate")


@query("asked_seasons", "season:i n:i n_entities:i first_pid:i", r"""WITH q AS (SELECT pid, concat('Why is ', year + doy % 5 - 2, ' unlike 9', year, ' or x', year, ', ',
year + doy % 3, '? And ', year, '.') AS question FROM {panel}), k AS (SELECT pid, list(DISTINCT year) AS known FROM {panel} GROUP BY pid)
SELECT season, count(*) AS n, count(DISTINCT pid) AS n_entities, min(pid) AS first_pid FROM (SELECT pid,
list_filter(CAST(regexp_extract_all(question, '\b(?:19|20)[0-9][0-9]\b') AS INT[]), lambda y: list_contains(known, y))[1] AS season FROM q JOIN k USING (pid)) GROUP BY season""")
def _(t):
    """Questions that name a year near their row's, numbers that aren't years, and the row's year."""
    y = F.col("year")
    q = t.panel.select("pid", F.concat(F.lit("Why is "), y + F.col("doy") % 5 - 2, F.lit(" unlike 9"), y, F.lit(" or x"), y, F.lit(", "),
                                       y + F.col("doy") % 3, F.lit("? And "), y, F.lit(".")).alias("question"))
    return R.asked_seasons(q, t.panel).groupBy("season").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("n_entities"), F.min("pid").alias("first_pid"))


@query("counted_nouns", "phrase:s n_groups:i", """SELECT concat(n, CASE WHEN n % 100 BETWEEN 11 AND 14 THEN ' days' WHEN n % 10 = 1 THEN ' day' WHEN n % 10 BETWEEN 2 AND 4 THEN ' days (few)' ELSE ' days' END)
AS phrase, count(*) AS n_groups FROM (SELECT count(DISTINCT day) AS n FROM {panel} GROUP BY pid, year) GROUP BY ALL""")
def _(t):
    n = t.panel.groupBy("pid", "year").agg(F.count_distinct("day").alias("n"))
    return n.groupBy(E.counted(F.col("n"), "day", "days (few)", "days").alias("phrase")).agg(F.count("*").alias("n_groups"))


@query("episode_summary", "cause:s year:i severity:s n:i n_entities:i", """SELECT cause, year, severity, count(*) AS n, count(DISTINCT pid) AS n_entities
FROM {caused} GROUP BY GROUPING SETS ((cause), (year), (severity), ())""")
def _(t):
    return R.episode_summary(run(t))


@query("entity_overview", "pid:i n_obs:i years:s n_episodes:i n_critical:i n_gaps:i has_drivers:b", """SELECT o.pid, n_obs, years, coalesce(n_episodes, 0) AS n_episodes,
coalesce(n_critical, 0) AS n_critical, coalesce(n_gaps, 0) AS n_gaps, o.pid IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT region FROM {drivers})) AS has_drivers
FROM (SELECT pid, count(*) AS n_obs, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM {season} GROUP BY pid) o
LEFT JOIN (SELECT pid, count(*) AS n_episodes, count(*) FILTER (min_z < -2 AND critical_days >= 5) AS n_critical FROM {eps} GROUP BY pid) e ON e.pid = o.pid
LEFT JOIN (SELECT pid, count(*) AS n_gaps FROM {targets} GROUP BY pid) g ON g.pid = o.pid""")
def _(t):
    ep = plan(t).saved_episodes.withColumn("severity", severity(F.col("min_z"), F.col("critical_days")))
    driven = t.categories.join(t.drivers.select(F.col("region").alias("category")).distinct(), "category", "left_semi")
    d = R.entity_overview(t.season, ep, t.targets, driven)
    return d.withColumn("years", F.concat_ws(",", F.col("years").cast("array<string>")))


cte("season_facts", """SELECT z.pid, z.year, n_obs, n_artifacts, mean_z, share_days_depressed, norm_source, d.valid, d.peak, d.peak_doy, d.base, d.amplitude, d.sos_doy,
d.half_decline_doy, d.peak_ratio, d.peak_shift, d.sos_shift, d.integral_ratio, d.decline_shift FROM (SELECT pid, year, avg(z) AS mean_z,
avg(CASE WHEN coalesce(z < -1, false) THEN 1.0 ELSE 0.0 END) AS share_days_depressed, max(norm_source) AS norm_source FROM {zs} GROUP BY pid, year) z
JOIN (SELECT pid, year, count(*) AS n_obs, count(*) FILTER (artifact) AS n_artifacts FROM {hseries} GROUP BY pid, year) h ON h.pid = z.pid AND h.year = z.year
LEFT JOIN {dev} d ON d.pid = z.pid AND d.year = z.year""")


@query("season_table", "pid:i year:i n_obs:i n_artifacts:i mean_z:f4 share_days_depressed:f6 norm_source:s valid:b peak:f5 peak_ratio:f5 decline_shift:i", "SELECT * FROM {season_facts}")
def _(t):
    return plan(t).seasons


@query("season_level", "pid:i year:i n_episodes:i level:s", """SELECT s.pid, s.year, count(c.cause) AS n_episodes, CASE
WHEN bool_or(c.cause NOT IN ('data_suspect', 'crop_rotation') AND severity = 'critical') THEN 'high' WHEN bool_or(c.cause NOT IN ('data_suspect', 'crop_rotation')) THEN 'medium'
WHEN bool_or(c.cause = 'data_suspect') THEN 'data' WHEN count(c.cause) > 0 THEN 'context' WHEN bool_or(f.mean_z IS NOT NULL) THEN 'clear' ELSE 'unknown' END AS level
FROM (SELECT DISTINCT pid, year FROM {season}) s LEFT JOIN {caused} c ON c.pid = s.pid AND c.year = s.year LEFT JOIN {season_facts} f ON f.pid = s.pid AND f.year = s.year GROUP BY s.pid, s.year""")
def _(t):
    return levels(t)


def levels(t):
    p = plan(t)
    assessed = p.saved_z.groupBy("pid", "year").agg(F.avg("z").alias("mean_z")).filter("mean_z IS NOT NULL")
    return R.season_level(t.season, p.run(driver_grid(t)), assessed)


@query("anomaly_feed", "pid:i name:s level:s level_rank:i", """SELECT l.pid, s_name AS name, level, list_position(['high', 'medium', 'data', 'context', 'unknown', 'clear'], level) - 1 AS level_rank
FROM (SELECT e.pid, CASE WHEN count(s.year) = 0 THEN 'unknown' WHEN bool_or(c.cause NOT IN ('data_suspect', 'crop_rotation') AND severity = 'critical') THEN 'high'
WHEN bool_or(c.cause NOT IN ('data_suspect', 'crop_rotation')) THEN 'medium' WHEN bool_or(c.cause = 'data_suspect') THEN 'data' WHEN count(c.cause) > 0 THEN 'context' ELSE 'clear' END AS level
FROM (SELECT DISTINCT pid FROM {season}) e LEFT JOIN (SELECT DISTINCT pid, year FROM {season} WHERE year = (SELECT max(year) FROM {season})) s ON s.pid = e.pid
LEFT JOIN {caused} c ON c.pid = s.pid AND c.year = s.year GROUP BY e.pid) l LEFT JOIN supplier ON s_suppkey = l.pid
ORDER BY level_rank, lower(s_name)""")
def _(t):
    names = t.read("supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_name").alias("name"))
    latest = t.season.agg(F.max("year")).first()[0]
    d = t.season.select("pid").distinct().join(levels(t).filter(F.col("year") == F.lit(latest)).select("pid", "level"), "pid", "left")
    d = d.join(names, "pid", "left").withColumn("level", F.coalesce("level", F.lit("unknown")))
    return d.withColumn("level_rank", R.level_rank(F.col("level"))).orderBy("level_rank", F.lower("name"))


cte("trend_pts", "SELECT h.pid, h.year, h.day, h.h, z.norm_mean, z.norm_std FROM {hseries} h LEFT JOIN {zs} z ON z.pid = h.pid AND z.day = h.day WHERE NOT artifact")
cte("trend", """SELECT *, CASE WHEN least(n_before, n_after) < 2 THEN 'insufficient' WHEN b >= -1 AND a >= -1 THEN 'within' WHEN a - b >= 0.5 AND a >= -1 THEN 'recovered'
WHEN a - b >= 0.5 THEN 'easing' WHEN a - b <= -0.5 THEN 'worsening' ELSE 'stable' END AS status, CASE WHEN least(n_before, n_after) >= 2 THEN b END AS before_z,
CASE WHEN least(n_before, n_after) >= 2 THEN a END AS after_z FROM (SELECT pid, year, "end", count(z) FILTER (day < "end" - 13) AS n_before, count(z) FILTER (day >= "end" - 13) AS n_after,
median(z) FILTER (day < "end" - 13 AND z IS NOT NULL) AS b, median(z) FILTER (day >= "end" - 13 AND z IS NOT NULL) AS a FROM (SELECT *, CASE WHEN norm_std > 0 THEN (h - norm_mean) / norm_std END AS z
FROM (SELECT *, max(day) OVER (PARTITION BY pid, year) AS "end" FROM {trend_pts})) WHERE day BETWEEN "end" - 27 AND "end" GROUP BY pid, year, "end")""")


def trend_points(p: SeasonPlan):
    norm = p.saved_z.select("pid", "day", "norm_mean", "norm_std")
    return p.saved_series.join(norm, ["pid", "day"], "left")


@query("deviation_trend", "pid:i year:i end:i n_before:i n_after:i status:s before_z:f4 after_z:f4", "SELECT * FROM {trend}")
def _(t):
    return R.deviation_trend(trend_points(plan(t)))


LABELS = """CASE WHEN off IS NULL THEN 'unknown' WHEN wi AND n < 0.25e0 THEN 'low_but_usual' WHEN abs(off) <= 7 OR wi THEN 'usual' WHEN off > 0 THEN 'more' ELSE 'less' END"""
cte("toned", f"""SELECT *, CASE WHEN label = 'less' AND off < -25 THEN 'crit' WHEN label = 'less' THEN 'warn' ELSE 'ok' END AS tone FROM (SELECT *, {LABELS} AS label FROM (
SELECT pid, date, year, day, CASE WHEN norm_mean >= 0.08e0 THEN floor((value - norm_mean) / norm_mean * 100 + 0.5e0) END AS off, coalesce(norm_std > 0 AND abs(value - norm_mean) < norm_std, false) AS wi,
norm_mean AS n FROM {{zs}} WHERE value IS NOT NULL))""")


@query("tone_labels", "pid:i date:d label:s tone:s", "SELECT pid, date, label, tone FROM {toned}")
def _(t):
    label, tone = R.value_tone(F.col("value"), F.col("norm_mean"), F.col("norm_std"))
    return plan(t).z.filter("value IS NOT NULL").withColumns({"label": label, "tone": tone})


@query("driver_tones", "pid:i year:i ep:i win:s rain:s rain_tone:s heat:s heat_tone:s dry_tone:s", """SELECT pid, year, ep, win, rain, CASE WHEN rain = 'almost_none' THEN 'crit' WHEN rain IN ('half', 'double')
THEN 'warn' ELSE 'ok' END AS rain_tone, CASE WHEN hd IS NULL THEN 'unknown' WHEN abs(hd) < 3 THEN 'on_schedule' WHEN hd > 0 THEN 'ahead' ELSE 'behind' END AS heat,
CASE WHEN abs(hd) > 10 THEN 'warn' ELSE 'ok' END AS heat_tone, CASE WHEN max_dry_spell < 14 THEN 'ok' WHEN max_dry_spell < 21 THEN 'warn' ELSE 'crit' END AS dry_tone FROM (SELECT *,
CASE WHEN r IS NULL THEN 'unknown' WHEN r < 0.35e0 THEN 'almost_none' WHEN r < 0.6e0 THEN 'half' WHEN r < 0.85e0 THEN 'slightly_less' WHEN r <= 1.25e0 THEN 'usual' WHEN r <= 1.8e0 THEN 'more' ELSE 'double' END AS rain
FROM (SELECT *, CASE WHEN amount_norm > 0 THEN amount / amount_norm END AS r, CASE WHEN level_norm > 0 THEN floor((level * 10 - level_norm * 10) / 20 + 0.5e0) END AS hd
FROM (SELECT *, level - level_anomaly AS level_norm FROM {win_facts})))""")
def _(t):
    d = plan(t).driver_facts(driver_grid(t)).withColumn("level_norm", F.col("level") - F.col("level_anomaly"))
    rain, rain_tone = R.amount_tone(F.col("amount"), F.col("amount_norm"))
    heat, heat_tone = R.heat_tone(F.col("level") * 10, F.col("level_norm") * 10)
    return d.withColumns({"rain": rain, "rain_tone": rain_tone, "heat": heat, "heat_tone": heat_tone, "dry_tone": R.dry_tone(F.col("max_dry_spell"))})


@query("season_verdict", "pid:i year:i verdict:s light:s", """WITH last AS (SELECT h.pid, h.year, h.day AS last_day, coalesce(tone, 'ok') AS tone, tr.status AS trend FROM (SELECT pid, year, max(day) AS day FROM {hseries} WHERE NOT artifact GROUP BY pid, year) h
LEFT JOIN {toned} t ON t.pid = h.pid AND t.day = h.day LEFT JOIN {trend} tr ON tr.pid = h.pid AND tr.year = h.year),
g AS (SELECT l.pid, l.year, any_value(tone) AS tone, any_value(trend) AS trend, arg_min(severity, (min_z, "end")) FILTER (cause NOT IN ('data_suspect', 'crop_rotation') AND "end" >= last_day - 7) AS nw,
coalesce(bool_or(cause NOT IN ('data_suspect', 'crop_rotation')), false) AS rl, count(cause) AS n FROM last l LEFT JOIN {caused} c ON c.pid = l.pid AND c.year = l.year GROUP BY l.pid, l.year),
v AS (SELECT *, CASE WHEN nw = 'critical' THEN 'behind' WHEN nw IS NOT NULL THEN 'watch' WHEN rl AND (coalesce(trend IN ('recovered', 'within'), false) OR tone = 'ok') THEN 'recovered' WHEN rl THEN 'watch'
WHEN n > 0 THEN 'explained' WHEN tone = 'crit' THEN 'low' ELSE 'normal' END AS verdict FROM g)
SELECT pid, year, verdict, CASE WHEN verdict = 'behind' THEN 'crit' WHEN verdict IN ('watch', 'low') THEN 'warn' ELSE 'ok' END AS light FROM v""")
def _(t):
    p = plan(t)
    _, tone = R.value_tone(F.col("value"), F.col("norm_mean"), F.col("norm_std"))
    days = p.saved_series.filter("NOT artifact").groupBy("pid", "year").agg(F.max("day").alias("last_day"))
    tones = p.saved_z.filter("value IS NOT NULL").select("pid", F.col("day").alias("last_day"), tone.alias("tone"))
    trend = R.deviation_trend(trend_points(p)).select("pid", "year", F.col("status").alias("trend"))
    last = days.join(tones, ["pid", "last_day"], "left").join(trend, ["pid", "year"], "left").fillna("ok", ["tone"])
    return R.season_verdict(last, p.run(driver_grid(t)))


_FE = ", ".join(f"('{f}', CAST({f} AS DOUBLE))" for f in R.SHAPE)
cte("shape_long", f"""SELECT pid, year, f.feature, f.x FROM {{season_facts}}, LATERAL (VALUES {_FE}) f(feature, x) WHERE valid AND norm_source = 'own'""")
cte("shape_dev", """SELECT *, d / CASE WHEN mad > 1e-9 THEN 1.4826e0 * mad ELSE 1 END AS dev FROM (SELECT *, median(d) OVER (PARTITION BY feature) AS mad FROM (
SELECT *, abs(coalesce(x, med) - med) AS d, coalesce(x, med) AS fx FROM (SELECT *, median(x) OVER (PARTITION BY feature) AS med FROM {shape_long})))""")
cte("shape_score", """SELECT pid, year, avg(dev) AS score, CASE WHEN max(fx) FILTER (feature = 'integral_ratio') < 1 OR max(fx) FILTER (feature = 'mean_z') < 0 THEN 'weaker' ELSE 'stronger' END AS direction,
string_agg(feature, ',' ORDER BY r) FILTER (r <= 3) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY pid, year ORDER BY round(dev, 6) DESC, feature) AS r FROM {shape_dev}) GROUP BY pid, year""")


@query("shape_outliers", "pid:i year:i score:f4 flag:b direction:s reasons:s", "SELECT *, score >= (SELECT quantile_cont(score, 0.95) FROM {shape_score}) - 1e-12 AS flag FROM {shape_score}")
def _(t):
    return R.shape_outliers(cut_lineage(plan(t).seasons))  # read four times below


@query("selectivity", "seasons:i episodes:i with_episode:f6 per_season:f6 share_short:f6 share_few_obs:f6 median_days:f3", """SELECT n AS seasons, count(*) AS episodes,
count(DISTINCT (pid, year)) / CAST(n AS DOUBLE) AS with_episode, count(*) / CAST(n AS DOUBLE) AS per_season, avg((days < 14)::INT) AS share_short, avg((n_obs <= 2)::INT) AS share_few_obs,
median(days) AS median_days FROM {eps} CROSS JOIN (SELECT count(*) AS n FROM (SELECT DISTINCT pid, year FROM {zs})) GROUP BY n""")
def _(t):
    p = plan(t)
    return R.selectivity(p.saved_episodes, p.saved_z.select("pid", "year").distinct())


@query("agreement", "n:i recall_depressed:f6 recall_critical:f6 precision:f6 base_rate:f6 share_inside:f6", """SELECT count(*) AS n, avg(i) FILTER (z < -1) AS recall_depressed,
avg(i) FILTER (z < -2) AS recall_critical, avg((z < -1)::INT) FILTER (i = 1) AS precision, avg((z < -1)::INT) AS base_rate, avg(i) AS share_inside FROM (
SELECT z, (EXISTS (SELECT 1 FROM {eps} e WHERE e.pid = l.pid AND l.day BETWEEN e.start AND e."end"))::INT AS i FROM {loyo} l WHERE z IS NOT NULL)""")
def _(t):
    return R.agreement(inside_episode(loyo_norm(t.season), cut_lineage(plan(t).episodes)))


@query("source_independence", "n_seasons:i corr_ours:f5 corr_raw:f5", """SELECT count(*) AS n_seasons, corr(share_days_depressed, s1_share) AS corr_ours, corr(raw, s1_share) AS corr_raw FROM (
SELECT pid, year, avg((source = 0)::INT) AS s1_share, avg(coalesce(z < -1, false)::INT) AS raw FROM {loyo} GROUP BY pid, year) JOIN {season_facts} USING (pid, year) WHERE s1_share BETWEEN 0.05 AND 0.95""")
def _(t):
    raw = loyo_norm(t.season).groupBy("pid", "year").agg(A.share(F.col("source") == 0).alias("s1_share"), A.share(F.coalesce(F.col("z") < -1, F.lit(False))).alias("raw"))
    ours = plan(t).z.groupBy("pid", "year").agg(A.share(F.coalesce(F.col("z") < -1, F.lit(False))).alias("ours"))
    return raw.join(ours, ["pid", "year"]).filter(F.col("s1_share").between(0.05, 0.95)).agg(
        F.count("*").alias("n_seasons"), F.corr("ours", "s1_share").alias("corr_ours"), F.corr("raw", "s1_share").alias("corr_raw"))


@query("year_ranking", "year:i rate:f6 rank:f1", """SELECT year, rate, rank() OVER (ORDER BY round(rate, 9) DESC) + (count(*) OVER (PARTITION BY round(rate, 9)) - 1) / 2.0 AS rank FROM (
SELECT s.year, coalesce(e, 0) / CAST(n AS DOUBLE) AS rate FROM (SELECT year, count(DISTINCT pid) AS n FROM {zs} GROUP BY year) s LEFT JOIN (SELECT year, count(DISTINCT pid) AS e FROM {eps} GROUP BY year) e ON e.year = s.year)""")
def _(t):
    p = plan(t)
    return R.year_ranking(p.saved_episodes, p.saved_z.select("pid", "year").distinct())


@query("example_seasons", "kind:s pid:i year:i n:i share:f6", """WITH s AS (SELECT pid, year, count(*) AS n, avg((status <> 'normal')::INT) AS share FROM {statused} WHERE status IS NOT NULL GROUP BY pid, year HAVING count(*) >= 40)
(SELECT 'worst' AS kind, pid, year, n, share FROM s ORDER BY share DESC, pid, year LIMIT 1) UNION ALL (SELECT 'calm', pid, year, n, share FROM s WHERE share = 0 ORDER BY n DESC, pid, year LIMIT 1)""")
def _(t):
    return R.example_seasons(with_status(t))


@query("top_episodes", "pid:i place:i year:i start:i severity:s min_z:f4", """SELECT pid, year, start, severity, min_z, row_number() OVER (PARTITION BY pid ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, min_z, year, start) AS place
FROM {caused} QUALIFY place <= 12""")
def _(t):
    return R.top_episodes(plan(t).saved_episodes.withColumn("severity", severity(F.col("min_z"), F.col("critical_days"))), 12)


def _object(**fields: str) -> str:
    """SQL text of a JSON object without its NULL fields."""
    return "'{' || rtrim(" + " || ".join(f"""coalesce('"{name}":' || {sql} || ',', '')""" for name, sql in fields.items()) + ", ',') || '}'"


_whole = "CAST({} AS BIGINT)".format
_text = "CAST(to_json({}) AS VARCHAR)".format


def _number(column: str, digits: int) -> str:
    return f"CAST(round(CAST({column} AS DOUBLE), {digits}) + 0.0 AS VARCHAR)"


cte("facts_ep", f"""SELECT pid, count(*) AS n, '[' || string_agg(j, ',' ORDER BY place) || ']' AS js FROM (SELECT pid, place, {_object(
    place=_whole('place'), year=_whole('year'), start=_whole('start'), end=_whole('"end"'), days=_whole('days'), severity=_text('severity'), cause=_text('cause'),
    min_z=_number('min_z', 2), text=_text('text'))} AS j FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY
    CASE severity WHEN 'critical' THEN 0 ELSE 1 END, min_z, year, start) AS place FROM {{described}} QUALIFY place <= 12)) GROUP BY pid""")
cte("facts_season", f"""SELECT pid, count(*) AS n, '[' || string_agg({_object(year=_whole('year'), n_obs=_whole('n_obs'), peak=_number('peak', 3),
    peak_doy=_whole('peak_doy'), mean_z=_number('mean_z', 2), norm_source=_text('norm_source'))}, ',' ORDER BY year) || ']' AS js
FROM {{season_facts}} GROUP BY pid""")


@query("field_facts", "pid:i n_seasons:i n_episodes:i doc:s", f"""SELECT s.pid, s.n AS n_seasons, coalesce(e.n, 0) AS n_episodes,
{_object(pid=_whole('s.pid'), seasons='s.js', episodes='e.js')} AS doc FROM {{facts_season}} s LEFT JOIN {{facts_ep}} e ON e.pid = s.pid""")
def _(t):
    p = plan(t)
    return R.field_facts(p.run(driver_grid(t)), p.seasons)


cte("season_held", """SELECT * EXCLUDE (g) FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 'rerun', pid, date))) <= round(count(*) OVER () * 0.15) AS g FROM {season}) WHERE NOT g""")
_HELD = variant("eps", "season", "SELECT * FROM {season_held}", "_again")


@query("mask_and_rerun", "seasons_full:i seasons_masked:i seasons_both:i day_jaccard:f4", f"""WITH f AS (SELECT DISTINCT pid, year, unnest(range(start, "end" + 1)) AS day FROM {{eps}}), m AS (SELECT DISTINCT pid, year, unnest(range(start, "end" + 1)) AS day FROM {{{_HELD}}}),
d AS (SELECT coalesce(f.pid, m.pid) AS pid, coalesce(f.year, m.year) AS year, f.day IS NOT NULL AS f, m.day IS NOT NULL AS m FROM f FULL JOIN m ON f.pid = m.pid AND f.year = m.year AND f.day = m.day),
s AS (SELECT bool_or(f) AS f, bool_or(m) AS m, count(*) FILTER (f AND m) AS n_both, count(*) AS n_either FROM d GROUP BY pid, year)
SELECT count(*) FILTER (f) AS seasons_full, count(*) FILTER (m) AS seasons_masked, count(*) FILTER (f AND m) AS seasons_both, sum(n_both) / sum(n_either) AS day_jaccard FROM s""")
def _(t):
    """Hides 15 % of the observations, reruns the detector and compares seasons and episode days."""
    full = cut_lineage(plan(t).episodes)
    held = sampling.exact_share(t.season, ["pid", "date"], C.GAP_SHARE, "rerun", "hidden").filter("NOT hidden").drop("hidden")
    part = cut_lineage(SeasonPlan(held, t.categories, parts=t.parts).episodes)
    tag = lambda d, c: d.select("pid", "year", F.explode(F.sequence("start", "end")).alias("day")).withColumn(c, F.lit(1))
    days = tag(full, "f").join(tag(part, "m"), ["pid", "year", "day"], "full")
    seasons = days.groupBy("pid", "year").agg(F.max("f").alias("f"), F.max("m").alias("m"), F.count(F.when(F.col("f") + F.col("m") == 2, 1)).alias("both"),
                                              F.count("*").alias("either"))
    return seasons.agg(F.count("f").alias("seasons_full"), F.count("m").alias("seasons_masked"), F.count(F.when(F.col("f") + F.col("m") == 2, 1)).alias("seasons_both"),
                       (F.sum("both") / F.sum("either")).alias("day_jaccard"))

"""Queries: aggregates A1..A40 that do not need predictions or season curves."""

from pyspark.sql import functions as F

from phenolake.functions import expr as E
from phenolake.operators import aggregate as A
from phenolake.operators import frames, pairs
from phenolake.operators.norms import bin_norms, loyo_norm, norm_search
from phenolake.operators.quantiles import exact_quantiles, ks_statistic
from phenolake.plans.ctes import cte
from phenolake.plans.registry import query

STATUSES = ["normal", "depressed", "critical"]


def with_status(t):
    d = loyo_norm(t.season)
    return d.withColumn("status", E.status_from_z(F.col("z")))


@query("coverage_by_year", "year:i train:f6 test:f6 test_full:f6", """SELECT year,
avg(CASE WHEN known THEN 1.0 ELSE 0.0 END) FILTER (status_flag = 'F') AS train,
avg(CASE WHEN known THEN 1.0 ELSE 0.0 END) FILTER (status_flag = 'O') AS test,
avg(CASE WHEN known OR is_gap THEN 1.0 ELSE 0.0 END) FILTER (status_flag = 'O') AS test_full
FROM (SELECT *, coalesce(s1, s2) IS NOT NULL AND NOT is_gap AS known FROM {marked}) GROUP BY year""")
def _(t):
    known = F.coalesce("s1", "s2").isNotNull() & ~F.col("is_gap")
    flag = lambda c, split: F.avg(F.when(F.col("status_flag") == split, F.when(c, 1.0).otherwise(0.0)))
    return t.marked.groupBy("year").agg(flag(known, "F").alias("train"), flag(known, "O").alias("test"),
                                        flag(known | F.col("is_gap"), "O").alias("test_full"))


@query("source_availability", "year:i s1:f6 s2:f6 s3:f6", "SELECT year, " + ", ".join(
    f"avg(CASE WHEN s{i} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS s{i}" for i in (1, 2, 3)) + " FROM {known} GROUP BY year")
def _(t):
    return A.presence(t.known, ["year"], ["s1", "s2", "s3"])


@query("coverage_pivot", "pid:i year:i share:f6", "SELECT pid, year, avg(CASE WHEN source = 0 THEN 1.0 ELSE 0.0 END) AS share FROM {panel} GROUP BY ALL")
def _(t):
    return A.share_by(t.panel, ["pid", "year"], F.col("source") == 0)


@query("grid_regime", "seasons:i partial:i entities_partial:i partial_rows_median:f6", """SELECT count(*) AS seasons,
count(*) FILTER (n < 45) AS partial, count(DISTINCT pid) FILTER (n < 45) AS entities_partial,
median(n) FILTER (n < 45) AS partial_rows_median FROM (SELECT pid, year, count(*) AS n FROM {season} GROUP BY ALL)""")
def _(t):
    return A.grid_regime(t.season, rows=45)


@query("shared_series", "signature:s n_entities:i first_entity:i", """SELECT signature, count(*) AS n_entities,
min(pid) AS first_entity FROM (SELECT pid, md5(string_agg(p, ',' ORDER BY p)) AS signature FROM (
SELECT o_custkey AS pid, concat(year(o_orderdate), '=', CAST(floor(min(o_totalprice) / 250000) AS BIGINT)) AS p
FROM orders GROUP BY o_custkey, year(o_orderdate)) GROUP BY pid) GROUP BY signature HAVING count(*) > 1""")
def _(t):
    d = t.read("orders").groupBy(F.col("o_custkey").alias("pid"), F.year("o_orderdate").alias("year")).agg(
        F.min("o_totalprice").alias("v"))
    return A.shared_series(d, "pid", "year", F.floor(F.col("v") / 250000).cast("bigint"))


@query("doy_profile", "doy:i value:f6 s1:f6 s2:f6", """SELECT doy, """ + ", ".join(
    f"CASE WHEN count(*) OVER w = 7 THEN avg({c}) OVER w END AS {c}" for c in ("value", "s1", "s2")) + """ FROM (
SELECT doy, """ + ", ".join(f"avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in ("value", "s1", "s2")) +
       """ FROM {panel} GROUP BY doy) WINDOW w AS (ORDER BY doy ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def _(t):
    return A.doy_profile(t.panel, ["value", "s1", "s2"])


PROBS = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("quantiles", "n:i " + " ".join(f"{p}:f6" for p in PROBS), "SELECT count(value) AS n, " + ", ".join(
    f"quantile_cont(value, {v}) AS {k}" for k, v in PROBS.items()) + " FROM {panel}")
def _(t):
    return exact_quantiles(t.panel, [], "value", PROBS)


cte("weekly_category", """SELECT category, floor((doy - 91) / 7.0) AS week, count(*) AS n, quantile_cont(value, 0.25) AS p25,
median(value) AS median, quantile_cont(value, 0.75) AS p75 FROM {panel_cat} WHERE doy BETWEEN 91 AND 304 GROUP BY ALL""")


def weekly_category(t):
    d = t.panel_cat.filter(E.in_season(F.col("doy"))).withColumn("week", E.bin_week(F.col("doy")))
    return A.seasonal_curve(d, ["category", "week"])


@query("seasonal_curve", "category:i week:i n:i p25:f6 median:f6 p75:f6", "SELECT * FROM {weekly_category}")
def _(t):
    return weekly_category(t)


@query("seasonal_curve_by_year", "year:i week:i n:i median:f6", """SELECT year, floor((doy - 91) / 7.0) AS week, count(*) AS n,
median(value) AS median FROM {season} GROUP BY ALL""")
def _(t):
    return A.seasonal_curve(t.season.withColumn("week", E.bin_week(F.col("doy"))), ["year", "week"])


@query("peak_bin", "category:i peak:i top:f6", """SELECT category, week AS peak, median AS top FROM {weekly_category}
QUALIFY row_number() OVER (PARTITION BY category ORDER BY median DESC, week) = 1""")
def _(t):
    return A.peak_bin(weekly_category(t), "category", "week", "median")


@query("crosstab_share", "year:i " + " ".join(f"{s}:f6" for s in STATUSES), "SELECT year, " + ", ".join(
    f"avg(CASE WHEN status = '{s}' THEN 1.0 ELSE 0.0 END) AS {s}" for s in STATUSES) +
       " FROM {statused} WHERE status IS NOT NULL GROUP BY year")
def _(t):
    return A.crosstab_share(with_status(t), "year", "status", STATUSES)


@query("value_shares", "status:s n:i share:f6", """SELECT status, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)
AS share FROM {statused} WHERE status IS NOT NULL GROUP BY status""")
def _(t):
    return A.value_shares(with_status(t), "status")


@query("source_agreement", "pair:s n:i bias:f6 rmse:f6 r:f6", " UNION ALL ".join(
    f"SELECT '{a}_{b}' AS pair, count(*) AS n, avg({b} - {a}) AS bias, sqrt(avg(({b} - {a}) * ({b} - {a}))) AS rmse, "
    f"corr({a}, {b}) AS r FROM {{panel}} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in (("s1", "s2"), ("s1", "s3"), ("s2", "s3"))))
def _(t):
    return A.source_agreement(t.panel)


FIVE = {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "hi": 1.0}


@query("bias_by_month", "month:i n:i " + " ".join(f"{k}:f6" for k in FIVE), "SELECT month, count(s2 - s1) AS n, " + ", ".join(
    f"quantile_cont(s2 - s1, {v}) AS {k}" for k, v in FIVE.items()) +
       " FROM {panel} WHERE s2 IS NOT NULL AND s1 IS NOT NULL GROUP BY month")
def _(t):
    return exact_quantiles(t.panel.withColumn("diff", F.col("s2") - F.col("s1")), ["month"], "diff", FIVE)


@query("negative_outliers", "source:i n:i below_02:i", """SELECT source, count(*) AS n, count(*) FILTER (value - 0.4e0 < -0.2e0)
AS below_02 FROM {panel} WHERE value - 0.4e0 < 0 GROUP BY source""")
def _(t):
    v = F.col("value") - F.lit(0.4)
    return t.panel.filter(v < 0).groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(v < -0.2, 1)).alias("below_02"))


@query("outlier_context", "pid:i date:d value:f9 worst_day:i worst_value:f9", """SELECT p.pid, p.date, p.value, w.day AS worst_day,
w.value AS worst_value FROM {panel} p JOIN (SELECT pid, day, value FROM {panel} ORDER BY value, pid, day LIMIT 4) w
ON p.pid = w.pid AND abs(p.day - w.day) <= 30""")
def _(t):
    return A.outlier_context(t.panel, F.col("value"))


@query("source_offsets", "s1:f6 s2:f6 s3:f6", "SELECT avg(s1 - s1) AS s1, avg(s2 - s1) AS s2, avg(s3 - s1) AS s3 FROM {panel}")
def _(t):
    return A.source_offsets(t.panel)


cte("offsets", """SELECT pid, count(s2 - s1) AS n_s2, count(s3 - s1) AS n_s3,
(count(s2 - s1) * coalesce(avg(s2 - s1), 0.037e0) + 10 * 0.037e0) / (count(s2 - s1) + 10) AS off_s2,
(count(s3 - s1) * coalesce(avg(s3 - s1), 0.083e0) + 10 * 0.083e0) / (count(s3 - s1) + 10) AS off_s3 FROM {season} GROUP BY pid""")


@query("shrunk_offsets", "pid:i n_s2:i n_s3:i off_s2:f6 off_s3:f6", "SELECT * FROM {offsets}")
def _(t):
    return A.shrunk_offsets(t.season)


PAIRS = {"s2_s1": ("s2", "s1"), "s3_s1": ("s3", "s1"), "s3_s2": ("s3", "s2")}


@query("entity_bias", "pid:i year:i " + " ".join(f"{k}:f6 {k}_n:i {k}_y:f6 {k}_y_n:i" for k in PAIRS),
       "SELECT pid, year, " + ", ".join(
           f"{k}_y, {k}_y_n, sum({k}_s) OVER p / nullif(sum({k}_y_n) OVER p, 0) AS {k}, sum({k}_y_n) OVER p AS {k}_n" for k in PAIRS) +
       " FROM (SELECT pid, year, " + ", ".join(
           f"avg({a} - {b}) AS {k}_y, sum({a} - {b}) AS {k}_s, count({a} - {b}) AS {k}_y_n" for k, (a, b) in PAIRS.items()) +
       " FROM {panel} GROUP BY pid, year) WINDOW p AS (PARTITION BY pid)")
def _(t):
    return A.entity_bias(t.panel, {k: F.col(a) - F.col(b) for k, (a, b) in PAIRS.items()})


@query("norm_consistency", "keys_multi:i share_varying:f6", """SELECT count(*) AS keys_multi,
avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) AS share_varying FROM (SELECT pid, doy, count(*) AS n,
count(DISTINCT round(norm_mean + 1.234567e-10, 6)) AS k FROM {loyo} WHERE norm_n > 0 GROUP BY ALL) WHERE n > 1""")
def _(t):
    per = (loyo_norm(t.season).filter("norm_n > 0").groupBy("pid", "doy")
           .agg(F.count("*").alias("n"), F.count_distinct(E.rnd("norm_mean")).alias("k")).filter("n > 1"))
    return per.agg(F.count("*").alias("keys_multi"), A.share(F.col("k") > 1).alias("share_varying"))


@query("gap_year_stats", "year:i n_gap:i masked_share:f6 known_share:f6", """SELECT year, count(*) FILTER (is_gap) AS n_gap,
count(*) FILTER (is_gap) / CAST(count(*) FILTER (is_gap OR s1 IS NOT NULL) AS DOUBLE) AS masked_share,
count(*) FILTER (NOT is_gap AND s1 IS NOT NULL) / CAST(count(*) AS DOUBLE) AS known_share FROM {marked} GROUP BY year""")
def _(t):
    gap, known = F.count(F.when(F.col("is_gap"), 1)), F.count(F.when(~F.col("is_gap") & F.col("s1").isNotNull(), 1))
    return t.marked.groupBy("year").agg(gap.alias("n_gap"), (gap / (gap + known)).alias("masked_share"),
                                        (known / F.count("*")).alias("known_share"))


@query("ks_statistic", "ks:f6 n_a:i n_b:i", """SELECT max(abs(fa - fb)) AS ks, max(na) AS n_a, max(nb) AS n_b FROM (
SELECT sum(sum(a)) OVER (ORDER BY v) / CAST(sum(sum(a)) OVER () AS DOUBLE) AS fa,
 sum(sum(b)) OVER (ORDER BY v) / CAST(sum(sum(b)) OVER () AS DOUBLE) AS fb, sum(sum(a)) OVER () AS na, sum(sum(b)) OVER () AS nb
FROM (SELECT value AS v, 1 AS a, 0 AS b FROM {panel} WHERE source = 0 UNION ALL
      SELECT value, 0, 1 FROM {panel} WHERE source = 1) GROUP BY v)""")
def _(t):
    return ks_statistic(t.panel.filter("source = 0"), t.panel.filter("source = 1"), "value")


@query("short_ids", "pid:i name:s id:s", "SELECT s_suppkey AS pid, s_name AS name, substr(sha256(concat_ws('|', s_suppkey, s_name)), 1, 12) AS id FROM supplier")
def _(t):
    return t.read("supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_name").alias("name"), E.short_id("s_suppkey", "s_name").alias("id"))


@query("entity_kind", "pid:i n_years:i kind:s", """SELECT pid, count(DISTINCT year) AS n_years,
CASE WHEN bool_or(s1 > 0.99 AND year < 1997) THEN 'old' WHEN count(DISTINCT year) <= 1 THEN 'new_single' ELSE 'new_hist' END AS kind
FROM {panel} GROUP BY pid""")
def _(t):
    return A.entity_kind(t.panel, (F.col("s1") > 0.99) & (F.col("year") < 1997))


@query("fingerprint", "n:i hash:i", """SELECT count(*) AS n, sum(CAST(concat('0x', substr(md5(concat_ws('|', pid, date, source)), 1, 8))
AS BIGINT)) AS hash FROM {panel}""")
def _(t):
    return E.fingerprint(t.panel, ["pid", "date", "source"])


@query("data_audit", "n_rows:i n_entities:i known_s1:i known_s2:i known_s3:i n_duplicates:i outside:i",
       """SELECT count(*) AS n_rows, count(DISTINCT pid) AS n_entities, count(s1) AS known_s1, count(s2) AS known_s2,
count(s3) AS known_s3, (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM {panel} WHERE s1 IS NOT NULL GROUP BY day, s1))
AS n_duplicates, count(*) FILTER (NOT value BETWEEN 0.3e0 AND 0.9e0) AS outside FROM {panel}""")
def _(t):
    p = t.panel
    return p.agg(F.count("*").alias("n_rows"), F.count_distinct("pid").alias("n_entities"),
                 *[F.count(s).alias(f"known_{s}") for s in ("s1", "s2", "s3")],
                 F.count(F.when(~F.col("value").between(0.3, 0.9), 1)).alias("outside")).withColumn(
        "n_duplicates", A.duplicates(p, ["day", "s1"]).scalar())


AUDIT_PROBS = {"q0": 0.0, "q001": 0.001, "q01": 0.01, "q50": 0.5, "q99": 0.99, "q999": 0.999, "q100": 1.0}


@query("audit_quantiles", "source:i n:i " + " ".join(f"{p}:f6" for p in AUDIT_PROBS), "SELECT source, count(value) AS n, " + ", ".join(
    f"quantile_cont(value, {v}) AS {k}" for k, v in AUDIT_PROBS.items()) + " FROM {panel} WHERE value IS NOT NULL GROUP BY GROUPING SETS ((source), ())")
def _(t):
    return A.target_quantiles(t.panel, AUDIT_PROBS)


cte("source_values", " UNION ALL ".join(f"SELECT pid, day, {i} AS source, s{i + 1} AS value FROM {{panel}} WHERE s{i + 1} IS NOT NULL" for i in range(3)))


@query("audit_duplicates", "source:i n_values:i n_distinct:i n_duplicates:i", """SELECT source, sum(c) AS n_values, count(*) AS n_distinct,
sum(c - 1) AS n_duplicates FROM (SELECT source, day, value, count(*) AS c FROM {source_values} GROUP BY ALL) GROUP BY source""")
def _(t):
    return A.duplicates_by_source(t.panel)


@query("audit_pairs", "source:i place:i a:i b:i n:i r:f6", """SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(r, 9) DESC, a, b) AS place
FROM (SELECT a.source, a.pid AS a, b.pid AS b, count(*) AS n, corr(a.value, b.value) AS r FROM {source_values} a JOIN {source_values} b
 ON a.source = b.source AND a.day = b.day AND a.pid < b.pid GROUP BY ALL HAVING count(*) >= 8) WHERE r IS NOT NULL AND NOT isnan(r) QUALIFY place <= 12""")
def _(t):
    """The most alike entities of each source, each on its own values, as a hint at copied series."""
    known = A.per_source(t.panel).select("pid", F.col("source").alias("part"), F.col("day").alias("key"), F.col("value").alias("v"))
    return pairs.best_pairs(known, 12, 8).withColumnRenamed("part", "source")


@query("weekly_drivers", "region:i year:i week:i amount:f6 level:f6", """
WITH w AS (SELECT region, year(date) AS year, least(greatest(floor((dayofyear(date) - 91) / 7.0), 0), 30) AS week,
  sum(greatest(precip, 0)) AS amount, avg(temp) AS level FROM {drivers} GROUP BY ALL)
SELECT g.region, g.year, g.week, amount, level FROM (SELECT DISTINCT region, year, unnest(range(0, 31)) AS week FROM w) g
LEFT JOIN w ON g.region = w.region AND g.year = w.year AND g.week = w.week""")
def _(t):
    d = t.drivers.withColumns({"year": F.year("date"), "doy": F.dayofyear("date")})
    return A.weekly_drivers(d, ["region"], ["year"], "precip", "temp")


@query("yearly_driver_corr", "n:i r_precip:f6 r_temp:f6", """SELECT count(*) AS n, corr(precip, z) AS r_precip, corr(temp, z) AS r_temp
FROM (SELECT year, avg(p) AS precip, avg(t) AS temp FROM (SELECT region, year(date) AS year, sum(precip) AS p, avg(temp) AS t
 FROM {drivers} GROUP BY ALL) GROUP BY year) JOIN (SELECT year, avg(z) AS z FROM {loyo} GROUP BY year) USING (year)""")
def _(t):
    per = t.drivers.groupBy("region", F.year("date").alias("year")).agg(F.sum("precip").alias("p"), F.avg("temp").alias("t"))
    yearly = per.groupBy("year").agg(F.avg("p").alias("precip"), F.avg("t").alias("temp"))
    z = loyo_norm(t.season).groupBy("year").agg(F.avg("z").alias("z"))
    return yearly.join(z, "year").agg(F.count("*").alias("n"), F.corr("precip", "z").alias("r_precip"),
                                      F.corr("temp", "z").alias("r_temp"))


@query("z_heatmap", "year:i month:i mean_z:f5 n:i", """SELECT year, month, avg(z) AS mean_z, count(z) AS n FROM {loyo} GROUP BY ALL""")
def _(t):
    return loyo_norm(t.season).groupBy("year", "month").agg(F.avg("z").alias("mean_z"), F.count("z").alias("n"))


@query("z_heatmap_entity", "pid:i year:i mean_z:f5", "SELECT pid, year, avg(z) AS mean_z FROM {loyo} GROUP BY ALL")
def _(t):
    return loyo_norm(t.season).groupBy("pid", "year").agg(F.avg("z").alias("mean_z"))


@query("bin_profile", "category:i bin:i mean:f6 std:f6", """SELECT category, floor(doy / 8.0) * 8 AS bin, avg(value) AS mean,
stddev_samp(value) AS std FROM {panel_cat} GROUP BY ALL""")
def _(t):
    return t.panel_cat.groupBy("category", E.bin_days(F.col("doy"), 8).alias("bin")).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


@query("z_by_source", "source:i mean_z:f5 n:i share:f6", """SELECT source, avg(z) AS mean_z, count(*) AS n,
avg(CASE WHEN z < -1 THEN 1.0 ELSE 0.0 END) AS share FROM {loyo} WHERE z IS NOT NULL GROUP BY source""")
def _(t):
    return loyo_norm(t.season).filter("z IS NOT NULL").groupBy("source").agg(
        F.avg("z").alias("mean_z"), F.count("*").alias("n"), A.share(F.col("z") < -1).alias("share"))


@query("flag_runs", "pid:i year:i longest:i isolated:i flagged:i", """
SELECT pid, year, max(n) AS longest, count(*) FILTER (n = 1) AS isolated, sum(n) AS flagged FROM (
 SELECT pid, year, g, count(*) FILTER (f) AS n FROM (SELECT pid, year, f, sum(CASE WHEN f AND NOT coalesce(pf, false) THEN 1 ELSE 0 END)
   OVER (PARTITION BY pid, year ORDER BY day) AS g FROM (SELECT *, coalesce(z < -1, false) AS f,
   lag(coalesce(z < -1, false)) OVER (PARTITION BY pid, year ORDER BY day) AS pf FROM {loyo})) WHERE f GROUP BY ALL)
GROUP BY pid, year""")
def _(t):
    e = frames.point_episodes(loyo_norm(t.season), F.col("z") < -1)
    per = e.groupBy("pid", "year", "episode").agg(F.count("*").alias("n"))
    return per.groupBy("pid", "year").agg(F.max("n").alias("longest"), F.count(F.when(F.col("n") == 1, 1)).alias("isolated"),
                                          F.sum("n").alias("flagged"))


@query("source_combos", "combo:s n:i", """SELECT concat(CAST(s1 IS NOT NULL AS INT), CAST(s2 IS NOT NULL AS INT),
CAST(s3 IS NOT NULL AS INT)) AS combo, count(*) AS n FROM {panel} GROUP BY 1""")
def _(t):
    combo = F.concat(*[F.col(s).isNotNull().cast("int").cast("string") for s in ("s1", "s2", "s3")])
    return t.panel.groupBy(combo.alias("combo")).agg(F.count("*").alias("n"))


@query("norm_search", "own_year_out:b window:i mean_abs_diff:f7 exact_share:f6", " UNION ALL ".join(
    f"""SELECT {out} AS own_year_out, {w} AS "window", avg(abs(m - norm_mean)) AS mean_abs_diff,
avg(CASE WHEN abs(m - norm_mean) <= 1e-6 THEN 1.0 WHEN m IS NOT NULL AND norm_mean IS NOT NULL THEN 0.0 END) AS exact_share
FROM (SELECT a.pid, a.day, any_value(a.norm_mean) AS norm_mean, avg(b.value) AS m FROM {{loyo}} a LEFT JOIN {{season}} b ON a.pid = b.pid
AND abs(a.doy - b.doy) <= {w} {"AND a.year <> b.year" if out == "true" else ""} GROUP BY a.pid, a.day)"""
    for w in (5, 8, 10) for out in ("true", "false")))
def _(t):
    d = loyo_norm(t.season)
    return norm_search(d.withColumnRenamed("norm_mean", "published"), F.col("published"), windows=(5, 8, 10))


@query("bin_norms", "bin:s mean_abs_diff:f7", " UNION ALL ".join(
    f"SELECT '{n}' AS bin, avg(abs(m - norm_mean)) AS mean_abs_diff FROM (SELECT norm_mean, avg(value) OVER (PARTITION BY pid, {e}) AS m FROM {{loyo}})"
    for n, e in (("b8", "floor(doy / 8.0)"), ("b16", "floor(doy / 16.0)"), ("m", "month"))))
def _(t):
    d = loyo_norm(t.season).withColumnRenamed("norm_mean", "published")
    bins = {"b8": E.bin_days(F.col("doy"), 8), "b16": E.bin_days(F.col("doy"), 16), "m": F.col("month")}
    return bin_norms(d, bins, F.col("published"))

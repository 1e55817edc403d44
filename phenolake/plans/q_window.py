"""Queries: windows W1..W19 and daily drivers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from phenolake.functions import expr as E
from phenolake.operators import drivers as D
from phenolake.operators import frames
from phenolake.operators.norms import loyo_norm
from phenolake.plans.ctes import cte
from phenolake.plans.registry import query


@query("natural_gaps", "year:i n:i median_gap:f6 share_gt15:f6 share_gt30:f6", """SELECT year, count(*) AS n, median(gap) AS median_gap,
avg(CASE WHEN gap > 15 THEN 1.0 ELSE 0.0 END) AS share_gt15, avg(CASE WHEN gap > 30 THEN 1.0 ELSE 0.0 END) AS share_gt30
FROM (SELECT year, day - lag(day) OVER (PARTITION BY pid, year ORDER BY day) AS gap FROM {season}) WHERE gap IS NOT NULL GROUP BY year""")
def _(t):
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("pid", "year").orderBy("day"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = F.col("gap")  # whole days within a season: few distinct values, so a plain median is small
    return (t.season.withColumn("gap", gap).filter("gap IS NOT NULL").groupBy("year")
            .agg(F.count("*").alias("n"), F.median(g).alias("median_gap"), share(g > 15).alias("share_gt15"),
                 share(g > 30).alias("share_gt30")))


@query("revisit_steps", "source:s step:i n:i share:f6", """SELECT source, step, count(*) AS n,
count(*) / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE) AS share FROM (""" + " UNION ALL ".join(
    f"SELECT '{s}' AS source, day - lag(day) OVER (PARTITION BY pid, year ORDER BY day) AS step FROM {{panel}} WHERE {s} IS NOT NULL"
    for s in ("s1", "s2", "s3")) + ") WHERE step IS NOT NULL GROUP BY source, step")
def _(t):
    steps = []
    for s in ("s1", "s2", "s3"):
        # the previous day with this source, read in one pass over the shared partitioning
        w = Window.partitionBy("pid", "year").orderBy("day").rowsBetween(frames.UNBOUNDED, -1)
        prev = F.last(F.when(F.col(s).isNotNull(), F.col("day")), ignorenulls=True).over(w)
        steps.append(F.when(F.col(s).isNotNull(), F.col("day") - prev).alias(s))
    d = t.panel.select(*steps).select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("source"), F.col(s).alias("step")) for s in ("s1", "s2", "s3")])).alias("r"))
    n = d.select("r.*").filter("step IS NOT NULL").groupBy("source", "step").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


cte("dr", "SELECT *, year(date) AS year, dayofyear(date) AS doy FROM {drivers}")
cte("rolled", """SELECT *, CASE WHEN count(temp) OVER w >= 5 THEN avg(temp) OVER w END AS temp30,
CASE WHEN count(precip) OVER w >= 5 THEN sum(precip) OVER w END AS precip30 FROM {dr}
WINDOW w AS (PARTITION BY region, year ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""")


def dr(t):
    return t.drivers.withColumns({"year": F.year("date"), "doy": F.dayofyear("date")})


@query("rolling_days", "region:i date:d temp30:f6 precip30:f6", "SELECT region, date, temp30, precip30 FROM {rolled}")
def _(t):
    k = ["region", "year"]
    return dr(t).withColumns({"temp30": frames.rolling("temp", F.avg, -29, 0, 5, k),
                              "precip30": frames.rolling("precip", F.sum, -29, 0, 5, k)})


cte("anoms", """SELECT *, temp30 - avg(temp30) OVER (PARTITION BY region, doy) AS temp30_anom,
precip30 - avg(precip30) OVER (PARTITION BY region, doy) AS precip30_anom FROM {rolled}""")


@query("rolling_anomaly", "region:i date:d temp30_anom:f6 precip30_anom:f6",
       "SELECT region, date, temp30_anom, precip30_anom FROM {anoms}")
def _(t):
    return D.rolling_anomaly(dr(t), ["region"], {"temp": F.avg, "precip": F.sum})


@query("row_driver_corr", "n:i r_precip:f6 r_temp:f6", """SELECT count(*) AS n, corr(precip30_anom, z) AS r_precip,
corr(temp30_anom, z) AS r_temp FROM {loyo} l JOIN supplier ON s_suppkey = pid
JOIN {anoms} a ON a.region = s_nationkey AND a.date = l.date WHERE z IS NOT NULL AND temp30_anom IS NOT NULL AND precip30_anom IS NOT NULL""")
def _(t):
    a = D.rolling_anomaly(dr(t), ["region"], {"temp": F.avg, "precip": F.sum}).select(
        F.col("region").alias("category"), "date", "temp30_anom", "precip30_anom")
    z = loyo_norm(t.season).join(t.categories, "pid").select("category", "date", "z")
    d = z.join(a, ["category", "date"]).filter("z IS NOT NULL AND temp30_anom IS NOT NULL AND precip30_anom IS NOT NULL")
    return d.agg(F.count("*").alias("n"), F.corr("precip30_anom", "z").alias("r_precip"), F.corr("temp30_anom", "z").alias("r_temp"))


cte("zpoints", """SELECT *, sum(CASE WHEN f AND NOT coalesce(pf, false) THEN 1 ELSE 0 END) OVER (PARTITION BY pid, year ORDER BY day)
AS episode FROM (SELECT *, z < -1 AS f, lag(z < -1) OVER (PARTITION BY pid, year ORDER BY day) AS pf FROM {loyo} WHERE z IS NOT NULL)""")
cte("zepisodes", """SELECT pid, year, episode, min(date) AS start, max(date) AS "end", count(*) AS n_points, min(z) AS min_z,
datediff('day', min(date), max(date)) + 1 AS days FROM {zpoints} WHERE f GROUP BY pid, year, episode""")
EPISODE = "pid:i year:i start:d end:d n_points:i min_z:f4 days:i"


def z_episodes(t):
    e = frames.point_episodes(loyo_norm(t.season).filter("z IS NOT NULL"), F.col("z") < -1)
    return (e.groupBy("pid", "year", "episode")
            .agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n_points"),
                 F.min("z").alias("min_z")).withColumn("days", F.datediff("end", "start") + 1))


@query("point_episodes", EPISODE, "SELECT * FROM {zepisodes}")
def _(t):
    return z_episodes(t)


@query("worst_point_episodes", EPISODE, "SELECT * FROM {zepisodes} ORDER BY n_points DESC, days DESC, min_z, pid, year, start LIMIT 20")
def _(t):
    return z_episodes(t).orderBy(F.desc("n_points"), F.desc("days"), "min_z", "pid", "year", "start").limit(20)


@query("episode_shares", "n_episodes:i n_flagged:i isolated_share:f6 single_share:f6 ge3_share:f6 days_median:f6", """SELECT
count(*) AS n_episodes, sum(n_points) AS n_flagged, count(*) FILTER (n_points = 1) / CAST(sum(n_points) AS DOUBLE) AS isolated_share,
avg(CASE WHEN n_points = 1 THEN 1.0 ELSE 0.0 END) AS single_share, avg(CASE WHEN n_points >= 3 THEN 1.0 ELSE 0.0 END) AS ge3_share,
median(days) AS days_median FROM {zepisodes}""")
def _(t):
    n = F.col("n_points")
    return z_episodes(t).agg(
        F.count("*").alias("n_episodes"), F.sum(n).alias("n_flagged"), (F.count(F.when(n == 1, 1)) / F.sum(n)).alias("isolated_share"),
        F.avg(F.when(n == 1, 1.0).otherwise(0.0)).alias("single_share"),
        F.avg(F.when(n >= 3, 1.0).otherwise(0.0)).alias("ge3_share"), F.median("days").alias("days_median"))


@query("islands", "pid:i start:i end:i n:i", """SELECT pid, min(day) AS start, max(day) AS "end", count(*) AS n FROM (
SELECT pid, day, sum(nw) OVER (PARTITION BY pid ORDER BY day) AS g FROM (SELECT pid, day,
CASE WHEN day - lag(day) OVER (PARTITION BY pid ORDER BY day) <= 6 THEN 0 ELSE 1 END AS nw FROM {panel} WHERE value < 0.5e0)) GROUP BY pid, g""")
def _(t):
    return frames.runs(t.panel.filter(F.col("value") < 0.5), ["pid"], gap=5)


@query("full_grid_flag", "pid:i date:d full_grid:b", "SELECT pid, date, count(*) OVER (PARTITION BY pid, year) >= 75 AS full_grid FROM {panel}")
def _(t):
    return t.panel.withColumn("full_grid", F.count("*").over(Window.partitionBy("pid", "year")) >= 75)


@query("smooth_seasonal", "year:i doy:i m:f6 smooth:f6", """SELECT year, doy, m, CASE WHEN count(m) OVER w >= 5 THEN avg(m) OVER w END AS smooth
FROM (SELECT year, doy, median(temp) AS m FROM {dr} GROUP BY ALL)
WINDOW w AS (PARTITION BY year ORDER BY doy RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
def _(t):
    return D.smooth_seasonal(dr(t), "temp")


cte("st", "SELECT *, year(date) AS year, dayofyear(date) AS doy FROM {stations}")


def st(t):
    return t.stations.withColumns({"year": F.year("date"), "doy": F.dayofyear("date")})


@query("strict_sum_30", "region:s date:d rain30:f6 balance:f6", """SELECT region, date, CASE WHEN count(rain) OVER w = 30 THEN sum(rain) OVER w END AS rain30,
CASE WHEN count(rain - et0) OVER w = 30 THEN sum(rain - et0) OVER w END AS balance FROM {stations}
WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(t):
    return t.stations.withColumns({"rain30": frames.strict_sum(F.col("rain"), 30, ["region"]),
                                   "balance": frames.strict_sum(F.col("rain") - F.col("et0"), 30, ["region"])})


@query("gdd", "region:s date:d corn:f6 sunflower:f6 custom:f6 corn_sum:f6", """
WITH g AS (SELECT *, greatest((greatest(10, least(30, tmin)) + greatest(10, least(30, tmax))) / 2 - 10, 0) AS corn,
 greatest((tmin + tmax) / 2 - 20e0 / 3, 0) AS sunflower, greatest((tmin + tmax) / 2 - 10, 0) AS custom,
 datediff('day', DATE '2000-01-01', make_date(year, 4, 1)) AS start FROM {st})
SELECT region, date, corn, sunflower, custom, CASE WHEN count(*) OVER w = day - start + 1 THEN sum(corn) OVER w END AS corn_sum
FROM g WHERE day >= start WINDOW w AS (PARTITION BY region, year ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def _(t):
    start = D.season_start(F.col("year"))
    d = st(t).filter(F.col("day") >= start)
    heat = {p: D.gdd(F.col("tmin"), F.col("tmax"), p, 10.0) for p in ("corn", "sunflower", "custom")}
    return d.withColumns(heat).withColumn("corn_sum", frames.cumulative_strict(F.col("corn"), start, ["region", "year"]))


@query("cumulative_strict", "region:s date:d heat:f6", """SELECT region, date, CASE WHEN count(*) OVER w = day - start + 1
THEN sum(greatest(temp - 10, 0)) OVER w END AS heat FROM (SELECT *, datediff('day', DATE '2000-01-01', make_date(year, 4, 1)) AS start FROM {st})
WHERE day >= start AND day < start + 213 WINDOW w AS (PARTITION BY region, year ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def _(t):
    start = D.season_start(F.col("year"))
    d = st(t).filter((F.col("day") >= start) & (F.col("day") < start + 213))
    return d.withColumn("heat", frames.cumulative_strict(F.greatest(F.col("temp") - 10, F.lit(0.0)), start, ["region", "year"]))


@query("longest_run", "region:s year:i days:i start:i end:i available:b complete:b", """
WITH s AS (SELECT *, datediff('day', DATE '2000-01-01', make_date(year, 4, 1)) AS s0 FROM {st}),
d AS (SELECT * FROM s WHERE day >= s0 AND day < s0 + 213),
r AS (SELECT region, year, min(day) AS start, max(day) AS "end", count(*) AS n FROM (SELECT *, day - row_number() OVER
 (PARTITION BY region, year ORDER BY day) AS g FROM d WHERE rain < 4) GROUP BY region, year, g),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY region, year ORDER BY n DESC, start) = 1)
SELECT k.region, k.year, coalesce(n, 0) AS days, start, "end", known > 0 AS available, known = 213 AS complete
FROM (SELECT region, year, count(rain) AS known FROM d GROUP BY ALL) k LEFT JOIN b ON b.region = k.region AND b.year = k.year""")
def _(t):
    return D.dry_spell(st(t), "rain", below=4.0)


cte("grid_drivers", """SELECT g.region, g.day, DATE '2000-01-01' + CAST(g.day AS INTEGER) AS date, d.precip, d.temp FROM (SELECT region, unnest(range(min(day), max(day) + 1)) AS day
FROM {drivers} GROUP BY region) g LEFT JOIN {drivers} d ON d.region = g.region AND d.day = g.day""")
cte("filled", """SELECT region, day, date, coalesce(precip, 0) AS precip, coalesce(temp, CASE WHEN day - pd <= 3 AND nd IS NOT NULL
THEN pt + (nt - pt) * (day - pd) / (nd - pd) END) AS temp FROM (SELECT *,
last_value(CASE WHEN temp IS NOT NULL THEN day END IGNORE NULLS) OVER b AS pd, last_value(temp IGNORE NULLS) OVER b AS pt,
first_value(CASE WHEN temp IS NOT NULL THEN day END IGNORE NULLS) OVER a AS nd, first_value(temp IGNORE NULLS) OVER a AS nt
FROM {grid_drivers} WINDOW b AS (PARTITION BY region ORDER BY day ROWS UNBOUNDED PRECEDING),
a AS (PARTITION BY region ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")


def filled(t):
    """Daily grid of the order drivers: days without orders have amount 0, the level is filled for up to 3 days."""
    grid = frames.densify(t.drivers, ["region"], ["precip", "temp"]).fillna(0.0, ["precip"])
    return D.with_calendar(frames.interpolate_inside(grid, ["region"], ["temp"], 3))


@query("interpolate_inside", "region:i date:d precip:f6 temp:f6", "SELECT region, date, precip, temp FROM {filled}")
def _(t):
    return filled(t)


WINDOWS = ("amount_pm1", "amount_7", "amount_30", "level_7", "level_30")


@query("driver_windows", "region:i date:d " + " ".join(f"{c}:f6" for c in WINDOWS), "SELECT region, date, " + ", ".join(
    f"CASE WHEN count({c}) OVER (PARTITION BY region ORDER BY day RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) >= {m} "
    f"THEN {f}({c}) OVER (PARTITION BY region ORDER BY day RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) END AS {n}"
    for n, c, f, lo, hi, m in zip(WINDOWS, ("precip", "precip", "precip", "temp", "temp"), ("sum", "sum", "sum", "avg", "avg"),
                                  (1, 6, 29, 6, 29), (1, 0, 0, 0, 0), (2, 4, 20, 4, 20))) + " FROM {filled}")
def _(t):
    return D.driver_windows(filled(t), ["region"], "precip", "temp")


cte("harm", "SELECT *, value - CASE source WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.037e0 ELSE 0.083e0 END AS h FROM {marked}")
FB = {"fwd": ("CURRENT ROW", "15 FOLLOWING"), "bwd": ("15 PRECEDING", "CURRENT ROW")}


def composite_windows(df, keys, context, value, days: int = 15):
    """Mean, count and maximum of the context rows in the days after and before each row."""
    out = {}
    for name, lo, hi in (("fwd", 0, days), ("bwd", -days, 0)):
        w = Window.partitionBy(*keys).orderBy("day").rangeBetween(lo, hi)
        v = F.when(context, value)
        out |= {f"{name}_mean": F.avg(v).over(w), f"{name}_n": F.count(v).over(w), f"{name}_max": F.max(v).over(w)}
    return df.withColumns(out)


@query("window_stats_fwd_bwd", "pid:i date:d " + " ".join(f"{n}_mean:f6 {n}_n:i {n}_max:f6" for n in FB),
       "SELECT pid, date, " + ", ".join(
           f"{f}(h) FILTER (NOT is_gap AND source <> 2) OVER (PARTITION BY pid ORDER BY day RANGE BETWEEN {a} AND {b}) AS {n}_{s}"
           for n, (a, b) in FB.items() for f, s in (("avg", "mean"), ("count", "n"), ("max", "max"))) + " FROM {harm} QUALIFY is_gap")
def _(t):
    h = F.col("value") - E.source_offset(F.col("source"))
    return composite_windows(t.marked, ["pid"], ~F.col("is_gap") & (F.col("source") != 2), h).filter("is_gap")


@query("window_median", "pid:i date:d m16:f6 m40:f6", "SELECT pid, date, " + ", ".join(
    f"quantile_cont(s1, 0.5) FILTER (NOT is_gap AND s1 IS NOT NULL) OVER (PARTITION BY pid ORDER BY day RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS m{w}"
    for w in (16, 40)) + " FROM {marked} QUALIFY is_gap")
def _(t):
    v = F.when(~F.col("is_gap"), F.col("s1"))
    return t.marked.withColumns({f"m{w}": F.percentile(v, F.lit(0.5)).over(frames.around(["pid"], w)) for w in (16, 40)}).filter("is_gap")


@query("thin", "pid:i date:d value:f9", """SELECT pid, date, value FROM (SELECT *, row_number() OVER (PARTITION BY pid, year ORDER BY day) - 1 AS j,
count(*) OVER (PARTITION BY pid, year) AS n FROM {season}) WHERE n <= 40 OR j = n - 1 OR 
list_contains([CAST(floor(i * n / 40.0) AS BIGINT) FOR i IN range(0, 39)], j)""")
def _(t):
    return frames.thin(t.season, ["pid", "year"], ["day"], 40)


@query("compare_with_history", "region:s date:d n_years:i mean:f6 p10:f6 p90:f6", """SELECT a.region, a.date, count(b.temp) AS n_years,
CASE WHEN count(b.temp) >= 3 THEN avg(b.temp) END AS mean, CASE WHEN count(b.temp) >= 3 THEN quantile_cont(b.temp, 0.1) END AS p10,
CASE WHEN count(b.temp) >= 3 THEN quantile_cont(b.temp, 0.9) END AS p90 FROM {st} a LEFT JOIN {st} b ON a.region = b.region
AND month(a.date) = month(b.date) AND day(a.date) = day(b.date) AND b.year < a.year AND b.year >= a.year - 30 GROUP BY a.region, a.date""")
def _(t):
    return D.compare_with_history(st(t), ["region"], "temp")


@query("regional_drivers", "day:i precip:f6 temp:f6", """SELECT day, median(precip) AS precip, median(temp) AS temp FROM {drivers} GROUP BY day""")
def _(t):
    return D.regional_drivers(t.drivers, ["precip", "temp"])


@query("daily_drivers", "pid:i n_days:i level:f6 origin:s", """WITH n AS (SELECT region, count(*) AS c FROM {drivers} GROUP BY region),
own AS (SELECT region AS pid, day, temp FROM {drivers} WHERE region IN (SELECT region FROM n WHERE c >= (SELECT avg(c) FROM n))),
ent AS (SELECT DISTINCT n_nationkey AS pid FROM nation),
f AS (SELECT day, median(temp) AS temp FROM own GROUP BY day)
SELECT pid, count(*) AS n_days, avg(temp) AS level, 'own' AS origin FROM own GROUP BY pid UNION ALL
SELECT pid, count(*), avg(temp), 'region' FROM ent CROSS JOIN f WHERE pid NOT IN (SELECT pid FROM own) GROUP BY pid""")
def _(t):
    """Entities with fewer driver days than the average one fall back to the regional series."""
    n = t.drivers.groupBy("region").agg(F.count("*").alias("c"))
    dense = n.filter(F.col("c") >= n.agg(F.avg("c")).scalar())
    own = t.drivers.join(dense.select("region"), "region", "left_semi").withColumnRenamed("region", "pid")
    ent = t.read("nation").select(F.col("n_nationkey").alias("pid"))
    mapping, series = D.with_fallback(ent, own, D.regional_drivers(own, ["temp"]), "pid", ["temp"])
    facts = series.groupBy("driver_key").agg(F.count("*").alias("n_days"), F.avg("temp").alias("level"))
    return mapping.join(facts, "driver_key")

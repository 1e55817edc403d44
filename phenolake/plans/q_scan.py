"""Queries: scans and sinks, projections and predicates, sorts, set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolake.functions import expr as E
from phenolake.operators import frames, sampling
from phenolake.operators.norms import loyo_norm
from phenolake.plans.ctes import cte
from phenolake.plans.registry import query
from phenolake.sources import io

# ---------------------------------------------------------------- sources and sinks
PANEL = "pid:i date:d s1:f9 s2:f9 s3:f9"
PANEL_SQL = "SELECT pid, date, s1, s2, s3 FROM {panel}"


@query("read_panel_csv", PANEL, PANEL_SQL)
def _(t):
    path = io.shared_dir(t.spark)
    t.panel.select("pid", "date", "s1", "s2", "s3").write.option("header", True).csv(path)
    return io.read_panel_csv(t.spark, path)


@query("write_parquet", PANEL, PANEL_SQL)
def _(t):
    base = io.shared_dir(t.spark)
    d = t.panel.select("pid", "date", "s1", "s2", "s3")
    return io.write_parquet(d, io.keyed_path(base, d, ["pid", "date"]))


cte("files", """SELECT l_linestatus AS file, l_suppkey AS pid, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
  max(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3""")


def files(t):
    return (t.read("lineitem").groupBy(F.col("l_linestatus").alias("file"), F.col("l_suppkey").alias("pid"),
                                       F.to_date("l_shipdate").alias("date"))
            .agg(F.count("*").alias("n"), F.max("l_quantity").alias("q")))


@query("load_sources", "pid:i date:d n:i q:f6 split:s",
       """SELECT pid, date, n, q, CASE file WHEN 'F' THEN 'train' ELSE 'test' END AS split FROM {files}
       QUALIFY row_number() OVER (PARTITION BY pid, date ORDER BY file) = 1""")
def _(t):
    f = files(t)
    return io.load_sources([(f.filter("file = 'F'").drop("file"), "train"), (f.filter("file = 'O'").drop("file"), "test"),
                            (None, "extra")], ["pid", "date"])


@query("split_panel", "part:s n:i days:i total:f6", """
SELECT 'obs' AS part, count(*) AS n, sum(day) AS days, sum(value) AS total FROM {marked} WHERE NOT is_gap
UNION ALL SELECT 'grid', count(*), sum(day), sum(value) FROM {marked}
UNION ALL SELECT 'gaps', count(*), sum(day), sum(value) FROM {marked} WHERE is_gap""")
def _(t):
    # one pass: each part's sums over the rows that ``split_panel`` gives it
    obs, gap = F.col("value").isNotNull() & ~F.col("is_gap"), F.col("is_gap")
    one = lambda name, c: F.struct(
        F.lit(name).alias("part"), F.count(F.when(c, 1)).alias("n"), F.sum(F.when(c, F.col("day"))).alias("days"),
        F.sum(F.when(c, F.col("value"))).alias("total")).alias(name)
    sums = t.marked.agg(one("obs", obs), one("grid", F.lit(True)), one("gaps", gap))
    return sums.select(F.explode(F.array("obs", "grid", "gaps")).alias("r")).select("r.*")


@query("weather_rows", "region:s date:d rain:f6 temp:f6", "SELECT region, date, rain, temp FROM {stations}")
def _(t):
    day = F.array_sort(F.collect_list(F.struct("date", "rain", "temp")))
    docs = t.stations.groupBy("region", F.year("date").alias("y")).agg(day.alias("d")).select(
        "region", F.to_json(F.struct(F.col("d.date").cast("array<string>").alias("time"),
                                     F.col("d.rain").alias("precipitation_sum"),
                                     F.col("d.temp").alias("temperature_mean"))).alias("doc"))
    return io.weather_rows(docs, ["region"], "doc", {"precipitation_sum": "rain", "temperature_mean": "temp"})


def _year_maps(t):
    day = F.array_sort(F.collect_list(F.struct("date", "temp", "rain")))
    per_year = t.stations.groupBy("region", F.year("date").alias("year")).agg(day.alias("d"))
    entry = F.struct("year", F.struct(F.col("d.date").alias("date"), F.col("d.temp").alias("temp"),
                                      F.col("d.rain").alias("precip")))
    return per_year.groupBy("region").agg(F.map_from_entries(F.collect_list(entry)).alias("years"))


@query("unnest_year_arrays", "region:s year:i date:d temp:f6 precip:f6",
       "SELECT region, year(date) AS year, date, temp, rain AS precip FROM {stations}")
def _(t):
    return io.unnest_year_arrays(_year_maps(t), ["region"], "years", ["date", "temp", "precip"])


@query("read_reports", "pid:i n_obs:i years:s",
       """SELECT pid, count(*) AS n_obs, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR))
       AS years FROM {panel} GROUP BY pid""")
def _(t):
    path = io.shared_dir(t.spark)
    (t.panel.groupBy("pid").agg(F.count("*").alias("n_obs"), F.array_sort(F.collect_set("year")).alias("years"))
     .write.json(path))
    schema = T.StructType([T.StructField("pid", T.LongType()), T.StructField("n_obs", T.LongType()),
                           T.StructField("years", T.ArrayType(T.IntegerType()))])
    d = io.read_reports(t.spark, path, schema, multi_line=False)
    return d.withColumn("years", F.concat_ws(",", F.col("years").cast("array<string>")))


cte("holdouts", """SELECT label, pid, date, value FROM (SELECT label, p.*, row_number() OVER (PARTITION BY label ORDER BY
  md5(concat_ws('|', label, pid, date))) AS r, count(*) OVER (PARTITION BY label) AS n
  FROM {panel} p CROSS JOIN (VALUES ('777'), ('999'), ('2026')) s(label)) WHERE r <= round(n * 0.15)""")


def holdouts(t, columns=("pid", "date", "value")):
    """Rows hidden by each of three seeds: the seed is a column and part of the key, so one plan serves all of them."""
    d = t.panel.withColumn("label", F.explode(F.array(*map(F.lit, ("777", "999", "2026")))))
    d = sampling.exact_share(d, ["label", "pid", "date"], 0.15, None, "is_held", ["label"])
    return d.filter("is_held").select(*columns, "label")


@query("read_holdouts", "label:s n:i total:f6",
       "SELECT label, count(*) AS n, sum(value) AS total FROM {holdouts} GROUP BY label")
def _(t):
    path = io.shared_dir(t.spark)
    holdouts(t, ("pid", "date", "value", "s1")).withColumn("file", F.concat(F.lit("holdout_"), "label")).drop("label") \
        .write.partitionBy("file").option("header", True).csv(path)
    schema = T.StructType([T.StructField("pid", T.LongType()), T.StructField("date", T.DateType()),
                           T.StructField("value", T.DoubleType()), T.StructField("s1", T.DoubleType())])
    d = io.read_holdouts(t.spark, path, schema, ["pid", "date", "value"], r"holdout_(\d+)")
    return d.groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("write_predictions", "n_rows:i n_gaps:i n_duplicates:i n_not_finite:i n_missing:i n_unexpected:i", """
SELECT sum(n) AS n_rows, count(g) AS n_gaps, sum(n - 1) AS n_duplicates, sum(bad) AS n_not_finite,
  count(*) FILTER (n IS NULL) AS n_missing, count(*) FILTER (g IS NULL) AS n_unexpected
FROM (SELECT l_suppkey AS pid, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
      count(*) FILTER (l_discount = 0) AS bad FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2) p
FULL JOIN (SELECT pid, date, 1 AS g FROM {targets}) g USING (pid, date)""")
def _(t):
    pred = t.read("lineitem").filter("l_returnflag <> 'R'").select(
        F.col("l_suppkey").alias("pid"), F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("pred"))
    return io.prediction_violations(pred, t.targets)


@query("write_summary", "n_entities:i n_rows:i first_day:i last_day:i",
       "SELECT count(DISTINCT pid) AS n_entities, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day FROM {panel}")
def _(t):
    path = io.shared_dir(t.spark)
    io.write_summary(t.panel.agg(F.count_distinct("pid").alias("n_entities"), F.count("*").alias("n_rows"),
                                 F.min("day").alias("first_day"), F.max("day").alias("last_day")), path)
    return t.spark.read.text(path).select(F.from_json(
        "value", "n_entities long, n_rows long, first_day long, last_day long").alias("j")).select("j.*")


@query("source_coverage", "source:i first_year:i last_year:i n:i missing:s", """
SELECT source, min(year) AS first_year, max(year) AS last_year, count(*) AS n,
  coalesce((SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM range(1990, 2004) r(y)
    WHERE y NOT IN (SELECT year FROM {panel} p2 WHERE p2.source = p.source)), '') AS missing
FROM {panel} p GROUP BY source""")
def _(t):
    return io.source_coverage(t.panel, "source", "year", 1990, 2003)


@query("row_counts", "table_name:s n:i", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("lineitem", "orders", "supplier", "events")))
def _(t):
    return io.row_counts({n: t.read(n) for n in ("lineitem", "orders", "supplier", "events")})


# ---------------------------------------------------------------- projections and predicates
@query("add_calendar", "pid:i date:d year:i doy:i month:i", "SELECT pid, date, year, doy, month FROM {panel}")
def _(t):
    return E.add_calendar(t.daily)


@query("day_num", "pid:i date:d day:i", "SELECT pid, date, day FROM {panel}")
def _(t):
    return t.daily.withColumn("day", E.day_num("date"))


FLAG_TEXT = """CASE o_orderpriority WHEN '1-URGENT' THEN 'TRUE' WHEN '2-HIGH' THEN 'True' WHEN '3-MEDIUM' THEN 'false'
  WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'x' END"""


@query("parse_flag", "o_orderkey:i flag:b",
       f"SELECT o_orderkey, coalesce(lower({FLAG_TEXT}) = 'true', false) AS flag FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", E.parse_flag(F.expr(FLAG_TEXT)).alias("flag"))


@query("encode", "o_orderkey:i code:i", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH'
THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE -1 END AS code FROM orders""")
def _(t):
    codes = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
    return t.read("orders").select("o_orderkey", E.encode(F.col("o_orderpriority"), codes).alias("code"))


@query("clip_cols", "pid:i date:d s1:f9 s2:f9", """SELECT pid, date, CASE WHEN s1 IS NOT NULL THEN greatest(0.3, least(0.8, s1))
END AS s1, CASE WHEN s2 IS NOT NULL THEN greatest(0.3, least(0.8, s2)) END AS s2 FROM {panel}""")
def _(t):
    return t.panel.select("pid", "date", *[E.clip(F.col(c), 0.3, 0.8).alias(c) for c in ("s1", "s2")])


@query("source_of", "pid:i date:d source:i label:s",
       "SELECT pid, date, source, CASE source WHEN 0 THEN 's1' WHEN 1 THEN 's2' WHEN 2 THEN 's3' ELSE 'none' END AS label FROM {panel}")
def _(t):
    return t.daily.select("pid", "date", E.source_code().alias("source"), E.source_label(E.source_code()).alias("label"))


@query("coalesce_value", "pid:i date:d value:f9", "SELECT pid, date, value FROM {panel}")
def _(t):
    return t.daily.select("pid", "date", F.coalesce("s1", "s2", "s3").alias("value"))


@query("source_index", "pid:i date:d idx:f9",
       "SELECT pid, date, CASE source WHEN 0 THEN x1 WHEN 1 THEN x2 END AS idx FROM {panel}")
def _(t):
    return t.panel.select("pid", "date", source_index().alias("idx"))


def source_index():
    return F.when(F.col("source") == 0, F.col("x1")).when(F.col("source") == 1, F.col("x2"))


@query("in_season", "pid:i date:d", "SELECT pid, date FROM {panel} WHERE doy BETWEEN 91 AND 304")
def _(t):
    return t.panel.filter(E.in_season(F.col("doy")))


cte("loyo", """SELECT *, CASE WHEN norm_std > 0 THEN (value - norm_mean) / norm_std END AS z FROM (
SELECT a.*, count(b.value) AS norm_n, avg(b.value) AS norm_mean,
  CASE WHEN count(b.value) = 0 THEN NULL WHEN stddev_pop(b.value) < 1e-6 THEN 0.0 ELSE stddev_pop(b.value) END AS norm_std,
  count(DISTINCT b.year) AS norm_years
FROM {season} a LEFT JOIN {season} b ON a.pid = b.pid AND b.doy BETWEEN a.doy - 8 AND a.doy + 8 AND a.year <> b.year
GROUP BY ALL)""")
cte("statused", """SELECT *, CASE WHEN z < -2 THEN 'critical' WHEN z < -1 THEN 'depressed' WHEN z IS NOT NULL THEN 'normal' END
AS status FROM {loyo}""")


@query("status_from_z", "pid:i date:d status:s status_filled:s",
       "SELECT pid, date, status, coalesce(status, 'normal') AS status_filled FROM {statused}")
def _(t):
    d = loyo_norm(t.season)
    return d.withColumns({"status": E.status_from_z(F.col("z")),
                          "status_filled": E.status_from_z(F.col("z"), null_as_normal=True)})


@query("phase_of", "pid:i date:d phase:s", """SELECT pid, date, CASE WHEN doy BETWEEN 91 AND 135 THEN 'spring'
WHEN doy BETWEEN 136 AND 175 THEN 'peak' WHEN doy BETWEEN 176 AND 220 THEN 'ripening' WHEN doy BETWEEN 221 AND 260
THEN 'after_harvest' WHEN doy BETWEEN 261 AND 304 THEN 'autumn' ELSE 'out_of_season' END AS phase FROM {panel}""")
def _(t):
    return t.panel.withColumn("phase", E.phase_of(F.col("doy")))


@query("bin_week", "pid:i date:d week:i", "SELECT pid, date, floor((doy - 91) / 7.0) AS week FROM {season}")
def _(t):
    return t.season.withColumn("week", E.bin_week(F.col("doy")))


@query("bin_days", "pid:i date:d b8:i b10:i", "SELECT pid, date, floor(doy / 8.0) * 8 AS b8, floor(doy / 10.0) * 10 AS b10 FROM {panel}")
def _(t):
    return t.panel.withColumns({"b8": E.bin_days(F.col("doy"), 8), "b10": E.bin_days(F.col("doy"), 10)})


@query("bin_edges", "l_orderkey:i l_linenumber:i dist:s z:s", """SELECT l_orderkey, l_linenumber,
CASE WHEN l_quantity > 0 AND l_quantity <= 3 THEN '1-3' WHEN l_quantity > 3 AND l_quantity <= 7 THEN '4-7'
 WHEN l_quantity > 7 AND l_quantity <= 15 THEN '8-15' WHEN l_quantity > 15 AND l_quantity <= 30 THEN '16-30'
 WHEN l_quantity > 30 THEN '>30' END AS dist,
CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 20 THEN 'mid'
 WHEN l_quantity >= 20 THEN 'high' END AS z FROM lineitem""")
def _(t):
    q = F.col("l_quantity")
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", E.bin_edges(q, DIST_EDGES, DIST_LABELS).alias("dist"),
        E.bin_edges(q, [0, 10, 20], ["low", "mid", "high"], right_closed=False).alias("z"))


DIST_EDGES, DIST_LABELS = [0, 3, 7, 15, 30], ["1-3", "4-7", "8-15", "16-30", ">30"]


@query("cycle_residue", "pid:i date:d r5:i r8:i r16:i on_grid:b", """SELECT pid, date, day % 5 AS r5, day % 8 AS r8,
day % 16 AS r16, (doy % 16 = 1) AS on_grid FROM (SELECT *, day FROM {panel})""".replace("day % ", "((day % 80) + 80) % "))
def _(t):
    d = F.col("day")
    return t.panel.withColumns({"r5": E.cycle_residue(d, 5), "r8": E.cycle_residue(d, 8),
                                "r16": E.cycle_residue(d, 16), "on_grid": E.on_fixed_grid(F.col("doy"))})


def hide(df, keys, cols, on=("pid", "date")):
    """NULLs ``cols`` of the rows whose key is in ``keys``."""
    marker = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    d = df.join(marker, list(on), "left")
    return d.withColumns({c: F.when(F.col("_hit").isNull(), F.col(c)) for c in cols}).drop("_hit")


@query("hide", "pid:i date:d s1:f9 s2:f9 s3:f9 value:f9", """SELECT pid, date, CASE WHEN NOT is_gap THEN s1 END AS s1,
CASE WHEN NOT is_gap THEN s2 END AS s2, CASE WHEN NOT is_gap THEN s3 END AS s3, CASE WHEN NOT is_gap THEN value END AS value
FROM {marked}""")
def _(t):
    return hide(t.panel, t.targets, ["s1", "s2", "s3", "value"])


def sanitize_weather(df, non_negative, tmin, tmax, cols):
    """Non-finite and negative amounts become NULL; a minimum above its maximum clears both."""
    d = df.withColumns({c: E.denan(F.col(c).cast("double")) for c in cols})
    d = d.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in non_negative})
    ok = F.coalesce(F.col(tmin) <= F.col(tmax), F.lit(True))
    return d.withColumns({tmin: F.when(ok, F.col(tmin)), tmax: F.when(ok, F.col(tmax))})


@query("sanitize_weather", "region:s date:d rain:f6 tmin:f6 tmax:f6", """SELECT region, date,
CASE WHEN rain - 3 >= 0 THEN rain - 3 END AS rain, CASE WHEN tmin * 10 <= tmax THEN tmin * 10 END AS tmin,
CASE WHEN tmin * 10 <= tmax THEN tmax END AS tmax FROM {stations}""")
def _(t):
    d = t.stations.withColumns({"rain": F.col("rain") - 3, "tmin": F.col("tmin") * 10})
    return sanitize_weather(d, ["rain"], "tmin", "tmax", ["rain", "tmin", "tmax"])


@query("audit_equal", "n:i share_s1:f6 share_mean:f6", """SELECT count(*) AS n,
avg(CASE WHEN abs(value - s1) <= 1e-9 THEN 1.0 ELSE 0.0 END) AS share_s1,
avg(CASE WHEN abs(value - (s1 + s2) / 2) <= 0.05 THEN 1.0 ELSE 0.0 END) AS share_mean FROM {panel}""")
def _(t):
    return t.panel.agg(F.count("*").alias("n"), E.audit_equal(F.col("value"), F.col("s1"), 1e-9).alias("share_s1"),
                       E.audit_equal(F.col("value"), (F.col("s1") + F.col("s2")) / 2, 0.05).alias("share_mean"))


@query("bbox_valid", "pid:i ok:b area_ha:f3", """SELECT s_suppkey AS pid, s >= -90 AND s < n AND n <= 90 AND w >= -180 AND w < e AND
e <= 180 AND (n - s) * (e - w) <= 0.25 AS ok, greatest((n - s) * (e - w) * 111.32e0 * 111.32e0 * cos(radians((s + n) / 2)), 0) * 100
AS area_ha FROM (SELECT s_suppkey, s_acctbal / 100 AS s, s_acctbal / 100 + s_nationkey / 100.0e0 AS n, s_acctbal / 60 AS w,
s_acctbal / 60 + 0.5e0 AS e FROM supplier)""")
def _(t):
    b = F.col("s_acctbal")
    s, n, w, e = b / 100, b / 100 + F.col("s_nationkey") / 100.0, b / 60, b / 60 + 0.5
    return t.read("supplier").select(F.col("s_suppkey").alias("pid"), E.bbox_valid(s, w, n, e).alias("ok"),
                                     E.bbox_area_ha(s, w, n, e).alias("area_ha"))


# ---------------------------------------------------------------- sorts, limits, samples
@query("sort_panel", "pid:i date:d value:f9", "SELECT pid, date, value FROM {panel}")
def _(t):
    return t.panel.orderBy("pid", "date")


@query("top_worst", "pid:i date:d value:f9", "SELECT pid, date, value FROM {panel} ORDER BY value, pid, date LIMIT 25")
def _(t):
    return t.panel.orderBy("value", "pid", "date").limit(25)


def clamped_page(df, order, limit: int, most: int = 100):
    """First ``limit`` rows (clamped to 1..most) with the total beside them; the total is a scalar subquery."""
    return (df.withColumn("total", df.agg(F.count("*")).scalar()).orderBy(*order).limit(max(1, min(limit, most))))


@query("clamped_page", "pid:i date:d value:f9 total:i", """SELECT pid, date, value, count(*) OVER () AS total FROM {panel}
ORDER BY value DESC, pid, date LIMIT 100""")
def _(t):
    return clamped_page(t.panel.select("pid", "date", "value"), [F.desc("value"), "pid", "date"], 500)


@query("exact_share", "pid:i date:d is_gap:b", "SELECT pid, date, is_gap FROM {marked}")
def _(t):
    return t.marked


@query("weighted_sample", "pid:i date:d", """SELECT pid, date FROM (SELECT pid, date,
-ln((CAST(concat('0x', substr(md5(concat_ws('|', 'w', pid, date)), 1, 12)) AS BIGINT) + 1) / 281474976710657e0)
  * count(*) OVER (PARTITION BY pid, year) AS k FROM {panel}) ORDER BY k, pid, date LIMIT 3000""")
def _(t):
    n = F.count("*").over(Window.partitionBy("pid", "year"))
    return sampling.weighted_sample(t.panel.withColumn("_n", n), ["pid", "date"], 1 / F.col("_n"), 3000, "w")


def folds(df, group: str, k: int, seed):
    """Fold of each group, balanced to one: position in hash order modulo k."""
    g = sampling.hash_rank(df.select(group).distinct(), [group], seed)
    return g.select(group, F.pmod(F.col("_rank") - 1, F.lit(k)).alias("fold"))


@query("folds", "pid:i fold:i", """SELECT pid, (row_number() OVER (ORDER BY md5(concat_ws('|', 'fold', pid))) - 1) % 5 AS fold
FROM (SELECT DISTINCT pid FROM {panel})""")
def _(t):
    return folds(t.panel, "pid", 5, "fold")


@query("holdout_groups", "pid:i held:b", """SELECT pid, row_number() OVER (ORDER BY md5(concat_ws('|', 'groups', pid)))
<= round(count(*) OVER () * 0.2) AS held FROM (SELECT DISTINCT pid FROM {panel})""")
def _(t):
    return sampling.exact_share(t.panel.select("pid").distinct(), ["pid"], 0.2, "groups", "held")


# ---------------------------------------------------------------- set operations
@query("union_splits", "split:s n:i q:f6", """SELECT split, count(*) AS n, sum(q) AS q FROM (
SELECT 'train' AS split, q FROM {files} WHERE file = 'F' UNION ALL SELECT 'test', q FROM {files} WHERE file = 'O' AND n < 2)
GROUP BY split""")
def _(t):
    f = files(t)
    both = (f.filter("file = 'F'").withColumn("split", F.lit("train"))
            .unionByName(f.filter("file = 'O' AND n < 2").withColumn("split", F.lit("test"))))
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum("q").alias("q"))


@query("first_wins", "user_id:i day:d event_id:i event_type:s", """SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1""")
def _(t):
    e = t.events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    return io.first_wins(e, ["user_id", "day"], F.struct("ts", "event_id"))


cte("ent_a", "SELECT DISTINCT l_suppkey AS pid FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.05")
cte("ent_b", "SELECT DISTINCT l_suppkey AS pid FROM lineitem WHERE l_quantity = 1 AND l_discount >= 0.05")


def _entities(t):
    li = t.read("lineitem").filter("l_discount >= 0.05").select(F.col("l_suppkey").alias("pid"), "l_quantity")
    return li.filter("l_quantity = 50").select("pid"), li.filter("l_quantity = 1").select("pid")


@query("entity_sets", "kind:s pid:i", """SELECT 'only_a' AS kind, pid FROM {ent_a} EXCEPT SELECT 'only_a', pid FROM {ent_b}
UNION ALL (SELECT 'only_b', pid FROM {ent_b} EXCEPT SELECT 'only_b', pid FROM {ent_a})
UNION ALL (SELECT 'both', pid FROM {ent_a} INTERSECT SELECT 'both', pid FROM {ent_b})""")
def _(t):
    a, b = _entities(t)
    kinds = {"only_a": a.subtract(b), "only_b": b.subtract(a), "both": a.intersect(b)}
    parts = [d.withColumn("kind", F.lit(k)) for k, d in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("union_entities", "pid:i store:s", """SELECT pid, min(store) AS store FROM (SELECT pid, 'a' AS store FROM {ent_a}
UNION ALL SELECT pid, 'b' FROM {ent_b}) GROUP BY pid""")
def _(t):
    a, b = _entities(t)
    both = a.withColumn("store", F.lit("a")).unionByName(b.withColumn("store", F.lit("b")))
    return both.groupBy("pid").agg(F.min("store").alias("store"))


@query("missing_days", "region:i day:i", """SELECT region, day FROM (SELECT region, unnest(range(lo, hi)) AS day FROM
(SELECT region, min(day) AS lo, max(day) AS hi FROM {drivers} GROUP BY region)) ANTI JOIN {drivers} USING (region, day)""")
def _(t):
    return frames.densify(t.drivers, ["region"], ["precip"]).filter("precip IS NULL")

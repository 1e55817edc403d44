"""Queries: pixel tables X1..X7 and the pixel expressions."""

from pyspark.sql import functions as F

from phenolake.functions import expr as E
from phenolake.operators import pixels as P
from phenolake.plans.ctes import cte
from phenolake.plans.registry import query

CLEAR_SQL = "(qa <> 0 AND (qa & 16) = 0 AND (qa & 32) = 0)"
BITS = (4, 5)


def clear():
    return E.qa_clear(F.col("qa"), BITS)


cte("px", f"""SELECT *, CASE WHEN clear AND nir >= 0 AND red >= 0 AND nir + red > 0 THEN (nir - red) / (nir + red) END AS ndvi,
CASE WHEN clear AND nir >= 0 AND swir >= 0 AND nir + swir > 0 THEN (nir - swir) / (nir + swir) END AS ndmi FROM (SELECT *, {CLEAR_SQL} AS clear FROM {{pixels}})""")


def px(t, keep=None):
    """Indexes of all pixels, or of the scenes in ``keep`` only: then bands are read for those."""
    raw = t.pixels if keep is None else t.pixels.join(keep, ["zone", "scene"], "left_semi")
    return P.index_of(raw.withColumn("clear", clear()), F.col("clear"))


@query("normalized_difference", "zone:i scene:d px:i ndvi:f6 ndmi:f6", "SELECT zone, scene, px, ndvi, ndmi FROM {px}")
def _(t):
    return px(t)


@query("qa_clear", "zone:i scene:d px:i clear:b all_bits:b refl:f6", """SELECT zone, scene, px, clear,
qa <> 0 AND (qa & 62) = 0 AS all_bits, qa * 0.0275e0 - 0.2e0 AS refl FROM {px}""")
def _(t):
    return t.pixels.withColumns({"clear": clear(), "all_bits": E.qa_clear(F.col("qa"), P.BAD_BITS), "refl": F.col("qa") * 0.0275 - 0.2})


@query("zonal_mean", "zone:i scene:d n_inside:i clear_share:f6 mean:f6", """SELECT zone, scene, n_inside, n_valid / CAST(n_inside AS DOUBLE) AS clear_share,
CASE WHEN n_inside >= 4 AND n_valid / CAST(n_inside AS DOUBLE) >= 0.6 THEN greatest(-1, least(1, m)) END AS mean FROM (SELECT zone, scene, count(*) AS n_inside,
count(*) FILTER (clear AND nir + red <> 0) AS n_valid, avg((nir - red) / nullif(nir + red, 0)) FILTER (clear) AS m FROM {px} GROUP BY zone, scene)""")
def _(t):
    return P.zonal_mean(t.pixels, "nir", "red", clear(), min_pixels=4)


@query("clear_scenes", "zone:i scene:d px:i ndvi:f6", """SELECT zone, scene, px, ndvi FROM {px} SEMI JOIN (SELECT zone, scene FROM {px} GROUP BY zone, scene
HAVING count(*) >= 4 AND avg(clear::INT) >= 0.6) USING (zone, scene)""")
def _(t):
    keep = P.clear_scenes(t.pixels.select("zone", "scene", "qa"), clear(), min_pixels=4).select("zone", "scene")
    return px(t, keep)


cte("stats", """SELECT zone, scene, round(avg(ndvi) + 1e-10, 4) AS mean, round(count(ndvi) / CAST(count(*) AS DOUBLE) + 1e-10, 4) AS clear_share,
round(count(ndvi) * 0.04e0 + 1e-10, 2) AS area_ha, count(ndvi) AS n_valid FROM {px} GROUP BY zone, scene""")


@query("scene_stats", "zone:i scene:d mean:f4 clear_share:f4 area_ha:f2", "SELECT * FROM {stats}")
def _(t):
    return P.scene_stats(px(t), "ndvi")


@query("scene_change", "zone:i scene:d prev:d n_common:i area_ha:f2 drop_area_ha:f2 drop_share:f4 clear_share:f4 mean:f4", """
WITH s AS (SELECT zone, scene, lag(scene) OVER (PARTITION BY zone ORDER BY scene) AS prev FROM (SELECT DISTINCT zone, scene FROM {px}))
SELECT n.zone, n.scene, s.prev, count(n.ndvi - o.ndvi) AS n_common, round(count(n.ndvi - o.ndvi) * 0.04e0 + 1e-10, 2) AS area_ha,
round(count(*) FILTER (n.ndvi - o.ndvi <= -0.1e0 + 1e-7) * 0.04e0 + 1e-10, 2) AS drop_area_ha,
round(count(*) FILTER (n.ndvi - o.ndvi <= -0.1e0 + 1e-7) / nullif(CAST(count(n.ndvi - o.ndvi) AS DOUBLE), 0) + 1e-10, 4) AS drop_share,
round(count(n.ndvi - o.ndvi) / CAST(count(*) AS DOUBLE) + 1e-10, 4) AS clear_share, round(avg(n.ndvi - o.ndvi) + 1e-10, 4) AS mean
FROM {px} n JOIN s ON s.zone = n.zone AND s.scene = n.scene AND s.prev IS NOT NULL LEFT JOIN {px} o ON o.zone = n.zone AND o.scene = s.prev AND o.px = n.px
GROUP BY n.zone, n.scene, s.prev""")
def _(t):
    return P.scene_change(px(t), "ndvi")


@query("best_scene", "zone:i period:i scene:d n_valid:i", """SELECT zone, year(scene) AS period, scene, n_valid FROM {stats}
QUALIFY row_number() OVER (PARTITION BY zone, year(scene) ORDER BY n_valid DESC, scene) = 1""")
def _(t):
    s = px(t).groupBy("zone", "scene").agg(F.count("ndvi").alias("n_valid"))
    return P.best_scene(s, F.year("scene"), "n_valid")


@query("monthly_index_norm", "zone:i month:i year:i value:f6 n_years:i mean:f6 low:f6 high:f6", """WITH y AS (SELECT zone, month(scene) AS month, year(scene) AS year, avg(m) AS value FROM (
SELECT zone, scene, avg(ndmi) AS m FROM {px} GROUP BY zone, scene) WHERE m IS NOT NULL GROUP BY ALL)
SELECT a.zone, a.month, a.year, any_value(a.value) AS value, count(b.value) AS n_years, CASE WHEN count(b.value) >= 3 THEN avg(b.value) END AS mean,
CASE WHEN count(b.value) >= 3 THEN quantile_cont(b.value, 0.1) END AS low, CASE WHEN count(b.value) >= 3 THEN quantile_cont(b.value, 0.9) END AS high
FROM y a LEFT JOIN y b ON a.zone = b.zone AND a.month = b.month AND b.year BETWEEN a.year - 10 AND a.year - 1 GROUP BY a.zone, a.month, a.year""")
def _(t):
    s = px(t).groupBy("zone", "scene").agg(F.avg("ndmi").alias("m"))
    return P.monthly_norm(s, "m")


@query("reliable_mean", "zone:i scene:d n:i mean:f6", """SELECT zone, scene, count(*) AS n, greatest(-1, least(1, avg(nir * 20 - 0.7e0))) AS mean FROM {px}
WHERE qa % 4 IN (0, 1) AND nir * 20 - 0.7e0 > -1 AND nir * 20 - 0.7e0 < 1 - 1e-9 GROUP BY zone, scene""")
def _(t):
    return P.reliable_mean(t.pixels.withColumn("q", F.col("qa") % 4), F.col("nir") * 20 - 0.7 + F.lit(0.0), "q")

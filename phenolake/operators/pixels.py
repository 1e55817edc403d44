"""Pixel tables by zone and scene: masks, zonal means, change, monthly norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.functions.expr import clip, normalized_difference, qa_clear

# --- fixed values ---
MIN_PIXELS, MIN_VALID_SHARE = 6, 0.6
BAD_BITS = (1, 2, 3, 4, 5)
PIXEL_HA = 0.04                # a 20 m pixel
DROP, DROP_EPS = -0.1, 1e-7


def clear_scenes(px: DataFrame, clear: Column, min_pixels: int = MIN_PIXELS, min_share: float = MIN_VALID_SHARE) -> DataFrame:
    """Scenes with enough clear pixels, from the flag column alone, so that band columns are read for these only."""
    g = px.groupBy("zone", "scene").agg(F.count("*").alias("n_inside"), F.avg(F.when(clear, 1.0).otherwise(0.0)).alias("clear_share"))
    return g.filter((F.col("n_inside") >= min_pixels) & (F.col("clear_share") >= min_share))


def zonal_mean(px: DataFrame, a: str, b: str, clear: Column, min_pixels: int = MIN_PIXELS, min_share: float = MIN_VALID_SHARE) -> DataFrame:
    """Mean index per zone and scene; NULL with too few pixels or too few valid ones."""
    num = F.col(a) + F.col(b)
    valid = clear & F.col(a).isNotNull() & F.col(b).isNotNull() & (num != 0)
    g = px.groupBy("zone", "scene").agg(F.count("*").alias("n_inside"), F.count(F.when(valid, 1)).alias("n_valid"),
                                        F.avg(F.when(valid, (F.col(a) - F.col(b)) / num)).alias("_m"))
    share = F.col("n_valid") / F.col("n_inside")
    ok = (F.col("n_inside") >= min_pixels) & (share >= min_share)
    return g.select("zone", "scene", "n_inside", share.alias("clear_share"), F.when(ok, clip(F.col("_m"), -1.0, 1.0)).alias("mean"))


def scene_stats(px: DataFrame, value: str) -> DataFrame:
    n = F.count(value)
    return px.groupBy("zone", "scene").agg(F.round(F.avg(value) + 1e-10, 4).alias("mean"), F.round(n / F.count("*") + 1e-10, 4).alias("clear_share"),
                                           F.round(n * PIXEL_HA + 1e-10, 2).alias("area_ha"))


def scene_change(px: DataFrame, value: str, total: int | None = None) -> DataFrame:
    """Drop against the zone's previous scene over pixels valid in both.

    The previous scene comes from the scene list, so a pixel missing in one scene is not compared across two.
    """
    scenes = px.select("zone", "scene").distinct().withColumn("prev", F.lag("scene").over(Window.partitionBy("zone").orderBy("scene")))
    now = px.join(scenes.filter("prev IS NOT NULL"), ["zone", "scene"]).select("zone", "scene", "prev", "px", F.col(value).alias("_v"))
    old = px.select("zone", F.col("scene").alias("prev"), "px", F.col(value).alias("_o"))
    d = now.join(old, ["zone", "prev", "px"], "left").withColumn("_d", F.col("_v") - F.col("_o"))
    n, low = F.count("_d"), F.count(F.when(F.col("_d") <= DROP + DROP_EPS, 1))
    area = F.lit(total) if total is not None else F.count("*")
    return d.groupBy("zone", "scene", "prev").agg(
        n.alias("n_common"), F.round(n * PIXEL_HA + 1e-10, 2).alias("area_ha"), F.round(low * PIXEL_HA + 1e-10, 2).alias("drop_area_ha"),
        F.round(F.try_divide(low, n) + 1e-10, 4).alias("drop_share"), F.round(n / area + 1e-10, 4).alias("clear_share"),
        F.round(F.avg("_d") + 1e-10, 4).alias("mean"))


def best_scene(scenes: DataFrame, period: Column, valid: str) -> DataFrame:
    """Scene with most valid pixels per zone and period; the earlier one on ties."""
    d = scenes.withColumn("period", period)
    rest = [c for c in scenes.columns if c != "zone"]
    best = F.max_by(F.struct(*rest), F.struct(F.col(valid), -F.unix_date("scene")))
    return d.groupBy("zone", "period").agg(best.alias("b")).select("zone", "period", "b.*")


def monthly_norm(scenes: DataFrame, value: str, back: int = 10) -> DataFrame:
    """Mean of yearly means of the same month over up to ``back`` earlier years with p10 and p90 (three years at least)."""
    y = scenes.filter(F.col(value).isNotNull()).groupBy("zone", F.month("scene").alias("month"), F.year("scene").alias("year")).agg(
        F.avg(value).alias("value"))
    w = Window.partitionBy("zone", "month").orderBy("year").rangeBetween(-back, -1)
    n = F.count("value").over(w)
    ok = n >= 3
    return y.withColumns({"n_years": n, "mean": F.when(ok, F.avg("value").over(w)), "low": F.when(ok, F.percentile("value", F.lit(0.1)).over(w)),
                          "high": F.when(ok, F.percentile("value", F.lit(0.9)).over(w))})


def reliable_mean(px: DataFrame, value: Column, quality: str, good=(0, 1)) -> DataFrame:
    """Mean of a finished product over pixels of reliable classes and physical values."""
    ok = F.col(quality).isin(*good) & (value > -1) & (value < 1)
    return px.filter(ok).groupBy("zone", "scene").agg(F.count("*").alias("n"), clip(F.avg(value), -1.0, 1.0).alias("mean"))


def index_of(px: DataFrame, clear: Column) -> DataFrame:
    return px.withColumns({"ndvi": normalized_difference(F.col("nir"), F.col("red"), clear), "ndmi": normalized_difference(F.col("nir"), F.col("swir"), clear)})


__all__ = ["clear_scenes", "zonal_mean", "scene_stats", "scene_change", "best_scene", "monthly_norm", "reliable_mean", "index_of", "qa_clear"]

"""Local linear kernel regression over whole days.

On a regular grid each known point adds its weighted terms to the fixed set of days it can reach and one aggregate per
(key, day) sums them: no range join and no pair list. At irregular rows a calendar range window brings the points in
reach to the row as an array, from which the sums are worked out: no row of a pair is made. Both run where the entity's rows already are.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.operators import frames

EPS = 1e-9


def kernel(d: Column, bw: float) -> Column:
    """Gaussian weight, zero beyond the cut-off."""
    return F.when(F.abs(d) <= C.KERNEL_CUTOFF * bw, F.exp(-0.5 * F.pow(d / bw, 2))).otherwise(0.0)


def sums(d: Column, y: Column, when: Column | None, bw: float, name: str) -> list[Column]:
    """The five weighted sums of one fit as aggregates; ``d`` is the point's day minus the evaluated day."""
    w = kernel(d, bw)
    w = F.when(y.isNotNull() if when is None else (when & y.isNotNull()), w).otherwise(0.0)
    y0 = F.coalesce(y, F.lit(0.0))
    d = F.coalesce(d, F.lit(0))
    terms = {"s0": w, "s1": w * d, "s2": w * d * d, "t0": w * y0, "t1": w * d * y0}
    return [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{name}_{k}") for k, c in terms.items()]


def solve(name: str, min_points: float = 0.0, own: Column | None = None) -> tuple[Column, Column, Column]:
    """(value, slope, weight). ``own`` removes a point at distance 0 with that value: the leave-one-out fit."""
    s0, s1, s2, t0, t1 = (F.col(f"{name}_{k}") for k in ("s0", "s1", "s2", "t0", "t1"))
    if own is not None:
        s0, t0 = s0 - F.when(own.isNotNull(), 1.0).otherwise(0.0), t0 - F.coalesce(own, F.lit(0.0))
    # weighted moments: the line through the centre of mass, read at distance 0
    at, level = F.try_divide(s1, s0), F.try_divide(t0, s0)
    spread, shared = F.try_divide(s2, s0) - at * at, F.try_divide(t1, s0) - at * level
    line = (s0 * s0 * spread > EPS) & (s0 >= min_points)
    slope = F.when(line, F.try_divide(shared, spread)).otherwise(0.0)
    some = s0 >= 1e-6
    return F.when(some, level - slope * F.when(line, at).otherwise(0.0)), F.when(some, slope), s0


def near_sums(fits: dict[str, tuple[str, float]]):
    """The five weighted sums of each fit (name: field of the points that holds y, bandwidth) from a row's own array of points in reach: struct of
    ``<name>_s0``...; no row of a pair is made, so nothing has to be aggregated. Points without y add nothing."""
    terms = ("s0", "s1", "s2", "t0", "t1")

    @F.arrow_udf(", ".join(f"{n}_{k}: double" for n in fits for k in terms).join(("struct<", ">")))
    def of(near: pa.Array, day: pa.Array) -> pa.Array:
        n, points = len(day), near.flatten()
        row = np.repeat(np.arange(n), near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        d = (points.field("pday").to_numpy(zero_copy_only=False) - day.to_numpy(zero_copy_only=False)[row]).astype("float64")
        out = {}
        for name, (field, bw) in fits.items():
            y = points.field(field)
            w = np.where(y.is_valid().to_numpy(zero_copy_only=False) & (np.abs(d) <= C.KERNEL_CUTOFF * bw), np.exp(-0.5 * (d / bw) ** 2), 0.0)
            y = y.fill_null(0.0).to_numpy(zero_copy_only=False)
            for k, term in zip(terms, (w, w * d, w * d * d, w * y, w * d * y)):
                out[f"{name}_{k}"] = pa.array(np.bincount(row, weights=term, minlength=n))
        return pa.StructArray.from_arrays(list(out.values()), names=list(out))

    return of


def scatter(df: DataFrame, reach: float, keep, skeleton: Column | None = None) -> DataFrame:
    """Copies each row to the days within ``reach``: columns ``eval_day`` and ``d`` (point day minus evaluated day).

    ``skeleton`` is an optional array of extra evaluation days; copies there carry ``d = NULL``.
    """
    r = floor(reach)
    days = F.sequence(F.col("day") - r, F.col("day") + r)
    if skeleton is not None:
        days = F.concat(days, F.coalesce(skeleton, F.array().cast("array<int>")))
    d = df.select(*keep, "day", F.posexplode(days).alias("_pos", "eval_day"))
    return d.select(*keep, "eval_day", F.when(F.col("_pos") <= 2 * r, F.col("day") - F.col("eval_day")).alias("d"))


def loo_fit(df: DataFrame, keys, value: str, bw: float, min_points: float = 0.0) -> DataFrame:
    """Leave-one-out fit at every row: ``fit``, ``fit_slope``, ``fit_weight``; one row per (keys, day).

    The points in reach are an array of the row (a window bounded by the calendar), from which its sums are worked out.
    """
    w = frames.around(keys, floor(C.KERNEL_CUTOFF * bw))
    # collect_list drops NULL, so rows without a value give nothing to their neighbours
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("day").alias("pday"), F.col(value).cast("double").alias("y")))
    d = df.withColumn("_near", F.collect_list(point).over(w)).withColumn("_k", near_sums({"k": ("y", bw)})("_near", "day"))
    d = d.select(*df.columns, "_k.*")
    fit, slope, weight = solve("k", min_points, own=F.col(value))
    return d.select(*df.columns, fit.alias("fit"), slope.alias("fit_slope"), weight.alias("fit_weight"))


def fit_at_targets(df: DataFrame, keys, is_target: Column, fits: dict[str, tuple[Column, Column | None, float]],
                   min_points: float = 0.0) -> DataFrame:
    """Several fits at target rows from one window of known rows; ``fits`` maps names to (value, condition, bandwidth).

    Returns keys, day and value, slope, weight of each fit. All bandwidths share the widest window.
    """
    reach = floor(C.KERNEL_CUTOFF * max(bw for _, _, bw in fits.values()))
    values = {f"_y{i}": (v if c is None else F.when(c, v)).cast("double") for i, (v, c, _) in enumerate(fits.values())}
    d = df.withColumns({**values, "_t": is_target})
    point = F.when(~F.col("_t"), F.struct(F.col("day").alias("pday"), *values))
    near = d.withColumn("_near", F.collect_list(point).over(frames.around(keys, reach))).filter("_t")
    sums = near_sums({n: (f"_y{i}", bw) for i, (n, (_, _, bw)) in enumerate(fits.items())})
    g = near.select(*keys, "day", sums("_near", "day").alias("_k")).select(*keys, "day", "_k.*")
    out = []
    for n in fits:
        v, s, w = solve(n, min_points)
        out += [v.alias(n), s.alias(f"{n}_slope"), w.alias(f"{n}_weight")]
    return g.select(*keys, "day", *out)

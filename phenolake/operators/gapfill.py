"""Reconstruction of hidden rows: source guess, baselines, features, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.functions.expr import bounded_score, on_fixed_grid, source_offset
from phenolake.operators import frames
from phenolake.operators.norms import loyo_norm
from phenolake.operators.smooth import fit_at_targets, loo_fit

def gap() -> Column:
    return F.col("is_gap")


def known() -> Column:
    return ~F.col("is_gap")


def seen(c: str) -> Column:
    return known() & F.col(c).isNotNull()


def count_by(cond: Column, *keys) -> Column:
    return F.count(F.when(cond, 1)).over(Window.partitionBy("pid", *keys))


def residue(period: int) -> Column:
    return F.pmod(F.col("day"), F.lit(period))


def guess_source(marked: DataFrame, loo: bool = False, grid: DataFrame | None = None) -> DataFrame:
    """Adds ``guess``: the first source whose revisit cycle fits the day in this entity-year, then the fixed grid.

    Counts per residue are windows over the marked panel, so no lookup join is needed; with ``loo`` a known row does
    not count itself. ``grid`` lists the days of year on which the third source occurs (366 rows at most).
    """
    own = lambda c: F.when(seen(c), 1).otherwise(0) if loo else F.lit(0)
    d = marked.withColumns({"n_s1": count_by(seen("s1"), "year", residue(C.CYCLE_PERIOD[0])) - own("s1"),
                            "n_s2": count_by(seen("s2"), "year", residue(C.CYCLE_PERIOD[1])) - own("s2")})
    if grid is None:
        d = d.withColumn("on_grid", on_fixed_grid(F.col("doy")))
    else:
        d = d.join(F.broadcast(grid.select("doy").distinct().withColumn("on_grid", F.lit(True))), "doy", "left")
        d = d.withColumn("on_grid", F.coalesce("on_grid", F.lit(False)))
    return d.withColumn("guess", F.when(F.col("n_s1") > 0, 0).when(F.col("n_s2") > 0, 1).when(F.col("on_grid"), 2).otherwise(-1))


def baseline_predictions(marked: DataFrame) -> DataFrame:
    """Neighbour mean, nearest, time-linear, norm, own climatology (±7 days) and their blend for every hidden row."""
    d = loyo_norm(marked, 7, where=known()).withColumn("own_clim", F.col("norm_mean")).drop("norm_mean", "norm_std", "norm_n", "norm_years", "z")
    d = loyo_norm(d, C.NORM_WINDOW, where=known())
    d = frames.neighbors(d, ["pid"], gap(), known())
    vp, vn, dp, dn = (F.col(c) for c in ("val_prev", "val_next", "days_prev", "days_next"))
    mean = frames.either(vp, vn)
    linear = F.coalesce(frames.interpolate(vp, vn, dp, dn), mean)
    far = F.lit(1 << 30)
    d = d.withColumns({
        "nearest_mean": mean, "linear_time": linear,
        "nearest_one": F.when(F.coalesce(dp, far) <= F.coalesce(dn, far), vp).otherwise(vn),
        "climatology": F.coalesce(F.when(F.col("norm_n") > 0, F.col("norm_mean")), mean),
        "doy_entity_mean": F.coalesce(F.col("own_clim"), mean)})
    return d.withColumn("blend", frames.either(F.col("linear_time"), F.col("climatology")))


METHODS = ("nearest_mean", "linear_time", "nearest_one", "climatology", "doy_entity_mean", "blend")


def offset_of(code: Column, offsets: DataFrame) -> Column:
    """Offset of a source from a one-row table of offsets, read as scalar subqueries."""
    return (F.when(code == 0, F.lit(0.0)).when(code == 1, offsets.select("s2").scalar())
            .when(code == 2, offsets.select("s3").scalar()))


def source_aware(d: DataFrame, offsets: DataFrame, code: Column) -> Column:
    """Neighbours moved to the first source's scale, interpolated, moved back to the scale of ``code``."""
    vp = F.col("val_prev") - offset_of(F.col("source_prev"), offsets)
    vn = F.col("val_next") - offset_of(F.col("source_next"), offsets)
    line = frames.interpolate(vp, vn, F.col("days_prev"), F.col("days_next"))
    return F.coalesce(line, frames.either(vp, vn)) + F.coalesce(offset_of(code, offsets), F.lit(0.0))


def unpivot(d: DataFrame, keys, truth: str, methods) -> DataFrame:
    return d.select(*keys, F.col(truth).alias("truth"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in methods])).alias("p")).select(*keys, "truth", "p.*")


def method_metrics(long: DataFrame, keys=()) -> DataFrame:
    err = F.col("pred") - F.col("truth")
    g = long.groupBy(*keys, "method").agg(F.count(err).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                                          F.count(F.when(F.col("pred").isNull(), 1)).alias("n_null"))
    return g.withColumn("score", bounded_score(F.col("rmse")))


def error_concentration(long: DataFrame, big: float = 0.2) -> DataFrame:
    err = F.col("pred") - F.col("truth")
    hit = F.abs(err) > big
    return long.groupBy("method").agg(F.avg(F.when(hit, 1.0).when(err.isNotNull(), 0.0)).alias("share_points"),
                                      (F.sum(F.when(hit, err * err).otherwise(0.0)) / F.sum(err * err)).alias("share_sse"))


def stratified_rmse(long: DataFrame, stratum: str, weights: dict[str, float], trim: float | None = None) -> DataFrame:
    """Weighted RMSE over the strata that are present; ``trim`` drops larger absolute errors."""
    err = F.col("pred") - F.col("truth")
    d = long.filter(err.isNotNull() & (F.abs(err) <= trim if trim is not None else F.lit(True)))
    per = d.groupBy("method", stratum).agg(F.avg(err * err).alias("mse"))
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    per = per.withColumn("w", F.try_element_at(w, F.col(stratum))).filter("w IS NOT NULL")
    return per.groupBy("method").agg(F.sqrt(F.sum(F.col("w") * F.col("mse")) / F.sum("w")).alias("rmse"), F.count("*").alias("n_strata"))


def holdout_report(long: DataFrame, run: str, stratum: str) -> DataFrame:
    """RMSE per method over all rows and per stratum of each run, then mean and spread across runs."""
    err = F.col("pred") - F.col("truth")
    per = long.withColumn("_e", err * err).groupingSets(
        [[F.col("method"), F.col(run), F.col(stratum)], [F.col("method"), F.col(run)]], "method", run, stratum).agg(
        F.sqrt(F.avg("_e")).alias("rmse"))
    per = per.withColumn(stratum, F.coalesce(F.col(stratum), F.lit("all")))
    return per.groupBy("method", stratum).agg(F.count("*").alias("n_runs"), F.avg("rmse").alias("mean_rmse"),
                                              (F.max("rmse") - F.min("rmse")).alias("spread"))


# ---------------------------------------------------------------- features of the hidden rows
def with_h(d: DataFrame) -> DataFrame:
    return d.withColumn("h", F.col("value") - source_offset(F.col("source")))


def cycle_features(marked: DataFrame) -> DataFrame:
    """How often each source was seen in the year, near the day and on the same cycle day, and the nearest such days."""
    cols = {}
    for name, periods, half in (("s1", (5,), 30), ("s2", (8, 16), 40), ("s3", (16,), 40)):
        ok = known() & (F.col("source") == int(name[1]) - 1)
        cols[f"cy_{name}_year"] = count_by(ok, "year")
        cols[f"cy_{name}_win"] = frames.count_in_window(ok, half, ["pid"])
        for p in periods:
            key = ["pid", residue(p)]
            if name != "s3":
                cols[f"cy_{name}_r{p}_year"] = count_by(ok, "year", residue(p))
                cols[f"cy_{name}_r{p}_win"] = frames.count_in_window(ok, half, key)
            cols[f"cy_{name}_r{p}_prev"] = F.col("day") - frames.last_before(ok, F.col("day"), key)
            cols[f"cy_{name}_r{p}_next"] = frames.first_after(ok, F.col("day"), key) - F.col("day")
    return marked.withColumns(cols)


def curve_features(marked: DataFrame) -> DataFrame:
    """Local linear curves at hidden rows by source group and bandwidth, all from one window."""
    md = F.col("source") == 2
    h = F.col("h")
    fits = {"sl_6": (h, ~md, 6.0), "sl_15": (h, ~md, 15.0), "md_15": (h, md, 15.0), "all_6": (h, None, 6.0), "all_15": (h, None, 15.0)}
    d = fit_at_targets(with_h(marked), ["pid"], gap(), fits)
    return d.withColumn("sl_minus_md", F.col("sl_15") - F.col("md_15"))


def loo_residuals(rows: DataFrame) -> DataFrame:
    """Leave-one-out residual of each known row against the curve of its source group (three points at least)."""
    d = with_h(rows).withColumn("grp", F.when(F.col("source") == 2, "md").otherwise("sl"))
    many = F.count("*").over(Window.partitionBy("pid", "grp")) >= 3
    out = None
    for grp, bw in (("sl", 8.0), ("md", 15.0)):
        f = loo_fit(d.withColumn("_many", many).filter(F.col("grp") == grp), ["pid"], "h", bw)
        f = f.withColumn("res", F.when(F.col("_many") & (F.col("fit_weight") >= 0.5), F.col("h") - F.col("fit")))
        f = f.drop("_many", "fit", "fit_slope", "fit_weight")
        out = f if out is None else out.unionByName(f)
    return out


def day_tables(res: DataFrame, keys=()) -> DataFrame:
    """Sum and count of residuals and rows per (day, source), and entities active in the year. ``keys`` (a mask) keep panels apart."""
    t = res.groupBy(*keys, "day", "year", "source").agg(F.sum("res").alias("sum"), F.count("res").alias("cnt"), F.count("*").alias("n_obs"))
    active = res.groupBy(*keys, "year").agg(F.count_distinct("pid").alias("active"))
    return t.join(F.broadcast(active), [*keys, "year"])  # one row per year


DAY_OFFSETS = {"d0": (0,), "pm1": (-1, 1), "pm3": (-3, -2, 2, 3)}


def day_effects(targets: DataFrame, tables: DataFrame, keys=()) -> DataFrame:
    """Mean residual of all rows by source on the target's day and near it, with counts and share of active entities."""
    hits = []
    for name, offs in DAY_OFFSETS.items():
        hits += [F.struct(F.lit(name).alias("o"), (F.col("day") - o).alias("at")) for o in offs]
    # each (day, source) row offers itself to the few days that look at it; the table is bounded by the calendar
    t = tables.select(*keys, "source", "sum", "cnt", "n_obs", F.explode(F.array(*hits)).alias("x")).select(*keys, "source", "sum", "cnt", "n_obs", "x.*")
    aggs = []
    for s in range(3):
        for name in DAY_OFFSETS:
            on = (F.col("source") == s) & (F.col("o") == name)
            aggs += [F.coalesce(F.sum(F.when(on, F.col("cnt"))), F.lit(0)).alias(f"de_s{s + 1}_{name}_n"),
                     F.try_divide(F.sum(F.when(on, F.col("sum"))), F.sum(F.when(on, F.col("cnt")))).alias(f"de_s{s + 1}_{name}")]
        aggs.append(F.coalesce(F.sum(F.when((F.col("source") == s) & (F.col("o") == "d0"), F.col("n_obs"))), F.lit(0)).alias(f"xp_s{s + 1}_n"))
    wide = t.groupBy(*keys, "at").agg(*aggs)
    active = tables.select(*keys, "year", "active").distinct()
    d = targets.join(F.broadcast(wide.withColumnRenamed("at", "day")), [*keys, "day"], "left").join(F.broadcast(active), [*keys, "year"], "left")
    fill = {c: 0 for c in wide.columns if c.endswith("_n")}
    d = d.fillna(fill)
    return d.withColumns({f"xp_s{s}_share": F.col(f"xp_s{s}_n") / F.greatest(F.col("active"), F.lit(1)) for s in (1, 2, 3)})


def climatology_features(marked: DataFrame) -> DataFrame:
    """Own climatology of h (±7 days, other years) and the season's anomaly within ±30 and ±60 days of the year."""
    d = loyo_norm(with_h(marked), 7, value="h", where=known())
    d = d.withColumn("_a", F.when(known() & (F.col("norm_n") >= 3), F.col("h") - F.col("norm_mean")))
    cols = {"clim_mean": F.col("norm_mean"), "clim_std": F.when(F.col("norm_n") > 1, F.col("norm_std")), "clim_n": F.col("norm_n")}
    for half in (30, 60):
        w = frames.around(["pid", "year"], half)
        cols |= {f"anom_{half}": F.avg("_a").over(w), f"anom_{half}_n": F.count("_a").over(w)}
    d = d.withColumns(cols)
    return d.withColumn("clim_plus_anom", F.col("clim_mean") + F.coalesce("anom_30", F.lit(0.0)))


def source_hypotheses(d: DataFrame) -> DataFrame:
    """Value under the hypothesis that each source produced the hidden row."""
    base = {"s1": F.col("sl_6"), "s2": F.col("sl_6"), "s3": F.coalesce(F.col("fwd_mean"), F.col("sl_15"))}
    return d.withColumns({f"hyp_{s}": base[s] + C.SOURCE_OFFSET[i] + F.coalesce(F.col(f"pb_res_{s}"), F.lit(0.0))
                          for i, s in enumerate(C.SOURCES)})


def blend_weights(d: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """Least-squares share of ``a`` in a two-model blend, clipped to [0, 1], from sums over the rows."""
    x, y = F.col(a) - F.col(b), F.col(truth) - F.col(b)
    w = F.try_divide(F.sum(x * y), F.sum(x * x))
    return d.filter(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), w)).alias("weight"))


def constraint_audit(marked: DataFrame, published: DataFrame, window: int = C.NORM_WINDOW) -> DataFrame:
    """What published leave-one-year-out means disclose about hidden rows.

    Every published mean fixes a sum over ±window days of the other years. Per row: rows and hidden rows in its window,
    the residual where nothing is hidden, and the hidden value itself where exactly one is.
    """
    every = Window.partitionBy("pid").orderBy("doy").rangeBetween(-window, window)
    own = Window.partitionBy("pid", "year").orderBy("doy").rangeBetween(-window, window)
    diff = lambda agg: F.coalesce(agg.over(every), F.lit(0)) - F.coalesce(agg.over(own), F.lit(0))
    hid = F.when(gap(), F.col("day"))
    d = marked.join(published.select("pid", "day", "pub_mean"), ["pid", "day"], "left").withColumns({
        "n_window": diff(F.count(F.lit(1))), "n_hidden": diff(F.count(hid)),
        "_known": diff(F.sum(F.when(known(), F.col("value")))), "_hid": diff(F.sum(hid))})
    rest = F.col("n_window") * F.col("pub_mean") - F.col("_known")
    d = d.filter(known() & F.col("pub_mean").isNotNull() & (F.col("n_window") > 0))
    return d.select("pid", "day", "n_window", "n_hidden", F.when(F.col("n_hidden") == 0, rest / F.col("n_window")).alias("residual"),
                    F.when(F.col("n_hidden") == 1, F.col("_hid")).alias("solved_day"), F.when(F.col("n_hidden") == 1, rest).alias("solved_value"))


def constraint_rows(df: DataFrame, window: int = C.NORM_WINDOW) -> DataFrame:
    """Edges of the published norms: (pid, day of a known row, day of a hidden row that its norm is made of).

    One window by the entity's day of year brings the hidden rows of all years to the known one; those of its own year are left out.
    """
    near = Window.partitionBy("pid").orderBy("doy").rangeBetween(-window, window)
    hidden = F.collect_list(F.when(gap(), F.struct("day", "year"))).over(near)
    d = df.select("pid", "day", "year", known().alias("_known"), hidden.alias("_h")).filter("_known")
    return d.select("pid", "day", F.explode(F.filter("_h", lambda x: x["year"] != F.col("year"))).alias("x")).select(
        "pid", "day", F.col("x.day").alias("row_day"))


def others_effect(res: DataFrame, tables: DataFrame) -> DataFrame:
    """Day effect of the other entities at rows that are in the table themselves: total minus own, NULL where no one else was seen."""
    t = tables.select("day", "source", F.col("sum").alias("_s"), F.col("cnt").alias("_c"))
    own = F.when(F.col("res").isNotNull(), 1).otherwise(0)
    d = res.join(F.broadcast(t), ["day", "source"])  # bounded by the calendar
    return d.withColumns({"others_n": F.col("_c") - own,
                          "others_effect": F.try_divide(F.col("_s") - F.coalesce("res", F.lit(0.0)), F.col("_c") - own)}).drop("_s", "_c")

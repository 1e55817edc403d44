"""Leave-one-year-out norms from the moments of a row's own window, without a self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.functions import constants as C


def moments(values: Column) -> Column:
    """struct(n, mean, std) of an array: deviations from its smallest value are averaged, then squares around that mean, so neither a large
    level nor a small spread is lost and equal values have a std of exactly 0. Sorted first: the order of rows doesn't matter, and the smallest
    value is one look-up where a minimum would be taken again for each element. Mean and std are NULL for an empty array."""
    def of(v):
        n, low = F.size(v), F.get(v, F.lit(0))
        above = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - low)) / F.nullif(n, F.lit(0))
        return F.transform(F.array(above), lambda m: F.struct(n.alias("n"), (low + m).alias("mean"), F.sqrt(
            F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(x - low - m, 2)) / F.nullif(n, F.lit(0))).alias("std")))[0]
    return F.transform(F.array(F.sort_array(values)), of)[0]


def loyo_norm(df: DataFrame, window: int = C.NORM_WINDOW, value: str = "value", where: Column | None = None,
              keys=("pid",)) -> DataFrame:
    """Mean, population std and count over ±``window`` days of year of the other years, with z.

    ``where`` limits the rows that feed the norm; every row still receives one. A row's window is an array of at most
    2 * ``window`` + 1 rows a year, as keys and day are unique. The norm is generated from that array: a filter on what follows from it stays above, so
    no copies of the whole expression are evaluated for it, and the rows stay where they are.
    """
    near = Window.partitionBy(*keys).orderBy("doy").rangeBetween(-window, window)
    v = F.col(value).cast("double")
    feeds = F.col(value).isNotNull() if where is None else where & F.col(value).isNotNull()
    d = df.withColumn("_near", F.collect_list(F.when(feeds, F.struct(F.col("year").alias("y"), v.alias("v")))).over(near))
    d = d.withColumn("_others", F.filter("_near", lambda x: x["y"] != F.col("year")))
    norm = F.transform(F.array(moments(F.transform("_others", lambda x: x["v"]))), lambda m: F.struct(
        m["n"].cast("long").alias("norm_n"), m["mean"].alias("norm_mean"), m["std"].alias("norm_std"),
        F.when(m["std"] > 0, (F.col(value) - m["mean"]) / m["std"]).alias("z")))
    kept = [c for c in df.columns if c not in ("norm_n", "norm_years", "norm_mean", "norm_std", "z")]
    d = d.select(*kept, "_others", F.inline_outer(norm)).withColumn("norm_years", F.size(F.array_distinct(F.transform("_others", lambda x: x["y"]))))
    return d.select(*kept, "norm_n", "norm_years", "norm_mean", "norm_std", "z")


def norm_search(df: DataFrame, published: Column, windows=(5, 6, 7, 8, 10), value: str = "value") -> DataFrame:
    """Tries norm formulas (±window, own year in or out) against a published mean; one row per candidate."""
    cols, aggs = {}, []
    for w in windows:
        every = Window.partitionBy("pid").orderBy("doy").rangeBetween(-w, w)
        own = Window.partitionBy("pid", "year").orderBy("doy").rangeBetween(-w, w)
        s, n = F.sum(value).over(every), F.count(value).over(every)
        so, no = F.sum(value).over(own), F.count(value).over(own)
        cols[f"in_{w}"] = s / n
        cols[f"out_{w}"] = F.when(n > no, (s - so) / (n - no))
    d = df.withColumn("_pub", published).withColumns(cols)
    for name in cols:
        err = F.abs(F.col(name) - F.col("_pub"))
        aggs.append(F.struct(F.lit(name.split("_")[0] == "out").alias("own_year_out"),
                             F.lit(int(name.split("_")[1])).alias("window"),
                             F.avg(err).alias("mean_abs_diff"),
                             F.avg(F.when(err <= 1e-6, 1.0).when(err.isNotNull(), 0.0)).alias("exact_share"))
                    .alias(name))
    one = d.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("r")).select("r.*")


def bin_norms(df: DataFrame, bins: dict[str, Column], published: Column, value: str = "value") -> DataFrame:
    """Same search for fixed bins: the mean over the entity's bin, own year included."""
    cols = {f"b_{name}": F.avg(value).over(Window.partitionBy("pid", c)) for name, c in bins.items()}
    d = df.withColumn("_pub", published).withColumns(cols)
    aggs = []
    for name in bins:
        err = F.abs(F.col(f"b_{name}") - F.col("_pub"))
        aggs.append(F.struct(F.lit(name).alias("bin"), F.avg(err).alias("mean_abs_diff")).alias(name))
    one = d.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"`{n}`") for n in bins])).alias("r")).select("r.*")

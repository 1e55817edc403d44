"""Bindings of the sample tables to the panel model.

Each binding aggregates to one row per key and day first. Money and percentages are summed as whole numbers, so the
averages do not depend on the order in which partial sums arrive.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolake.functions import constants as C
from phenolake.functions.expr import day_num
from phenolake.functions.spec import PanelSpec, as_panel
from phenolake.operators.sampling import exact_share


ROWS = 50_000  # raw rows whose entities one task windows, about


def exact_mean(value, when, scale: int, divisor: float):
    """Mean of ``value`` where ``when`` holds, summed as integers of ``1/scale``."""
    n = F.count(F.when(when, 1))
    return F.sum(F.when(when, F.round(value * scale).cast("bigint"))).cast("double") / (F.lit(divisor) * n)


class Tables:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Tasks for windows by entity, in proportion to the input (the files' footers tell its rows)."""
        return max(1, -(-self.read("lineitem").count() // ROWS))

    def by_entity(self, df: DataFrame) -> DataFrame:
        """Dealt by entity to as many tasks as the input needs, so that a task's sorts don't grow with it; windows by entity need no other exchange."""
        return df.repartition(self.parts, "pid")

    @cached_property
    def daily(self) -> DataFrame:
        """One row per supplier and ship day, one column per source flag."""
        li = self.read("lineitem")
        flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
        return (li.groupBy(F.col("l_suppkey").alias("pid"), F.to_date("l_shipdate").alias("date"))
                .agg(exact_mean(price, flag == "N", 100, 1e7).alias("s1"),
                     exact_mean(price, flag == "A", 100, 1e7).alias("s2"),
                     exact_mean(price, flag == "R", 100, 1e7).alias("s3"),
                     exact_mean(F.col("l_discount"), flag == "N", 100, 1e2).alias("x1"),
                     exact_mean(F.col("l_discount"), flag == "A", 100, 1e2).alias("x2"),
                     F.min("l_linestatus").alias("status_flag")))

    @cached_property
    def panel(self) -> DataFrame:
        spec = PanelSpec(extra={"x1": "x1", "x2": "x2", "status_flag": "status_flag"})
        return as_panel(self.daily, spec)

    @cached_property
    def categories(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("category"))

    @cached_property
    def panel_cat(self) -> DataFrame:
        return self.panel.join(self.categories, "pid", "left")

    @cached_property
    def season(self) -> DataFrame:
        return self.panel.filter(F.col("doy").between(*C.SEASON_DOY))

    @cached_property
    def marked(self) -> DataFrame:
        """Panel with the hidden 15 % flagged."""
        return exact_share(self.panel, ["pid", "date"], C.GAP_SHARE, "gap", "is_gap")

    @cached_property
    def known(self) -> DataFrame:
        return self.marked.filter(~F.col("is_gap"))

    @cached_property
    def targets(self) -> DataFrame:
        return self.marked.filter("is_gap")

    @cached_property
    def drivers(self) -> DataFrame:
        """Region and day of orders: number of orders as precip, mean price as temp; only days with orders."""
        cust = self.read("customer").select("c_custkey", "c_nationkey")
        return (self.read("orders").select("o_custkey", "o_orderdate", "o_totalprice")
                .join(cust, F.col("o_custkey") == F.col("c_custkey"))
                .groupBy(F.col("c_nationkey").alias("region"), F.to_date("o_orderdate").alias("date"))
                .agg(F.count("*").cast("double").alias("precip"),
                     exact_mean(F.col("o_totalprice"), F.lit(True), 100, 1e6).alias("temp"))
                .withColumn("day", day_num("date")))

    @cached_property
    def stations(self) -> DataFrame:
        """Denser daily drivers per (return flag, line status)."""
        one = F.lit(True)
        return (self.read("lineitem")
                .groupBy(F.concat("l_returnflag", "l_linestatus").alias("region"), F.to_date("l_shipdate").alias("date"))
                .agg(exact_mean(F.col("l_tax"), one, 100, 1.0).alias("rain"),
                     exact_mean(F.col("l_quantity"), one, 1, 1.0).alias("temp"),
                     F.min("l_quantity").alias("tmin"), F.max("l_quantity").alias("tmax"),
                     exact_mean(F.col("l_discount"), one, 100, 2.0).alias("et0"))
                .withColumn("day", day_num("date")))

    @cached_property
    def pixels(self) -> DataFrame:
        """Pixel rows: zone = supplier, scene = month, pixel = line number, with bands and a flag word."""
        one = F.lit(True)
        return (self.read("lineitem")
                .groupBy(F.col("l_suppkey").alias("zone"), F.trunc("l_shipdate", "month").alias("scene"),
                         F.col("l_linenumber").alias("px"))
                .agg(exact_mean(F.col("l_tax"), one, 100, 1e2).alias("nir"),
                     exact_mean(F.col("l_discount"), one, 100, 1e2).alias("red"),
                     exact_mean(F.col("l_quantity"), one, 1, 1e3).alias("swir"),
                     F.max(F.col("l_quantity").cast("int")).alias("qa")))

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

"""Readers and sinks: typed CSV, prioritised unions, JSON documents, labelled files, checked outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolake.functions.expr import clip, fingerprint

PANEL_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("s1", T.DoubleType()), T.StructField("s2", T.DoubleType()), T.StructField("s3", T.DoubleType())])


def shared_dir(spark: SparkSession) -> str:
    """New folder below the location that driver and executors share; removed when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/phenolake/{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises a frame in the shared folder, so lost executors do not recompute everything before it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType = PANEL_SCHEMA) -> DataFrame:
    """CSV with a header, fixed types and strict ISO dates; a malformed row fails the read."""
    return (spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd")
            .option("mode", "FAILFAST").csv(path))


def first_wins(df: DataFrame, key, priority: str | Column) -> DataFrame:
    """One row per key, the one with the lowest priority; partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in key]
    p = F.col(priority) if isinstance(priority, str) else priority
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), p).alias("_r")).select(*key, "_r.*")


def load_sources(parts: list[tuple[DataFrame | None, str]], key) -> DataFrame:
    """Union of labelled parts; an absent part is skipped; of equal keys the earlier part wins."""
    out = None
    for rank, (df, split) in enumerate(parts):
        if df is None:
            continue
        d = df.withColumns({"split": F.lit(split), "_rank": F.lit(rank)})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return first_wins(out, key, "_rank").drop("_rank")


def split_panel(grid: DataFrame, value: str = "value", gap: str = "is_gap"):
    """(obs, grid, gaps): rows with a known value outside gaps, all rows, rows to predict."""
    return grid.filter(F.col(value).isNotNull() & ~F.col(gap)), grid, grid.filter(F.col(gap))


def weather_rows(df: DataFrame, keys, doc: str, names: dict[str, str]) -> DataFrame:
    """One JSON document of parallel arrays per row -> one row per day; the first of equal dates wins."""
    fields = [T.StructField("time", T.ArrayType(T.StringType()))] + [
        T.StructField(k, T.ArrayType(T.DoubleType())) for k in names]
    d = df.select(*keys, F.from_json(doc, T.StructType(fields)).alias("j"))
    d = d.select(*keys, F.posexplode(F.arrays_zip("j.time", *[f"j.{k}" for k in names])).alias("_pos", "r"))
    d = d.select(*keys, "_pos", F.to_date("r.time").alias("date"), *[F.col(f"r.{k}").alias(v) for k, v in names.items()])
    return first_wins(d, [*keys, "date"], "_pos").drop("_pos")


def unnest_year_arrays(df: DataFrame, keys, column: str, fields) -> DataFrame:
    """map<year, struct of parallel arrays> -> one record per array position."""
    d = df.select(*keys, F.explode(column).alias("year", "y"))
    d = d.select(*keys, "year", F.explode(F.arrays_zip(*[f"y.{f}" for f in fields])).alias("r"))
    return d.select(*keys, "year", "r.*")


def read_reports(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_holdouts(spark: SparkSession, path: str, schema: T.StructType, columns, pattern: str) -> DataFrame:
    """CSV files with a label in their path; only ``columns`` are parsed."""
    return (spark.read.schema(schema).option("header", True).csv(path)
            .select(*columns, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("label")))


def keyed_path(base: str, df: DataFrame, cols) -> str:
    """Path that changes with the content of ``cols``: the key of an intermediate result."""
    n, h = df.transform(fingerprint, cols).first()
    return f"{base}/n{n}_{h or 0:x}"


def write_parquet(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prediction_violations(pred: DataFrame, gaps: DataFrame, key=("pid", "date"), value: str = "pred") -> DataFrame:
    """One row of contract violations: duplicate keys, bad values, gaps without and keys beyond the gaps."""
    p = pred.groupBy(*key).agg(F.count("*").alias("_n"), F.count(F.when(
        F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf")), 1)).alias("_bad"),
        F.lit(1).alias("_p"))
    g = gaps.select(*key).distinct().withColumn("_g", F.lit(1))
    return p.join(g, list(key), "full").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("_g").alias("n_gaps"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_not_finite"),
        F.count(F.when(F.col("_p").isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.col("_g").isNull(), 1)).alias("n_unexpected"))


def write_predictions(pred: DataFrame, gaps: DataFrame, path: str, value: str = "pred", lo: float = -0.2,
                      hi: float = 1.0) -> None:
    """CSV sink that refuses a violated contract; the value is clipped to [lo, hi]."""
    v = prediction_violations(pred, gaps, value=value).first().asDict()
    bad = {k: n for k, n in v.items() if k not in ("n_rows", "n_gaps") and n}
    if bad:
        raise ValueError(f"prediction contract violated: {bad}")
    (pred.select("pid", "date", clip(F.col(value), lo, hi).alias(value))
     .write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path))


def write_summary(summary: DataFrame, path: str) -> None:
    """One small aggregate as a JSON text file."""
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def source_coverage(df: DataFrame, source: str, year: str, first: int, last: int) -> DataFrame:
    """Years covered by each source and the expected years that are missing."""
    got = F.collect_set(year)
    return (df.groupBy(source).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"),
                                   F.count("*").alias("n"), got.alias("_y"))
            .withColumn("missing", F.concat_ws(",", F.array_sort(F.array_except(
                F.sequence(F.lit(first), F.lit(last)), F.col("_y"))).cast("array<string>"))).drop("_y"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out

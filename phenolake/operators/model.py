"""Learned reconstruction with MLlib: imputed features with missing flags and boosted trees."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenolake.functions.expr import clip

TREES = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42}


class Fit(NamedTuple):
    """A fitted model with the features it reads: names, places in the packed row, and the means that stand for missing values."""
    used: list[str]
    at: list[int]
    means: list[float]
    model: PipelineModel


def packed(df: DataFrame, features, keep) -> DataFrame:
    """``keep`` and the features as one array ``x`` of doubles: Spark reads and fills one value a row instead of a wide row column by column."""
    return df.select(*keep, F.array(*[F.col(f).cast("double") for f in features]).alias("x"))


def matrix(x: pa.Array) -> np.ndarray:
    """Packed rows of a batch, NaN where a feature is missing."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1 if len(x) else 0)


def known_means(df: DataFrame) -> list[float | None]:
    """Mean of each place of ``x`` over the rows that know it, None where none does. A task hands on one row a place."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for v in (matrix(b.column("x")) for b in batches if b.num_rows):
            total = total + np.stack([np.nansum(v, axis=0), (~np.isnan(v)).sum(axis=0)])
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"place": np.arange(total.shape[1], dtype="int32"), "s": total[0], "n": total[1]})

    sums = df.select("x").mapInArrow(part, "place int, s double, n double").groupBy("place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return [r["s"] / r["n"] if r["n"] else None for r in sums.orderBy("place").collect()]  # one row a feature


def vector(at, means) -> Column:
    """Values of the places ``at``, the mean where one is missing, then a missing flag of each, because MLlib trees have no missing values."""
    at, means = np.array(at, dtype=int), np.array(means)

    @F.arrow_udf("array<double>")
    def filled(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        v = matrix(x)[:, at]
        gone = np.isnan(v)
        rows = np.hstack([np.where(gone, means, v), gone])
        return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype="int32"), rows.ravel())

    return array_to_vector(filled("x"))


def fitted(train: DataFrame, features, label: str, estimator) -> Fit:
    """Fits on the features with at least one known value."""
    means = known_means(train)
    at = [i for i, m in enumerate(means) if m is not None]
    means = [means[i] for i in at]
    rows = train.select(F.col(label).cast("double").alias("_label"), vector(at, means).alias("features"))
    return Fit([features[i] for i in at], at, means, Pipeline(stages=[estimator]).fit(rows))


def fit_gap_model(train: DataFrame, features, label: str, params: dict | None = None) -> Fit:
    """Boosted trees over the packed ``features``."""
    return fitted(train, features, label, GBTRegressor(featuresCol="features", labelCol="_label", predictionCol="pred", **{**TREES, **(params or {})}))


def score_gaps(fit: Fit, df: DataFrame) -> DataFrame:
    return fit.model.transform(df.withColumn("features", vector(fit.at, fit.means))).drop("features")


def feature_importances(fit: Fit) -> list[tuple[str, float]]:
    names = [*fit.used, *[f"{f}_missing" for f in fit.used]]
    return sorted(zip(names, fit.model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: -x[1])


def error_scale(train: DataFrame, features, truth: str, pred: str, bounds: tuple[float, float] = (0.003, 0.3)) -> Fit:
    """Second model: the absolute error of the first one on rows it did not see, within bounds."""
    return fit_gap_model(train.withColumn("_abs_err", clip(F.abs(F.col(truth) - F.col(pred)), *bounds)), features, "_abs_err", {"maxIter": 10})


def with_scale(fit: Fit, df: DataFrame) -> DataFrame:
    d = score_gaps(fit, df.withColumnRenamed("pred", "_first")).withColumnRenamed("pred", "_s")
    return d.withColumn("scale", clip(0.5 * F.col("_s") + 0.0175, 0.015, 0.15)).withColumnRenamed("_first", "pred").drop("_s")


def fit_source_model(train: DataFrame, features, label: str) -> Fit:
    """Forest over the classes of ``label``."""
    return fitted(train, features, label, RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=10, maxDepth=5, seed=42))


def with_probabilities(fit: Fit, df: DataFrame) -> DataFrame:
    """Adds ``probs``, an array with a probability for each class."""
    p = score_gaps(fit, df).withColumn("probs", vector_to_array("probability"))
    return p.drop("rawPrediction", "probability", "prediction")


def source_probabilities(df: DataFrame, features, label: str, fold: str, k: int) -> DataFrame:
    """Out-of-fold class probabilities: each fold is scored by a forest fitted on the others. ``df`` holds the packed ``features``."""
    out = None
    for i in range(k):
        p = with_probabilities(fit_source_model(df.filter(F.col(fold) != i), features, label), df.filter(F.col(fold) == i))
        out = p if out is None else out.unionByName(p)
    return out

"""Models fitted batch by batch.

A batch leaves one row behind: its normal equations (counts and sums of
products), aggregated on Spark. The row is written below the batch's id, so a
batch that is repeated replaces itself and changes nothing. Least squares adds
the rows up; stochastic gradient descent takes a step per batch from the
weights of the batch before. The driver sees sums of columns x columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.sources import drain_batches


def _terms(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(f).cast("double") for f in features]]


def batch_sums(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row: n, the upper half of X'X, X'y and y'y of the rows without NULL
    or NaN in a feature or the target; an intercept comes first."""
    y = F.col(target).cast("double")
    used = [*features, target]
    kept = rows.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in used]).na.drop()
    x = _terms(features)
    pairs = [F.coalesce(F.sum(a * b), F.lit(0.0)) for i, a in enumerate(x) for b in x[i:]]
    return kept.agg(
        F.count(F.lit(1)).alias("n"), F.array(*pairs).alias("xtx"), F.array(*[F.coalesce(F.sum(a * y), F.lit(0.0)) for a in x]).alias("xty"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias("yty")
    )


def _matrices(row, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    xtx = np.zeros((p, p))
    xtx[np.triu_indices(p)] = row["xtx"]
    return row["n"], xtx + np.triu(xtx, 1).T, np.array(row["xty"])


def _coefficients(spark: SparkSession, features: Sequence[str], weights: np.ndarray, n: int) -> DataFrame:
    rows = [(t, float(w), int(n)) for t, w in zip(["intercept", *features], weights, strict=True)]
    return spark.createDataFrame(rows, "term string, coefficient double, n long")


def fit_least_squares(stream: DataFrame, features: Sequence[str], target: str, arrivals: Iterable | None = None, ridge: float = 0.0, name: str = "least-squares") -> DataFrame:
    """(term, coefficient, n) after all batches of a stream: the same as of one
    fit over all rows. Collinear features get the solution of least norm."""

    def handle(batch: DataFrame, batch_id: int, folder: str) -> None:
        batch_sums(batch, features, target).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    spark, p = stream.sparkSession, len(features) + 1
    folder = drain_batches(stream, name, handle, arrivals=arrivals)
    sums = spark.read.parquet(folder)
    width = p * (p + 1) // 2
    total = sums.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.array(*[F.coalesce(F.sum(F.col("xtx")[i]), F.lit(0.0)) for i in range(width)]).alias("xtx"),
        F.array(*[F.coalesce(F.sum(F.col("xty")[i]), F.lit(0.0)) for i in range(p)]).alias("xty"),
    ).first()
    n, xtx, xty = _matrices(total, p)
    penalty = np.diag([0.0, *[ridge] * (p - 1)])
    return _coefficients(spark, features, np.linalg.lstsq(xtx + penalty, xty, rcond=None)[0], n)


def fit_gradient(stream: DataFrame, features: Sequence[str], target: str, rate: float = 0.1, decay: float = 0.0, arrivals: Iterable | None = None, name: str = "gradient") -> DataFrame:
    """(batch, term, coefficient, n): weights after each batch of a stream, by
    one gradient step of the mean squared error per batch, from zero.

    The step of batch b is ``rate / (1 + decay * b)``; a batch without usable
    rows keeps the weights. Features are expected on a common scale.
    """
    spark, p = stream.sparkSession, len(features) + 1

    def handle(batch: DataFrame, batch_id: int, folder: str) -> None:
        before = np.zeros(p)
        if batch_id > 0:
            rows = spark.read.parquet(f"{folder}/batch={batch_id - 1}").collect()  # a row per term
            by = {r["term"]: r["coefficient"] for r in rows}
            before = np.array([by[t] for t in ["intercept", *features]])
        n, xtx, xty = _matrices(batch_sums(batch, features, target).first(), p)
        step = rate / (1 + decay * batch_id)
        after = before - step * (xtx @ before - xty) / n if n else before
        _coefficients(spark, features, after, n).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    folder = drain_batches(stream, name, handle, arrivals=arrivals)
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")

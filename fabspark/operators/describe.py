"""Grouped aggregates, cross tables, correlation and linear algebra on sums."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pearson, ratio_or
from ..functions.distributions import t_inverse, t_two_sided_p
from .ordered import HOT_ROWS
from .ranks import attach_stats, distribution, quantiles, value_counts

WIDE_COLUMNS = 40


def basic_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def describe(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Moments, quartiles, mode (lowest on ties), range and CV per key."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("var"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
    )
    quart = quantiles(df, keys, value, [0.25, 0.5, 0.75], hot_rows)
    quart = quart.select(*keys, F.col("q25").alias("q1"), F.col("q50").alias("median"), F.col("q75").alias("q3"))
    modes = value_counts(df, keys, value).groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col("n"), -F.col(value))).alias("mode")
    )
    out = attach_stats(attach_stats(moments, quart, keys), modes, keys)
    return out.withColumns(
        {
            "range": F.col("max") - F.col("min"),
            "iqr": F.col("q3") - F.col("q1"),
            "cv_pct": F.try_divide(F.col("std"), F.col("mean")) * 100,
        }
    )


def balanced_design(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """One row: number of cells and whether all cells have the same size."""
    cells = df.groupBy(*factors).count()
    return cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.min("count").alias("min_count"),
        F.max("count").alias("max_count"),
        (F.min("count") == F.max("count")).alias("balanced"),
    )


def cross_means(df: DataFrame, row: str, column: str, values: Sequence[object], measure: str) -> DataFrame:
    """Pivot of means; the pivot values are given, so no extra job finds them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(measure))


def cross_counts(df: DataFrame, row: str, column: str, values: Sequence[object]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def marginal_means(df: DataFrame, factors: Sequence[str], measure: str) -> DataFrame:
    """Cell, marginal and grand means in one pass."""
    return df.cube(*factors).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean"))


def well_filled_groups(df: DataFrame, group: str, cell: str, cells: int, more_than: int = 5) -> DataFrame:
    """Rows of groups where each of ``cells`` cells has over ``more_than`` rows."""
    counts = df.groupBy(group, cell).count()
    kept = counts.groupBy(group).agg(F.min("count").alias("low"), F.count(F.lit(1)).alias("seen"))
    kept = kept.filter((F.col("low") > more_than) & (F.col("seen") == cells)).select(group)
    return df.join(kept, group, "left_semi")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return attach_stats(counts, total, []).withColumn("share", F.col("n") / F.col("total")).drop("total")


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, distinct values, non-null values, uniqueness ratio).

    Exact counts go through one row per column and value with partial
    aggregation, so neither a hot value nor a wide table explodes.
    """
    if approximate:
        row = df.agg(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.approx_count_distinct(F.col(f"`{c}`")).alias("distinct_values"),
                        F.count(F.col(f"`{c}`")).alias("non_null"),
                    )
                    for c in columns
                ]
            ).alias("s")
        )
        out = row.select(F.inline("s"))
    else:
        text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
        long = text.unpivot([], list(columns), "column", "value")
        per_value = long.groupBy("column", "value").agg(F.count("value").alias("n"))
        out = per_value.groupBy("column").agg(F.count("value").alias("distinct_values"), F.sum("n").alias("non_null"))
    return out.withColumn("uniqueness_ratio", ratio_or(F.col("distinct_values"), F.col("non_null")))


def class_imbalance(counts: DataFrame, count: str = "n") -> DataFrame:
    return counts.agg((F.max(count) / F.min(count)).alias("imbalance_ratio"), F.count(F.lit(1)).alias("classes"))


def label_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: cardinality, density, per-label frequency."""
    total = sum((F.col(c) for c in labels), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(total).alias("cardinality"),
        (F.avg(total) / len(labels)).alias("density"),
        *[F.avg(F.col(c)).alias(f"frequency_{c}") for c in labels],
    )


def label_pairs(df: DataFrame, labels: Sequence[str], top: int = 5) -> DataFrame:
    """Most frequent label pairs; pairs come from the schema, so one aggregate
    without a join counts them all."""
    sums = [
        F.struct(F.lit(a).alias("label_1"), F.lit(b).alias("label_2"), F.sum(F.col(a) * F.col(b)).alias("n"))
        for a, b in combinations(labels, 2)
    ]
    rows = df.agg(F.array(*sums).alias("p")).select(F.inline("p"))
    return rows.orderBy(F.desc("n"), "label_1", "label_2").limit(top)


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every column pair, pairwise complete: NULL, NaN
    and infinite values are missing. Above ``WIDE_COLUMNS`` columns the pairs
    no longer fit one aggregate; the values are the same."""
    if len(columns) > WIDE_COLUMNS and not keys:
        return wide_correlations(df, columns)
    df = df.withColumns({c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns})
    pairs = [
        F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), pearson(a, b).alias("correlation"))
        for a, b in combinations(columns, 2)
    ]
    return df.groupBy(*keys).agg(F.array(*pairs).alias("p")).select(*keys, F.inline("p"))


def wide_correlations(df: DataFrame, columns: Sequence[str], fan_in: int = 32) -> DataFrame:
    """As ``correlations`` for hundreds of columns: every task adds up the
    products of its rows, d x d sums are merged ``fan_in`` at a time, and one
    set of sums reaches the driver. Values are centred first."""
    cols, d = list(columns), len(columns)
    typed = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    row = typed.agg(*[F.coalesce(F.avg(F.when(F.abs(F.col(c)) < float("inf"), F.col(c))), F.lit(0.0)).alias(c) for c in cols]).first()
    centre = np.array([row[c] for c in cols])

    def products(batches):
        total = np.zeros((4, d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            have = np.isfinite(x).astype(float)
            x = np.where(have > 0, x, 0.0)
            total += np.stack([x.T @ x, have.T @ have, x.T @ have, (x * x).T @ have])
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"g": [part], "sums": [total.tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["sums"])
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0]) // fan_in], "sums": [total.tobytes()]})

    parts = typed.rdd.getNumPartitions()
    sums = typed.mapInPandas(products, "g int, sums binary")
    while parts > 1:
        sums = sums.groupBy(F.floor(F.col("g") / fan_in).alias("_up")).applyInPandas(merge, "g int, sums binary")
        parts = -(-parts // fan_in)
    xx, n, s, q = np.frombuffer(bytes(sums.first()["sums"])).reshape(4, d, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xx - s * s.T / n
        corr = cov / np.sqrt((q - s * s / n) * (q.T - s.T * s.T / n))
    rows = [(cols[i], cols[j], float(corr[i, j]) if np.isfinite(corr[i, j]) else None) for i in range(d) for j in range(i + 1, d)]
    return df.sparkSession.createDataFrame(rows, "column1 string, column2 string, correlation double")


def spearman(df: DataFrame, a: str, b: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank correlation. Works on one row per distinct value pair with its
    count, so ties are cheap and no row-level rank join is needed."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("_w"))
    ra = distribution(both, [], a, hot_rows=hot_rows).select(a, F.col("avg_rank").alias("_ra"))
    rb = distribution(both, [], b, hot_rows=hot_rows).select(b, F.col("avg_rank").alias("_rb"))
    rows = pairs.join(ra, a).join(rb, b)
    n = F.sum("_w")
    mean = (n + 1) / 2  # the mean of average ranks
    cov = F.sum(F.col("_w") * F.col("_ra") * F.col("_rb")) / n - mean * mean
    va = F.sum(F.col("_w") * F.col("_ra") * F.col("_ra")) / n - mean * mean
    vb = F.sum(F.col("_w") * F.col("_rb") * F.col("_rb")) / n - mean * mean
    return rows.agg(n.alias("n"), F.try_divide(cov, F.sqrt(va * vb)).alias("rho"))


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance of complete rows.

    One aggregate; only its d x d result comes to the driver.
    """
    cond = None
    for c in columns:
        ok = F.col(c).isNotNull()
        cond = ok if cond is None else cond & ok
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    row = df.filter(cond).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    d = len(columns)
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else np.nan
    return row["n"], np.array([row[f"m{i}"] for i in range(d)], dtype=float), cov


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix, largest first."""
    _, _, cov = moments(df, columns)
    sd = np.sqrt(np.diag(cov))
    vif = np.diag(np.linalg.pinv(cov / np.outer(sd, sd)))
    rows = sorted(zip(columns, map(float, vif)), key=lambda kv: -kv[1])
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


class LeastSquares:
    """Ordinary least squares from means and covariances."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str):
        self.features, self.target = list(features), target
        n, mean, cov = moments(df, [*features, target])
        d = len(self.features)
        self.n, self.d = n, d
        self.x_mean, self.y_mean = mean[:d], mean[d]
        self.inverse = np.linalg.pinv(cov[:d, :d]) / n
        self.slopes = np.linalg.pinv(cov[:d, :d]) @ cov[:d, d]
        self.intercept = float(self.y_mean - self.slopes @ self.x_mean)
        self.sse = float(n * (cov[d, d] - self.slopes @ cov[:d, d]))
        self.sst = float(n * cov[d, d])
        self.dof = n - d - 1
        self.mse = self.sse / self.dof

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for f, b in zip(self.features, self.slopes):
            out = out + F.lit(float(b)) * F.col(f)
        return out

    def leverage(self) -> Column:
        out = F.lit(1.0 / self.n)
        for i, a in enumerate(self.features):
            for j, b in enumerate(self.features):
                da, db = F.col(a) - float(self.x_mean[i]), F.col(b) - float(self.x_mean[j])
                out = out + da * db * float(self.inverse[i, j])
        return out

    def table(self, spark, confidence: float = 0.95) -> DataFrame:
        se = np.sqrt(np.diag(self.inverse) * self.mse)
        se0 = float(np.sqrt(self.mse * (1.0 / self.n + self.x_mean @ self.inverse @ self.x_mean)))
        rows = [("const", self.intercept, se0)] + [
            (f, float(b), float(s)) for f, b, s in zip(self.features, self.slopes, se)
        ]
        t = t_inverse(1 - (1 - confidence) / 2, self.dof)
        out = spark.createDataFrame(rows, "term string, coefficient double, std_error double")
        out = out.withColumn("t_value", F.col("coefficient") / F.col("std_error"))
        return out.withColumns(
            {
                "p_value": t_two_sided_p(F.col("t_value"), F.lit(float(self.dof))),
                "ci_lower": F.col("coefficient") - t * F.col("std_error"),
                "ci_upper": F.col("coefficient") + t * F.col("std_error"),
            }
        )


def cooks_distance(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Adds residual, leverage and Cook's distance to every row."""
    fit = LeastSquares(df, features, target)
    out = df.withColumns({"residual": F.col(target) - fit.predict(), "leverage": fit.leverage()})
    h, e = F.col("leverage"), F.col("residual")
    return out.withColumn(
        "cooks_d", e * e / F.lit((fit.d + 1) * fit.mse) * h / ((1 - h) * (1 - h))
    )

"""Regular series, decomposition, autocorrelation and AR forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import micros
from .ordered import HOT_ROWS, POS, Ordered
from .ranks import attach_stats, quantile_name, wide_quantiles


def regular_series(df: DataFrame, keys: Sequence[str], ts: str, aggs: dict[str, Column], step_s: int = 3600) -> DataFrame:
    """One row per key and step from its first to its last step; steps
    without rows hold NULL. ``step`` counts steps since 1970."""
    keys = list(keys)
    step = F.floor(micros(df, ts) / F.lit(step_s * 1_000_000)).cast("long")
    cells = df.withColumn("step", step).groupBy(*keys, "step").agg(*[c.alias(n) for n, c in aggs.items()])
    spans = cells.groupBy(*keys).agg(F.min("step").alias("a"), F.max("step").alias("b"))
    grid = spans.select(*keys, F.explode(F.sequence("a", "b")).alias("step"))
    return grid.join(cells, [*keys, "step"], "left")


def seasonal_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, period: int = 24, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Additive decomposition: centred 2 x period moving average, phase means
    of the detrended values shifted to sum to zero, residual."""
    keys, half = list(keys), period // 2
    seq = Ordered(df, keys, order, hot_rows=hot_rows)

    def build(d: DataFrame, w) -> DataFrame:
        inner = F.sum(value).over(w.rowsBetween(-(half - 1), half - 1))
        ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        return d.withColumn("trend", (inner + 0.5 * ends) / period)

    rows = seq.windowed(half, half, build).result()
    rows = rows.withColumns({"phase": (F.col(POS) % period).cast("int"), "_detrended": F.col(value) - F.col("trend")})
    phases = rows.groupBy(*keys, "phase").agg(F.avg("_detrended").alias("_pm"))
    centre = phases.groupBy(*keys).agg(F.avg("_pm").alias("_c"))
    phases = attach_stats(phases, centre, keys)
    phases = phases.select(*keys, "phase", (F.col("_pm") - F.col("_c")).alias("seasonal"))
    out = attach_stats(rows, phases, [*keys, "phase"])
    return out.withColumn("resid", F.col("_detrended") - F.col("seasonal")).drop("_detrended")


def autocorrelation(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Autocorrelation of lags 0..n, all lags from one window pass."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    rows = attach_stats(df, mean, keys).withColumn("_x", F.col(value) - F.col("_mean"))

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumns({f"_p{k}": F.col("_x") * F.lag("_x", k).over(w) for k in range(1, lags + 1)})

    prods = Ordered(rows, keys, order, hot_rows=hot_rows).windowed(lags, 0, build).result()
    sums = prods.groupBy(*keys).agg(
        F.sum(F.col("_x") * F.col("_x")).alias("_v"),
        F.array(F.sum(F.col("_x") * F.col("_x")), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) for k in range(1, lags + 1)]).alias("_s"),
    )
    return sums.select(*keys, "_v", F.posexplode("_s").alias("lag", "_c")).select(
        *keys, "lag", F.try_divide(F.col("_c"), F.col("_v")).alias("acf")
    )


def holdout_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``is_test``: true on the last n rows of each key."""
    seq = Ordered(df, keys, order, hot_rows=hot_rows).positioned()
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    out = attach_stats(seq.result(), totals, list(keys))
    return out.withColumn("is_test", F.col(POS) >= F.col("_total") - n).drop("_total")


def _solve(sums: np.ndarray, d: int) -> np.ndarray:
    """Least squares from the (d+1) x (d+1) sums of products, target last."""
    m = sums.reshape(d + 1, d + 1)
    return np.linalg.pinv(m[:d, :d]) @ m[:d, d]


def ar_fit(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int = 3, exog: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per key a linear model of the value on its lags and on standardised
    exogenous columns. Normal-equation sums are aggregated on Spark, so the
    solver sees one small array per key. Returns coef (intercept, lags, exog),
    the last values (newest first), exog means and deviations, training mean
    and deviation."""
    keys = list(keys)
    aggs = [F.avg(value).alias("train_mean"), F.stddev_samp(value).alias("train_std")]
    for e in exog:
        aggs += [F.avg(e).alias(f"_m_{e}"), F.stddev_pop(e).alias(f"_s_{e}")]
    stats = df.groupBy(*keys).agg(*aggs)
    rows = attach_stats(df, stats, keys)
    for e in exog:
        rows = rows.withColumn(f"_z_{e}", F.coalesce(F.try_divide(F.col(e) - F.col(f"_m_{e}"), F.col(f"_s_{e}")), F.lit(0.0)))

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumns({f"_l{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)})

    lagged = Ordered(rows, keys, order, hot_rows=hot_rows).windowed(lags, 0, build).result()
    terms = [F.lit(1.0), *[F.col(f"_l{k}") for k in range(1, lags + 1)], *[F.col(f"_z_{e}") for e in exog], F.col(value)]
    d = len(terms) - 1
    complete = F.col(f"_l{lags}").isNotNull() & F.col(value).isNotNull()
    sums = [F.sum(F.when(complete, terms[min(i, j)] * terms[max(i, j)])) for i in range(d + 1) for j in range(d + 1)]
    newest = F.max_by(F.array(F.col(value), *[F.col(f"_l{k}") for k in range(1, lags)]), F.col(POS))
    keep = [F.first(c).alias(c) for c in ["train_mean", "train_std", *[f"_{x}_{e}" for e in exog for x in "ms"]]]
    per_key = lagged.groupBy(*keys).agg(F.array(*sums).alias("_sums"), newest.alias("last_values"), F.max(POS).alias("last_pos"), *keep)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(s: pd.Series) -> pd.Series:
        return s.map(lambda v: _solve(np.asarray(v, dtype=float), d).tolist() if v[0] is not None else None)

    return per_key.withColumn("coef", solve("_sums")).drop("_sums")


def ar_forecast(model: DataFrame, keys: Sequence[str], lags: int, steps: int, drift_threshold: float = 2.0) -> DataFrame:
    """Forecast of ``steps`` values per key by recursion (exogenous columns at
    their mean, where they are zero after scaling), with the drift flag."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def roll(coef: pd.Series, last: pd.Series) -> pd.Series:
        def one(c, x):
            if c is None or x is None or any(v is None for v in x):
                return None
            state, out = list(x), []
            for _ in range(steps):
                out.append(float(c[0] + np.dot(c[1 : lags + 1], state[:lags])))
                state = [out[-1], *state[:-1]]
            return out

        return pd.Series([one(c, x) for c, x in zip(coef, last)])

    out = model.withColumn("_f", roll("coef", "last_values"))
    out = out.select(*keys, "train_mean", "train_std", F.posexplode("_f").alias("step", "forecast"))
    return out.withColumn("step", F.col("step") + 1).withColumn(
        "drift_flag", F.abs(F.col("forecast") - F.col("train_mean")) > drift_threshold * F.col("train_std")
    )


def forecast_flags(df: DataFrame, value: str, stats: DataFrame, keys: Sequence[str], threshold: float = 2.0) -> DataFrame:
    """Flag where a value leaves the band around the training mean."""
    out = attach_stats(df, stats.select(*keys, "train_mean", "train_std"), keys)
    return out.withColumn("drift_flag", F.abs(F.col(value) - F.col("train_mean")) > threshold * F.col("train_std")).drop("train_mean", "train_std")


def partial_dependence(df: DataFrame, features: Sequence[str], vary: str, predict, points: int = 20, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Prediction along quantiles of one feature, the others at their mean.
    ``predict`` maps a frame with the features to one with ``prediction``."""
    probs = [i / (points - 1) for i in range(points)]
    grid = wide_quantiles(df, [], [vary], probs)
    names = [f"{vary}_{quantile_name(p)}" for p in probs]
    rows = grid.select(F.posexplode(F.array(*names)).alias("point", vary))
    others = [f for f in features if f != vary]
    if others:
        rows = attach_stats(rows, df.agg(*[F.avg(f).alias(f) for f in others]), [])
    return predict(rows)

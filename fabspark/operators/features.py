"""Derived columns that need statistics of the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from .ordered import HOT_ROWS
from .quality import missing_by_column
from .ranks import attach_stats, wide_quantiles


def interaction_features(df: DataFrame, temperature: str, pressure: str, flow: str, time: str) -> DataFrame:
    """Centred temperature, squared pressure and two products."""
    out = attach_stats(df, df.agg(F.avg(temperature).alias("_mean")), [])
    return out.withColumns(
        {
            "temp_centered": F.col(temperature) - F.col("_mean"),
            "pressure_sq": F.col(pressure) * F.col(pressure),
            "flow_time_inter": F.col(flow) * F.col(time),
            "temp_flow_inter": F.col(temperature) * F.col(flow),
        }
    ).drop("_mean")


def scaled_features(df: DataFrame, temperature: str, pressure: str, flow: str, power: str, time: str) -> DataFrame:
    """Centred, scaled by maximum, and the distance from the mean point."""
    stats = df.agg(
        F.avg(temperature).alias("_mt"),
        F.avg(pressure).alias("_mp"),
        F.max(power).alias("_xp"),
        F.max(time).alias("_xt"),
    )
    out = attach_stats(df, stats, [])
    dt, dp = F.col(temperature) - F.col("_mt"), F.col(pressure) - F.col("_mp")
    return out.withColumns(
        {
            "temp_centered": dt,
            "pressure_sq": F.col(pressure) * F.col(pressure),
            "flow_temp_inter": F.col(flow) * F.col(temperature),
            "power_efficiency": F.try_divide(F.col(power), F.col("_xp")),
            "normalized_time": F.try_divide(F.col(time), F.col("_xt")),
            "stability_index": F.sqrt(dt * dt + dp * dp),
        }
    ).drop("_mt", "_mp", "_xp", "_xt")


def element_transform(df: DataFrame, columns: Sequence[str], suffix: str = "_t") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.sqrt(F.abs(F.col(c))) + F.log1p(F.abs(F.col(c))) for c in columns})


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "median", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fill missing values by exact median or mean, or drop incomplete rows."""
    if strategy == "drop":
        return df.na.drop(subset=list(columns))
    if strategy == "median":
        stats = wide_quantiles(df, [], columns, [0.5])
        fill = {c: f"{c}_q50" for c in columns}
    elif strategy == "mean":
        stats = df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
        fill = {c: f"{c}_mean" for c in columns}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = attach_stats(df, stats, [])
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f)) for c, f in fill.items()}).drop(*fill.values())


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean, unit population deviation; constant columns become zero."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    out = attach_stats(df, df.agg(*aggs), [])
    for c in columns:
        sd = F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / sd)
    return out.drop(*[f"_{x}_{c}" for c in columns for x in "ms"])


def robust_scale(df: DataFrame, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Centre on the median, divide by the interquartile range."""
    stats = wide_quantiles(df, [], columns, [0.25, 0.5, 0.75])
    out = attach_stats(df, stats, [])
    for c in columns:
        iqr = F.col(f"{c}_q75") - F.col(f"{c}_q25")
        iqr = F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
        out = out.withColumn(c, (F.col(c) - F.col(f"{c}_q50")) / iqr)
    return out.drop(*[f"{c}_{q}" for c in columns for q in ("q25", "q50", "q75")])


def reduce_features(
    df: DataFrame,
    keys: Sequence[str],
    top: int,
    max_missing: float = 0.4,
    min_variance: float = 1e-5,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Drop columns with many missing values, impute medians, keep the columns
    of highest variance above a floor, scale. Returns rows and the column
    report. The choice of columns needs the profile on the driver: one row per
    column of the schema."""
    columns = [c for c in numeric_columns(df) if c not in keys]
    missing = missing_by_column(df.select(*columns)).select("column", (F.col("missing") / F.col("rows")).alias("missing_ratio"))
    ratio = {row["column"]: row["missing_ratio"] for row in missing.collect()}
    kept = [c for c in columns if ratio[c] <= max_missing]
    filled = impute(df.select(*keys, *kept), kept, "median", hot_rows)
    var_row = filled.agg(*[F.var_samp(c).alias(c) for c in kept]).first()
    varying = [c for c in kept if var_row[c] is not None and var_row[c] > min_variance]
    chosen = sorted(varying, key=lambda c: (-var_row[c], c))[:top]
    report = df.sparkSession.createDataFrame(
        [(c, float(ratio[c]), float(var_row[c]) if c in kept and var_row[c] is not None else None, c in chosen) for c in columns],
        "column string, missing_ratio double, variance double, chosen boolean",
    )
    return standard_scale(filled.select(*keys, *chosen), chosen), report

"""Process capability and yield from grouped sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, finite, ladder
from ..functions.distributions import normal_cdf, t_quantile


@dataclass(frozen=True)
class Specs:
    lsl: float
    usl: float
    target: float


# Capability classes and their lower Cpk bounds.
CAPABILITY_CLASSES = [
    (1.67, "World Class (Cpk ≥ 1.67)"),
    (1.33, "Adequate (1.33 ≤ Cpk < 1.67)"),
    (1.0, "Marginal (1.0 ≤ Cpk < 1.33)"),
    (0.67, "Poor (0.67 ≤ Cpk < 1.0)"),
]
LOWEST_CLASS = "Unacceptable (Cpk < 0.67)"
CENTRED_BELOW = 0.25
Z_95 = 1.959963984540054


def capability(df: DataFrame, keys: Sequence[str], value: str, specs: Specs) -> DataFrame:
    """Cp, Cpu, Cpl, Cpk, centring and class per key; missing and infinite
    measurements are left out."""
    v = F.col(value).cast("double")
    stats = df.filter(finite(v)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std_dev"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )
    width = specs.usl - specs.lsl
    mean, sd = F.col("mean"), F.col("std_dev")
    out = stats.withColumns(
        {
            "cp": F.try_divide(F.lit(width), 6 * sd),
            "cpu": F.try_divide(F.lit(specs.usl) - mean, 3 * sd),
            "cpl": F.try_divide(mean - F.lit(specs.lsl), 3 * sd),
        }
    )
    out = out.withColumns(
        {
            "cpk": F.least("cpu", "cpl"),
            "centering_ratio": F.abs(mean - F.lit(specs.target)) / F.lit(width / 2),
        }
    )
    return out.withColumns(
        {
            "pp": F.col("cp"),
            "ppk": F.col("cpk"),
            "is_centered": F.col("centering_ratio") < CENTRED_BELOW,
            "capability_class": ladder("cpk", CAPABILITY_CLASSES, LOWEST_CLASS),
        }
    )


def cpk_standard_error(cpk: Column | str, n: Column | str) -> Column:
    c, k = as_col(cpk), as_col(n)
    return c * F.sqrt(F.try_divide(F.lit(1.0), 9 * k * c * c) + F.try_divide(F.lit(1.0), 2.0 * (k - 1)))


def cpk_interval(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Adds cpk_lower and cpk_upper; both zero where Cpk is not positive."""
    t = t_quantile(F.lit(1 - (1 - confidence) / 2), (F.col("n") - 1).cast("double"))
    half = t * cpk_standard_error("cpk", "n")
    cpk = F.col("cpk")
    return df.withColumns(
        {
            "cpk_lower": F.when(cpk <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), cpk - half)),
            "cpk_upper": F.when(cpk <= 0, F.lit(0.0)).otherwise(cpk + half),
        }
    )


def predicted_yield(mean: Column | str, sd: Column | str, specs: Specs) -> Column:
    """Percent inside the limits under a normal distribution."""
    m, s = as_col(mean), as_col(sd)
    return (normal_cdf(F.lit(specs.usl), m, s) - normal_cdf(F.lit(specs.lsl), m, s)) * 100


def predicted_defects(mean: Column | str, sd: Column | str, specs: Specs) -> dict[str, Column]:
    m, s = as_col(mean), as_col(sd)
    lower = normal_cdf(F.lit(specs.lsl), m, s) * 100
    upper = normal_cdf(-F.lit(specs.usl), -m, s) * 100
    return {"lower_defect_pct": lower, "upper_defect_pct": upper, "total_defect_pct": lower + upper}


def observed_yield(df: DataFrame, keys: Sequence[str], value: str, specs: Specs) -> DataFrame:
    v = F.col(value)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_units"),
        F.count_if((v >= specs.lsl) & (v <= specs.usl)).alias("passing_units"),
        F.count_if(v < specs.lsl).alias("below_lsl_count"),
        F.count_if(v > specs.usl).alias("above_usl_count"),
    )
    n = F.col("total_units")
    return out.withColumns(
        {
            "failing_units": n - F.col("passing_units"),
            "yield_percent": F.try_divide(F.col("passing_units"), n) * 100,
            "defect_rate_ppm": F.try_divide(n - F.col("passing_units"), n) * 1e6,
            "below_lsl_rate": F.try_divide(F.col("below_lsl_count"), n) * 100,
            "above_usl_rate": F.try_divide(F.col("above_usl_count"), n) * 100,
        }
    )


def wilson_interval(passing: Column | str, total: Column | str, z: float = Z_95) -> dict[str, Column]:
    """Wilson score interval of a pass proportion, in percent."""
    n = as_col(total).cast("double")
    n = F.when(n > 0, n)
    p = as_col(passing) / n
    z2 = z * z
    denom = 1 + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2 * n)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / denom
    return {
        "ci_lower": F.greatest(F.lit(0.0), (centre - half) * 100),
        "ci_upper": F.least(F.lit(100.0), (centre + half) * 100),
    }


def yield_sensitivity(
    stats: DataFrame,
    keys: Sequence[str],
    specs: Specs,
    mean_range: tuple[float, float],
    std_range: tuple[float, float],
    points: int = 10,
) -> DataFrame:
    """Predicted yield over grids of the mean (sd kept) and of the sd (mean
    kept), with the central-difference slope. ``stats`` has keys, mean,
    std_dev; the grid is exploded in place, so nothing is joined."""

    def grid(bounds: tuple[float, float]) -> Column:
        low, high = bounds
        step = (high - low) / (points - 1)
        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit(step))

    both = F.array(
        F.struct(F.lit("mean").alias("parameter"), grid(mean_range).alias("grid")),
        F.struct(F.lit("std_dev").alias("parameter"), grid(std_range).alias("grid")),
    )
    rows = stats.select(*keys, "mean", "std_dev", F.explode(both).alias("g"))
    rows = rows.select(*keys, "mean", "std_dev", "g.parameter", F.posexplode("g.grid").alias("point", "grid_value"))
    on_mean = F.col("parameter") == "mean"
    mean = F.when(on_mean, F.col("grid_value")).otherwise(F.col("mean"))
    sd = F.when(on_mean, F.col("std_dev")).otherwise(F.col("grid_value"))
    rows = rows.withColumn("yield_percent", predicted_yield(mean, sd, specs))
    w = Window.partitionBy(*keys, "parameter").orderBy("point")
    y, x = F.col("yield_percent"), F.col("grid_value")
    y_hi, y_lo = F.coalesce(F.lead(y).over(w), y), F.coalesce(F.lag(y).over(w), y)
    x_hi, x_lo = F.coalesce(F.lead(x).over(w), x), F.coalesce(F.lag(x).over(w), x)
    return rows.withColumn("sensitivity", (y_hi - y_lo) / (x_hi - x_lo)).drop("mean", "std_dev")

"""Joins: alignment by key, future events, set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros
from .ordered import HOT_ROWS, Ordered


def align(features: DataFrame, targets: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    return features.join(targets, list(key), how)


def alignment_report(features: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys present on one side only, and rows per key on each side."""
    key = list(key)
    a = features.groupBy(*key).agg(F.count(F.lit(1)).alias("a"))
    b = targets.groupBy(*key).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("feature_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("target_rows"),
        F.count_if(F.col("b").isNull()).alias("features_without_target"),
        F.count_if(F.col("a").isNull()).alias("targets_without_features"),
        F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated_keys"),
    )


def next_event(
    df: DataFrame, keys: Sequence[str], ts: str, is_event: Column, horizons_h: Sequence[int] = (24, 72), cap_h: float = 999.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Hours to the next event of the key strictly after the row, capped, and
    flags for events within the horizons. A backward running minimum: no range
    join, no pair of rows is ever built."""
    at = micros(df, ts)
    rows = df.withColumns({"_back": -at, "_event_at": F.when(is_event, at)})
    seq = Ordered(rows, keys, ["_back"], hot_rows=hot_rows)
    out = seq.running({"_next": ("min", F.col("_event_at"))}, strict=True).result()
    hours = (F.col("_next") + F.col("_back")) / 3.6e9
    cols = {"time_to_event": F.coalesce(F.least(hours, F.lit(float(cap_h))), F.lit(float(cap_h)))}
    for h in horizons_h:
        cols[f"event_in_{h}h"] = F.coalesce((hours <= h).cast("int"), F.lit(0))
    return out.withColumns(cols).drop("_back", "_event_at", "_next")


def outside_domain(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose value is not in the allowed set."""
    return df.join(allowed.select(column).distinct(), column, "left_anti")


def domain_contained(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """One row: distinct values outside, shared and unused."""
    a = df.select(F.col(column)).distinct().withColumn("_in_df", F.lit(1))
    b = allowed.select(F.col(column)).distinct().withColumn("_allowed", F.lit(1))
    both = a.join(b, column, "full_outer")
    return both.agg(
        F.count_if(F.col("_allowed").isNull()).alias("outside"),
        F.count_if(F.col("_allowed").isNotNull() & F.col("_in_df").isNotNull()).alias("shared"),
        F.count_if(F.col("_in_df").isNull()).alias("unused"),
    ).withColumn("is_subset", F.col("outside") == 0)


def duplicate_groups(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def stacked_union(frames: dict[str, DataFrame], tag: str = "part") -> DataFrame:
    out = None
    for name, f in frames.items():
        f = f.withColumn(tag, F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of b that also occur in a."""
    wa, wb = (F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")) for x in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wa, wb)).cast("double"), F.size(wb).cast("double")), F.lit(0.0))

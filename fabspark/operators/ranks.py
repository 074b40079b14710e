"""Ranks, empirical distributions and exact quantiles of whole columns.

Distributions start from one row per key and distinct value, so ties cost
nothing, and cumulative counts run through :class:`Ordered`, so no key is
gathered in one task. Quantiles only look at the values around them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .ordered import HOT_ROWS, Ordered


def value_counts(df: DataFrame, keys: Sequence[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, n, extra sums), missing values left out."""
    more = [F.sum(c).alias(n) for n, c in (extra or {}).items()]
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *more)


def distribution(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: dict[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Distinct values with n, below (rows smaller), upto (rows not larger),
    total, average rank; for each extra sum its running value ``upto_<name>``
    and total ``total_<name>``."""
    keys, extra = list(keys), extra or {}
    counts = value_counts(df, keys, value, extra)
    run = {"upto": ("sum", F.col("n")), **{f"upto_{n}": ("sum", F.col(n)) for n in extra}}
    out = Ordered(counts, keys, [value], hot_rows=hot_rows, bound=df).running(run).result()
    totals = counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), *[F.sum(n).alias(f"total_{n}") for n in extra]
    )
    out = attach_stats(out, totals, keys)
    return out.withColumn("below", F.col("upto") - F.col("n")).withColumn(
        "avg_rank", F.col("below") + (F.col("n") + 1) / 2
    )


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the columns of a per-key (or one-row) statistics frame to rows.

    One row: scalar subquery. Per key: an equi-join left to adaptive
    execution, which broadcasts by measured size or splits skewed partitions.
    """
    keys = list(keys)
    cols = [c for c in stats.columns if c not in keys]
    if not cols:
        return df
    if not keys:
        row = stats.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")).scalar()
        return df.withColumn("_row", row).withColumns({c: F.col("_row")[c] for c in cols}).drop("_row")
    right = stats.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(f"`{c}`") for c in cols])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def stacked(df: DataFrame, keys: Sequence[str], columns: Sequence[str], value: str = "value") -> DataFrame:
    """Long form (keys, column, value) of several numeric columns."""
    typed = spread(df).select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keys), list(columns), "column", value)


def quantile_name(p: float) -> str:
    return "q" + f"{p * 100:g}".replace(".", "_")


# A sketch with this accuracy places a quantile within 1 / ACCURACY of the rows;
# brackets reach three times as far to either side.
ACCURACY = 2_000


def wide_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], totals: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key with columns
    ``<column>_<q>`` (and ``<column>_total``).

    One aggregate sketches all columns and so brackets every quantile; a second
    pass counts the rows below each bracket and keeps the values inside, a few
    thousandths of the rows, among which the exact rank is found.
    """
    keys, columns, probs = list(keys), list(columns), [float(p) for p in probs]
    typed = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    marks = F.array(*[F.lit(min(1.0, max(0.0, p + side * 3 / ACCURACY))) for p in probs for side in (-1, 1)])
    sketch = typed.groupBy(*keys).agg(
        *[x for i in range(len(columns)) for x in (F.count(f"_c{i}").alias(f"_n{i}"), F.percentile_approx(f"_c{i}", marks, F.lit(ACCURACY)).alias(f"_a{i}"))]
    )
    cells = [(i, j) for i in range(len(columns)) for j in range(len(probs))]
    # Up to ACCURACY values the bracket is open (NaN is above all numbers): a few
    # thousandths of them would not reach the neighbouring rank.
    few = lambda i: F.col(f"_n{i}") <= ACCURACY
    low = lambda i, j: F.when(few(i), F.lit(-math.inf)).otherwise(F.col(f"_a{i}")[2 * j])
    high = lambda i, j: F.when(few(i), F.lit(math.nan)).otherwise(F.col(f"_a{i}")[2 * j + 1])
    within = lambda i, j: (F.col(f"_c{i}") >= low(i, j)) & (F.col(f"_c{i}") <= high(i, j))
    if keys:
        sized = lambda rows: attach_stats(rows, sketch.select(*keys, *[f"_n{i}" for i in range(len(columns))]), keys)
        rows = attach_stats(typed, sketch, keys)
    else:
        row = sketch.first()  # one row: brackets become literals that reach the scan
        numbers = {f"_n{i}": F.lit(row[f"_n{i}"]) for i in range(len(columns))}
        sized = lambda rows: rows.withColumns(numbers)
        rows = sized(typed).withColumns({f"_a{i}": F.array(*[F.lit(float(x)) for x in row[f"_a{i}"] or [math.nan] * 2 * len(probs)]) for i in range(len(columns))})
    below = rows.groupBy(*keys).agg(*[F.count_if(F.col(f"_c{i}") < low(i, j)).alias(f"_b{k}") for k, (i, j) in enumerate(cells)])
    below = below.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(None).cast("double").alias("_v"), F.col(f"_b{k}").alias("_w")) for k in range(len(cells))])))
    some = rows.filter(reduce(or_, [F.coalesce(within(i, j), F.lit(False)) for i, j in cells]))
    picked = F.array_compact(F.array(*[F.when(within(i, j), F.struct(F.lit(k).alias("_k"), F.col(f"_c{i}").alias("_v"))) for k, (i, j) in enumerate(cells)]))
    counts = some.select(*keys, F.inline(picked)).groupBy(*keys, "_k", "_v").agg(F.count(F.lit(1)).alias("_w"))
    # The rows below come first: a NULL value with their number. A bracket of very
    # many distinct values is ranked in slices.
    merged = below.unionByName(counts)
    if not keys and max((row[f"_n{i}"] for i in range(len(columns))), default=0) * 6 / ACCURACY > hot_rows:
        merged = Ordered(merged, ["_k"], ["_v"], hot_rows=hot_rows).running({"_upto": ("sum", F.col("_w"))}).result()
    else:
        merged = merged.withColumn("_upto", F.sum("_w").over(Window.partitionBy(*keys, "_k").orderBy(F.asc_nulls_first("_v"))))
    placed = sized(merged)
    at = lambda i, j: F.lit(probs[j]) * (F.col(f"_n{i}") - 1)
    ends = [F.max(f"_n{i}").alias(f"_n{i}") for i in range(len(columns))]
    for k, (i, j) in enumerate(cells):
        mine = F.col("_k") == k
        ends.append(F.max(F.when(mine & F.col("_v").isNull(), F.col("_upto"))).alias(f"_b{i}_{j}"))
        for side, index in (("l", F.floor(at(i, j))), ("h", F.ceil(at(i, j)))):
            ends.append(F.min(F.when(mine & (F.col("_upto") > index), F.col("_v"))).alias(f"_{side}{i}_{j}"))
    out = placed.groupBy(*keys).agg(*ends)
    cols = {}
    for i, j in cells:
        lo, hi = F.col(f"_l{i}_{j}"), F.col(f"_h{i}_{j}")
        lost = (F.col(f"_n{i}") > 0) & (lo.isNull() | hi.isNull() | (F.col(f"_b{i}_{j}") > F.floor(at(i, j))))
        value = lo + (hi - lo) * (at(i, j) - F.floor(at(i, j)))
        cols[f"{columns[i]}_{quantile_name(probs[j])}"] = F.when(lost, F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double")).otherwise(value)
    if totals:
        cols |= {f"{c}_total": F.expr(f"nullif(_n{i}, 0)") for i, c in enumerate(columns)}
    return out.select(*keys, *[c.alias(n) for n, c in cols.items()])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact quantiles of one column: (keys, total, q25, ...), keys with values only."""
    wide = wide_quantiles(df.select(*keys, F.col(f"`{value}`").alias("_value")), keys, ["_value"], probs, totals=True, hot_rows=hot_rows)
    out = wide.select(*keys, F.col("_value_total").alias("total"), *[F.col(f"_value_{quantile_name(p)}").alias(quantile_name(p)) for p in probs])
    return out.filter(F.col("total").isNotNull()) if keys else out


def column_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same of several columns, one row each: (keys, column, total, q...)."""
    wide = wide_quantiles(df, keys, columns, probs, totals=True, hot_rows=hot_rows)
    names = [quantile_name(p) for p in probs]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}_total`").alias("total"), *[F.col(f"`{c}_{n}`").alias(n) for n in names]) for c in columns])
    return wide.select(*keys, F.inline(rows)).filter(F.col("total").isNotNull())


def ranked(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Rows with the average rank of ``value`` within the keys.

    The join runs on keys and value; a value held by very many rows is split
    by adaptive execution like any other skewed join key.
    """
    dist = distribution(df, keys, value).select(*keys, value, F.col("avg_rank").alias(name))
    return attach_stats(df, dist, [*keys, value])

"""Time-window features per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, POS, Ordered, decayed_sum


def rolling_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    windows: Sequence[int] = (6, 12, 24),
    full: bool = False,
    stats: Sequence[str] = ("mean", "std", "min", "max", "range"),
    fill_single_std: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rolling statistics over the last w rows of the entity.

    ``full=False`` uses what is there (the deviation of one row is 0, or NULL
    when ``fill_single_std`` is off); ``full=True`` is NULL until the frame
    holds w values.
    """

    def build(d: DataFrame, w) -> DataFrame:
        out = {}
        for c in columns:
            for size in windows:
                frame = w.rowsBetween(-(size - 1), 0)
                low, high = F.min(c).over(frame), F.max(c).over(frame)
                std = F.stddev_samp(c).over(frame)
                if not full and fill_single_std:
                    std = F.coalesce(std, F.lit(0.0))
                made = {"mean": F.avg(c).over(frame), "std": std, "min": low, "max": high, "range": high - low}
                for s in stats:
                    col = made[s]
                    if full:
                        col = F.when(F.count(c).over(frame) == size, col)
                    out[f"{c}_{s}_{size}"] = col
        return d.withColumns(out)

    return Ordered(df, keys, order, hot_rows=hot_rows).windowed(max(windows), 0, build).result()


def lag_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], lags: Sequence[int] = (1, 6, 12), hot_rows: int = HOT_ROWS
) -> DataFrame:
    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumns({f"{c}_lag_{n}": F.lag(c, n).over(w) for c in columns for n in lags})

    return Ordered(df, keys, order, hot_rows=hot_rows).windowed(max(lags), 0, build).result()


def rolling_slope(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], size: int = 12, full: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Slope of the last ``size`` values against the row number, from 2 rows
    on (or a full frame); the slope does not depend on where counting starts."""

    def build(d: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(size - 1), 0)
        enough = F.col(POS) >= (size - 1 if full else 1)
        return d.withColumns(
            {f"{c}_trend_{size}": F.when(enough, F.regr_slope(F.col(c), F.col(POS).cast("double")).over(frame)) for c in columns}
        )

    return Ordered(df, keys, order, hot_rows=hot_rows).windowed(size, 0, build).result()


def ewm_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, halflives: Sequence[float] = (12, 24), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exponentially weighted mean with normalised weights. Missing values
    carry no weight but age the earlier ones."""
    seq = Ordered(df, keys, order, hot_rows=hot_rows).positioned()
    for h in halflives:
        ratio = 0.5 ** (1.0 / h)
        seq = decayed_sum(seq, {"_num": F.col(column), "_den": F.col(column).isNotNull().cast("double")}, ratio)
        name = f"{column}_ewma_{h:g}"
        seq = seq._next(seq.df.withColumn(name, F.try_divide(F.col("_num"), F.col("_den"))).drop("_num", "_den"))
    return seq.result()


def differences(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """First and second difference and relative change."""

    def build(d: DataFrame, w) -> DataFrame:
        out = {}
        for c in columns:
            x, one, two = F.col(c), F.lag(c, 1).over(w), F.lag(c, 2).over(w)
            out[f"{c}_diff1"] = x - one
            out[f"{c}_diff2"] = (x - one) - (one - two)
            out[f"{c}_pct_change"] = F.try_divide(x, one) - 1
        return d.withColumns(out)

    return Ordered(df, keys, order, hot_rows=hot_rows).windowed(2, 0, build).result()


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(columns))


def anomaly_intervals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flagged: Column, score: str, ts: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Runs of consecutive flagged rows, an open run at the end included.

    The run number is the count of unflagged rows before; grouping by it is
    partial-aggregated, so one endless run is no hot task.
    """
    seq = Ordered(df.withColumn("_flag", flagged), keys, order, hot_rows=hot_rows).positioned()
    seq = seq.running({"_run": ("sum", (~F.col("_flag")).cast("long"))})
    runs = seq.result().filter(F.col("_flag")).groupBy(*keys, "_run").agg(
        F.min(POS).alias("start_index"),
        F.max(POS).alias("end_index"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("duration_rows"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
    )
    return runs.drop("_run")


def cumulative(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    return Ordered(df, keys, order, hot_rows=hot_rows).running({n: ("sum", c) for n, c in sums.items()}).result()


def leaderboard(df: DataFrame, key: str, metric: str, top: int) -> DataFrame:
    """Top rows by metric; the key breaks ties. Sorting and limiting come
    first, so the rank window only sees ``top`` rows."""
    best = df.orderBy(F.desc(metric), F.asc(key)).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), F.asc(key))))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order (a window group limit
    keeps n rows per key and partition before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def centred_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, size: int = 25, hot_rows: int = HOT_ROWS
) -> DataFrame:
    half = size // 2

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn(f"{column}_centred_{size}", F.avg(column).over(w.rowsBetween(-half, half)))

    return Ordered(df, keys, order, hot_rows=hot_rows).windowed(half, half, build).result()


def rolling_band(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, size: int = 50, width: float = 2.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rolling mean with a band of ``width`` deviations, full frames only."""
    out = rolling_features(df, keys, order, [column], [size], full=True, stats=("mean", "std"), hot_rows=hot_rows)
    m, s = F.col(f"{column}_mean_{size}"), F.col(f"{column}_std_{size}")
    out = out.withColumns({"band_upper": m + width * s, "band_lower": m - width * s})
    return out.withColumn("outside_band", (F.col(column) > F.col("band_upper")) | (F.col(column) < F.col("band_lower")))

"""Distribution drift between a reference and a current sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import ks_p
from .ordered import HOT_ROWS, Ordered
from .ranks import attach_stats, stacked

# Alert thresholds.
PSI_ALERT, KS_P_ALERT, WASSERSTEIN_ALERT = 0.2, 0.05, 0.5
EMPTY_SHARE = 0.0001


def two_samples(df: DataFrame, current: Column, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form (keys, column, value, is_current) without missing values."""
    long = stacked(df.withColumn("is_current", current.cast("int")), [*keys, "is_current"], columns)
    return long.filter(F.col("value").isNotNull() & F.col("is_current").isNotNull())


def sample_counts(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct value: r reference rows, c current rows."""
    return long.groupBy(*keys, "value").agg(
        F.count_if(F.col("is_current") == 0).alias("r"), F.count_if(F.col("is_current") == 1).alias("c")
    )


def psi(long: DataFrame, keys: Sequence[str], bins: int = 10, clip: bool = False) -> DataFrame:
    """Population stability index on equal-width bins of the reference range.

    Current values outside the range stay in the denominator only, unless
    ``clip`` counts them in the outer bins.
    """
    now = F.col("is_current").cast("long")
    return psi_of_counts(long.withColumns({"r": 1 - now, "c": now}), keys, bins, clip)


def psi_of_counts(rows: DataFrame, keys: Sequence[str], bins: int = 10, clip: bool = False) -> DataFrame:
    """As ``psi`` for rows (keys, value, r, c) with counts per sample."""
    keys = list(keys)
    ref = F.when(F.col("r") > 0, F.col("value"))
    stats = rows.groupBy(*keys).agg(
        F.min(ref).alias("_lo"), F.max(ref).alias("_hi"), F.sum("r").alias("_n_ref"), F.sum("c").alias("_n_cur")
    )
    same = F.col("_lo") == F.col("_hi")
    stats = stats.withColumns(
        {"_a": F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")), "_b": F.when(same, F.col("_hi") + 0.5).otherwise(F.col("_hi"))}
    ).drop("_lo", "_hi")
    # Per column of the schema the statistics are a few rows: rows stay where they are.
    rows = attach_stats(rows.select(*keys, "value", "r", "c"), F.broadcast(stats) if keys == ["column"] else stats, keys)
    a, b, v = F.col("_a"), F.col("_b"), F.col("value")
    width = (b - a) / bins
    guess = F.least(F.floor((v - a) / width), F.lit(bins - 1))
    # Bin edges are a + i * width; correct the guess where division rounded.
    guess = F.when(v < a + guess * width, guess - 1).when((guess < bins - 1) & (v >= a + (guess + 1) * width), guess + 1).otherwise(guess)
    inside = (v >= a) & (v <= b)
    bin_no = F.greatest(F.lit(0), F.least(F.lit(bins - 1), guess)) if clip else F.when(inside, guess)
    hist = rows.withColumn("bin", bin_no).filter(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    # All bins of each key, also those empty on both sides.
    every = stats.select(*keys, "_n_ref", "_n_cur", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = every.join(hist, [*keys, "bin"], "left").na.fill(0, subset=["r", "c"])

    def share(n: str, total: str) -> Column:
        s = F.try_divide(F.col(n).cast("double"), F.col(total).cast("double"))
        return F.when(s == 0, F.lit(EMPTY_SHARE)).otherwise(s)

    p, q = share("r", "_n_ref"), share("c", "_n_cur")
    return full.groupBy(*keys).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def ks_and_wasserstein(long: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Two-sample KS statistic, its asymptotic p and the Wasserstein-1
    distance, all from one table of distinct values with running counts."""
    keys = list(keys)
    counts = sample_counts(long, keys) if counts is None else counts
    seq = Ordered(counts, keys, ["value"], hot_rows=hot_rows, bound=long)
    seq = seq.running({"_fr": ("sum", F.col("r")), "_fc": ("sum", F.col("c"))})

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("_next", F.lead("value").over(w))

    rows = seq.windowed(0, 1, build).result()
    totals = counts.groupBy(*keys).agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    rows = attach_stats(rows, totals, keys)
    gap = F.abs(F.col("_fr") / F.col("n_ref") - F.col("_fc") / F.col("n_cur"))
    out = rows.groupBy(*keys).agg(
        F.max("n_ref").alias("n_ref"),
        F.max("n_cur").alias("n_cur"),
        F.max(gap).alias("ks_stat"),
        F.coalesce(F.sum(gap * (F.col("_next") - F.col("value"))), F.lit(0.0)).alias("wasserstein"),
    )
    n = F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur"))
    return out.withColumn("ks_p", ks_p(F.col("ks_stat"), n.cast("double")))


def drift_report(df: DataFrame, current: Column, columns: Sequence[str], bins: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per column PSI, KS and Wasserstein with alert flags, and whether any
    column alerts."""
    long = two_samples(df, current, columns)
    # Both measures read the same table of distinct values: one scan, one shuffle.
    counts = sample_counts(long, ["column"])
    out = attach_stats(ks_and_wasserstein(long, ["column"], hot_rows, counts), psi_of_counts(counts, ["column"], bins), ["column"])
    out = out.withColumns(
        {
            "psi_alert": F.col("psi") > PSI_ALERT,
            "ks_alert": F.col("ks_p") < KS_P_ALERT,
            "wasserstein_alert": F.col("wasserstein") > WASSERSTEIN_ALERT,
        }
    )
    any_alert = F.col("psi_alert") | F.col("ks_alert") | F.col("wasserstein_alert")
    # One row per column of the schema.
    return out.withColumn("overall_drift", F.bool_or(any_alert).over(Window.partitionBy()))


def trend_of_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Trend of the last three scores before each row."""

    def build(d: DataFrame, w) -> DataFrame:
        a, b, c = (F.lag(score, n).over(w) for n in (3, 2, 1))
        trend = (
            F.when(a.isNull() | b.isNull() | c.isNull(), "insufficient_data")
            .when((b <= a) & (c <= b), "improving")
            .when((b >= a) & (c >= b), "degrading")
            .otherwise("stable")
        )
        return d.withColumn("trend", trend)

    return Ordered(df, keys, order, hot_rows=hot_rows).windowed(3, 0, build).result()


def append_monitoring(record: DataFrame, history_path: str, keys: Sequence[str], order: Sequence[str], score: str) -> DataFrame:
    """Appends monitoring records to the history table and returns the whole
    history with its trends."""
    record.write.mode("append").parquet(history_path)
    history = record.sparkSession.read.parquet(history_path)
    return trend_of_last(history, keys, order, score)


def hourly_monitor(df: DataFrame, ts: str, value: str, alert: Column, loss: Column, window: str = "1 hour") -> DataFrame:
    """Tumbling windows: rows, mean, alerts, loss, drift flag."""
    return df.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_value"),
        F.count_if(alert).alias("alert_count"),
        F.sum(loss).alias("loss"),
    ).select(F.col("w.start").alias("window_start"), "n", "mean_value", "alert_count", "loss", (F.col("alert_count") > 0).alias("drift_detected"))


def monitor_summary(hours: DataFrame) -> DataFrame:
    return hours.agg(
        F.count(F.lit(1)).alias("hours"),
        F.count_if("drift_detected").alias("hours_with_drift"),
        F.avg("alert_count").alias("mean_alerts"),
        F.sum("loss").alias("total_loss"),
    )

"""Time-window features and series work on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import micros, rounded
from ..operators import describe, series, windows
from ..session import table
from .registry import query, r

KEY, ORDER = ["user_id"], ["ts", "event_id"]
W = "PARTITION BY user_id ORDER BY ts, event_id"


def events(spark, sf, *extra):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value", *extra)


def _sql_roll(size: int) -> str:
    w = f"OVER ({W} ROWS {size - 1} PRECEDING)"
    return (
        f"{r(f'avg(value) {w}', 7)} AS value_mean_{size}, {r(f'coalesce(stddev_samp(value) {w}, 0)', 7)} AS value_std_{size}, "
        f"min(value) {w} AS value_min_{size}, max(value) {w} AS value_max_{size}, {r(f'max(value) {w} - min(value) {w}', 7)} AS value_range_{size}"
    )


@query("rolling_stats", f"SELECT event_id, {', '.join(_sql_roll(s) for s in (6, 12, 24))} FROM events")
def rolling_stats(spark, sf):
    out = windows.rolling_features(events(spark, sf), KEY, ORDER, ["value"])
    cols = [
        (rounded(f"value_{s}_{n}", 7) if s in ("mean", "std", "range") else F.col(f"value_{s}_{n}")).alias(f"value_{s}_{n}")
        for n in (6, 12, 24)
        for s in ("mean", "std", "min", "max", "range")
    ]
    return out.select("event_id", *cols)


@query(
    "rolling_stats_full",
    f"""SELECT event_id, CASE WHEN count(value) OVER w = 24 THEN {r('avg(value) OVER w', 7)} END AS value_mean_24,
    CASE WHEN count(value) OVER w = 24 THEN {r('stddev_samp(value) OVER w', 7)} END AS value_std_24,
    CASE WHEN count(value) OVER w = 24 THEN min(value) OVER w END AS value_min_24, CASE WHEN count(value) OVER w = 24 THEN max(value) OVER w END AS value_max_24
    FROM events WINDOW w AS ({W} ROWS 23 PRECEDING)""",
)
def rolling_stats_full(spark, sf):
    out = windows.rolling_features(events(spark, sf), KEY, ORDER, ["value"], [24], full=True, stats=("mean", "std", "min", "max"))
    return out.select("event_id", rounded("value_mean_24", 7).alias("value_mean_24"), rounded("value_std_24", 7).alias("value_std_24"), "value_min_24", "value_max_24")


@query(
    "ewma_halflife",
    f"""WITH h AS (SELECT event_id, list(value) OVER ({W} ROWS UNBOUNDED PRECEDING) AS v FROM events)
    SELECT event_id, {r('list_sum(list_transform(v, lambda x, i: x * pow(pow(0.5, 1 / 12.0), len(v) - i))) / list_sum(list_transform(v, lambda x, i: pow(pow(0.5, 1 / 12.0), len(v) - i)))', 7)} AS value_ewma_12,
    {r('list_sum(list_transform(v, lambda x, i: x * pow(pow(0.5, 1 / 24.0), len(v) - i))) / list_sum(list_transform(v, lambda x, i: pow(pow(0.5, 1 / 24.0), len(v) - i)))', 7)} AS value_ewma_24 FROM h""",
)
def ewma_halflife(spark, sf):
    out = windows.ewm_mean(events(spark, sf), KEY, ORDER, "value")
    return out.select("event_id", rounded("value_ewma_12", 7).alias("value_ewma_12"), rounded("value_ewma_24", 7).alias("value_ewma_24"))


@query(
    "lags",
    f"SELECT event_id, coalesce(lag(value, 1) OVER w, 0) AS value_lag_1, coalesce(lag(value, 6) OVER w, 0) AS value_lag_6, coalesce(lag(value, 12) OVER w, 0) AS value_lag_12 FROM events WINDOW w AS ({W})",
)
def lags(spark, sf):
    out = windows.lag_features(events(spark, sf), KEY, ORDER, ["value"])
    names = ["value_lag_1", "value_lag_6", "value_lag_12"]
    return windows.zero_fill(out, names).select("event_id", *names)


@query(
    "rolling_slope",
    f"""WITH n AS (SELECT *, row_number() OVER ({W}) - 1 AS pos FROM events)
    SELECT event_id, CASE WHEN pos >= 1 THEN {r(f'regr_slope(value, pos) OVER ({W} ROWS 11 PRECEDING)', 7)} END AS value_trend_12 FROM n""",
)
def rolling_slope(spark, sf):
    out = windows.rolling_slope(events(spark, sf), KEY, ORDER, ["value"])
    return out.select("event_id", rounded("value_trend_12", 7).alias("value_trend_12"))


@query(
    "differences",
    f"""SELECT event_id, {r('value - lag(value) OVER w')} AS value_diff1, {r('(value - lag(value) OVER w) - (lag(value) OVER w - lag(value, 2) OVER w)')} AS value_diff2,
    CASE WHEN lag(value) OVER w <> 0 THEN {r('value / lag(value) OVER w - 1', 4)} END AS value_pct_change FROM events WINDOW w AS ({W})""",
)
def differences(spark, sf):
    out = windows.differences(events(spark, sf), KEY, ORDER, ["value"])
    return out.select("event_id", rounded("value_diff1").alias("value_diff1"), rounded("value_diff2").alias("value_diff2"), rounded("value_pct_change", 4).alias("value_pct_change"))


ISLANDS = f"""f AS (SELECT *, value > 60 AS flag, row_number() OVER ({W}) - 1 AS pos FROM events),
  g AS (SELECT *, sum(CAST(NOT flag AS INT)) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM f)"""


@query(
    "anomaly_intervals",
    f"""WITH {ISLANDS} SELECT user_id, min(pos) AS start_index, max(pos) AS end_index, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us,
    CAST(epoch_us(max(ts)) AS BIGINT) AS end_us, count(*) AS duration_rows, max(value) AS max_score, {r('avg(value)')} AS mean_score
    FROM g WHERE flag GROUP BY user_id, run""",
)
def anomaly_intervals(spark, sf):
    out = windows.anomaly_intervals(events(spark, sf), KEY, ORDER, F.col("value") > 60, "value", "ts")
    return out.select(
        "user_id",
        "start_index",
        "end_index",
        micros(out, "start_ts").alias("start_us"),
        micros(out, "end_ts").alias("end_us"),
        "duration_rows",
        "max_score",
        rounded("mean_score").alias("mean_score"),
    )


@query(
    "cumulative_loss",
    f"""SELECT event_id, {r('sum(greatest(0, value - 50)) OVER w', 4)} AS cumulative_loss,
    CAST(sum(CAST(event_type = 'error' AS INT)) OVER w AS BIGINT) AS errors_so_far FROM events WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)""",
)
def cumulative_loss(spark, sf):
    sums = {
        "cumulative_loss": F.greatest(F.lit(0.0), F.col("value") - 50),
        "errors_so_far": (F.col("event_type") == "error").cast("long"),
    }
    out = windows.cumulative(events(spark, sf, "event_type"), KEY, ORDER, sums)
    return out.select("event_id", rounded("cumulative_loss", 4).alias("cumulative_loss"), "errors_so_far")


@query(
    "leaderboard",
    """WITH t AS (SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY user_id)
    SELECT user_id, total, CAST(row_number() OVER (ORDER BY total DESC, user_id) AS INTEGER) AS rank FROM t QUALIFY rank <= 10""",
)
def leaderboard(spark, sf):
    totals = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return windows.leaderboard(totals, "user_id", "total", 10)


@query(
    "last_rows",
    "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10",
)
def last_rows(spark, sf):
    return windows.last_rows(events(spark, sf), KEY, [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "value")


@query(
    "centred_mean",
    f"SELECT event_id, {r(f'avg(value) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)', 7)} AS value_centred_25 FROM events",
)
def centred_mean(spark, sf):
    out = windows.centred_mean(events(spark, sf), KEY, ORDER, "value")
    return out.select("event_id", rounded("value_centred_25", 7).alias("value_centred_25"))


@query(
    "rolling_band",
    f"""WITH b AS (SELECT event_id, value, CASE WHEN count(value) OVER w = 50 THEN avg(value) OVER w END AS m,
      CASE WHEN count(value) OVER w = 50 THEN stddev_samp(value) OVER w END AS s FROM events WINDOW w AS ({W} ROWS 49 PRECEDING))
    SELECT event_id, {r('m + 2 * s', 7)} AS band_upper, {r('m - 2 * s', 7)} AS band_lower, value > m + 2 * s OR value < m - 2 * s AS outside_band FROM b""",
)
def rolling_band(spark, sf):
    out = windows.rolling_band(events(spark, sf), KEY, ORDER, "value")
    return out.select("event_id", rounded("band_upper", 7).alias("band_upper"), rounded("band_lower", 7).alias("band_lower"), "outside_band")


def hourly(spark, sf):
    """Hourly total per event type; hours without events count as zero."""
    cells = series.regular_series(table(spark, sf, "events"), ["event_type"], "ts", {"total": F.sum("value")})
    return cells.na.fill(0.0, subset=["total"])


HOURLY = """c AS (SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS step, sum(value) AS total FROM events GROUP BY 1, 2),
  sp AS (SELECT event_type, unnest(range(min(step), max(step) + 1)) AS step FROM c GROUP BY event_type),
  h AS (SELECT event_type, step, coalesce(total, 0) AS total FROM sp LEFT JOIN c USING (event_type, step)),
  hp AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) - 1 AS pos FROM h)"""


@query("hourly_series", f"WITH {HOURLY} SELECT event_type, step, {r('total', 4)} AS total FROM h")
def hourly_series(spark, sf):
    return hourly(spark, sf).withColumn("total", rounded("total", 4))


@query(
    "seasonal_parts",
    f"""WITH {HOURLY}, t AS (SELECT *, CAST(pos % 24 AS INTEGER) AS phase, (sum(total) OVER (w ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)
      + 0.5 * (lag(total, 12) OVER w + lead(total, 12) OVER w)) / 24 AS trend FROM hp WINDOW w AS (PARTITION BY event_type ORDER BY step)),
    p AS (SELECT event_type, phase, avg(total - trend) AS pm FROM t GROUP BY 1, 2),
    s AS (SELECT event_type, phase, pm - avg(pm) OVER (PARTITION BY event_type) AS seasonal FROM p)
    SELECT event_type, step, phase, {r('trend', 7)} AS trend, {r('seasonal', 7)} AS seasonal, {r('total - trend - seasonal', 7)} AS resid FROM t JOIN s USING (event_type, phase)""",
)
def seasonal_parts(spark, sf):
    out = series.seasonal_parts(hourly(spark, sf), ["event_type"], ["step"], "total")
    return out.select("event_type", "step", "phase", *[rounded(c, 7).alias(c) for c in ("trend", "seasonal", "resid")])


@query(
    "acf",
    f"""WITH {HOURLY}, x AS (SELECT event_type, pos, total - avg(total) OVER (PARTITION BY event_type) AS x FROM hp),
    v AS (SELECT event_type, sum(x * x) AS v FROM x GROUP BY 1),
    l AS (SELECT a.event_type, a.pos - b.pos AS lag, sum(a.x * b.x) AS c FROM x a JOIN x b ON a.event_type = b.event_type AND a.pos - b.pos BETWEEN 0 AND 50 GROUP BY 1, 2)
    SELECT event_type, CAST(lag AS INTEGER) AS lag, {r('c / v')} AS acf FROM l JOIN v USING (event_type)""",
)
def acf(spark, sf):
    return series.autocorrelation(hourly(spark, sf), ["event_type"], ["step"], "total").withColumn("acf", rounded("acf"))


@query(
    "stationarity_view",
    f"""WITH {HOURLY} SELECT event_type, step, CASE WHEN pos >= 23 THEN {r('avg(total) OVER w', 7)} END AS total_mean_24,
    CASE WHEN pos >= 23 THEN {r('stddev_samp(total) OVER w', 7)} END AS total_std_24 FROM hp WINDOW w AS (PARTITION BY event_type ORDER BY step ROWS 23 PRECEDING)""",
)
def stationarity_view(spark, sf):
    out = windows.rolling_features(hourly(spark, sf), ["event_type"], ["step"], ["total"], [24], full=True, stats=("mean", "std"))
    return out.select("event_type", "step", rounded("total_mean_24", 7).alias("total_mean_24"), rounded("total_std_24", 7).alias("total_std_24"))


@query(
    "holdout_tail",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5 AS is_test FROM events",
)
def holdout_tail(spark, sf):
    return series.holdout_tail(events(spark, sf), KEY, ORDER, 5).select("event_id", "is_test")


@query("ar_forecast")
def ar_forecast(spark, sf):
    h = hourly(spark, sf).withColumn("hour", (F.col("step") % 24).cast("double"))
    model = series.ar_fit(h, ["event_type"], ["step"], "total", lags=3, exog=["hour"])
    return series.ar_forecast(model, ["event_type"], 3, 24)


@query(
    "ar_one_lag",
    f"""WITH {HOURLY}, l AS (SELECT event_type, total AS y, lag(total) OVER (PARTITION BY event_type ORDER BY step) AS x FROM hp)
    SELECT event_type, {r('regr_intercept(y, x)', 7)} AS intercept, {r('regr_slope(y, x)', 7)} AS lag_1 FROM l GROUP BY event_type""",
)
def ar_one_lag(spark, sf):
    model = series.ar_fit(hourly(spark, sf), ["event_type"], ["step"], "total", lags=1)
    return model.select("event_type", rounded(F.col("coef")[0], 7).alias("intercept"), rounded(F.col("coef")[1], 7).alias("lag_1"))


@query(
    "forecast_flags",
    f"""WITH {HOURLY}, s AS (SELECT event_type, avg(total) AS m, stddev_samp(total) AS s FROM h GROUP BY 1)
    SELECT event_type, step, abs(total - m) > 2 * s AS drift_flag FROM h JOIN s USING (event_type)""",
)
def forecast_flags(spark, sf):
    h = hourly(spark, sf)
    stats = h.groupBy("event_type").agg(F.avg("total").alias("train_mean"), F.stddev_samp("total").alias("train_std"))
    return series.forecast_flags(h, "total", stats, ["event_type"]).select("event_type", "step", "drift_flag")


@query(
    "partial_dependence",
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      quantile_cont(l_quantity, [i / 19.0 for i in range(0, 20)]) AS g FROM lineitem)
    SELECT CAST(i AS INTEGER) AS point, g[i + 1] AS l_quantity, {r('a + b * g[i + 1]', 3)} AS prediction FROM f, (SELECT unnest(range(0, 20)) AS i)""",
)
def partial_dependence(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    fit = describe.LeastSquares(li, ["l_quantity"], "l_extendedprice")
    out = series.partial_dependence(li, ["l_quantity"], "l_quantity", lambda d: d.withColumn("prediction", fit.predict()))
    return out.withColumn("prediction", rounded("prediction", 3))

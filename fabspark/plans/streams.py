"""Streaming queries: the events table as a file stream, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..session import stream_folder, table
from ..streaming import jobs
from ..streaming.baseline import adaptive_baseline
from ..streaming.sources import Replay, closing, drain, drain_batches, file_stream
from .registry import query, r


def events(spark, sf):
    schema = table(spark, sf, "events").schema
    return file_stream(spark, str(sf), schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _us(name: str):
    # Wall clock of the session zone, as the zone-free table has it.
    zero = F.unix_micros(F.to_timestamp(F.lit("1970-01-01 00:00:00")))
    return F.unix_micros(name) - zero


WEEK = 7 * 24 * 3600


@query(
    "stream_throughput",
    f"""WITH s AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL (10 * k) MINUTE AS start FROM events CROSS JOIN (SELECT unnest(range(0, 6)) AS k))
    SELECT CAST(epoch_us(start) AS BIGINT) AS start_us, count(*) AS n, {r('count(*) / 3600')} AS per_second FROM s GROUP BY start""",
)
def stream_throughput(spark, sf):
    rows, arrivals = closing(events(spark, sf), "ts")
    out = drain(jobs.throughput(rows, "ts", "1 hour", "10 minutes", "10 minutes"), "throughput", arrivals=arrivals)
    return out.select(_us("start").alias("start_us"), "n", rounded("per_second").alias("per_second"))


@query(
    "stream_latency",
    f"""WITH s AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, value FROM events)
    SELECT CAST(epoch_us(start) AS BIGINT) AS start_us, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, {r('avg(value) + 1e-10')} AS avg, max(value) AS max, count(*) AS n FROM s GROUP BY start""",
)
def stream_latency(spark, sf):
    rows, arrivals = closing(events(spark, sf), "ts")
    out = jobs.latency(drain(jobs.latency_counts(rows, "ts", "value", "1 day"), "latency", arrivals=arrivals))
    return out.select(_us("start").alias("start_us"), "p50", "p95", "p99", rounded(F.col("avg") + 1e-10).alias("avg"), "max", "n")


@query(
    "latency_last_rows",
    f"""WITH l AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.95)')} AS p95, {r('quantile_cont(value, 0.99)')} AS p99,
    {r('avg(value)')} AS avg, max(value) AS max, count(*) AS n FROM l""",
)
def latency_last_rows(spark, sf):
    out = jobs.latency_of_last(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")], "value")
    return out.withColumns({c: rounded(c) for c in ("p50", "p95", "p99", "avg")})


@query(
    "stream_error_rate",
    f"""WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type FROM events)
    SELECT CAST(epoch_us(start) AS BIGINT) AS start_us, count(*) AS n, {r("avg(CAST(event_type = 'error' AS DOUBLE))")} AS error_rate FROM s GROUP BY start""",
)
def stream_error_rate(spark, sf):
    rows, arrivals = closing(events(spark, sf), "ts")
    out = drain(jobs.error_rate(rows, "ts", F.col("event_type") == "error"), "errors", arrivals=arrivals)
    return out.select(_us("start").alias("start_us"), "n", rounded("error_rate").alias("error_rate"))


@query(
    "stream_hourly_record",
    f"""WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, value FROM events)
    SELECT CAST(epoch_us(start) AS BIGINT) AS start_us, count(*) AS n, {r('avg(value)')} AS mean_value, count(*) FILTER (value > 100) AS alert_count, count(*) FILTER (value > 100) > 0 AS drift_detected
    FROM s GROUP BY start""",
)
def stream_hourly_record(spark, sf):
    rows, arrivals = closing(events(spark, sf), "ts")
    out = drain(jobs.hourly_record(rows, "ts", "value", F.col("value") > 100), "hourly", arrivals=arrivals)
    return out.select(_us("start").alias("start_us"), "n", rounded("mean_value").alias("mean_value"), "alert_count", "drift_detected")


@query(
    "stream_sessions",
    f"""WITH f AS (SELECT event_type, ts, value, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) > INTERVAL 2 HOUR AS brk FROM events WHERE value > 60),
    g AS (SELECT *, sum(CAST(coalesce(brk, true) AS INT)) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT event_type, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts) + INTERVAL 2 HOUR) AS BIGINT) AS end_us, count(*) AS n, max(value) AS max_score, {r('avg(value)')} AS mean_score
    FROM g GROUP BY event_type, k""",
)
def stream_sessions(spark, sf):
    rows, arrivals = closing(events(spark, sf), "ts", value=1e9)
    out = drain(jobs.anomaly_sessions(rows, ["event_type"], "ts", F.col("value") > 60, "value", "2 hours"), "sessions", arrivals=arrivals)
    return out.select("event_type", _us("start").alias("start_us"), _us("end").alias("end_us"), "n", "max_score", rounded("mean_score").alias("mean_score"))


INSPECT = """i AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'scratch' WHEN 2 THEN 'particle' WHEN 3 THEN 'pattern' ELSE 'unknown' END AS defect_type, (event_id % 100) / 100.0 AS confidence FROM events)"""


def inspections(spark, sf):
    rows = jobs.inspection_results(events(spark, sf), F.col("user_id") % 5, (F.col("event_id") % 100) / 100.0)
    return rows.select("event_id", "defect_type", "confidence", "action_required")


@query("stream_inspection", f"WITH {INSPECT} SELECT event_id, defect_type, {r('CAST(confidence AS DOUBLE)')} AS confidence, confidence > 0.7 AND defect_type <> 'normal' AS action_required FROM i")
def stream_inspection(spark, sf):
    return drain(inspections(spark, sf), "inspection").withColumn("confidence", rounded("confidence"))


@query(
    "stream_routes",
    f"""WITH {INSPECT} SELECT event_id, CASE WHEN defect_type IN ('scratch', 'particle') AND confidence > 0.8 THEN 'hold' WHEN confidence < 0.6 THEN 'review' ELSE 'pass' END AS route FROM i""",
)
def stream_routes(spark, sf):
    folder = jobs.write_by_route(jobs.routes(inspections(spark, sf)), "routes", "route")
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").select("event_id", F.col("route").cast("string").alias("route"))


@query("stream_sla_breaches", "SELECT event_id, value FROM events WHERE value > 50")
def stream_sla_breaches(spark, sf):
    return drain(jobs.sla_breaches(events(spark, sf), "value").select("event_id", "value"), "sla")


# A cached score holds for six hours here: events are minutes apart.
TTL = 6 * 3600


@query(
    "stream_dedup",
    f"""WITH RECURSIVE k AS (SELECT event_id, event_type AS k_type, CAST(round(value / 10) AS BIGINT) AS k_value, CAST(epoch_us(ts) AS BIGINT) AS t, value / 60 AS s,
      row_number() OVER (PARTITION BY event_type, CAST(round(value / 10) AS BIGINT) ORDER BY ts, event_id) AS p FROM events),
    c AS (SELECT *, t AS since, s AS score, false AS cache_hit FROM k WHERE p = 1 UNION ALL
      SELECT k.*, CASE WHEN k.t - since < {TTL * 1_000_000} THEN since ELSE k.t END, CASE WHEN k.t - since < {TTL * 1_000_000} THEN score ELSE k.s END, k.t - since < {TTL * 1_000_000}
      FROM c JOIN k ON k.k_type = c.k_type AND k.k_value = c.k_value AND k.p = c.p + 1)
    SELECT k_type, k_value, event_id, {r('score')} AS score, cache_hit FROM c""",
)
def stream_dedup(spark, sf):
    """Rounded keys answered from a cache of scores, over micro-batches of two weeks."""
    source = Replay(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", 2 * WEEK)
    keys = {"k_type": F.col("event_type"), "k_value": F.round(F.col("value") / 10).cast("long")}
    with jobs.with_state_store(spark):
        out = drain(jobs.cached_scores(source.stream(), keys, "ts", "event_id", F.col("value") / 60, TTL), "cache", arrivals=source)
    return out.select(*keys, "event_id", rounded("score").alias("score"), "cache_hit")


@query("stream_running_totals", "SELECT count(*) AS processed, count(*) FILTER (value > 60) AS anomalies FROM events")
def stream_running_totals(spark, sf):
    def handle(batch, batch_id, folder):
        batch.write.mode("overwrite").parquet(f"{folder}/{batch_id}")
        batch.write.mode("overwrite").parquet(f"{folder}/latest")

    folder = drain_batches(jobs.running_totals(events(spark, sf), F.col("value") > 60), "totals", handle, mode="complete")
    return spark.read.parquet(f"{folder}/latest")


BASELINE = """w AS (SELECT *, count(*) OVER f AS n, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s, median(value) OVER f AS med, mad(value) OVER f AS mad
      FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)),
    fl AS (SELECT *, n >= 100 AS has_baseline, n >= 100 AND coalesce(abs(value - m) / nullif(s, 0) > 3, false) AS zscore_flag,
      n >= 100 AND coalesce(0.6745 * abs(value - med) / nullif(mad, 0) > 3.5, false) AS modified_zscore_flag FROM w)"""


def _baseline(spark, sf):
    source = Replay(table(spark, sf, "events"), "ts", WEEK)
    return adaptive_baseline(source.stream(), ["event_type"], "ts", "value", "event_id", arrivals=source)


@query(
    "stream_baseline",
    f"""WITH {BASELINE} SELECT event_id, event_type, {r('value')} AS value, n AS base_n, {r('m + 1e-10')} AS base_mean, {r('s + 1e-10')} AS base_std, {r('CAST(med AS DOUBLE)')} AS base_median, {r('CAST(mad AS DOUBLE)')} AS base_mad,
    has_baseline, zscore_flag, modified_zscore_flag FROM fl""",
)
def stream_baseline(spark, sf):
    # Means of hundredths lie on ties of the rounding; the shift parts them alike in both engines.
    stats = {c: rounded(F.col(c) + 1e-10 if c in ("base_mean", "base_std") else c) for c in ("value", "base_mean", "base_std", "base_median", "base_mad")}
    return _baseline(spark, sf).withColumns(stats).select("event_id", "event_type", *stats, "base_n", "has_baseline", "zscore_flag", "modified_zscore_flag")


@query(
    "stream_alerts",
    f"""WITH {BASELINE}, v AS (SELECT *, (CAST(zscore_flag AS INT) + CAST(modified_zscore_flag AS INT)) / 2 AS c FROM fl)
    SELECT event_id, event_type, {r('c')} AS consensus_score, CASE WHEN c >= 0.8 THEN 'CRITICAL' ELSE 'WARNING' END AS level,
    array_to_string(list_filter([CASE WHEN zscore_flag THEN 'zscore' END, CASE WHEN modified_zscore_flag THEN 'modified_zscore' END], lambda m: m IS NOT NULL), ',') AS methods,
    CASE WHEN c >= 0.8 THEN 'IMMEDIATE_INVESTIGATION' ELSE 'MONITOR_CLOSELY' END AS action FROM v WHERE c >= 0.8 * 0.6""",
)
def stream_alerts(spark, sf):
    found = jobs.route_alerts(_baseline(spark, sf), ["zscore_flag", "modified_zscore_flag"])
    out = stream_folder(spark, "alerts")
    found.write.partitionBy("level").parquet(out)
    back = spark.read.schema(found.schema).parquet(out)
    return back.select("event_id", "event_type", rounded("consensus_score").alias("consensus_score"), F.col("level").cast("string").alias("level"), F.array_join("methods", ",").alias("methods"), F.col("recommendation.action").alias("action"))


def _scorer(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    train = table(spark, sf, "events").select("value", F.hour("ts").cast("double").alias("hour"), (F.col("event_type") == "error").cast("double").alias("label"))
    stages = [VectorAssembler(inputCols=["value", "hour"], outputCol="features"), LogisticRegression(maxIter=20)]
    return Pipeline(stages=stages).fit(train)


@query("stream_score")
def stream_score(spark, sf):
    rows = events(spark, sf).withColumn("hour", F.hour("ts").cast("double"))
    out = jobs.score_rows(rows, _scorer(spark, sf)).select("event_id", "prediction", "confidence")
    return drain(out, "score")


@query("stream_score_micro_batches")
def stream_score_micro_batches(spark, sf):
    source = Replay(table(spark, sf, "events"), "ts", WEEK)
    rows = source.stream().withColumn("hour", F.hour("ts").cast("double"))
    return drain(jobs.score_rows(rows, _scorer(spark, sf)).select("event_id", "prediction", "confidence"), "score-batches", arrivals=source)

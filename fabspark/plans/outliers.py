"""Outlier detection and drift on lineitem, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import micros, rounded
from ..operators import drift
from ..operators import outliers as o
from ..session import stream_folder, table
from .registry import query, r

ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID_SQL = ", ".join(ID)
COLS = ["l_quantity", "l_extendedprice"]


def measures(spark, sf, *extra):
    return table(spark, sf, "lineitem").select(*ID, *COLS, *extra)


def _run(det, rows):
    return det.apply(rows, det.fit(rows))


Z_SQL = """z AS (SELECT lineitem.*, abs(l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS z1,
   abs(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS z2 FROM lineitem)"""
MZ_SQL = """md AS (SELECT median(l_quantity) AS m1, median(l_extendedprice) AS m2 FROM lineitem),
  ad AS (SELECT median(abs(l_quantity - m1)) AS a1, median(abs(l_extendedprice - m2)) AS a2 FROM lineitem, md),
  mz AS (SELECT lineitem.*, 0.6745 * abs(l_quantity - m1) / a1 AS y1, 0.6745 * abs(l_extendedprice - m2) / a2 AS y2 FROM lineitem, md, ad)"""
IQR_SQL = """q AS (SELECT quantile_cont(l_quantity, 0.25) AS a1, quantile_cont(l_quantity, 0.75) AS b1,
    quantile_cont(l_extendedprice, 0.25) AS a2, quantile_cont(l_extendedprice, 0.75) AS b2 FROM lineitem),
  fence AS (SELECT lineitem.*, a1 - 0.5 * (b1 - a1) AS lo1, b1 + 0.5 * (b1 - a1) AS hi1, a2 - 0.5 * (b2 - a2) AS lo2, b2 + 0.5 * (b2 - a2) AS hi2 FROM lineitem, q)"""


@query("zscore", f"WITH {Z_SQL} SELECT {ID_SQL}, z1 > 1.7 OR z2 > 1.7 AS zscore_flag, {r('greatest(z1, z2)')} AS zscore_score FROM z")
def zscore(spark, sf):
    out = _run(o.ZScore(COLS, threshold=1.7), measures(spark, sf))
    return out.select(*ID, "zscore_flag", rounded("zscore_score").alias("zscore_score"))


@query("modified_zscore", f"WITH {MZ_SQL} SELECT {ID_SQL}, y1 > 1.3 OR y2 > 1.3 AS modified_zscore_flag, {r('greatest(y1, y2)')} AS modified_zscore_score FROM mz")
def modified_zscore(spark, sf):
    out = _run(o.ModifiedZScore(COLS, threshold=1.3), measures(spark, sf))
    return out.select(*ID, "modified_zscore_flag", rounded("modified_zscore_score").alias("modified_zscore_score"))


@query(
    "iqr",
    f"""WITH {IQR_SQL} SELECT {ID_SQL}, l_quantity < lo1 OR l_quantity > hi1 OR l_extendedprice < lo2 OR l_extendedprice > hi2 AS iqr_flag,
    {r('greatest(0, lo1 - l_quantity, l_quantity - hi1, lo2 - l_extendedprice, l_extendedprice - hi2)', 3)} AS iqr_score FROM fence""",
)
def iqr(spark, sf):
    out = _run(o.IQRFence(COLS, k=0.5), measures(spark, sf))
    return out.select(*ID, "iqr_flag", rounded("iqr_score", 3).alias("iqr_score"))


MAHA_SQL = """s AS (SELECT avg(l_quantity) AS m1, avg(l_extendedprice) AS m2, var_samp(l_quantity) AS v1, var_samp(l_extendedprice) AS v2,
    covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem),
  dist AS (SELECT lineitem.*, sqrt(((l_quantity - m1) * (l_quantity - m1) * v2 - 2 * c * (l_quantity - m1) * (l_extendedprice - m2)
    + (l_extendedprice - m2) * (l_extendedprice - m2) * v1) / (v1 * v2 - c * c)) AS dist FROM lineitem, s)"""


@query(
    "mahalanobis",
    f"WITH {MAHA_SQL}, cut AS (SELECT quantile_cont(dist, 0.95) AS cut FROM dist) SELECT {ID_SQL}, dist > cut AS mahalanobis_flag, {r('dist')} AS mahalanobis_score FROM dist, cut",
)
def mahalanobis(spark, sf):
    out = _run(o.Mahalanobis(COLS), measures(spark, sf))
    return out.select(*ID, "mahalanobis_flag", rounded("mahalanobis_score").alias("mahalanobis_score"))


RECIPE_SQL = """g AS (SELECT l_suppkey AS k, count(*) AS n, avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1,
   avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2 FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 590),
  rz AS (SELECT lineitem.*, coalesce(greatest(abs(l_quantity - m1) / s1, abs(l_extendedprice - m2) / s2), 0) AS score,
   coalesce(abs(l_quantity - m1) / s1 > 1.8 OR abs(l_extendedprice - m2) / s2 > 1.8, false) AS flag FROM lineitem LEFT JOIN g ON l_suppkey = k)"""


def recipe_detector():
    return o.ZScore(COLS, ["l_suppkey"], min_rows=590, threshold=1.8)


@query("recipe_aware", f"WITH {RECIPE_SQL} SELECT {ID_SQL}, flag AS zscore_flag, {r('score')} AS zscore_score FROM rz")
def recipe_aware(spark, sf):
    out = _run(recipe_detector(), measures(spark, sf))
    return out.select(*ID, "zscore_flag", rounded("zscore_score").alias("zscore_score"))


@query(
    "recipe_breakdown",
    f"""WITH {RECIPE_SQL} SELECT l_suppkey, count(*) FILTER (flag) AS n_outliers, count(*) AS n_samples, {r('count(*) FILTER (flag) / count(*) * 100')} AS outlier_percentage
    FROM rz GROUP BY l_suppkey""",
)
def recipe_breakdown(spark, sf):
    out = _run(recipe_detector(), measures(spark, sf))
    return o.group_breakdown(out, ["l_suppkey"], "zscore_flag").withColumn("outlier_percentage", rounded("outlier_percentage"))


@query("unfitted_recipes", "SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY l_suppkey HAVING count(*) < 590")
def unfitted_recipes(spark, sf):
    rows = measures(spark, sf)
    return o.unfitted_groups(rows, "l_suppkey", recipe_detector().fit(rows))


@query(
    "recipe_mahalanobis",
    f"""WITH s AS (SELECT l_suppkey, avg(l_quantity) AS m1, avg(l_extendedprice) AS m2, var_samp(l_quantity) AS v1, var_samp(l_extendedprice) AS v2,
      covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY l_suppkey),
    d AS (SELECT l_suppkey, sqrt((pow(l_quantity - m1, 2) * v2 - 2 * c * (l_quantity - m1) * (l_extendedprice - m2) + pow(l_extendedprice - m2, 2) * v1) / (v1 * v2 - c * c)) AS dist FROM lineitem JOIN s USING (l_suppkey)),
    q AS (SELECT l_suppkey, quantile_cont(dist, 0.95) AS cut FROM d GROUP BY l_suppkey)
    SELECT l_suppkey, count(*) FILTER (dist > cut) AS n_outliers, count(*) AS n_samples, {r('count(*) FILTER (dist > cut) / count(*) * 100')} AS outlier_percentage FROM d JOIN q USING (l_suppkey) GROUP BY l_suppkey""",
)
def recipe_mahalanobis(spark, sf):
    out = _run(o.Mahalanobis(COLS, ["l_suppkey"]), measures(spark, sf))
    return o.group_breakdown(out, ["l_suppkey"], "mahalanobis_flag").withColumn("outlier_percentage", rounded("outlier_percentage"))


FLAGS_SQL = f"""{MZ_SQL}, fl AS (SELECT mz.*, coalesce(abs(mz.l_quantity - avg(mz.l_quantity) OVER ()) / stddev_samp(mz.l_quantity) OVER () > 1.6, false)
      OR abs(mz.l_extendedprice - avg(mz.l_extendedprice) OVER ()) / stddev_samp(mz.l_extendedprice) OVER () > 1.6 AS f1,
    y1 > 1.25 OR y2 > 1.25 AS f2,
    l_quantity < a - 0.4 * (b - a) OR l_quantity > b + 0.4 * (b - a) AS f3
  FROM mz, (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem))"""
FLAGS = ["zscore_flag", "modified_zscore_flag", "iqr_flag"]


def flagged(spark, sf):
    rows = measures(spark, sf, "l_discount", "l_tax")
    for det in (o.ZScore(COLS, threshold=1.6), o.ModifiedZScore(COLS, threshold=1.25), o.IQRFence(["l_quantity"], k=0.4)):
        rows = det.apply(rows, det.fit(measures(spark, sf)))
    return rows


@query(
    "consensus",
    f"""WITH {FLAGS_SQL}, v AS (SELECT *, CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT) AS votes FROM fl)
    SELECT {ID_SQL}, votes, {r('votes / 3 * 100')} AS vote_percentage, votes >= 1.5 AS consensus FROM v""",
)
def consensus(spark, sf):
    out = o.consensus(flagged(spark, sf), FLAGS)
    return out.select(*ID, "votes", rounded("vote_percentage").alias("vote_percentage"), "consensus")


@query(
    "physics_rules",
    f"""WITH {FLAGS_SQL}, q AS (SELECT quantile_cont(l_quantity, 0.9) AS qh, quantile_cont(l_quantity, 0.1) AS ql, quantile_cont(l_discount, 0.1) AS dl,
      quantile_cont(l_tax, 0.9) AS th FROM lineitem),
    x AS (SELECT fl.*, l_quantity > qh AND l_discount < dl AS r1, l_tax > th AND l_quantity < ql AS r2,
      CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT) >= 1.5 AS c FROM fl, q)
    SELECT {ID_SQL}, r1 AS rule_temperature_pressure, r2 AS rule_power_temperature, c OR r1 OR r2 AS validated FROM x""",
)
def physics_rules(spark, sf):
    rows = o.consensus(flagged(spark, sf), FLAGS)
    rules = {"temperature_pressure": ("l_quantity", "l_discount"), "power_temperature": ("l_tax", "l_quantity")}
    out = o.validated(o.physics_rules(rows, rules), "consensus", list(rules))
    return out.select(*ID, "rule_temperature_pressure", "rule_power_temperature", "validated")


@query(
    "alerts",
    f"""WITH {FLAGS_SQL}, v AS (SELECT *, (CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT)) / 3 AS s FROM fl)
    SELECT {ID_SQL}, {r('s')} AS consensus_score, CASE WHEN s >= 0.8 THEN 'CRITICAL' ELSE 'WARNING' END AS level,
    array_to_string(list_filter([CASE WHEN f1 THEN 'zscore' END, CASE WHEN f2 THEN 'modified_zscore' END, CASE WHEN f3 THEN 'iqr' END], lambda m: m IS NOT NULL), ',') AS methods,
    CASE WHEN s >= 0.8 THEN 'IMMEDIATE_INVESTIGATION' ELSE 'MONITOR_CLOSELY' END AS action FROM v WHERE s >= 0.8 * 0.6""",
)
def alerts(spark, sf):
    out = o.alerts(flagged(spark, sf), FLAGS)
    return out.select(*ID, rounded("consensus_score").alias("consensus_score"), "level", F.array_join("methods", ",").alias("methods"), F.col("recommendation.action").alias("action"))


SCORED = "sc AS (SELECT event_id, ts, 0.2 - value / 60 AS score FROM events)"


@query(
    "alert_summary",
    f"""WITH {SCORED} SELECT count(*) AS total_samples, count(*) FILTER (score < 0) AS detected_anomalies,
    count(*) FILTER (score <= -0.5 AND score > -1) AS warning_alerts, count(*) FILTER (score <= -1) AS critical_alerts,
    {r('count(*) FILTER (score < 0) / count(*)')} AS anomaly_rate, {r('avg(score)')} AS avg_anomaly_score FROM sc""",
)
def alert_summary(spark, sf):
    rows = table(spark, sf, "events").withColumn("score", 0.2 - F.col("value") / 60)
    out = o.alert_summary(o.score_alerts(rows, "score"), "score", F.col("score") < 0)
    return out.withColumns({"anomaly_rate": rounded("anomaly_rate"), "avg_anomaly_score": rounded("avg_anomaly_score")})


@query(
    "recent_alerts",
    f"""WITH {SCORED} SELECT event_id, CASE WHEN score <= -1 THEN 'critical' ELSE 'warning' END AS alert_level FROM sc
    WHERE score <= -0.5 AND ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR""",
)
def recent_alerts(spark, sf):
    rows = table(spark, sf, "events").withColumn("score", 0.2 - F.col("value") / 60)
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return o.recent_alerts(o.score_alerts(rows, "score"), "ts", as_of, 24).select("event_id", "alert_level")


@query("isolation_forest")
def isolation_forest(spark, sf):
    rows = measures(spark, sf, "l_discount", "l_tax")
    det = o.IsolationForest([*COLS, "l_discount", "l_tax"], ID)
    return det.fit(rows).apply(rows)


@query("gaussian_mixture_outliers")
def gaussian_mixture_outliers(spark, sf):
    return o.mixture_outliers(measures(spark, sf), COLS)


@query("context_zscore")
def context_zscore(spark, sf):
    return o.context_zscore(measures(spark, sf, "l_discount"), ["l_quantity", "l_discount"], "l_extendedprice")


DRIFT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CURRENT = "1998-06-01 00:00:00"
LONG_SQL = (
    "v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x, l_shipdate >= TIMESTAMP '1998-06-01' AS cur FROM lineitem" for c in DRIFT_COLS)
    + ")"
)
PSI_SQL = f"""st AS (SELECT "column", min(x) FILTER (NOT cur) AS a, max(x) FILTER (NOT cur) AS b, count(*) FILTER (NOT cur) AS nr, count(*) FILTER (cur) AS nc FROM v GROUP BY "column"),
  bn AS (SELECT "column", unnest(range(0, 10)) AS i, a, b, nr, nc FROM st),
  hs AS (SELECT bn."column", i, nr, nc, count(*) FILTER (NOT cur) AS hr, count(*) FILTER (cur) AS hc
    FROM bn LEFT JOIN v ON v."column" = bn."column" AND x >= a + i * ((b - a) / 10) AND (x < a + (i + 1) * ((b - a) / 10) OR (i = 9 AND x <= b)) GROUP BY ALL),
  pr AS (SELECT "column", CASE WHEN hr = 0 THEN 0.0001 ELSE hr / nr END AS p, CASE WHEN hc = 0 THEN 0.0001 ELSE hc / nc END AS c FROM hs),
  psi AS (SELECT "column", sum((c - p) * ln(c / p)) AS psi FROM pr GROUP BY "column")"""
KS_SQL = """ct AS (SELECT "column", x, count(*) FILTER (NOT cur) AS hr, count(*) FILTER (cur) AS hc FROM v GROUP BY "column", x),
  cf AS (SELECT "column", x, sum(hr) OVER w AS fr, sum(hc) OVER w AS fc, lead(x) OVER (PARTITION BY "column" ORDER BY x) AS nx FROM ct
    WINDOW w AS (PARTITION BY "column" ORDER BY x ROWS UNBOUNDED PRECEDING)),
  nn AS (SELECT "column", sum(hr) AS n_ref, sum(hc) AS n_cur FROM ct GROUP BY "column"),
  ks AS (SELECT "column", max(n_ref) AS n_ref, max(n_cur) AS n_cur, max(abs(fr / n_ref - fc / n_cur)) AS ks, coalesce(sum(abs(fr / n_ref - fc / n_cur) * (nx - x)), 0) AS wd
    FROM cf JOIN nn USING ("column") GROUP BY "column")"""


def drift_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_shipdate", *DRIFT_COLS)
    return li, F.col("l_shipdate") >= F.lit(CURRENT).cast("timestamp_ntz")


@query("psi", f'WITH {LONG_SQL}, {PSI_SQL} SELECT "column", {r("psi", 8)} AS psi FROM psi')
def psi(spark, sf):
    li, cur = drift_rows(spark, sf)
    return drift.psi(drift.two_samples(li, cur, DRIFT_COLS), ["column"]).withColumn("psi", rounded("psi", 8))


@query(
    "ks_and_wasserstein",
    f'WITH {LONG_SQL}, {KS_SQL} SELECT "column", CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, {r("ks", 8)} AS ks_stat, {r("wd", 5)} AS wasserstein FROM ks',
)
def ks_and_wasserstein(spark, sf):
    li, cur = drift_rows(spark, sf)
    out = drift.ks_and_wasserstein(drift.two_samples(li, cur, DRIFT_COLS), ["column"])
    return out.select("column", "n_ref", "n_cur", rounded("ks_stat", 8).alias("ks_stat"), rounded("wasserstein", 5).alias("wasserstein"))


@query(
    "drift_report",
    f"""WITH {LONG_SQL}, {PSI_SQL}, {KS_SQL}, k AS (SELECT *, ks * sqrt(n_ref * n_cur / (n_ref + n_cur)) AS z FROM ks),
    p AS (SELECT "column", ks, wd, CASE WHEN z < 0.2 THEN 1.0
        WHEN z < 1.18 THEN 1 - sqrt(2 * pi()) / z * list_sum(list_transform(range(1, 20), lambda j: exp(-pow(2 * j - 1, 2) * pow(pi(), 2) / (8 * z * z))))
        ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j: pow(-1, j - 1) * exp(-2.0 * j * j * z * z))))) END AS ks_p FROM k),
    a AS (SELECT "column", psi, ks, ks_p, wd, psi > 0.2 AS psi_alert, ks_p < 0.05 AS ks_alert, wd > 0.5 AS wasserstein_alert FROM p JOIN psi USING ("column"))
    SELECT "column", {r('psi', 8)} AS psi, {r('ks', 8)} AS ks_stat, {r('ks_p')} AS ks_p, {r('wd', 5)} AS wasserstein, psi_alert, ks_alert, wasserstein_alert,
      bool_or(psi_alert OR ks_alert OR wasserstein_alert) OVER () AS overall_drift FROM a""",
)
def drift_report(spark, sf):
    li, cur = drift_rows(spark, sf)
    out = drift.drift_report(li, cur, DRIFT_COLS).drop("n_ref", "n_cur")
    return out.withColumns({"psi": rounded("psi", 8), "ks_stat": rounded("ks_stat", 8), "ks_p": rounded("ks_p"), "wasserstein": rounded("wasserstein", 5)})


TREND_SQL = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(avg(value), 4) AS score FROM events GROUP BY 1, 2),
    l AS (SELECT *, lag(score, 3) OVER w AS a, lag(score, 2) OVER w AS b, lag(score, 1) OVER w AS c FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', day) AS INTEGER) AS day_no,
      CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'insufficient_data' WHEN b <= a AND c <= b THEN 'improving' WHEN b >= a AND c >= b THEN 'degrading' ELSE 'stable' END AS trend FROM l"""


def daily_scores(spark, sf):
    ev = table(spark, sf, "events").withColumn("day_no", F.unix_date(F.col("ts").cast("date")))
    return ev.groupBy("user_id", "day_no").agg(F.round(F.avg("value"), 4).alias("score"))


@query("trend_last3", TREND_SQL)
def trend_last3(spark, sf):
    return drift.trend_of_last(daily_scores(spark, sf), ["user_id"], ["day_no"], "score").select("user_id", "day_no", "trend")


@query("monitoring_history", TREND_SQL)
def monitoring_history(spark, sf):
    """The same trends over a history table that grows by appended records."""
    days, path = daily_scores(spark, sf), stream_folder(spark, "monitoring")
    for even in (True, False):
        part = days.filter((F.col("day_no") % 2 == 0) == even)
        history = drift.append_monitoring(part, path, ["user_id"], ["day_no"], "score")
    return history.select("user_id", "day_no", "trend")


MONITOR = """hm AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, count(*) AS n, avg(value) AS mean_value, count(*) FILTER (value > 100) AS alert_count,
  sum(greatest(0, value - 50)) AS loss FROM events GROUP BY 1)"""


def monitor(spark, sf):
    return drift.hourly_monitor(table(spark, sf, "events"), "ts", "value", F.col("value") > 100, F.greatest(F.lit(0.0), F.col("value") - 50))


@query(
    "hourly_monitor",
    f"WITH {MONITOR} SELECT CAST(epoch_us(h) AS BIGINT) AS window_us, n, {r('mean_value')} AS mean_value, alert_count, {r('loss', 4)} AS loss, alert_count > 0 AS drift_detected FROM hm",
)
def hourly_monitor(spark, sf):
    out = monitor(spark, sf)
    return out.select(micros(out, "window_start").alias("window_us"), "n", rounded("mean_value").alias("mean_value"), "alert_count", rounded("loss", 4).alias("loss"), "drift_detected")


@query(
    "monitor_summary",
    f"WITH {MONITOR} SELECT count(*) AS hours, count(*) FILTER (alert_count > 0) AS hours_with_drift, {r('avg(alert_count)')} AS mean_alerts, {r('sum(loss)', 3)} AS total_loss FROM hm",
)
def monitor_summary(spark, sf):
    return drift.monitor_summary(monitor(spark, sf)).withColumns({"mean_alerts": rounded("mean_alerts"), "total_loss": rounded("total_loss", 3)})

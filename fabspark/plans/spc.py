"""Capability, yield and control charts on lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import capability as cap
from ..operators import spc
from ..operators.ordered import POS
from ..session import table
from .common import LINE_ORDER, LINE_ORDER_SQL, QUANTITY, lineitem, phi_sql
from .registry import query, r

SIZE = 5
SUBGROUPS_SQL = f"""subs AS (
  SELECT l_suppkey, subgroup, count(*) AS n, avg(l_quantity) AS xbar,
         max(l_quantity) - min(l_quantity) AS rng
  FROM (SELECT l_suppkey, l_quantity,
               (row_number() OVER (PARTITION BY l_suppkey ORDER BY {LINE_ORDER_SQL}) - 1) // {SIZE} AS subgroup
        FROM lineitem)
  GROUP BY l_suppkey, subgroup HAVING count(*) = {SIZE})"""
LIMITS_SQL = """SELECT l_suppkey, count(*) AS n_subgroups, avg(xbar) AS xbar_center, avg(rng) AS r_center,
         avg(xbar) + 0.577 * avg(rng) AS xbar_ucl, avg(xbar) - 0.577 * avg(rng) AS xbar_lcl,
         2.114 * avg(rng) AS r_ucl, 0.0 * avg(rng) AS r_lcl"""
# Phase I is every supplier's first 40 subgroups.
PHASE1_ROWS = 40


def subgroups(spark, sf):
    rows = spc.consecutive_subgroups(lineitem(spark, sf), ["l_suppkey"], LINE_ORDER, SIZE)
    return spc.subgroup_stats(rows, ["l_suppkey"], "l_quantity", SIZE)


@query(
    "spc_subgroups",
    f"WITH {SUBGROUPS_SQL} SELECT l_suppkey, CAST(subgroup AS BIGINT) AS subgroup, n, {r('xbar')} AS xbar, rng AS range FROM subs",
)
def spc_subgroups(spark, sf):
    return subgroups(spark, sf).withColumn("xbar", rounded("xbar"))


@query(
    "spc_xbar_r_limits",
    f"""WITH {SUBGROUPS_SQL}, lims AS ({LIMITS_SQL} FROM subs GROUP BY l_suppkey)
    SELECT l_suppkey, n_subgroups, {r('xbar_center')} AS xbar_center, {r('r_center')} AS r_center,
    {r('xbar_ucl')} AS xbar_ucl, {r('xbar_lcl')} AS xbar_lcl, {r('r_ucl')} AS r_ucl, {r('r_lcl')} AS r_lcl FROM lims""",
)
def spc_xbar_r_limits(spark, sf):
    out = spc.control_limits(subgroups(spark, sf), ["l_suppkey"], SIZE)
    names = ["xbar_center", "r_center", "xbar_ucl", "xbar_lcl", "r_ucl", "r_lcl"]
    return out.withColumns({n: rounded(n) for n in names})


def _rules_sql(chart: str, value: str) -> str:
    w = "PARTITION BY l_suppkey ORDER BY subgroup"
    return f"""(SELECT l_suppkey, subgroup, '{chart}' AS chart, {value} AS value, unnest(list_filter([
      CASE WHEN {value} > {chart}_ucl OR {value} < {chart}_lcl THEN 1 END,
      CASE WHEN pos >= 8 AND (min(CAST({value} > {chart}_center AS INT)) OVER (w ROWS 8 PRECEDING) = 1
                           OR min(CAST({value} < {chart}_center AS INT)) OVER (w ROWS 8 PRECEDING) = 1) THEN 2 END,
      CASE WHEN pos >= 5 AND (min(CAST(d > 0 AS INT)) OVER (w ROWS 4 PRECEDING) = 1
                           OR min(CAST(d < 0 AS INT)) OVER (w ROWS 4 PRECEDING) = 1) THEN 3 END,
      CASE WHEN pos >= 13 AND max(d * pd) OVER (w ROWS 11 PRECEDING) < 0 THEN 4 END,
      CASE WHEN pos >= 2 AND sum(CAST({value} > {chart}_center + 2 * ({chart}_ucl - {chart}_center) / 3
             OR {value} < {chart}_center - 2 * ({chart}_center - {chart}_lcl) / 3 AS INT)) OVER (w ROWS 2 PRECEDING) >= 2 THEN 5 END,
      CASE WHEN pos >= 4 AND sum(CAST({value} > {chart}_center + ({chart}_ucl - {chart}_center) / 3
             OR {value} < {chart}_center - ({chart}_center - {chart}_lcl) / 3 AS INT)) OVER (w ROWS 4 PRECEDING) >= 4 THEN 6 END
      ], lambda q: q IS NOT NULL)) AS rule
     FROM (SELECT *, lag(d) OVER ({w}) AS pd FROM (
             SELECT p2.*, row_number() OVER ({w}) - 1 AS pos, {value} - lag({value}) OVER ({w}) AS d FROM p2))
     WINDOW w AS ({w}))"""


SIGNALS_SQL = f"""{SUBGROUPS_SQL}, lims AS ({LIMITS_SQL} FROM subs WHERE subgroup < {PHASE1_ROWS} GROUP BY l_suppkey),
  p2 AS (SELECT subs.*, lims.* EXCLUDE (l_suppkey) FROM subs LEFT JOIN lims USING (l_suppkey) WHERE subgroup >= {PHASE1_ROWS}),
  sig AS ({_rules_sql('xbar', 'xbar')} UNION ALL {_rules_sql('r', 'rng')})"""


@query(
    "spc_signals",
    f"WITH {SIGNALS_SQL} SELECT l_suppkey, CAST(subgroup AS BIGINT) AS subgroup, chart, {r('value')} AS value, rule FROM sig",
)
def spc_signals(spark, sf):
    subs = subgroups(spark, sf)
    out = spc.phase_signals(subs, ["l_suppkey"], SIZE, F.col("subgroup") < PHASE1_ROWS, bound=lineitem(spark, sf))
    return out.withColumn("value", rounded("value")).drop("signal")


@query(
    "spc_stability",
    f"""WITH {SIGNALS_SQL}, c AS (SELECT l_suppkey, count(*) FILTER (chart = 'xbar') AS x, count(*) FILTER (chart = 'r') AS q
          FROM sig GROUP BY l_suppkey),
    s AS (SELECT l_suppkey, count(*) AS phase2_subgroups FROM p2 GROUP BY l_suppkey)
    SELECT l_suppkey, phase2_subgroups, coalesce(x, 0) AS xbar_signals, coalesce(q, 0) AS r_signals,
      coalesce(x, 0) + coalesce(q, 0) AS total_signals, coalesce(x, 0) = 0 AS xbar_in_control,
      coalesce(q, 0) = 0 AS r_in_control, coalesce(x, 0) + coalesce(q, 0) = 0 AS overall_in_control
    FROM s LEFT JOIN c USING (l_suppkey)""",
)
def spc_stability(spark, sf):
    subs = subgroups(spark, sf)
    phase1 = F.col("subgroup") < PHASE1_ROWS
    signals = spc.phase_signals(subs, ["l_suppkey"], SIZE, phase1, bound=lineitem(spark, sf))
    return spc.stability(subs, signals, ["l_suppkey"], phase1)


@query(
    "ewma_chart",
    f"""WITH s AS (SELECT l_suppkey, l_quantity AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY {LINE_ORDER_SQL}) - 1 AS pos,
          list(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY {LINE_ORDER_SQL} ROWS 190 PRECEDING) AS h FROM lineitem),
    st AS (SELECT l_suppkey, avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sigma FROM lineitem GROUP BY l_suppkey),
    e AS (SELECT l_suppkey, pos, x, list_sum(list_transform(h, lambda v, i:
            v * (CASE WHEN pos < len(h) AND i = 1 THEN 1.0 ELSE 0.2 END) * pow(0.8, len(h) - i))) AS ewma FROM s),
    f AS (SELECT e.*, mu + 3 * sigma * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (pos + 1)))) AS ucl,
            mu - 3 * sigma * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * (pos + 1)))) AS lcl FROM e JOIN st USING (l_suppkey))
    SELECT l_suppkey, pos, {r('ewma')} AS ewma, {r('ucl')} AS ucl, {r('lcl')} AS lcl, ewma > ucl OR ewma < lcl AS ewma_flag FROM f""",
)
def ewma_chart(spark, sf):
    out = spc.ewma_chart(lineitem(spark, sf), ["l_suppkey"], LINE_ORDER, "l_quantity")
    return out.select("l_suppkey", POS, *[rounded(c).alias(c) for c in ("ewma", "ucl", "lcl")], "ewma_flag")


@query(
    "cusum_chart",
    f"""WITH RECURSIVE st AS (SELECT l_suppkey, avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sigma FROM lineitem GROUP BY l_suppkey),
    s AS (SELECT l_suppkey, (l_quantity - mu) / sigma AS z,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY {LINE_ORDER_SQL}) - 1 AS pos FROM lineitem JOIN st USING (l_suppkey)),
    c AS (SELECT l_suppkey, pos,
            sum(CASE WHEN pos = 0 THEN 0 ELSE z - 0.5 END) OVER w AS up, sum(CASE WHEN pos = 0 THEN 0 ELSE z + 0.5 END) OVER w AS dn
          FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT l_suppkey, pos, up - min(up) OVER w AS c_plus, dn - max(dn) OVER w AS c_minus
          FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT l_suppkey, pos, {r('c_plus')} AS c_plus, {r('c_minus')} AS c_minus, c_plus > 5 OR c_minus < -5 AS cusum_flag FROM o""",
)
def cusum_chart(spark, sf):
    out = spc.cusum_chart(lineitem(spark, sf), ["l_suppkey"], LINE_ORDER, "l_quantity")
    return out.select("l_suppkey", POS, rounded("c_plus").alias("c_plus"), rounded("c_minus").alias("c_minus"), "cusum_flag")


@query(
    "rolling_defect_rule",
    """WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER w AS n,
        sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS recent
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, CAST(recent AS BIGINT) AS recent_defects,
      event_type = 'error' AND n > 10 AND recent > 3 AS violation FROM s""",
)
def rolling_defect_rule(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    out = spc.rolling_defect_rule(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return out.select("user_id", "event_id", "recent_defects", "violation")


@query(
    "consecutive_violation_alerts",
    """WITH s AS (SELECT user_id, event_id, row_number() OVER w AS n,
        min(CAST(value > 50 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 1 PRECEDING) AS m
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, n >= 2 AND m = 1 AS alert FROM s""",
)
def consecutive_violation_alerts(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    out = spc.consecutive_violations(ev, ["user_id"], ["ts", "event_id"], F.col("value") > 50)
    return out.select("user_id", "event_id", "alert")


CAP_SQL = """c AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std_dev,
    min(l_quantity) AS min_value, max(l_quantity) AS max_value FROM lineitem GROUP BY l_suppkey),
  k AS (SELECT *, 30.0 / (6 * std_dev) AS cp, (40 - mean) / (3 * std_dev) AS cpu, (mean - 10) / (3 * std_dev) AS cpl,
    least((40 - mean) / (3 * std_dev), (mean - 10) / (3 * std_dev)) AS cpk, abs(mean - 25) / 15.0 AS centering_ratio FROM c)"""


@query(
    "capability_by_tool",
    f"""WITH {CAP_SQL} SELECT l_suppkey, n, {r('mean')} AS mean, {r('std_dev')} AS std_dev, min_value, max_value,
      {r('cp')} AS cp, {r('cpu')} AS cpu, {r('cpl')} AS cpl, {r('cpk')} AS cpk, {r('cp')} AS pp, {r('cpk')} AS ppk,
      {r('centering_ratio')} AS centering_ratio, centering_ratio < 0.25 AS is_centered,
      CASE WHEN cpk >= 1.67 THEN 'World Class (Cpk ≥ 1.67)' WHEN cpk >= 1.33 THEN 'Adequate (1.33 ≤ Cpk < 1.67)'
           WHEN cpk >= 1.0 THEN 'Marginal (1.0 ≤ Cpk < 1.33)' WHEN cpk >= 0.67 THEN 'Poor (0.67 ≤ Cpk < 1.0)'
           ELSE 'Unacceptable (Cpk < 0.67)' END AS capability_class FROM k""",
)
def capability_by_tool(spark, sf):
    out = cap.capability(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", QUANTITY)
    names = ["mean", "std_dev", "cp", "cpu", "cpl", "cpk", "pp", "ppk", "centering_ratio"]
    return out.withColumns({n: rounded(n) for n in names})


@query(
    "predicted_yield",
    f"""WITH {CAP_SQL} SELECT l_suppkey,
      {r('100 * (' + phi_sql('(40 - mean) / std_dev') + ' - ' + phi_sql('(10 - mean) / std_dev') + ')')} AS predicted_yield,
      {r('100 * ' + phi_sql('(10 - mean) / std_dev'))} AS lower_defect_pct,
      {r('100 * ' + phi_sql('(mean - 40) / std_dev'))} AS upper_defect_pct,
      {r('100 * (' + phi_sql('(10 - mean) / std_dev') + ' + ' + phi_sql('(mean - 40) / std_dev') + ')')} AS total_defect_pct,
      {r('cpk * sqrt(1 / (9 * n * cpk * cpk) + 1 / (2.0 * (n - 1)))')} AS cpk_standard_error FROM k""",
)
def predicted_yield(spark, sf):
    out = cap.capability(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", QUANTITY)
    cols = {
        "predicted_yield": cap.predicted_yield("mean", "std_dev", QUANTITY),
        **cap.predicted_defects("mean", "std_dev", QUANTITY),
        "cpk_standard_error": cap.cpk_standard_error("cpk", "n"),
    }
    return out.select("l_suppkey", *[rounded(c).alias(n) for n, c in cols.items()])


# Quantile of Student's t as a series in 1 / dof around the normal one; exact to
# the digits compared from some 50 rows on.
T_SQL = """1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * v)
    + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * v * v)
    + (3 * pow(1.959963984540054, 7) + 19 * pow(1.959963984540054, 5) + 17 * pow(1.959963984540054, 3) - 15 * 1.959963984540054) / (384 * v * v * v)"""


@query(
    "cpk_intervals",
    f"""WITH s AS (SELECT l_suppkey, count(l_quantity) AS n, avg(l_quantity) AS mu, stddev_samp(l_quantity) AS sd, count(l_quantity) - 1.0 AS v FROM lineitem GROUP BY 1),
    c AS (SELECT l_suppkey, n, v, least(40 - mu, mu - 10) / (3 * sd) AS cpk FROM s),
    h AS (SELECT l_suppkey, n, cpk, ({T_SQL}) * abs(cpk) * sqrt(1 / (9 * n * cpk * cpk) + 1 / (2 * v)) AS half FROM c)
    SELECT l_suppkey, n, {r('cpk')} AS cpk, CASE WHEN cpk <= 0 THEN 0 ELSE {r('greatest(0, cpk - half)', 5)} END AS cpk_lower,
      CASE WHEN cpk <= 0 THEN 0 ELSE {r('cpk + half', 5)} END AS cpk_upper FROM h""",
)
def cpk_intervals(spark, sf):
    out = cap.capability(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", QUANTITY)
    out = cap.cpk_interval(out).select("l_suppkey", "n", "cpk", "cpk_lower", "cpk_upper")
    return out.withColumns({"cpk": rounded("cpk"), "cpk_lower": rounded("cpk_lower", 5), "cpk_upper": rounded("cpk_upper", 5)})


YIELD_SQL = """y AS (SELECT l_suppkey, count(*) AS total_units,
    count(*) FILTER (l_quantity >= 10 AND l_quantity <= 40) AS passing_units,
    count(*) FILTER (l_quantity < 10) AS below_lsl_count, count(*) FILTER (l_quantity > 40) AS above_usl_count
  FROM lineitem GROUP BY l_suppkey)"""


@query(
    "observed_yield",
    f"""WITH {YIELD_SQL} SELECT *, total_units - passing_units AS failing_units,
      {r('passing_units / total_units * 100')} AS yield_percent,
      {r('(total_units - passing_units) / total_units * 1e6')} AS defect_rate_ppm,
      {r('below_lsl_count / total_units * 100')} AS below_lsl_rate,
      {r('above_usl_count / total_units * 100')} AS above_usl_rate FROM y""",
)
def observed_yield(spark, sf):
    out = cap.observed_yield(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", QUANTITY)
    names = ["yield_percent", "defect_rate_ppm", "below_lsl_rate", "above_usl_rate"]
    return out.withColumns({n: rounded(n) for n in names})


@query(
    "wilson_yield",
    f"""WITH {YIELD_SQL}, p AS (SELECT *, passing_units / total_units AS p, CAST(total_units AS DOUBLE) AS n, 1.959963984540054 AS z FROM y),
    c AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid,
            z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM p)
    SELECT l_suppkey, total_units, passing_units, {r('greatest(0, (mid - half) * 100)')} AS ci_lower,
      {r('least(100, (mid + half) * 100)')} AS ci_upper FROM c""",
)
def wilson_yield(spark, sf):
    out = cap.observed_yield(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", QUANTITY)
    ci = cap.wilson_interval("passing_units", "total_units")
    return out.select("l_suppkey", "total_units", "passing_units", *[rounded(c).alias(n) for n, c in ci.items()])


@query(
    "yield_sensitivity",
    f"""WITH c AS (SELECT l_returnflag, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY l_returnflag),
    g AS (SELECT l_returnflag, 'mean' AS parameter, i AS point, 20.0 + i * (10.0 / 9) AS gv, 20.0 + i * (10.0 / 9) AS m, sd AS s
          FROM c CROSS JOIN (SELECT unnest(range(0, 10)) AS i)
        UNION ALL SELECT l_returnflag, 'std_dev', i, 5.0 + i * (10.0 / 9), mean, 5.0 + i * (10.0 / 9)
          FROM c CROSS JOIN (SELECT unnest(range(0, 10)) AS i)),
    y AS (SELECT *, 100 * ({phi_sql('(40 - m) / s')} - {phi_sql('(10 - m) / s')}) AS y FROM g),
    d AS (SELECT *, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, coalesce(lead(gv) OVER w, gv) - coalesce(lag(gv) OVER w, gv) AS dx
          FROM y WINDOW w AS (PARTITION BY l_returnflag, parameter ORDER BY point))
    SELECT l_returnflag, parameter, CAST(point AS INTEGER) AS point, {r('gv')} AS grid_value, {r('y')} AS yield_percent,
      {r('dy / dx')} AS sensitivity FROM d""",
)
def yield_sensitivity(spark, sf):
    stats = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("std_dev")
    )
    out = cap.yield_sensitivity(stats, ["l_returnflag"], QUANTITY, (20.0, 30.0), (5.0, 15.0))
    return out.withColumns({n: rounded(n) for n in ("grid_value", "yield_percent", "sensitivity")})

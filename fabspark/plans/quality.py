"""Data-quality profiles of lineitem, events and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import quality as q
from ..session import table
from .registry import query, r

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def measures(spark, sf):
    """Process measurements with zero discount and zero tax as missing."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_quantity",
        "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"),
    )


M = "m AS (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem)"
LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM m" for c in COLUMNS) + ")"
PROFILE = """p AS (SELECT "column", count(*) AS rows, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std_pop,
    stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, count(*) FILTER (value < 0) AS negative,
    count(*) FILTER (value = 0) AS zero, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
  FROM l GROUP BY "column")"""
OUT = """o AS (SELECT "column", count(value) AS n,
    count(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS iqr_outliers,
    count(*) FILTER (abs((value - mean) / std_pop) > 3) AS zscore_outliers
  FROM l JOIN p USING ("column") GROUP BY "column")"""
ROWMISS = """rm AS (SELECT CAST(l_discount IS NULL AS INT) + CAST(l_tax IS NULL AS INT) AS k FROM m)"""


@query(
    "dq_missing_by_column",
    f"""WITH {M}, {LONG} SELECT "column", count(*) AS rows, CAST(count(*) - count(value) AS BIGINT) AS missing,
    {r('(count(*) - count(value)) / count(*) * 100')} AS missing_pct, {r('100 - (count(*) - count(value)) / count(*) * 100')} AS completeness_pct
    FROM l GROUP BY "column" """,
)
def dq_missing_by_column(spark, sf):
    out = q.missing_by_column(measures(spark, sf))
    return out.withColumns({"missing_pct": rounded("missing_pct"), "completeness_pct": rounded("completeness_pct")})


@query(
    "dq_top_missing",
    f"""WITH {M}, {LONG} SELECT "column", CAST(count(*) - count(value) AS BIGINT) AS missing
    FROM l GROUP BY "column" ORDER BY missing DESC, "column" LIMIT 2""",
)
def dq_top_missing(spark, sf):
    return q.top_missing(measures(spark, sf), 2).select("column", "missing")


@query(
    "dq_missing_rows",
    f"""WITH {M}, {ROWMISS} SELECT count(*) AS rows, min(k) AS min_missing, max(k) AS max_missing, {r('avg(k)')} AS avg_missing,
    count(*) FILTER (k = 0) AS rows_none_missing, count(*) FILTER (k = 4) AS rows_all_missing, CAST(sum(k) AS BIGINT) AS total_missing FROM rm""",
)
def dq_missing_rows(spark, sf):
    return q.missing_per_row(measures(spark, sf)).withColumn("avg_missing", rounded("avg_missing"))


@query(
    "dq_completeness",
    f"""WITH {M}, {ROWMISS} SELECT {r('(4 * count(*) - sum(k)) / (4 * count(*)) * 100')} AS overall_completeness_pct,
    CAST(sum(k) AS BIGINT) AS total_missing_values, count(*) FILTER (k > 0) AS rows_with_missing,
    {r('count(*) FILTER (k = 0) / count(*) * 100')} AS complete_rows_pct,
    CAST(2 AS BIGINT) AS columns_with_missing, CAST(0 AS BIGINT) AS high_missing_columns FROM rm""",
)
def dq_completeness(spark, sf):
    out = q.completeness(measures(spark, sf))
    names = ["overall_completeness_pct", "complete_rows_pct"]
    return out.withColumns({n: rounded(n) for n in names})


@query(
    "dq_outliers_by_column",
    f"""WITH {M}, {LONG}, {PROFILE}, {OUT} SELECT "column", n, iqr_outliers, zscore_outliers,
    {r('iqr_outliers / n * 100')} AS outlier_rate_pct FROM o""",
)
def dq_outliers_by_column(spark, sf):
    return q.outlier_counts(measures(spark, sf)).withColumn("outlier_rate_pct", rounded("outlier_rate_pct"))


@query(
    "dq_accuracy",
    f"""WITH {M}, {LONG}, {PROFILE}, {OUT},
    s AS (SELECT CAST(0 AS BIGINT) AS infinite_values, CAST(sum(negative) AS BIGINT) AS negative_values, CAST(sum(zero) AS BIGINT) AS zero_values,
      count(*) FILTER (lo = hi AND n > 0) AS constant_columns FROM p),
    a AS (SELECT CAST(sum(iqr_outliers) AS BIGINT) AS total_outliers_iqr, CAST(sum(zscore_outliers) AS BIGINT) AS total_outliers_zscore,
      {r('sum(iqr_outliers) / sum(n) * 100')} AS outlier_rate_iqr_pct, {r('sum(zscore_outliers) / sum(n) * 100')} AS outlier_rate_zscore_pct,
      count(*) FILTER (iqr_outliers > 0) AS columns_with_outliers FROM o)
    SELECT * FROM a CROSS JOIN s""",
)
def dq_accuracy(spark, sf):
    out = q.accuracy(measures(spark, sf))
    return out.withColumns({n: rounded(n) for n in ("outlier_rate_iqr_pct", "outlier_rate_zscore_pct")})


CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS correlation FROM m"
    for i, a in enumerate(COLUMNS)
    for b in COLUMNS[i + 1 :]
)


@query(
    "dq_consistency",
    f"""WITH {M}, {LONG}, {PROFILE}, c AS ({CORR_SQL}),
    s AS (SELECT min(hi - lo) AS min_range, max(hi - lo) AS max_range, max(hi - lo) / min(hi - lo) AS range_ratio,
      {r('min(std)')} AS min_scale, {r('max(std)', 4)} AS max_scale, {r('max(std) / min(std)', 2)} AS scale_ratio,
      quantile_cont(hi - lo, 0.9) AS p90 FROM p),
    w AS (SELECT string_agg("column", ',' ORDER BY "column") AS columns_needing_scaling FROM p, s WHERE hi - lo > p90)
    SELECT min_range, max_range, {r('range_ratio', 2)} AS range_ratio, min_scale, max_scale, scale_ratio, columns_needing_scaling,
      1 AS type_diversity, 'double' AS dominant_type,
      (SELECT count(*) FROM c WHERE abs(correlation) > 0.95) AS high_correlation_pairs,
      (SELECT {r('max(abs(correlation))')} FROM c) AS max_correlation,
      (SELECT {r('sum(abs(correlation)) * 2 / 16')} FROM c) AS avg_correlation FROM s CROSS JOIN w""",
)
def dq_consistency(spark, sf):
    out = q.consistency(measures(spark, sf))
    digits = {"range_ratio": 2, "scale_ratio": 2, "max_scale": 4, "min_scale": 6, "max_correlation": 6, "avg_correlation": 6}
    return out.withColumns({n: rounded(n, d) for n, d in digits.items()})


@query(
    "dq_validity",
    f"""WITH {M}, {LONG}, {PROFILE} SELECT {r('sum(n) / sum(rows) * 100')} AS finite_values_pct, {r('sum(n) / sum(rows) * 100')} AS non_null_pct,
    4 AS numeric_columns, 0 AS categorical_columns, false AS sensor_naming_convention,
    count(*) FILTER (lo >= -1e6 AND hi <= 1e6) AS reasonable_ranges, {r('count(*) FILTER (lo >= -1e6 AND hi <= 1e6) / 4 * 100')} AS reasonable_range_pct,
    0 AS physical_checks, CAST(0 AS BIGINT) AS physical_passed FROM p""",
)
def dq_validity(spark, sf):
    out = q.validity(measures(spark, sf))
    return out.withColumns({n: rounded(n) for n in ("finite_values_pct", "non_null_pct", "reasonable_range_pct")})


@query(
    "dq_uniqueness",
    """WITH k AS (SELECT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT count(*) AS n FROM k GROUP BY l_orderkey, l_linenumber)
    SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, (round((sum(n) - count(*)) / sum(n) * 100, 6) + 0.0) AS duplicate_rate_pct,
    count(*) AS unique_rows,
    (SELECT CAST(count(DISTINCT l_orderkey) / count(*) < 0.1 AS BIGINT) + CAST(count(DISTINCT l_linenumber) / count(*) < 0.1 AS BIGINT) FROM k) AS low_uniqueness_columns
    FROM g""",
)
def dq_uniqueness(spark, sf):
    keys = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return q.uniqueness(keys).withColumn("duplicate_rate_pct", rounded("duplicate_rate_pct"))


@query(
    "dq_distinct_counts",
    """SELECT 'c_nationkey' AS "column", count(DISTINCT c_nationkey) AS distinct_values, count(c_nationkey) AS non_null,
      (round(count(DISTINCT c_nationkey) / count(c_nationkey), 6) + 0.0) AS uniqueness_ratio FROM customer
    UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(c_mktsegment), (round(count(DISTINCT c_mktsegment) / count(c_mktsegment), 6) + 0.0) FROM customer
    UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(c_name), (round(count(DISTINCT c_name) / count(c_name), 6) + 0.0) FROM customer""",
)
def dq_distinct_counts(spark, sf):
    from ..operators.describe import distinct_counts

    c = table(spark, sf, "customer")
    return distinct_counts(c, ["c_nationkey", "c_mktsegment", "c_name"]).withColumn("uniqueness_ratio", rounded("uniqueness_ratio"))


@query(
    "dq_timeliness",
    """SELECT CAST(epoch_us(min(ts)) AS BIGINT) AS earliest_us, CAST(epoch_us(max(ts)) AS BIGINT) AS latest_us,
    (round(count(ts) / count(*) * 100, 6) + 0.0) AS timestamp_completeness_pct,
    CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT) AS temporal_span_days FROM events""",
)
def dq_timeliness(spark, sf):
    out = q.timeliness(table(spark, sf, "events"), "ts")
    # Both ends read back in the session zone, whichever it is.
    local = [F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp")) for c in ("earliest_timestamp", "latest_timestamp")]
    offset = F.unix_micros(F.to_timestamp(F.lit("1970-01-01 00:00:00")))
    return out.select(
        (local[0] - offset).alias("earliest_us"),
        (local[1] - offset).alias("latest_us"),
        rounded("timestamp_completeness_pct").alias("timestamp_completeness_pct"),
        "temporal_span_days",
    )


@query(
    "dq_freshness",
    f"""SELECT event_id, {r("1 / (1 + (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 3.6e9 / 24)")} AS freshness FROM events""",
)
def dq_freshness(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", rounded(q.freshness("ts", "2024-02-01 00:00:00")).alias("freshness"))


SCORE_SQL = f"""{M}, {LONG}, {PROFILE}, {OUT}, {ROWMISS}, g AS (SELECT count(*) AS n FROM m GROUP BY l_quantity, l_extendedprice, l_discount, l_tax),
    s AS (SELECT (SELECT (4 * count(*) - sum(k)) / (4 * count(*)) * 100 FROM rm) AS completeness,
      (SELECT 100 - least(sum(iqr_outliers) / sum(n) * 100, 100) FROM o) AS accuracy,
      (SELECT sum(n) / sum(rows) * 100 FROM p) AS validity,
      (SELECT 100 - (sum(n) - count(*)) / sum(n) * 100 FROM g) AS uniqueness)"""


@query(
    "dq_score",
    f"""WITH {SCORE_SQL} SELECT {r('completeness')} AS completeness, {r('accuracy')} AS accuracy, {r('validity')} AS validity, {r('uniqueness')} AS uniqueness,
      {r('greatest(0, least(100, 0.3 * completeness + 0.3 * accuracy + 0.2 * validity + 0.2 * uniqueness))')} AS overall_score FROM s""",
)
def dq_score(spark, sf):
    out = q.overall_score(measures(spark, sf))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "dq_six_dimension_score",
    f"""WITH {M}, {LONG}, {PROFILE}, {ROWMISS}, g AS (SELECT count(*) AS n FROM m GROUP BY l_quantity, l_extendedprice, l_discount, l_tax),
    e AS (SELECT "column", count(*) FILTER (abs((value - mean) / std) > 5) / count(*) AS rate FROM l JOIN p USING ("column") GROUP BY "column"),
    s AS (SELECT (SELECT (4 * count(*) - sum(k)) / (4 * count(*)) * 100 FROM rm) AS completeness, (SELECT 100 - 10 * sum(rate) FROM e) AS validity,
      (SELECT 100 - (sum(n) - count(*)) / sum(n) * 100 FROM g) AS uniqueness)
    SELECT {r('completeness')} AS completeness, {r('validity')} AS validity, {r('uniqueness')} AS uniqueness, CAST(100 AS DOUBLE) AS consistency,
      CAST(100 AS DOUBLE) AS accuracy, CAST(100 AS DOUBLE) AS timeliness,
      {r('0.25 * completeness + 20 + 0.2 * validity + 15 + 0.1 * uniqueness + 10')} AS overall_score FROM s""",
)
def dq_six_dimension_score(spark, sf):
    out = q.six_dimension_score(measures(spark, sf))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "dq_recommendations",
    f"""WITH {SCORE_SQL}, x AS (SELECT completeness, 100 - accuracy AS outlier_rate, 100 - uniqueness AS dup_rate,
        (SELECT max(std) / min(std) FROM p) AS scale_ratio, (SELECT count(*) FROM p WHERE n < 0.5 * rows) AS high_missing FROM s)
    SELECT 'completeness' AS category, 'HIGH' AS priority, 'Low Overall Data Completeness' AS issue, {r('completeness', 3)} AS measure FROM x WHERE completeness < 95
    UNION ALL SELECT 'completeness', 'HIGH', 'Columns with High Missing Rates', {r('high_missing', 3)} FROM x WHERE high_missing > 0
    UNION ALL SELECT 'accuracy', 'HIGH', 'High Outlier Rate', {r('outlier_rate', 3)} FROM x WHERE outlier_rate > 10
    UNION ALL SELECT 'consistency', 'MEDIUM', 'Inconsistent Feature Scales', {r('scale_ratio', 3)} FROM x WHERE scale_ratio > 100
    UNION ALL SELECT 'uniqueness', 'MEDIUM', 'Duplicate Records Present', {r('dup_rate', 3)} FROM x WHERE dup_rate > 1""",
)
def dq_recommendations(spark, sf):
    return q.recommendations(measures(spark, sf)).withColumn("measure", rounded("measure", 3))


@query(
    "dq_expectations",
    """SELECT 'quality in allowed set' AS "check", count(*) FILTER (NOT coalesce(quality IN (0, 1), false)) AS failures,
      count(*) FILTER (NOT coalesce(quality IN (0, 1), false)) = 0 AS passed FROM labels
    UNION ALL SELECT 'toxic is zero', count(*) FILTER (toxic <> 0), count(*) FILTER (toxic <> 0) = 0 FROM labels
    UNION ALL SELECT 'key present', count(*) FILTER (doc_id IS NULL), count(*) FILTER (doc_id IS NULL) = 0 FROM labels""",
)
def dq_expectations(spark, sf):
    checks = {
        "quality in allowed set": F.col("quality").isin(0, 1),
        "toxic is zero": F.col("toxic") == 0,
        "key present": F.col("doc_id").isNotNull(),
    }
    return q.expectations(table(spark, sf, "labels"), checks)


@query(
    "dq_full_report",
    f"""WITH {SCORE_SQL} SELECT {r('completeness')} AS completeness_pct, {r('100 - accuracy')} AS outlier_rate_pct, {r('validity')} AS finite_pct,
      {r('100 - uniqueness')} AS duplicate_rate_pct, {r('greatest(0, least(100, 0.3 * completeness + 0.3 * accuracy + 0.2 * validity + 0.2 * uniqueness))')} AS overall_score,
      CAST((completeness < 95)::INT + (accuracy < 90)::INT + ((SELECT max(std) / min(std) FROM p) > 100)::INT + (uniqueness < 99)::INT AS INTEGER) AS recommendations FROM s""",
)
def dq_full_report(spark, sf):
    out = q.full_report(measures(spark, sf))
    return out.select(
        rounded(F.col("completeness.overall_completeness_pct")).alias("completeness_pct"),
        rounded(F.col("accuracy.outlier_rate_iqr_pct")).alias("outlier_rate_pct"),
        rounded(F.col("validity.finite_values_pct")).alias("finite_pct"),
        rounded(F.col("uniqueness.duplicate_rate_pct")).alias("duplicate_rate_pct"),
        rounded(F.col("score.overall_score")).alias("overall_score"),
        F.size("recommendations").alias("recommendations"),
    )

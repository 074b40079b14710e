"""Data-quality profiles.

Statistics per column come from the long form (column, value): partial
aggregation shrinks it to one row per column and partition before the shuffle,
and the plan stays small for tables with hundreds of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns
from ..session import one_row
from .describe import correlations, distinct_counts
from .ordered import HOT_ROWS
from .profile import Profile, missing
from .ranks import stacked

# Thresholds of the assessment.
COMPLETENESS_CRITICAL = 95.0
MISSING_COLUMN_PCT = 50.0
OUTLIER_RATE_CRITICAL = 10.0
SCALE_RATIO_WARNING = 100.0
DUPLICATE_RATE_WARNING = 1.0
CORRELATION_THRESHOLD = 0.95
# Weights of the overall and of the six-dimension score.
OVERALL_WEIGHTS = {"completeness": 0.3, "accuracy": 0.3, "validity": 0.2, "uniqueness": 0.2}
SIX_WEIGHTS = {
    "completeness": 0.25,
    "consistency": 0.20,
    "validity": 0.20,
    "accuracy": 0.15,
    "uniqueness": 0.10,
    "timeliness": 0.10,
}


def _missing_flags(df: DataFrame) -> DataFrame:
    return df.select(*[missing(df, c).cast("int").alias(c) for c in df.columns])


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, rows, missing, missing_pct, completeness_pct)."""
    long = _missing_flags(df).unpivot([], df.columns, "column", "missing")
    out = long.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.sum("missing").alias("missing"))
    pct = F.col("missing") / F.col("rows") * 100
    return out.withColumns({"missing_pct": pct, "completeness_pct": 100 - pct})


def missing_per_row(df: DataFrame) -> DataFrame:
    """One row: spread of the number of missing values per row."""
    flags = _missing_flags(df)
    count = sum((F.col(f"`{c}`") for c in df.columns), F.lit(0))
    return flags.select(count.alias("m")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("m").alias("min_missing"),
        F.max("m").alias("max_missing"),
        F.avg("m").alias("avg_missing"),
        F.count_if(F.col("m") == 0).alias("rows_none_missing"),
        F.count_if(F.col("m") == len(df.columns)).alias("rows_all_missing"),
        F.sum("m").alias("total_missing"),
    )


def completeness(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    cols = profile.missing_by_column if profile else missing_by_column(df)
    per_col = cols.agg(
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.count_if(F.col("missing_pct") > MISSING_COLUMN_PCT).alias("high_missing_columns"),
    )
    row = profile.missing_per_row if profile else missing_per_row(df)
    cells = F.col("rows") * len(df.columns)
    out = row.select(
        (F.try_divide(cells - F.col("total_missing"), cells) * 100).alias("overall_completeness_pct"),
        F.col("total_missing").alias("total_missing_values"),
        (F.col("rows") - F.col("rows_none_missing")).alias("rows_with_missing"),
        (F.try_divide(F.col("rows_none_missing"), F.col("rows")) * 100).alias("complete_rows_pct"),
    )
    return _with_row(out, per_col)


def _with_row(df: DataFrame, other: DataFrame) -> DataFrame:
    row = one_row(other)
    return df.withColumn("_o", row).select("*", *[F.col("_o")[c].alias(c) for c in other.columns]).drop("_o")


def top_missing(df: DataFrame, n: int = 10) -> DataFrame:
    return missing_by_column(df).orderBy(F.desc("missing"), "column").limit(n)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: moments, extremes and counts of special values."""
    columns = list(columns or numeric_columns(df))
    long = stacked(df, [], columns).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    v = F.col("value")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_pop"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(F.abs(v) == float("inf")).alias("infinite"),
        F.count_if(v < 0).alias("negative"),
        F.count_if(v == 0).alias("zero"),
    )


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """IQR (1.5) and z-score (> 3, population sd) outliers per column, in two
    passes; a column without finite deviation has no z-score outliers."""
    return Profile(df, columns, hot_rows).outliers.drop("beyond_five")


def accuracy(df: DataFrame, columns: Sequence[str] | None = None, hot_rows: int = HOT_ROWS, profile: Profile | None = None) -> DataFrame:
    profile = profile or Profile(df, columns, hot_rows)
    out = profile.outliers.agg(
        F.sum("iqr_outliers").alias("total_outliers_iqr"),
        F.sum("zscore_outliers").alias("total_outliers_zscore"),
        (F.try_divide(F.sum("iqr_outliers"), F.sum("n")) * 100).alias("outlier_rate_iqr_pct"),
        (F.try_divide(F.sum("zscore_outliers"), F.sum("n")) * 100).alias("outlier_rate_zscore_pct"),
        F.count_if(F.col("iqr_outliers") > 0).alias("columns_with_outliers"),
    )
    special = profile.numeric.agg(
        F.sum("infinite").alias("infinite_values"),
        F.sum("negative").alias("negative_values"),
        F.sum("zero").alias("zero_values"),
        F.count_if((F.col("min") == F.col("max")) & (F.col("n") > 0)).alias("constant_columns"),
    )
    return _with_row(out, special)


def scale_analysis(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    prof = (profile.numeric if profile else numeric_profile(df, columns)).filter(F.col("n") > 0)
    rows = prof.select("column", (F.col("max") - F.col("min")).alias("range"), "std")

    def ratio(c: str) -> Column:
        return F.when(F.min(c) > 0, F.max(c) / F.min(c)).otherwise(F.lit(float("inf")))

    out = rows.agg(
        F.min("range").alias("min_range"),
        F.max("range").alias("max_range"),
        ratio("range").alias("range_ratio"),
        F.min("std").alias("min_scale"),
        F.max("std").alias("max_scale"),
        ratio("std").alias("scale_ratio"),
        # The rows here are the columns of the schema, so lists stay short.
        F.percentile("range", 0.9).alias("_p90"),
        F.array_sort(F.collect_list(F.struct("column", "range"))).alias("_all"),
    )
    wide = F.transform(F.filter("_all", lambda x: x["range"] > F.col("_p90")), lambda x: x["column"])
    return out.withColumn("columns_needing_scaling", F.array_join(wide, ",")).drop("_p90", "_all")


def type_distribution(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in df.schema:
        out[f.dataType.simpleString()] = out.get(f.dataType.simpleString(), 0) + 1
    return dict(sorted(out.items(), key=lambda kv: (-kv[1], kv[0])))


def consistency(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    """One row: schema facts, scales, number of high correlations. The mean
    correlation runs over the full matrix with a zero diagonal."""
    columns = list(columns or numeric_columns(df))
    types = type_distribution(df)
    out = scale_analysis(df, columns, profile).withColumns(
        {"type_diversity": F.lit(len(types)), "dominant_type": F.lit(next(iter(types)))}
    )
    d = len(columns)
    if d < 2:
        return out
    corr = correlations(df, columns).withColumn("correlation", F.abs("correlation")).agg(
        F.count_if(F.col("correlation") > CORRELATION_THRESHOLD).alias("high_correlation_pairs"),
        F.coalesce(F.max("correlation"), F.lit(0.0)).alias("max_correlation"),
        (F.sum("correlation") * 2 / (d * d)).alias("avg_correlation"),
    )
    return _with_row(out, corr)


def validity(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    sensors = [c for c in df.columns if c.lower().startswith("sensor")]
    temps = [c for c in columns if "temp" in c.lower()]
    prof = profile.numeric if profile else numeric_profile(df, columns)
    cells = F.sum("rows")
    return prof.agg(
        ((F.sum("n") - F.sum("infinite")) / cells * 100).alias("finite_values_pct"),
        (F.sum("n") / cells * 100).alias("non_null_pct"),
        F.lit(len(columns)).alias("numeric_columns"),
        F.lit(len(text)).alias("categorical_columns"),
        F.lit(len(sensors) > 0.5 * len(df.columns)).alias("sensor_naming_convention"),
        F.count_if((F.col("min") >= -1e6) & (F.col("max") <= 1e6)).alias("reasonable_ranges"),
        (F.count_if((F.col("min") >= -1e6) & (F.col("max") <= 1e6)) / len(columns) * 100).alias("reasonable_range_pct"),
        F.lit(len(temps)).alias("physical_checks"),
        F.count_if(F.col("column").isin(temps) & (F.col("min") > -500) if temps else F.lit(False)).alias("physical_passed"),
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Duplicate rows = rows - distinct rows, by counts of whole rows."""
    counts = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"),
        (F.try_divide(F.sum("_n") - F.count(F.lit(1)), F.sum("_n")) * 100).alias("duplicate_rate_pct"),
        F.count(F.lit(1)).alias("unique_rows"),
    )


def uniqueness(df: DataFrame, approximate: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` is the result of :func:`duplicates` if it is known."""
    low = distinct_counts(df, df.columns, approximate).agg(
        F.count_if(F.col("uniqueness_ratio") < 0.1).alias("low_uniqueness_columns")
    )
    return _with_row(duplicates(df) if rows is None else rows, low)


def timeliness(df: DataFrame, column: str) -> DataFrame:
    """Span in whole days and share of parseable timestamps."""
    raw = F.col(column)
    ts = F.try_to_timestamp(raw) if isinstance(df.schema[column].dataType, T.StringType) else raw
    out = df.select(ts.cast("timestamp").alias("t")).agg(
        F.min("t").alias("earliest_timestamp"),
        F.max("t").alias("latest_timestamp"),
        (F.try_divide(F.count("t"), F.count(F.lit(1))) * 100).alias("timestamp_completeness_pct"),
    )
    micros = F.unix_micros("latest_timestamp") - F.unix_micros("earliest_timestamp")
    return out.withColumn("temporal_span_days", F.floor(micros / 86_400_000_000))


def freshness(ts: Column | str, as_of: str) -> Column:
    """1 / (1 + age in days), for a fixed point in time."""
    c = F.col(ts) if isinstance(ts, str) else ts
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(c.cast("timestamp"))) / 3.6e9
    return 1 / (1 + hours / 24)


def overall_score(df: DataFrame, hot_rows: int = HOT_ROWS, profile: Profile | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Weighted score of completeness, accuracy, validity and uniqueness; two
    passes for the profile and one for whole-row duplicates (``rows``)."""
    profile = profile or Profile(df, hot_rows=hot_rows)
    out = completeness(df, profile).select(F.col("overall_completeness_pct").alias("completeness"))
    acc = accuracy(df, profile=profile).select((100 - F.least("outlier_rate_iqr_pct", F.lit(100.0))).alias("accuracy"))
    val = validity(df, profile=profile).select(F.col("finite_values_pct").alias("validity"))
    uni = (duplicates(df) if rows is None else rows).select((100 - F.col("duplicate_rate_pct")).alias("uniqueness"))
    for part in (acc, val, uni):
        out = _with_row(out, part)
    total = sum((F.col(k) * w for k, w in OVERALL_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("overall_score", F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)))


def six_dimension_score(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Score with weights for six dimensions; validity loses ten times the
    share of values beyond five standard deviations, per numeric column."""
    profile = profile or Profile(df)
    sizes = profile.numeric.select("column", "rows")
    extreme = profile.outliers.join(sizes, "column").select(F.try_divide("beyond_five", "rows").alias("rate"))
    out = completeness(df, profile).select(F.col("overall_completeness_pct").alias("completeness"))
    out = _with_row(out, extreme.agg((100 - 10 * F.sum("rate")).alias("validity")))
    out = _with_row(out, duplicates(df).select((100 - F.col("duplicate_rate_pct")).alias("uniqueness")))
    out = out.withColumns({k: F.lit(100.0) for k in ("consistency", "accuracy", "timeliness")})
    total = sum((F.col(k) * w for k, w in SIX_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("overall_score", total)


# Titles of the recommendations.
ISSUES = {
    "completeness": "Low Overall Data Completeness",
    "columns": "Columns with High Missing Rates",
    "outliers": "High Outlier Rate",
    "scales": "Inconsistent Feature Scales",
    "duplicates": "Duplicate Records Present",
}


def recommendations(df: DataFrame, hot_rows: int = HOT_ROWS, profile: Profile | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Rows (category, priority, issue, measure) whose threshold is passed."""
    profile = profile or Profile(df, hot_rows=hot_rows)
    row = completeness(df, profile).select("overall_completeness_pct", "high_missing_columns")
    for part in (
        accuracy(df, profile=profile).select("outlier_rate_iqr_pct"),
        scale_analysis(df, profile=profile).select("scale_ratio"),
        (duplicates(df) if rows is None else rows).select("duplicate_rate_pct"),
    ):
        row = _with_row(row, part)
    rules = [
        ("completeness", "HIGH", ISSUES["completeness"], F.col("overall_completeness_pct"), F.col("overall_completeness_pct") < COMPLETENESS_CRITICAL),
        ("completeness", "HIGH", ISSUES["columns"], F.col("high_missing_columns").cast("double"), F.col("high_missing_columns") > 0),
        ("accuracy", "HIGH", ISSUES["outliers"], F.col("outlier_rate_iqr_pct"), F.col("outlier_rate_iqr_pct") > OUTLIER_RATE_CRITICAL),
        ("consistency", "MEDIUM", ISSUES["scales"], F.col("scale_ratio"), F.col("scale_ratio") > SCALE_RATIO_WARNING),
        ("uniqueness", "MEDIUM", ISSUES["duplicates"], F.col("duplicate_rate_pct"), F.col("duplicate_rate_pct") > DUPLICATE_RATE_WARNING),
    ]
    items = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(c).alias("category"), F.lit(p).alias("priority"), F.lit(i).alias("issue"), m.alias("measure")))
                for c, p, i, m, cond in rules
            ]
        )
    )
    return row.select(F.inline(items))


def expectations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, failures, passed) for row rules evaluated in one pass."""
    sums = [F.struct(F.lit(n).alias("check"), F.count_if(~F.coalesce(c, F.lit(False))).alias("failures")) for n, c in checks.items()]
    out = df.agg(F.array(*sums).alias("c")).select(F.inline("c"))
    return out.withColumn("passed", F.col("failures") == 0)


def full_report(df: DataFrame, timestamp: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One nested row with all dimensions, the score and recommendations. Two
    passes for the profile, one each for correlations, duplicate rows and
    distinct values."""
    profile = Profile(df, hot_rows=hot_rows)
    found = duplicates(df)
    rows = df.sparkSession.createDataFrame(found.collect(), found.schema)  # one row, used three times
    out = completeness(df, profile)
    out = out.select(F.struct(*out.columns).alias("completeness"))
    parts = {
        "accuracy": accuracy(df, profile=profile),
        "consistency": consistency(df, profile=profile),
        "validity": validity(df, profile=profile),
        "uniqueness": uniqueness(df, rows=rows),
        "score": overall_score(df, profile=profile, rows=rows).select("overall_score"),
    }
    if timestamp:
        parts["timeliness"] = timeliness(df, timestamp)
    for name, part in parts.items():
        out = out.withColumn(name, one_row(part))
    found = recommendations(df, profile=profile, rows=rows)
    listed = found.agg(F.sort_array(F.collect_list(F.struct(*found.columns))).alias("r"))
    return out.withColumn("recommendations", one_row(listed)["r"])

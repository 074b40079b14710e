"""Projections, joins and aggregates: features, alignment, cross tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions.columns import rounded
from ..operators import describe as d
from ..operators import features, joins
from ..session import table
from .common import lineitem
from .registry import query, r

ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ID_SQL = ", ".join(ID)


@query(
    "filtered_rows",
    f"SELECT {ID_SQL}, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND isfinite(l_quantity)",
)
def filtered_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    kept = li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45) & fc.finite("l_quantity"))
    return kept.select(*ID, "l_quantity")


@query(
    "interaction_features",
    f"""SELECT {ID_SQL}, {r('l_quantity - avg(l_quantity) OVER ()')} AS temp_centered, {r('l_discount * l_discount')} AS pressure_sq,
    {r('l_tax * l_linenumber')} AS flow_time_inter, {r('l_quantity * l_tax')} AS temp_flow_inter FROM lineitem""",
)
def interaction_features(spark, sf):
    li = table(spark, sf, "lineitem").select(*ID, "l_quantity", "l_discount", "l_tax")
    out = features.interaction_features(li, "l_quantity", "l_discount", "l_tax", "l_linenumber")
    return out.select(*ID, *[rounded(c).alias(c) for c in ("temp_centered", "pressure_sq", "flow_time_inter", "temp_flow_inter")])


@query(
    "scaled_features",
    f"""WITH s AS (SELECT avg(l_quantity) AS mt, avg(l_discount) AS mp, max(l_extendedprice) AS xp, max(l_linenumber) AS xt FROM lineitem)
    SELECT {ID_SQL}, {r('l_quantity - mt')} AS temp_centered, {r('l_discount * l_discount')} AS pressure_sq, {r('l_tax * l_quantity')} AS flow_temp_inter,
      {r('l_extendedprice / xp')} AS power_efficiency, {r('l_linenumber / xt')} AS normalized_time,
      {r('sqrt((l_quantity - mt) * (l_quantity - mt) + (l_discount - mp) * (l_discount - mp))')} AS stability_index FROM lineitem CROSS JOIN s""",
)
def scaled_features(spark, sf):
    li = table(spark, sf, "lineitem").select(*ID, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    out = features.scaled_features(li, "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber")
    names = ["temp_centered", "pressure_sq", "flow_temp_inter", "power_efficiency", "normalized_time", "stability_index"]
    return out.select(*ID, *[rounded(c).alias(c) for c in names])


@query(
    "element_transform",
    f"SELECT {ID_SQL}, {r('sqrt(abs(l_extendedprice)) + ln(1 + abs(l_extendedprice))')} AS l_extendedprice_t FROM lineitem",
)
def element_transform(spark, sf):
    li = table(spark, sf, "lineitem").select(*ID, "l_extendedprice")
    return features.element_transform(li, ["l_extendedprice"]).select(*ID, rounded("l_extendedprice_t").alias("l_extendedprice_t"))


@query(
    "safe_ratios",
    f"SELECT {ID_SQL}, {r('l_quantity / (l_linenumber + 1e-8)')} AS ratio FROM lineitem",
)
def safe_ratios(spark, sf):
    return table(spark, sf, "lineitem").select(*ID, rounded(fc.safe_ratio("l_quantity", "l_linenumber")).alias("ratio"))


@query(
    "calendar_features",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
    CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events""",
)
def calendar_features(spark, sf):
    return table(spark, sf, "events").withColumns(fc.calendar_features("ts")).select("event_id", "hour", "day_of_week", "is_weekend")


@query(
    "imputed_median",
    f"""WITH m AS (SELECT *, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS t FROM lineitem),
    s AS (SELECT median(d) AS md, median(t) AS mt FROM m)
    SELECT {ID_SQL}, {r('coalesce(d, md)')} AS l_discount, {r('coalesce(t, mt)')} AS l_tax FROM m CROSS JOIN s""",
)
def imputed_median(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *ID, *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in ("l_discount", "l_tax")]
    )
    out = features.impute(li, ["l_discount", "l_tax"])
    return out.select(*ID, rounded("l_discount").alias("l_discount"), rounded("l_tax").alias("l_tax"))


@query(
    "imputed_mean",
    f"""WITH m AS (SELECT *, nullif(l_discount, 0) AS d FROM lineitem)
    SELECT {ID_SQL}, {r('coalesce(d, avg(d) OVER ())')} AS l_discount FROM m""",
)
def imputed_mean(spark, sf):
    li = table(spark, sf, "lineitem").select(*ID, F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"))
    return features.impute(li, ["l_discount"], "mean").withColumn("l_discount", rounded("l_discount"))


@query(
    "standard_scaled",
    f"""SELECT {ID_SQL}, {r('(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()')} AS l_quantity,
    {r('(l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER ()')} AS l_tax FROM lineitem""",
)
def standard_scaled(spark, sf):
    out = features.standard_scale(table(spark, sf, "lineitem").select(*ID, "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return out.withColumns({"l_quantity": rounded("l_quantity"), "l_tax": rounded("l_tax")})


@query(
    "robust_scaled",
    f"""WITH s AS (SELECT median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS w FROM lineitem)
    SELECT {ID_SQL}, {r('(l_extendedprice - m) / w')} AS l_extendedprice FROM lineitem CROSS JOIN s""",
)
def robust_scaled(spark, sf):
    out = features.robust_scale(table(spark, sf, "lineitem").select(*ID, "l_extendedprice"), ["l_extendedprice"])
    return out.withColumn("l_extendedprice", rounded("l_extendedprice"))


@query(
    "reduced_features",
    f"""WITH m AS (SELECT *, nullif(l_discount, 0) AS d, CASE WHEN l_tax > 0.06 THEN l_tax END AS t FROM lineitem),
    i AS (SELECT {ID_SQL}, l_quantity, l_extendedprice FROM m)
    SELECT {ID_SQL}, {r('(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER ()')} AS l_extendedprice,
      {r('(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()')} AS l_quantity FROM i""",
)
def reduced_features(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *ID,
        "l_quantity",
        "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.when(F.col("l_tax") > 0.06, F.col("l_tax")).alias("l_tax"),
    )
    rows, _ = features.reduce_features(li, ID, top=2)
    return rows.withColumns({"l_quantity": rounded("l_quantity"), "l_extendedprice": rounded("l_extendedprice")})


@query(
    "recoded_priority",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS severity,
    CAST(floor(o_totalprice / 60) AS BIGINT) || 'm ' || (CAST(o_totalprice AS BIGINT) % 60) || 's' AS duration FROM
    (SELECT o_orderkey, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders)""",
)
def recoded_priority(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        fc.recode("o_orderstatus", {"F": 0, "O": 1, "P": 2}).alias("severity"),
        fc.minutes_seconds(F.floor("o_totalprice")).alias("duration"),
    )


@query(
    "labelled_documents",
    "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def labelled_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return joins.align(docs, table(spark, sf, "labels"), ["doc_id"])


@query(
    "labelled_documents_left",
    "SELECT doc_id, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def labelled_documents_left(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return joins.align(docs, table(spark, sf, "labels"), ["doc_id"], "left")


@query(
    "alignment_report",
    """SELECT (SELECT count(*) FROM documents) AS feature_rows, (SELECT count(*) FROM labels) AS target_rows,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS features_without_target,
    (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS targets_without_features,
    (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS repeated_keys""",
)
def alignment_report(spark, sf):
    out = joins.alignment_report(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])
    return out


@query(
    "next_error_event",
    """WITH n AS (SELECT e.event_id, e.ts, (SELECT min(f.ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND f.ts > e.ts) AS nx FROM events e),
    h AS (SELECT event_id, (epoch_us(nx) - epoch_us(ts)) / 3.6e9 AS hours FROM n)
    SELECT event_id, (round(coalesce(least(hours, 999.0), 999.0), 6) + 0.0) AS time_to_event,
      CAST(coalesce(hours <= 24, false) AS INTEGER) AS event_in_24h, CAST(coalesce(hours <= 72, false) AS INTEGER) AS event_in_72h FROM h""",
)
def next_error_event(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    out = joins.next_event(ev, ["user_id"], "ts", F.col("event_type") == "error")
    return out.select("event_id", rounded("time_to_event").alias("time_to_event"), "event_in_24h", "event_in_72h")


@query(
    "unlabelled_sources",
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def unlabelled_sources(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return joins.outside_domain(docs, "doc_id", table(spark, sf, "labels")).select("doc_id", "source")


@query(
    "domain_contained",
    """WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier), b AS (SELECT n_nationkey AS k FROM nation)
    SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS outside, (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS shared,
    (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS unused, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) = 0 AS is_subset""",
)
def domain_contained(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return joins.domain_contained(s, "k", table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return joins.duplicate_groups(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "union_of_roles",
    """SELECT part, count(*) AS n FROM (SELECT 'asked' AS part FROM conversations WHERE role = 'user'
    UNION ALL SELECT 'answered' FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT 'other' FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')) GROUP BY part""",
)
def union_of_roles(spark, sf):
    c = table(spark, sf, "conversations")
    both = joins.stacked_union({"asked": c.filter(F.col("role") == "user"), "answered": c.filter(F.col("role") == "assistant"), "other": c.filter(F.col("role").isNull() | ~F.col("role").isin("user", "assistant"))})
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "describe_by_group",
    f"""WITH v AS (SELECT l_returnflag, l_quantity AS x FROM lineitem),
    md AS (SELECT l_returnflag, arg_min(x, (-n, x)) AS mode FROM (SELECT l_returnflag, x, count(*) AS n FROM v GROUP BY ALL) GROUP BY l_returnflag),
    m AS (SELECT l_returnflag, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS var, min(x) AS min, max(x) AS max,
      avg(x) AS mu, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3, kurtosis_pop(x) AS kurtosis FROM v GROUP BY l_returnflag),
    s AS (SELECT v.l_returnflag, avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS skewness FROM v JOIN m USING (l_returnflag) GROUP BY v.l_returnflag)
    SELECT l_returnflag, count, {r('mean')} AS mean, {r('std')} AS std, {r('var')} AS var, min, max, {r('skewness')} AS skewness, {r('kurtosis')} AS kurtosis,
      q1, median, q3, mode, max - min AS range, q3 - q1 AS iqr, {r('std / mean * 100')} AS cv_pct FROM m JOIN s USING (l_returnflag) JOIN md USING (l_returnflag)""",
)
def describe_by_group(spark, sf):
    out = d.describe(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.withColumns({c: rounded(c) for c in ("mean", "std", "var", "skewness", "kurtosis", "cv_pct")})


@query(
    "basic_stats",
    f"""SELECT l_suppkey, l_returnflag, count(l_extendedprice) AS count, {r('avg(l_extendedprice)', 4)} AS mean, {r('stddev_samp(l_extendedprice)', 4)} AS std,
    min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def basic_stats(spark, sf):
    out = d.basic_stats(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice")
    return out.withColumns({"mean": rounded("mean", 4), "std": rounded("std", 4)})


@query(
    "balanced_design",
    """SELECT count(*) AS cells, min(n) AS min_count, max(n) AS max_count, min(n) = max(n) AS balanced
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus)""",
)
def balanced_design(spark, sf):
    return d.balanced_design(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "crosstab_means",
    f"""SELECT l_returnflag, {r("avg(l_quantity) FILTER (l_linestatus = 'F')")} AS "F", {r("avg(l_quantity) FILTER (l_linestatus = 'O')")} AS "O"
    FROM lineitem GROUP BY l_returnflag""",
)
def crosstab_means(spark, sf):
    out = d.cross_means(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity")
    return out.withColumns({"F": rounded("F"), "O": rounded("O")})


@query(
    "crosstab_counts",
    """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_returnflag""",
)
def crosstab_counts(spark, sf):
    return d.cross_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query(
    "marginal_means",
    f"SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, {r('avg(l_quantity)')} AS mean FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
def marginal_means(spark, sf):
    return d.marginal_means(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("mean", rounded("mean"))


@query(
    "well_filled_lots",
    """WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    k AS (SELECT l_partkey FROM c GROUP BY l_partkey HAVING min(n) > 5 AND count(*) = 3)
    SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM k) GROUP BY l_partkey, l_returnflag""",
)
def well_filled_lots(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")
    kept = d.well_filled_groups(li, "l_partkey", "l_returnflag", 3)
    return kept.groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "value_shares",
    f"SELECT event_type, count(*) AS n, {r('count(*) / (SELECT count(*) FROM events)')} AS share FROM events GROUP BY event_type",
)
def value_shares(spark, sf):
    return d.value_shares(table(spark, sf, "events"), "event_type").withColumn("share", rounded("share"))


@query(
    "class_imbalance",
    f"SELECT {r('max(n) / min(n)')} AS imbalance_ratio, count(*) AS classes FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)",
)
def class_imbalance(spark, sf):
    counts = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return d.class_imbalance(counts).withColumn("imbalance_ratio", rounded("imbalance_ratio"))


TAGS = ["quality", "toxic", "long", "english"]


def tagged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    both = joins.align(docs, table(spark, sf, "labels"), ["doc_id"])
    return both.select(
        "doc_id",
        "quality",
        "toxic",
        (F.col("n_chars") > 800).cast("int").alias("long"),
        (F.col("lang") == "en").cast("int").alias("english"),
    )


TAGGED_SQL = """t AS (SELECT doc_id, quality, toxic, CAST(n_chars > 800 AS INT) AS long, CAST(lang = 'en' AS INT) AS english
  FROM documents JOIN labels USING (doc_id))"""


@query(
    "label_distribution",
    f"""WITH {TAGGED_SQL} SELECT count(*) AS samples, {r('avg(quality + toxic + long + english)')} AS cardinality, {r('avg(quality + toxic + long + english) / 4')} AS density,
    {r('avg(quality)')} AS frequency_quality, {r('avg(toxic)')} AS frequency_toxic, {r('avg(long)')} AS frequency_long, {r('avg(english)')} AS frequency_english FROM t""",
)
def label_distribution(spark, sf):
    out = d.label_distribution(tagged(spark, sf), TAGS)
    return out.withColumns({c: rounded(c) for c in out.columns if c != "samples"})


@query(
    "label_cooccurrence",
    f"WITH {TAGGED_SQL}, p AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS label_1, '{b}' AS label_2, CAST(sum({a} * {b}) AS BIGINT) AS n FROM t" for i, a in enumerate(TAGS) for b in TAGS[i + 1 :]
    )
    + ") SELECT * FROM p ORDER BY n DESC, label_1, label_2 LIMIT 5",
)
def label_cooccurrence(spark, sf):
    return d.label_pairs(tagged(spark, sf), TAGS)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS column1, '{b}' AS column2, {r(f'corr({a}, {b})')} AS correlation FROM lineitem GROUP BY l_returnflag"
        for i, a in enumerate(MEASURES)
        for b in MEASURES[i + 1 :]
    ),
)
def corr_matrix(spark, sf):
    return d.correlations(table(spark, sf, "lineitem"), MEASURES, ["l_returnflag"]).withColumn("correlation", rounded("correlation"))


@query(
    "spearman",
    f"""WITH q AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
      rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
    SELECT count(*) AS n, {r('corr(a, b)')} AS rho FROM q""",
)
def spearman(spark, sf):
    return d.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount").withColumn("rho", rounded("rho"))


CORR_SQL = " UNION ALL ".join(f"SELECT '{x}' AS f, '{y}' AS g, corr({x}, {y}) AS c FROM lineitem" for x in MEASURES for y in MEASURES if x != y)


# 1 - R2 of a measure on three others is a product of partial correlations.
@query(
    "vif",
    f"""WITH c AS ({CORR_SQL}), m AS (SELECT DISTINCT f FROM c),
    q AS (SELECT i.f AS i, j.f AS j, k.f AS k, l.f AS l FROM m i JOIN m j ON j.f <> i.f JOIN m k ON k.f > j.f AND k.f <> i.f JOIN m l ON l.f > k.f AND l.f <> i.f),
    p AS (SELECT i, a.c AS ij, b.c AS ik, d.c AS il, e.c AS jk, g.c AS jl, h.c AS kl FROM q JOIN c a ON a.f = i AND a.g = j JOIN c b ON b.f = i AND b.g = k JOIN c d ON d.f = i AND d.g = l
      JOIN c e ON e.f = j AND e.g = k JOIN c g ON g.f = j AND g.g = l JOIN c h ON h.f = k AND h.g = l),
    s AS (SELECT i, ij, (ik - ij * jk) / sqrt((1 - ij * ij) * (1 - jk * jk)) AS ik, (il - ij * jl) / sqrt((1 - ij * ij) * (1 - jl * jl)) AS il, (kl - jk * jl) / sqrt((1 - jk * jk) * (1 - jl * jl)) AS kl FROM p),
    t AS (SELECT i, ij, ik, (il - ik * kl) / sqrt((1 - ik * ik) * (1 - kl * kl)) AS il FROM s)
    SELECT i AS feature, {r('1 / ((1 - ij * ij) * (1 - ik * ik) * (1 - il * il))', 8)} AS vif FROM t""",
)
def vif(spark, sf):
    return d.variance_inflation(table(spark, sf, "lineitem"), MEASURES).withColumn("vif", rounded("vif", 8))


@query(
    "ols_table",
    f"""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my,
      var_pop(l_quantity) AS xx, var_pop(l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz,
      covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS zy, var_pop(l_extendedprice) AS yy FROM lineitem),
    b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM s),
    e AS (SELECT *, n * (yy - b1 * xy - b2 * zy) / (n - 3) AS mse FROM b)
    SELECT 'l_quantity' AS term, {r('b1', 3)} AS coefficient, {r('sqrt(mse * zz / (xx * zz - xz * xz) / n)', 3)} AS std_error FROM e
    UNION ALL SELECT 'l_discount', {r('b2', 3)}, {r('sqrt(mse * xx / (xx * zz - xz * xz) / n)', 3)} FROM e
    UNION ALL SELECT 'const', {r('my - b1 * mx - b2 * mz', 3)}, {r('sqrt(mse / n * (1 + (mx * mx * zz - 2 * mx * mz * xz + mz * mz * xx) / (xx * zz - xz * xz)))', 3)} FROM e""",
)
def ols_table(spark, sf):
    fit = d.LeastSquares(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    out = fit.table(spark)
    return out.select("term", rounded("coefficient", 3).alias("coefficient"), rounded("std_error", 3).alias("std_error"))


@query("ols_p_values")
def ols_p_values(spark, sf):
    fit = d.LeastSquares(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return fit.table(spark)


@query(
    "cooks_distance",
    f"""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, var_pop(l_quantity) AS xx, regr_slope(l_extendedprice, l_quantity) AS b,
      regr_intercept(l_extendedprice, l_quantity) AS a, var_pop(l_extendedprice) AS yy, covar_pop(l_quantity, l_extendedprice) AS xy FROM lineitem),
    e AS (SELECT {ID_SQL}, l_extendedprice - a - b * l_quantity AS residual, 1 / n + (l_quantity - mx) * (l_quantity - mx) / (n * xx) AS h,
      n * (yy - b * xy) / (n - 2) AS mse FROM lineitem CROSS JOIN s)
    SELECT {ID_SQL}, {r('residual', 4)} AS residual, {r('h', 9)} AS leverage, {r('residual * residual / (2 * mse) * h / ((1 - h) * (1 - h))', 9)} AS cooks_d FROM e""",
)
def cooks_distance(spark, sf):
    li = table(spark, sf, "lineitem").select(*ID, "l_quantity", "l_extendedprice")
    out = d.cooks_distance(li, ["l_quantity"], "l_extendedprice")
    return out.select(*ID, rounded("residual", 4).alias("residual"), rounded("leverage", 9).alias("leverage"), rounded("cooks_d", 9).alias("cooks_d"))


@query(
    "word_overlap",
    r"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(prev), '\s+'), lambda x: x <> '')) AS a,
      list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS b FROM t WHERE prev IS NOT NULL)
    SELECT conv_id, turn, (round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b) END, 6) + 0.0) AS overlap FROM w""",
)
def word_overlap(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    # A conversation is a bounded list of turns.
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = c.withColumn("prev", F.lag("text").over(w)).filter(F.col("prev").isNotNull())
    return t.select("conv_id", "turn", rounded(joins.word_overlap(F.col("prev"), F.col("text"))).alias("overlap"))


@query(
    "parsed_records",
    r"""SELECT event_id, CAST(regexp_extract(props, '"k": *(-?\d+)', 1) AS INTEGER) AS k FROM events""",
)
def parsed_records(spark, sf):
    from ..sources.readers import parse_json_records

    return parse_json_records(table(spark, sf, "events").select("event_id", "props"), "props", "k int").select("event_id", "k")


@query("table_checksums")
def table_checksums(spark, sf):
    """Length and sha256 of the table files."""
    from ..sources.checks import file_checksums

    return file_checksums(spark, str(sf), "*.parquet")

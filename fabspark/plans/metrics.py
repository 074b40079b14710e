"""Model-quality metrics over scored tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import metrics as m
from ..session import table
from .registry import query, r


def _round_all(df, skip=(), digits=6):
    return df.select(*[F.col(c) if c in skip else rounded(c, digits).alias(c) for c in df.columns])


def regress(spark, sf):
    """Predicted price 1500 per unit of quantity, in thousands."""
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))


REG = "s AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p FROM lineitem)"


@query(
    "regression_metrics",
    f"""WITH {REG} SELECT count(*) AS n, {r('avg(abs(p - y))')} AS mae, {r('sqrt(avg((p - y) * (p - y)))')} AS rmse,
    {r('1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*))')} AS r2, {r('avg(abs(p - y) / greatest(abs(y), 1e-8)) * 100')} AS mape FROM s""",
)
def regression_metrics(spark, sf):
    return _round_all(m.regression(regress(spark, sf), "y", "p"), ["n"])


@query(
    "pws_modes",
    f"""WITH {REG} SELECT {r('avg(CAST(p >= 10 AND p <= 60 AS DOUBLE))')} AS spec, {r('avg(CAST(coalesce(abs((p - y) / nullif(y, 0)) <= 0.1, false) AS DOUBLE))')} AS relative,
    {r('avg(CAST(abs(p - y) <= 5 AS DOUBLE))')} AS absolute, {r('avg(CAST(abs(p - y) <= 0.2 * y AS DOUBLE))')} AS scaled, {r('avg(CAST(p = y AS DOUBLE))')} AS exact FROM s""",
)
def pws_modes(spark, sf):
    modes = {
        "spec": ("spec", {"low": 10, "high": 60}),
        "relative": ("relative", {"tolerance": 0.1}),
        "absolute": ("absolute", {"tolerance": 5}),
        "scaled": ("scaled", {"tolerance": 0.2}),
        "exact": ("exact", {}),
    }
    return _round_all(m.pws(regress(spark, sf), "y", "p", modes))


@query(
    "loss_modes",
    f"""WITH {REG} SELECT {r('sum(greatest(0, abs(p - y) - 5) * 2)', 2)} AS dead_band, {r('sum((p - y) * (p - y) * 10)', 1)} AS quadratic,
    {r('avg(CASE WHEN p - y < 0 THEN 2 * abs(p - y) ELSE abs(p - y) END)')} AS asymmetric, {r('sum(greatest(0, abs(p - y) - 0.2 * y))', 2)} AS scaled FROM s""",
)
def loss_modes(spark, sf):
    modes = {
        "dead_band": ("dead_band", {"tolerance": 5, "cost": 2.0}),
        "quadratic": ("quadratic", {"cost": 10.0}),
        "asymmetric": ("asymmetric", {"penalty": 2.0}),
        "scaled": ("scaled_dead_band", {"tolerance": 0.2, "cost": 1.0}),
    }
    out = m.losses(regress(spark, sf), "y", "p", modes)
    return out.select(rounded("dead_band", 2).alias("dead_band"), rounded("quadratic", 1).alias("quadratic"), rounded("asymmetric").alias("asymmetric"), rounded("scaled", 2).alias("scaled"))


@query("yield_rate", f"WITH {REG} SELECT {r('avg(CAST(p >= 70 AS DOUBLE)) * 100')} AS yield_rate FROM s")
def yield_rate(spark, sf):
    return _round_all(m.yield_rate(regress(spark, sf), "p"))


def classified(spark, sf):
    """Quality labels scored by document length."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    both = docs.join(table(spark, sf, "labels"), "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + 800.0)
    return both.select("doc_id", F.col("quality").alias("y"), score.alias("score"), (score >= 0.5).cast("int").alias("p"))


CLS = "s AS (SELECT doc_id, quality AS y, n_chars / (n_chars + 800.0) AS score, CAST(n_chars / (n_chars + 800.0) >= 0.5 AS INT) AS p FROM documents JOIN labels USING (doc_id))"
CONF = f"{CLS}, c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM s)"


@query(
    "confusion",
    f"""WITH {CONF}, d AS (SELECT *, CAST(tp AS DOUBLE) AS a, CAST(fp AS DOUBLE) AS b, CAST(fn AS DOUBLE) AS x, CAST(tn AS DOUBLE) AS d FROM c)
    SELECT tp, fp, fn, tn, {r('a / (a + b)')} AS precision, {r('a / (a + x)')} AS recall, {r('2 * a / (2 * a + b + x)')} AS f1,
    {r('(a * d - b * x) / sqrt((a + b) * (a + x) * (d + b) * (d + x))')} AS mcc, {r('(a / (a + x) + d / (d + b)) / 2')} AS balanced_accuracy,
    {r('(a + d) / (a + b + x + d)')} AS accuracy, {r('(a + d) / (a + b + x + d) * 100')} AS pws, {r('a / (a + x)')} AS detection_rate, {r('b / (b + d)')} AS false_alarm_rate,
    {r('b + 10 * x')} AS estimated_loss, {r('(b + 10 * x) / (a + b + x + d)')} AS cost_per_sample FROM d""",
)
def confusion(spark, sf):
    out = m.binary_scores(m.confusion(classified(spark, sf), "y", "p"))
    return _round_all(out, ["tp", "fp", "fn", "tn"])


PTS = f"""{CLS}, g AS (SELECT score, count(*) AS n, sum(y) AS pos FROM s GROUP BY score),
  pt AS (SELECT score, n, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS pr, sum(pos) OVER () AS np, sum(n) OVER () AS nn,
    sum(n) OVER (ORDER BY score) - n + (n + 1) / 2.0 AS rk FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "roc_pr_auc",
    f"""WITH {PTS} SELECT {r('(sum(pos * rk) - max(np) * (max(np) + 1) / 2) / (max(np) * (max(nn) - max(np)))')} AS roc_auc, {r('sum(pos * tp / pr) / max(np)')} AS pr_auc FROM pt""",
)
def roc_pr_auc(spark, sf):
    return _round_all(m.roc_pr_auc(m.curve(classified(spark, sf), "y", "score")))


@query(
    "threshold_f1",
    f"""WITH {PTS}, f AS (SELECT score AS threshold, tp / pr AS precision, tp / np AS recall, 2 * (tp / pr) * (tp / np) / (tp / pr + tp / np + 1e-9) AS f1 FROM pt)
    SELECT {r('threshold')} AS threshold, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM f WHERE precision >= 0.3 AND recall >= 0.5 ORDER BY f.f1 DESC, f.threshold LIMIT 1""",
)
def threshold_f1(spark, sf):
    return _round_all(m.threshold_by_f1(m.curve(classified(spark, sf), "y", "score"), 0.3, 0.5))


@query(
    "threshold_youden",
    f"""WITH {PTS}, f AS (SELECT score AS threshold, tp / np - (pr - tp) / (nn - np) AS youden FROM pt)
    SELECT {r('threshold')} AS threshold, {r('youden')} AS youden FROM f ORDER BY f.youden DESC, f.threshold DESC LIMIT 1""",
)
def threshold_youden(spark, sf):
    return _round_all(m.threshold_by_youden(m.curve(classified(spark, sf), "y", "score")))


@query(
    "threshold_cost",
    f"""WITH {CLS}, g AS (SELECT CASE WHEN i = 99 THEN 0.99 ELSE 0.01 + i * (0.98 / 99) END AS threshold FROM (SELECT unnest(range(0, 100)) AS i)),
    f AS (SELECT threshold, sum(CASE WHEN score >= threshold AND y = 0 THEN 100.0 WHEN score < threshold AND y = 1 THEN 300.0 ELSE 0 END) AS cost FROM g CROSS JOIN s GROUP BY threshold)
    SELECT {r('threshold')} AS threshold, {r('cost')} AS cost FROM f ORDER BY f.cost, f.threshold LIMIT 1""",
)
def threshold_cost(spark, sf):
    return _round_all(m.threshold_by_cost(classified(spark, sf), "y", "score", 100.0, 300.0))


@query(
    "cost_grid",
    f"""WITH {CONF} SELECT mc AS miss_cost, fn * mc + fp * 10.0 AS alarm_10, fn * mc + fp * 100.0 AS alarm_100 FROM c, (SELECT unnest([100.0::DOUBLE, 1000.0, 5000.0]) AS mc)""",
)
def cost_grid(spark, sf):
    return m.cost_grid(m.confusion(classified(spark, sf), "y", "p"), [100, 1000, 5000], [10, 100])


def classes(spark, sf):
    """Wafer labels with every fourth decision off by one class."""
    e = table(spark, sf, "embeddings")
    pred = F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return e.select("vec_id", F.col("label").alias("y"), pred.cast("int").alias("p"))


MC = """s AS (SELECT vec_id, label AS y, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS p FROM embeddings),
  k AS (SELECT DISTINCT y AS k FROM s UNION SELECT DISTINCT p FROM s),
  pc AS (SELECT k, (SELECT count(*) FROM s WHERE y = k AND p = k) AS tp, (SELECT count(*) FROM s WHERE y = k) AS sup, (SELECT count(*) FROM s WHERE p = k) AS pr FROM k)"""


@query(
    "multiclass_f1",
    f"""WITH {MC} SELECT {r('sum(tp) / sum(sup)')} AS accuracy, {r('avg(coalesce(tp / nullif(pr, 0), 0))')} AS precision_macro, {r('avg(coalesce(tp / nullif(sup, 0), 0))')} AS recall_macro,
    {r('avg(2 * tp / (pr + sup))')} AS f1_macro, {r('sum(2 * tp / (pr + sup) * sup) / sum(sup)')} AS f1_weighted FROM pc""",
)
def multiclass_f1(spark, sf):
    return _round_all(m.multiclass(classes(spark, sf), "y", "p"))


@query(
    "matrix_losses",
    f"""WITH {MC}, v AS (SELECT y, p, y % 3 AS y3, p % 3 AS p3 FROM s)
    SELECT {r('avg(CASE WHEN y = p THEN 0 WHEN y = 0 THEN 2.0 ELSE 1.0 END)')} AS loss_defect, {r('avg(CASE WHEN y = p THEN 0 WHEN p = 0 THEN 50.0 ELSE 10.0 END)')} AS loss_pattern,
    {r('avg(CASE WHEN y = 2 AND p < 2 THEN 1000.0 WHEN y = 1 AND p = 0 THEN 100.0 ELSE abs(y - p) * 10.0 END)')} AS loss_severity, {r('avg(abs(y - p) * 50.0)')} AS loss_area FROM v""",
)
def matrix_losses(spark, sf):
    return _round_all(m.matrix_loss(classes(spark, sf), "y", "p", ["defect", "pattern", "severity", "area"]))


@query(
    "confidence_metrics",
    f"""WITH {MC}, c AS (SELECT *, (vec_id % 10) / 10.0 AS conf FROM s) SELECT {r('avg(CAST(y = p AS DOUBLE))')} AS accuracy,
    {r('count(*) FILTER (y <> 0 AND p <> 0) / count(*) FILTER (y <> 0)')} AS defect_detection_rate, {r('count(*) FILTER (y = 0 AND p <> 0) / count(*) FILTER (y = 0)')} AS false_alarm_rate,
    {r('count(*) FILTER (conf > 0.7 AND y = p) / count(*) FILTER (conf > 0.7)')} AS high_confidence_accuracy FROM c""",
)
def confidence_metrics(spark, sf):
    rows = classes(spark, sf).withColumn("conf", (F.col("vec_id") % 10) / 10.0)
    return _round_all(m.confidence_metrics(rows, "y", "p", "conf"))


LABELS = ["quality", "toxic", "long"]


def multi(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    both = docs.join(table(spark, sf, "labels"), "doc_id")
    return both.select(
        "doc_id",
        F.col("quality").alias("quality_true"),
        (F.col("n_chars") > 500).cast("int").alias("quality_pred"),
        F.col("toxic").alias("toxic_true"),
        (F.col("doc_id") % 3 == 0).cast("int").alias("toxic_pred"),
        (F.col("n_chars") > 800).cast("int").alias("long_true"),
        (F.col("n_chars") > 900).cast("int").alias("long_pred"),
    )


ML = """s AS (SELECT doc_id, quality AS y1, CAST(n_chars > 500 AS INT) AS p1, toxic AS y2, CAST(doc_id % 3 = 0 AS INT) AS p2,
    CAST(n_chars > 800 AS INT) AS y3, CAST(n_chars > 900 AS INT) AS p3 FROM documents JOIN labels USING (doc_id)),
  l AS (SELECT 'quality' AS label, y1 AS y, p1 AS p FROM s UNION ALL SELECT 'toxic', y2, p2 FROM s UNION ALL SELECT 'long', y3, p3 FROM s),
  pl AS (SELECT label, CAST(sum(y * p) AS DOUBLE) AS tp, CAST(sum(y) AS DOUBLE) AS t, CAST(sum(p) AS DOUBLE) AS q FROM l GROUP BY label)"""


@query(
    "multilabel_metrics",
    f"""WITH {ML}, w AS (SELECT abs(y1 - p1) + abs(y2 - p2) + abs(y3 - p3) AS wrong, y1 * p1 + y2 * p2 + y3 * p3 AS b, y1 + y2 + y3 AS ny, p1 + p2 + p3 AS np FROM s),
    a AS (SELECT avg(CAST(wrong = 0 AS DOUBLE)) AS subset_accuracy, avg(wrong) / 3 AS hamming_loss, avg(coalesce(b / nullif(ny + np - b, 0), 0)) AS jaccard_samples,
      avg(coalesce(2 * b / nullif(ny + np, 0), 0)) AS f1_samples FROM w)
    SELECT {r('subset_accuracy')} AS subset_accuracy, {r('hamming_loss')} AS hamming_loss, {r('jaccard_samples')} AS jaccard_samples, {r('f1_samples')} AS f1_samples,
      (SELECT {r('sum(tp) / sum(q)')} FROM pl) AS micro_precision, (SELECT {r('sum(tp) / sum(t)')} FROM pl) AS micro_recall, (SELECT {r('2 * sum(tp) / (sum(t) + sum(q))')} FROM pl) AS micro_f1,
      (SELECT {r('avg(coalesce(tp / nullif(q, 0), 0))')} FROM pl) AS macro_precision, (SELECT {r('avg(coalesce(tp / nullif(t, 0), 0))')} FROM pl) AS macro_recall,
      (SELECT {r('avg(coalesce(2 * tp / nullif(t + q, 0), 0))')} FROM pl) AS macro_f1, (SELECT {r('avg(coalesce(tp / nullif(t + q - tp, 0), 0))')} FROM pl) AS macro_jaccard FROM a""",
)
def multilabel_metrics(spark, sf):
    return _round_all(m.multilabel(multi(spark, sf), LABELS)[0])


@query(
    "multilabel_per_label",
    f"""WITH {ML} SELECT label, {r('coalesce(tp / nullif(q, 0), 0)')} AS precision, {r('coalesce(tp / nullif(t, 0), 0)')} AS recall, {r('coalesce(2 * tp / nullif(t + q, 0), 0)')} AS f1,
    {r('coalesce(tp / nullif(t + q - tp, 0), 0)')} AS jaccard, CAST(t AS BIGINT) AS support FROM pl""",
)
def multilabel_per_label(spark, sf):
    return _round_all(m.multilabel(multi(spark, sf), LABELS)[1], ["label", "support"])


@query(
    "cluster_sizes",
    f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM c)
    SELECT {r('-sum(p * ln(p + 1e-12)) / ln(max(k))')} AS cluster_size_entropy, {r('max(p)')} AS largest_cluster_fraction, CAST(0 AS DOUBLE) AS anomaly_ratio, '' AS warnings FROM p""",
)
def cluster_sizes(spark, sf):
    return _round_all(m.cluster_sizes(table(spark, sf, "embeddings"), "label"), ["warnings"])


@query(
    "cluster_separation",
    f"""WITH v AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
    c AS (SELECT label, count(*) AS n, avg(a) AS ca, avg(b) AS cb FROM v GROUP BY label), g AS (SELECT avg(a) AS ga, avg(b) AS gb, count(*) AS nn FROM v),
    d AS (SELECT v.label, pow(a - ca, 2) + pow(b - cb, 2) AS d2 FROM v JOIN c USING (label)), w AS (SELECT label, sum(d2) AS w, avg(sqrt(d2)) AS s FROM d GROUP BY label),
    x AS (SELECT c.*, w, s FROM c JOIN w USING (label)),
    ch AS (SELECT sum(n * (pow(ca - ga, 2) + pow(cb - gb, 2))) / (count(*) - 1) / (sum(w) / (max(nn) - count(*))) AS ch FROM x, g),
    db AS (SELECT p.label, max((p.s + q.s) / sqrt(pow(p.ca - q.ca, 2) + pow(p.cb - q.cb, 2))) AS r FROM x p JOIN x q ON p.label <> q.label GROUP BY p.label)
    SELECT {r('ch')} AS calinski_harabasz, (SELECT {r('avg(r)')} FROM db) AS davies_bouldin FROM ch""",
)
def cluster_separation(spark, sf):
    v = table(spark, sf, "embeddings").select(
        "label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b")
    )
    return _round_all(m.cluster_separation(v, "label", ["a", "b"]))


PROB = """pb AS (SELECT vec_id, label, [exp(embedding[1]), exp(embedding[2]), exp(embedding[3])] AS e FROM (SELECT vec_id, label, list_transform(embedding, lambda x: 6 * CAST(x AS DOUBLE)) AS embedding FROM embeddings)),
  pr AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM pb),
  un AS (SELECT *, -list_sum(list_transform(p, lambda x: x * ln(x + 1e-10))) / ln(3) AS h, list_max(p) AS c FROM pr),
  uc AS (SELECT *, CASE WHEN (h + 1 - c) / 2 < 0.2 THEN 'low' WHEN (h + 1 - c) / 2 < 0.5 THEN 'medium' ELSE 'high' END AS cat FROM un)"""


def probabilities(spark, sf):
    """Softmax of the first three components, sharpened six times."""
    e = table(spark, sf, "embeddings")
    raw = F.transform(F.slice("embedding", 1, 3), lambda x: F.exp(6 * x.cast("double")))
    rows = e.select("vec_id", "label", raw.alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("p", F.transform("e", lambda x: x / total)).drop("e")


@query(
    "uncertainty",
    f"WITH {PROB} SELECT vec_id, {r('h')} AS entropy_uncertainty, {r('c')} AS confidence, {r('(h + 1 - c) / 2')} AS overall_uncertainty, cat AS uncertainty_category FROM uc",
)
def uncertainty(spark, sf):
    out = m.uncertainty(probabilities(spark, sf), "p").drop("label", "p")
    return _round_all(out, ["vec_id", "uncertainty_category"])


@query(
    "risk_actions",
    f"""WITH {PROB}, k AS (SELECT vec_id, CASE WHEN label <> 0 THEN least(1.0, 0.5 * (CASE WHEN c > 0.8 THEN 1.2 WHEN c > 0.6 THEN 1.0 ELSE 0.7 END)
        * (CASE cat WHEN 'high' THEN 0.8 WHEN 'low' THEN 1.1 ELSE 1.0 END)) END AS risk FROM uc)
    SELECT vec_id, {r('CAST(risk AS DOUBLE)')} AS risk_score, CASE WHEN risk > 0.8 THEN 'high' WHEN risk > 0.5 THEN 'medium' ELSE 'low' END AS risk_level,
    CASE WHEN risk IS NULL THEN 'continue_processing' WHEN risk > 0.8 THEN 'reject_wafer' WHEN risk > 0.5 THEN 'investigate_further' ELSE 'monitor_closely' END AS recommended_action FROM k""",
)
def risk_actions(spark, sf):
    rows = m.uncertainty(probabilities(spark, sf), "p")
    out = m.risk_action(rows, F.col("label") != 0, "confidence", "uncertainty_category")
    return out.select("vec_id", rounded("risk_score").alias("risk_score"), "risk_level", "recommended_action")


@query(
    "detection_severity",
    f"""WITH {PROB}, s AS (SELECT vec_id, CASE WHEN label <> 0 THEN c * (1 + (vec_id % 4) * 0.2) ELSE 0 END AS s FROM un)
    SELECT vec_id, {r('least(1.0, s)')} AS severity_score, CASE WHEN s > 0.8 THEN 'high' WHEN s > 0.5 THEN 'medium' ELSE 'low' END AS yield_impact,
    {r('CASE WHEN s > 0.8 THEN 5000 * s WHEN s > 0.5 THEN 2000 * s ELSE 500 * s END')} AS economic_impact_usd FROM s""",
)
def detection_severity(spark, sf):
    rows = m.uncertainty(probabilities(spark, sf), "p")
    out = m.detection_severity(rows, F.col("confidence"), F.col("vec_id") % 4, F.col("label") != 0)
    return out.select("vec_id", rounded("severity_score").alias("severity_score"), "yield_impact", rounded("economic_impact_usd").alias("economic_impact_usd"))


@query(
    "anomaly_forecast_scores",
    f"""WITH {REG}, f AS (SELECT abs(y - 60) > 40 AS a, abs(p - 60) > 20 AND abs(p - 60) > 40 AS b FROM s),
    c AS (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn, avg(CAST(b AS DOUBLE)) * 100 AS anomaly_rate FROM f)
    SELECT {r('anomaly_rate')} AS anomaly_rate, {r('tp / (tp + fp)')} AS anomaly_precision, {r('tp / (tp + fn)')} AS anomaly_recall, {r('2 * tp / (2 * tp + fp + fn)')} AS anomaly_f1 FROM c""",
)
def anomaly_forecast_scores(spark, sf):
    return _round_all(m.anomaly_forecast_scores(regress(spark, sf), "y", "p", 60.0, 40.0))

"""Model-quality and cost metrics as aggregates over scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio_or
from .ordered import HOT_ROWS
from .pairs import largest_over_others
from .ranks import attach_stats, distribution


def regression(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2, MAPE."""
    y, e = F.col(truth).cast("double"), (F.col(pred) - F.col(truth)).cast("double")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        (F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1e-8))) * 100).alias("mape"),
    )
    return out


def within_spec(mode: str, truth: Column, pred: Column, **p: float) -> Column:
    """Row condition of "prediction within spec", by mode: ``spec`` (low,
    high), ``relative`` or ``absolute`` (tolerance), ``scaled`` (absolute error
    within tolerance * truth), ``exact``."""
    err = F.abs(pred - truth)
    if mode == "spec":
        return (pred >= p["low"]) & (pred <= p["high"])
    if mode == "relative":
        return F.abs(F.try_divide(pred - truth, truth)) <= p["tolerance"]
    if mode == "absolute":
        return err <= p["tolerance"]
    if mode == "scaled":
        return err <= p["tolerance"] * truth
    if mode == "exact":
        return pred == truth
    raise ValueError(f"unknown mode {mode!r}")


def pws(df: DataFrame, truth: str, pred: str, modes: dict[str, tuple[str, dict]]) -> DataFrame:
    """Share of rows within spec for several named definitions."""
    cols = [
        F.avg(F.coalesce(within_spec(m, F.col(truth), F.col(pred), **p), F.lit(False)).cast("double")).alias(n)
        for n, (m, p) in modes.items()
    ]
    return df.agg(*cols)


def row_loss(mode: str, truth: Column, pred: Column, **p: float) -> Column:
    """Loss of one row, by mode: ``dead_band`` (cost per unit beyond the
    tolerance), ``scaled_dead_band`` (tolerance * truth), ``quadratic``,
    ``linear``, ``asymmetric`` (underestimates cost ``penalty`` times more)."""
    e = pred - truth
    if mode == "dead_band":
        return F.greatest(F.lit(0.0), F.abs(e) - p["tolerance"]) * p["cost"]
    if mode == "scaled_dead_band":
        return F.greatest(F.lit(0.0), F.abs(e) - p["tolerance"] * truth) * p["cost"]
    if mode == "quadratic":
        return e * e * p["cost"]
    if mode == "linear":
        return F.abs(e) * p["cost"]
    if mode == "asymmetric":
        return F.when(e < 0, F.abs(e) * p["penalty"]).otherwise(F.abs(e))
    raise ValueError(f"unknown mode {mode!r}")


def losses(df: DataFrame, truth: str, pred: str, modes: dict[str, tuple[str, dict]]) -> DataFrame:
    """Sums (means for ``asymmetric``) of several named losses."""
    cols = []
    for n, (m, p) in modes.items():
        c = row_loss(m, F.col(truth), F.col(pred), **p)
        cols.append((F.avg(c) if m == "asymmetric" else F.sum(c)).alias(n))
    return df.agg(*cols)


def confusion(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(truth) == 1, F.col(pred) == 1
    return df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )


def binary_scores(conf: DataFrame, fp_cost: float = 1.0, fn_cost: float = 10.0) -> DataFrame:
    """Precision, recall, F1, MCC, balanced accuracy, PWS, rates and cost from
    confusion counts; undefined ratios are zero."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = ratio_or(tp, tp + fp), ratio_or(tp, tp + fn)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    cost = fp * fp_cost + fn * fn_cost
    return conf.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": ratio_or(2 * tp, 2 * tp + fp + fn),
            "mcc": ratio_or(tp * tn - fp * fn, root),
            "balanced_accuracy": (recall + ratio_or(tn, tn + fp)) / 2,
            "accuracy": ratio_or(tp + tn, n),
            "pws": ratio_or(tp + tn, n) * 100,
            "detection_rate": recall,
            "false_alarm_rate": ratio_or(fp, fp + tn),
            "estimated_loss": cost,
            "cost_per_sample": ratio_or(cost, n),
        }
    )


def curve(df: DataFrame, truth: str, score: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct score used as a threshold (score >= threshold):
    tp, fp, positives, negatives, precision, recall, fpr."""
    rows = df.select(F.col(score), (F.col(truth) == 1).cast("long").alias("_y"))
    d = distribution(rows, [], score, extra={"pos": F.col("_y")}, hot_rows=hot_rows)
    tp = F.col("total_pos") - (F.col("upto_pos") - F.col("pos"))
    predicted = F.col("total") - F.col("below")
    return d.select(
        F.col(score).alias("threshold"),
        "n",
        "pos",
        "avg_rank",
        tp.alias("tp"),
        (predicted - tp).alias("fp"),
        F.col("total_pos").alias("positives"),
        (F.col("total") - F.col("total_pos")).alias("negatives"),
        ratio_or(tp, predicted).alias("precision"),
        ratio_or(tp, F.col("total_pos")).alias("recall"),
        ratio_or(predicted - tp, F.col("total") - F.col("total_pos")).alias("fpr"),
    )


def roc_pr_auc(points: DataFrame) -> DataFrame:
    """ROC AUC from the rank sum, average precision from recall steps; zero
    where a class is missing."""
    p, n = F.max("positives").cast("double"), F.max("negatives").cast("double")
    rank_sum = F.sum(F.col("pos") * F.col("avg_rank"))
    return points.agg(
        ratio_or(rank_sum - p * (p + 1) / 2, p * n).alias("roc_auc"),
        F.when(n > 0, ratio_or(F.sum(F.col("pos") * F.col("precision")), p)).otherwise(0.0).alias("pr_auc"),
    )


def threshold_by_f1(points: DataFrame, min_precision: float = 0.0, min_recall: float = 0.0) -> DataFrame:
    """Threshold of highest F1 among those reaching both floors."""
    ok = points.filter((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    best = F.max_by(F.struct("threshold", "precision", "recall", f1.alias("f1")), F.struct(f1, -F.col("threshold")))
    return ok.agg(best.alias("b")).select("b.*")


def threshold_by_youden(points: DataFrame) -> DataFrame:
    j = F.col("recall") - F.col("fpr")
    best = F.max_by(F.struct("threshold", j.alias("youden")), F.struct(j, F.col("threshold")))
    return points.agg(best.alias("b")).select("b.*")


def threshold_by_cost(df: DataFrame, truth: str, score: str, fp_cost: float, fn_cost: float, points: int = 100) -> DataFrame:
    """Cheapest of ``points`` thresholds from 0.01 to 0.99, the lowest on
    ties. Rows are counted per threshold interval first, so the grid never
    meets the rows."""
    grid = [0.01 + i * (0.98 / (points - 1)) for i in range(points)]
    grid[-1] = 0.99
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col(score)))
    y = F.col(truth) == 1
    cells = df.groupBy(passed.alias("passed")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    # At most points + 1 cells: one bounded row of them.
    row = cells.agg(F.collect_list(F.struct("passed", "p", "n")).alias("c"))

    def total(field: str, cond) -> Column:
        return F.aggregate(F.filter("c", cond), F.lit(0).cast("long"), lambda acc, x: acc + x[field])

    options = row.select(
        "c", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold")
    ).select(
        "threshold",
        (total("n", lambda x: x["passed"] > F.col("i")) * F.lit(fp_cost) + total("p", lambda x: x["passed"] <= F.col("i")) * F.lit(fn_cost)).alias("cost"),
    )
    return options.agg(F.min_by(F.struct("threshold", "cost"), F.struct("cost", "threshold")).alias("b")).select("b.*")


def multiclass(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, macro and weighted precision / recall / F1."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    by_t = cells.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_p = cells.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("predicted"))
    both = by_t.join(by_p, "k", "full_outer").na.fill(0, subset=["support", "tp", "predicted"])
    per = both.withColumns(
        {
            "precision": ratio_or(F.col("tp"), F.col("predicted")),
            "recall": ratio_or(F.col("tp"), F.col("support")),
            "f1": ratio_or(2 * F.col("tp"), F.col("predicted") + F.col("support")),
        }
    )
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def cost_matrix(kind: str, truth: Column, pred: Column) -> Column:
    """Cost of one decision. ``defect``: missing a defect 2, others 1.
    ``pattern``: missing 50, other errors 10. ``severity``: high missed 1000,
    medium missed 100, else 10 per step. ``area``: 50 per step."""
    same = truth == pred
    if kind == "defect":
        return F.when(same, 0.0).when(truth == 0, 2.0).otherwise(1.0)
    if kind == "pattern":
        return F.when(same, 0.0).when(pred == 0, 50.0).otherwise(10.0)
    if kind == "severity":
        step = F.abs(truth - pred) * 10.0
        return F.when((truth == 2) & (pred < 2), 1000.0).when((truth == 1) & (pred == 0), 100.0).otherwise(step)
    if kind == "area":
        return F.abs(truth - pred) * 50.0
    raise ValueError(f"unknown cost matrix {kind!r}")


def matrix_loss(df: DataFrame, truth: str, pred: str, kinds: Sequence[str]) -> DataFrame:
    """Mean cost per sample, from the confusion table."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(*[(F.sum(cost_matrix(k, F.col("t"), F.col("p")) * F.col("n")) / F.sum("n")).alias(f"loss_{k}") for k in kinds])


def multilabel(df: DataFrame, labels: Sequence[str], truth_suffix: str = "_true", pred_suffix: str = "_pred") -> tuple[DataFrame, DataFrame]:
    """Overall metrics (one row) and per-label rows, one pass each."""
    y = {c: F.col(c + truth_suffix) for c in labels}
    p = {c: F.col(c + pred_suffix) for c in labels}
    wrong = sum((F.abs(y[c] - p[c]) for c in labels), F.lit(0))
    both = sum((y[c] * p[c] for c in labels), F.lit(0)).cast("double")
    ny, np_ = sum(y.values(), F.lit(0)), sum(p.values(), F.lit(0))
    sums = []
    for c in labels:
        sums += [F.sum(y[c] * p[c]).alias(f"_tp_{c}"), F.sum(y[c]).alias(f"_t_{c}"), F.sum(p[c]).alias(f"_p_{c}")]
    row = df.agg(
        F.avg((wrong == 0).cast("double")).alias("subset_accuracy"),
        (F.avg(wrong) / len(labels)).alias("hamming_loss"),
        F.avg(ratio_or(both, ny + np_ - both)).alias("jaccard_samples"),
        F.avg(ratio_or(2 * both, ny + np_)).alias("f1_samples"),
        *sums,
    )
    per = row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("label"),
                        ratio_or(F.col(f"_tp_{c}"), F.col(f"_p_{c}")).alias("precision"),
                        ratio_or(F.col(f"_tp_{c}"), F.col(f"_t_{c}")).alias("recall"),
                        ratio_or(2 * F.col(f"_tp_{c}"), F.col(f"_t_{c}") + F.col(f"_p_{c}")).alias("f1"),
                        ratio_or(F.col(f"_tp_{c}"), F.col(f"_t_{c}") + F.col(f"_p_{c}") - F.col(f"_tp_{c}")).alias("jaccard"),
                        F.col(f"_t_{c}").cast("long").alias("support"),
                    )
                    for c in labels
                ]
            )
        )
    )
    tp = sum((F.col(f"_tp_{c}") for c in labels), F.lit(0))
    t = sum((F.col(f"_t_{c}") for c in labels), F.lit(0))
    q = sum((F.col(f"_p_{c}") for c in labels), F.lit(0))

    def macro(name: str) -> Column:
        parts = {
            "precision": lambda c: ratio_or(F.col(f"_tp_{c}"), F.col(f"_p_{c}")),
            "recall": lambda c: ratio_or(F.col(f"_tp_{c}"), F.col(f"_t_{c}")),
            "f1": lambda c: ratio_or(2 * F.col(f"_tp_{c}"), F.col(f"_t_{c}") + F.col(f"_p_{c}")),
            "jaccard": lambda c: ratio_or(F.col(f"_tp_{c}"), F.col(f"_t_{c}") + F.col(f"_p_{c}") - F.col(f"_tp_{c}")),
        }[name]
        return sum((parts(c) for c in labels), F.lit(0.0)) / len(labels)

    overall = row.select(
        "subset_accuracy", "hamming_loss", "jaccard_samples", "f1_samples",
        ratio_or(tp, q).alias("micro_precision"), ratio_or(tp, t).alias("micro_recall"), ratio_or(2 * tp, t + q).alias("micro_f1"),
        *[macro(n).alias(f"macro_{n}") for n in ("precision", "recall", "f1", "jaccard")],
    )
    return overall, per


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """Normalised size entropy and largest fraction without noise (-1), the
    share of noise, and warnings."""
    counts = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col(cluster) != -1, F.col("n"))
    sums = counts.agg(F.sum(kept).alias("_in"), F.sum("n").alias("_all"), F.count(kept).alias("_k"))
    rows = attach_stats(counts, sums, [])
    p = kept / F.col("_in")
    out = rows.agg(
        F.try_divide(-F.sum(p * F.ln(p + 1e-12)), F.ln(F.max("_k").cast("double"))).alias("cluster_size_entropy"),
        F.max(p).alias("largest_cluster_fraction"),
        (1 - F.max("_in") / F.max("_all")).alias("anomaly_ratio"),
    )
    warn = F.array_compact(
        F.array(
            F.when(F.col("largest_cluster_fraction") > 0.85, F.lit("degenerate_cluster:largest_frac>0.85")),
            F.when(F.col("anomaly_ratio") > 0.15, F.lit("high_anomaly_ratio:possible_global_drift")),
        )
    )
    return out.withColumn("warnings", F.array_join(warn, ","))


def worst_overlap(clusters: DataFrame, centre: Sequence[str], block: int = 1000) -> DataFrame:
    """(id, worst): per cluster its largest Davies-Bouldin ratio to another one;
    ``clusters`` has id, scatter ``_s`` and the columns of the centre."""

    def ratio(a: Column, b: Column) -> Column:
        d2 = sum(((a[c] - b[c]) * (a[c] - b[c]) for c in centre), F.lit(0.0))
        return (a["_s"] + b["_s"]) / F.sqrt(d2)

    return largest_over_others(clusters, "id", ratio, "worst", block)


def cluster_separation(df: DataFrame, cluster: str, columns: Sequence[str], block: int = 1000) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from centroids and scatter. The
    only pairs are of clusters, which meet in blocks of about ``block``."""
    cols = list(columns)
    cent = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_c_{c}") for c in cols])
    grand = df.agg(*[F.avg(c).alias(f"_g_{c}") for c in cols], F.count(F.lit(1)).alias("_total"))
    rows = attach_stats(df.select(cluster, *cols), cent, [cluster])

    def sq(pairs) -> Column:
        return sum(((a - b) * (a - b) for a, b in pairs), F.lit(0.0))

    d2 = sq([(F.col(c), F.col(f"_c_{c}")) for c in cols])
    scatter = rows.groupBy(cluster).agg(F.sum(d2).alias("_w"), F.avg(F.sqrt(d2)).alias("_s"))
    groups = attach_stats(attach_stats(cent, scatter, [cluster]), grand, [])
    between = F.sum(F.col("_n") * sq([(F.col(f"_c_{c}"), F.col(f"_g_{c}")) for c in cols]))
    k, n = F.count(F.lit(1)), F.max("_total")
    ch = groups.agg((between / (k - 1) / (F.sum("_w") / (n - k))).alias("calinski_harabasz"))
    # Davies-Bouldin compares every cluster with every other one, in blocks.
    db = worst_overlap(groups.select(F.col(cluster).alias("id"), "_s", *[f"_c_{c}" for c in cols]), [f"_c_{c}" for c in cols], block)
    db = db.agg(F.avg("worst").alias("davies_bouldin"))
    return attach_stats(ch, db, [])


def confidence_metrics(df: DataFrame, truth: str, pred: str, confidence: str, threshold: float = 0.7) -> DataFrame:
    """Defect detection rate, false alarm rate, accuracy of confident rows."""
    y, p, sure = F.col(truth), F.col(pred), F.col(confidence) > threshold
    return df.agg(
        F.avg((y == p).cast("double")).alias("accuracy"),
        ratio_or(F.count_if((y != 0) & (p != 0)), F.count_if(y != 0)).alias("defect_detection_rate"),
        ratio_or(F.count_if((y == 0) & (p != 0)), F.count_if(y == 0)).alias("false_alarm_rate"),
        ratio_or(F.count_if(sure & (y == p)), F.count_if(sure)).alias("high_confidence_accuracy"),
    )


def uncertainty(df: DataFrame, probabilities: str) -> DataFrame:
    """Entropy, confidence and category from an array of probabilities."""
    p = F.col(probabilities)
    entropy = -F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * F.ln(x + 1e-10)) / F.ln(F.size(p).cast("double"))
    out = df.withColumns({"entropy_uncertainty": entropy, "confidence": F.array_max(p)})
    both = (F.col("entropy_uncertainty") + 1 - F.col("confidence")) / 2
    return out.withColumns(
        {
            "overall_uncertainty": both,
            "uncertainty_category": F.when(both < 0.2, "low").when(both < 0.5, "medium").otherwise("high"),
        }
    )


def risk_action(df: DataFrame, is_defect: Column, confidence: str, category: str, high_risk_regions: Column | int = 0) -> DataFrame:
    """Risk score, level and action of a defect decision."""
    c = F.col(confidence)
    regions = F.lit(high_risk_regions) if isinstance(high_risk_regions, int) else high_risk_regions
    m = F.when(c > 0.8, 1.2).when(c > 0.6, 1.0).otherwise(0.7)
    m = m * F.when(F.col(category) == "high", 0.8).when(F.col(category) == "low", 1.1).otherwise(1.0)
    m = m * F.when(regions > 2, 1.3).otherwise(1.0)
    risk = F.when(is_defect, F.least(F.lit(1.0), 0.5 * m))
    out = df.withColumn("risk_score", risk)
    r = F.col("risk_score")
    return out.withColumns(
        {
            "risk_level": F.when(r > 0.8, "high").when(r > 0.5, "medium").otherwise("low"),
            "recommended_action": F.when(r.isNull(), "continue_processing")
            .when(r > 0.8, "reject_wafer")
            .when(r > 0.5, "investigate_further")
            .otherwise("monitor_closely"),
        }
    )


def detection_severity(df: DataFrame, confidence: Column, detections: Column, is_defect: Column) -> DataFrame:
    """confidence * (1 + 0.2 n) with its ladder and dollar impact."""
    raw = F.when(is_defect, confidence * (1 + detections * 0.2)).otherwise(0.0)
    out = df.withColumn("_raw", raw)
    s = F.col("_raw")
    return out.withColumns(
        {
            "severity_score": F.least(F.lit(1.0), s),
            "yield_impact": F.when(s > 0.8, "high").when(s > 0.5, "medium").otherwise("low"),
            "economic_impact_usd": F.when(s > 0.8, 5000 * s).when(s > 0.5, 2000 * s).otherwise(500 * s),
        }
    ).drop("_raw")


def cost_grid(conf: DataFrame, miss_costs: Sequence[float], alarm_costs: Sequence[float]) -> DataFrame:
    """Total loss for every miss cost (rows) and false-alarm cost (columns)."""
    rows = conf.select("fp", "fn", F.explode(F.array(*[F.lit(float(c)) for c in miss_costs])).alias("miss_cost"))
    return rows.select(
        "miss_cost", *[(F.col("fn") * F.col("miss_cost") + F.col("fp") * float(a)).alias(f"alarm_{a:g}") for a in alarm_costs]
    )


def yield_rate(df: DataFrame, pred: str, threshold: float = 70.0) -> DataFrame:
    return df.agg((F.avg((F.col(pred) >= threshold).cast("double")) * 100).alias("yield_rate"))


def anomaly_forecast_scores(df: DataFrame, truth: str, pred: str, mean: float | Column, threshold: float | Column) -> DataFrame:
    """Precision / recall / F1 of threshold anomalies; without any actual
    anomaly precision and F1 are 1 if nothing was predicted, else 0."""
    actual = F.abs(F.col(truth) - mean) > threshold
    found = F.abs(F.col(pred) - mean) > threshold
    row = df.agg(
        F.count_if(actual & found).alias("tp"), F.count_if(~actual & found).alias("fp"), F.count_if(actual & ~found).alias("fn"),
        (F.avg(found.cast("double")) * 100).alias("anomaly_rate"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none, quiet = (tp + fn) == 0, F.when(tp + fp == 0, 1.0).otherwise(0.0)
    return row.select(
        "anomaly_rate",
        F.when(none, quiet).otherwise(ratio_or(tp, tp + fp)).alias("anomaly_precision"),
        F.when(none, 1.0).otherwise(ratio_or(tp, tp + fn)).alias("anomaly_recall"),
        F.when(none, quiet).otherwise(ratio_or(2 * tp, 2 * tp + fp + fn)).alias("anomaly_f1"),
    )



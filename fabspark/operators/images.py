"""Image-level evaluation: masks, boxes, greedy matching, pixel features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import box_iou, ratio_or
from ..session import cut_lineage
from .metrics import curve, roc_pr_auc
from .ranks import attach_stats


def mask_metrics(pixels: DataFrame, image: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """IoU, accuracy, coverage, false positive rate and Dice per image. Two
    empty masks agree fully; with an empty truth coverage is 1 or 0."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    s = pixels.groupBy(image).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("both"), F.count_if(t).alias("t"), F.count_if(p).alias("p"), F.count_if(t == p).alias("same")
    )
    union = F.col("t") + F.col("p") - F.col("both")
    return s.select(
        image,
        ratio_or(F.col("both"), union, 1.0).alias("iou"),
        (F.col("same") / F.col("n")).alias("pixel_accuracy"),
        F.when(F.col("t") == 0, (F.col("p") == 0).cast("double")).otherwise(ratio_or(F.col("both"), F.col("t"))).alias("defect_coverage"),
        ratio_or(F.col("p") - F.col("both"), F.col("n") - F.col("t")).alias("false_positive_rate"),
        ratio_or(2 * F.col("both"), F.col("t") + F.col("p"), 1.0).alias("dice"),
    )


def segmentation_summary(per_image: DataFrame) -> DataFrame:
    return per_image.agg(
        F.avg("iou").alias("mean_iou"),
        F.avg("pixel_accuracy").alias("pixel_accuracy"),
        F.avg("defect_coverage").alias("defect_coverage"),
        F.avg("false_positive_rate").alias("false_positive_rate"),
        F.avg((F.col("iou") > 0.1).cast("double")).alias("defect_detection_rate"),
    )


def scores_by_type(per_image: DataFrame, kind: str) -> DataFrame:
    return per_image.groupBy(kind).agg(
        F.avg("dice").alias("dice_mean"), F.stddev_samp("dice").alias("dice_std"), F.avg("iou").alias("iou_mean"), F.stddev_samp("iou").alias("iou_std")
    )


def overlapping_boxes(pred: DataFrame, truth: DataFrame, image: str, cell: int = 32) -> DataFrame:
    """Pairs of boxes of an image that overlap, with their IoU.

    Boxes meet through the grid cells they cover, so an image with very many
    boxes is spread over its cells and distant boxes never pair up. A pair is
    kept in the cell of its intersection's corner only.
    """

    def cells(df: DataFrame, tag: str) -> DataFrame:
        b = F.col("bbox")
        xs = F.sequence(F.floor(b[0] / cell), F.greatest(F.floor((b[2] - 1) / cell), F.floor(b[0] / cell)))
        ys = F.sequence(F.floor(b[1] / cell), F.greatest(F.floor((b[3] - 1) / cell), F.floor(b[1] / cell)))
        out = df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))
        return out.select(image, "_cx", "_cy", *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c != image])

    both = cells(pred, "pred").join(cells(truth, "true"), [image, "_cx", "_cy"])
    p, t = F.col("pred_bbox"), F.col("true_bbox")
    left, top = F.greatest(p[0], t[0]), F.greatest(p[1], t[1])
    both = both.filter((F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy")))
    return both.withColumn("iou", box_iou(p, t)).filter(F.col("iou") > 0).drop("_cx", "_cy")


def settle_matches(pairs: DataFrame, image: str) -> DataFrame:
    """(image, det, true_det): the greedy matching of ``pairs`` (image, det,
    true_det, iou) in rounds of joins.

    The box that a prediction likes best among the free ones is its own once no
    earlier open prediction competes for it, whatever happens elsewhere. A round
    settles all such predictions of all images; then their pairs and those of
    the boxes they take are gone, and predictions without pairs have no box.
    """
    spark, schema = pairs.sparkSession, pairs.drop("iou").schema
    hits = spark.createDataFrame([], schema)
    left = cut_lineage(pairs)
    while not left.isEmpty():
        best = left.groupBy(image, "det").agg(F.max_by("true_det", F.struct("iou", -F.col("true_det"))).alias("true_det"))
        first = left.groupBy(image, "true_det").agg(F.min("det").alias("first"))
        done = cut_lineage(best.join(first, [image, "true_det"]).filter(F.col("first") == F.col("det")).select(image, "det", "true_det"))
        hits = hits.unionByName(done)
        left = cut_lineage(left.join(done.select(image, "det"), [image, "det"], "left_anti").join(done.select(image, "true_det"), [image, "true_det"], "left_anti"))
    return hits


def match_detections(pred: DataFrame, truth: DataFrame, image: str, iou_threshold: float = 0.5, cell: int = 32) -> DataFrame:
    """Greedy matching in prediction order: each prediction takes the free box
    of highest IoU (the earlier box on ties) and counts as true positive from
    the threshold on. ``pred`` has image, det, bbox, confidence; ``truth`` has
    image, det, bbox. Only overlapping pairs reach the matching, which goes in
    rounds (:func:`settle_matches`), so a crowded image is no single task. Returns
    one row per prediction (is_tp) and one per box left over (missed)."""
    # A box below the threshold is never taken, and what is never taken decides nothing.
    pairs = overlapping_boxes(pred.select(image, "det", "bbox"), truth.select(image, "det", "bbox"), image, cell).filter(F.col("iou") >= iou_threshold)
    hits = settle_matches(pairs.select(image, F.col("pred_det").alias("det"), "true_det", "iou"), image)
    scored = pred.join(hits, [image, "det"], "left").select(
        image, "det", "confidence", F.col("true_det").isNotNull().cast("int").alias("is_tp"), F.lit(0).alias("missed")
    )
    left = truth.join(hits.select(image, F.col("true_det").alias("det")), [image, "det"], "left_anti")
    return scored.unionByName(
        left.select(image, "det", F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("is_tp"), F.lit(1).alias("missed"))
    )


def detection_metrics(matches: DataFrame, miss_cost: float = 1000.0, alarm_cost: float = 100.0) -> DataFrame:
    """Precision, recall, F1, average precision, PWS and estimated loss."""
    matches = matches.persist()
    row = matches.agg(
        F.sum("is_tp").alias("tp"),
        F.count_if((F.col("missed") == 0) & (F.col("is_tp") == 0)).alias("fp"),
        F.sum("missed").alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = row.select(
        F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        ratio_or(tp, tp + fp).alias("precision"),
        ratio_or(tp, tp + fn).alias("recall"),
        ratio_or(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        (ratio_or(tp, tp + fp + fn) * 100).alias("pws_percent"),
        (fp * alarm_cost + fn * miss_cost).alias("estimated_loss_usd"),
    )
    ap = roc_pr_auc(curve(matches.filter(F.col("missed") == 0), "is_tp", "confidence")).select(F.col("pr_auc").alias("map_50"))
    return attach_stats(out, ap, [])


def _mirrored(pixels: DataFrame, image: str, h: int, w: int, reach: int) -> DataFrame:
    """Adds the mirrored border the filters reach into (d c b a | a b c d)."""
    def copies(name: str, size: int):
        v = F.col(name)
        return F.array_compact(
            F.array(v, F.when(v < reach, -1 - v), F.when(v >= size - reach, 2 * size - 1 - v))
        )

    return pixels.withColumn("_r", F.explode(copies("row", h))).withColumn("_c", F.explode(copies("col", w)))


def _in_tiles(rows: DataFrame, reach: int, tile: int) -> DataFrame:
    """Rows once for each tile (``_tr``, ``_tc``) they are in or near to."""

    def tiles(name: str):
        home, at = F.floor(F.col(name) / tile), F.pmod(F.col(name), F.lit(tile))
        return F.array_compact(F.array(home, F.when(at < reach, home - 1), F.when(at >= tile - reach, home + 1)))

    return rows.withColumn("_tr", F.explode(tiles("_r"))).withColumn("_tc", F.explode(tiles("_c")))


def pixel_features(pixels: DataFrame, image: str, h: int, w: int, patch: int = 5, tile: int = 1024) -> DataFrame:
    """Value, patch mean / deviation / minimum / maximum and Sobel gradients.
    The filters are separable: a window along rows, then one along columns,
    after a single shuffle by image, or by tile with a halo where an image is
    larger than a tile."""
    reach = patch // 2
    rows = _mirrored(pixels.withColumn("value", F.col("value").cast("double")), image, h, w, reach)
    part = [image]
    if max(h, w) > tile:
        part += ["_tr", "_tc"]
        rows = _in_tiles(rows, max(reach, 1), tile)
    rows = rows.repartition(*part)
    along, down = Window.partitionBy(*part, "_r").orderBy("_c"), Window.partitionBy(*part, "_c").orderBy("_r")
    fa, fd = along.rowsBetween(-reach, reach), down.rowsBetween(-reach, reach)
    v = F.col("value")
    left, right = F.lag("value").over(along), F.lead("value").over(along)
    rows = rows.withColumns(
        {
            "_s": F.sum(v).over(fa), "_q": F.sum(v * v).over(fa), "_lo": F.min(v).over(fa), "_hi": F.max(v).over(fa),
            "_dx": right - left, "_sx": left + 2 * v + right,
        }
    )
    n = patch * patch
    mean = F.sum("_s").over(fd) / n
    rows = rows.withColumns(
        {
            "local_mean": mean,
            "local_std": F.sqrt(F.greatest(F.lit(0.0), F.sum("_q").over(fd) / n - mean * mean)),
            "local_min": F.min("_lo").over(fd),
            "local_max": F.max("_hi").over(fd),
            "grad_x": F.lag("_dx").over(down) + 2 * F.col("_dx") + F.lead("_dx").over(down),
            "grad_y": F.lead("_sx").over(down) - F.lag("_sx").over(down),
        }
    )
    rows = rows.filter((F.col("_r") == F.col("row")) & (F.col("_c") == F.col("col")))
    if len(part) > 1:
        rows = rows.filter((F.col("_tr") == F.floor(F.col("row") / tile)) & (F.col("_tc") == F.floor(F.col("col") / tile))).drop("_tr", "_tc")
    out = rows.withColumn("grad_magnitude", F.sqrt(F.col("grad_x") * F.col("grad_x") + F.col("grad_y") * F.col("grad_y")))
    return out.drop("_r", "_c", "_s", "_q", "_lo", "_hi", "_dx", "_sx")

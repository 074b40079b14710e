"""Wafer maps and image evaluation on the 8 x 8 maps of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import images, wafer
from ..operators.tiles import tiled_components
from ..session import table
from .common import DIES_SQL, good_dies
from .registry import query, r

ZONE_SQL = f"""{DIES_SQL}, z AS (SELECT vec_id, count(*) AS total_die, CAST(sum(value) AS BIGINT) AS good_die, avg(value) * 100 AS yield_percentage,
    coalesce(avg(value) FILTER ("row" BETWEEN 3 AND 4 AND col BETWEEN 3 AND 4) * 100, 0) AS center_yield,
    avg(value) FILTER ("row" < 2 OR "row" >= 6 OR col < 2 OR col >= 6) * 100 AS edge_yield,
    avg(value) FILTER ("row" < 4 AND col < 4) * 100 AS q1_yield, avg(value) FILTER ("row" < 4 AND col >= 4) * 100 AS q2_yield,
    avg(value) FILTER ("row" >= 4 AND col < 4) * 100 AS q3_yield, avg(value) FILTER ("row" >= 4 AND col >= 4) * 100 AS q4_yield FROM dies GROUP BY vec_id)"""
YIELDS = ["yield_percentage", "center_yield", "edge_yield", "q1_yield", "q2_yield", "q3_yield", "q4_yield"]


def metrics(spark, sf):
    return wafer.basic_metrics(good_dies(spark, sf), "vec_id", 8, 8, edge_width=2)


@query("wafer_yield", f"WITH {ZONE_SQL} SELECT vec_id, total_die, good_die, {', '.join(f'{r(c)} AS {c}' for c in YIELDS)} FROM z")
def wafer_yield(spark, sf):
    return metrics(spark, sf).withColumns({c: rounded(c) for c in YIELDS})


RING_SQL = """rg AS (SELECT vec_id, rad AS radius, avg(value) AS ring_yield FROM (SELECT *, sqrt(("row" - 4) * ("row" - 4) + (col - 4) * (col - 4)) AS dist FROM dies)
  JOIN (SELECT unnest([1, 2, 3]) AS rad) ON abs(dist - rad) <= 0.5 GROUP BY 1, 2)"""


def rings(spark, sf):
    return wafer.ring_profile(good_dies(spark, sf), "vec_id", 8, 8, start=1, step=1, half_width=0.5)


@query("ring_profile", f"WITH {DIES_SQL}, {RING_SQL} SELECT vec_id, radius, {r('ring_yield')} AS ring_yield FROM rg")
def ring_profile(spark, sf):
    return rings(spark, sf).withColumn("ring_yield", rounded("ring_yield"))


@query(
    "failure_patterns",
    f"""WITH {ZONE_SQL}, {RING_SQL}, lg AS (SELECT *, lag(ring_yield) OVER w - ring_yield > 0.1 AND lead(ring_yield) OVER w - ring_yield > 0.1 AS hit FROM rg WINDOW w AS (PARTITION BY vec_id ORDER BY radius)),
    rp AS (SELECT vec_id, bool_or(coalesce(hit, false)) AS ring FROM lg GROUP BY vec_id),
    f AS (SELECT vec_id, array_to_string(list_filter([CASE WHEN ring THEN 'ring_pattern' END,
      CASE WHEN center_yield - edge_yield > 10 THEN 'edge_loss' WHEN edge_yield - center_yield > 10 THEN 'center_loss' END,
      CASE WHEN greatest(q1_yield, q2_yield, q3_yield, q4_yield) - least(q1_yield, q2_yield, q3_yield, q4_yield) > 15 THEN 'quadrant_imbalance' END,
      CASE WHEN yield_percentage < 70 THEN 'low_yield' WHEN yield_percentage > 95 THEN 'excellent_yield' END], lambda x: x IS NOT NULL), ',') AS p FROM z JOIN rp USING (vec_id))
    SELECT vec_id, CASE WHEN p = '' THEN 'normal' ELSE p END AS failure_patterns FROM f""",
)
def failure_patterns(spark, sf):
    out = wafer.failure_patterns(metrics(spark, sf), rings(spark, sf), "vec_id", dip=0.1)
    return out.select("vec_id", F.array_join("failure_patterns", ",").alias("failure_patterns"))


@query(
    "radial_profile",
    f"""WITH {DIES_SQL}, d AS (SELECT *, sqrt(("row" - 4) * ("row" - 4) + (col - 4) * (col - 4)) AS dist FROM dies)
    SELECT vec_id, radius, {r('avg(value) * 100')} AS radial_yield FROM d JOIN (SELECT unnest([0, 3]) AS radius) ON CASE WHEN radius = 0 THEN dist <= 2 ELSE abs(dist - radius) <= 2 END GROUP BY vec_id, radius""",
)
def radial_profile(spark, sf):
    return wafer.radial_profile(good_dies(spark, sf), "vec_id", 8, 8).withColumn("radial_yield", rounded("radial_yield"))


@query(
    "radial_zones",
    f"""WITH {DIES_SQL}, d AS (SELECT *, CAST(floor(sqrt(("row" - 4) * ("row" - 4) + (col - 4) * (col - 4)) / 0.8) AS INTEGER) AS zone FROM dies)
    SELECT vec_id, zone, {r('avg(value) * 100')} AS zone_yield FROM d WHERE zone < 5 GROUP BY vec_id, zone""",
)
def radial_zones(spark, sf):
    return wafer.radial_zones(good_dies(spark, sf), "vec_id", 8, 8).withColumn("zone_yield", rounded("zone_yield"))


@query(
    "radial_hist",
    f"""WITH {DIES_SQL}, d AS (SELECT *, sqrt(("row" - 4) * ("row" - 4) + (col - 4) * (col - 4)) AS dist FROM dies),
    b AS (SELECT vec_id, i, coalesce(avg(value) FILTER (dist >= i * 4 / 10.0 AND dist < (i + 1) * 4 / 10.0), 0) AS v FROM d CROSS JOIN (SELECT unnest(range(0, 10)) AS i) GROUP BY 1, 2)
    SELECT vec_id, CAST(i AS INTEGER) AS bin, {r('v')} AS density FROM b""",
)
def radial_hist(spark, sf):
    out = wafer.radial_histogram(good_dies(spark, sf), "vec_id", 8, 8)
    return out.select("vec_id", F.posexplode("histogram").alias("bin", "density")).withColumn("density", rounded("density"))


@query(
    "angular_hist",
    f"""WITH {DIES_SQL}, d AS (SELECT *, atan2("row" - 4, col - 4) + pi() AS a FROM dies),
    b AS (SELECT vec_id, i, coalesce(avg(value) FILTER (a >= i * 2 * pi() / 8 AND a < (i + 1) * 2 * pi() / 8), 0) AS v FROM d CROSS JOIN (SELECT unnest(range(0, 8)) AS i) GROUP BY 1, 2)
    SELECT vec_id, CAST(i AS INTEGER) AS bin, {r('v')} AS density FROM b""",
)
def angular_hist(spark, sf):
    out = wafer.angular_histogram(good_dies(spark, sf), "vec_id", 8, 8)
    return out.select("vec_id", F.posexplode("histogram").alias("bin", "density")).withColumn("density", rounded("density"))


def maps(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: F.when(x > 0, 255).otherwise(0)).alias("values"), F.lit(8).alias("height"), F.lit(8).alias("width"))


@query(
    "glcm",
    f"""WITH {DIES_SQL}, g AS (SELECT a.vec_id, s.angle, a.value * 255.0 AS i, b.value * 255.0 AS j FROM dies a
      CROSS JOIN (VALUES (0, 0, 1), (45, 1, 1), (90, 1, 0), (135, 1, -1)) AS s(angle, dr, dc)
      JOIN dies b ON b.vec_id = a.vec_id AND b."row" = a."row" + dr AND b.col = a.col + dc),
    y AS (SELECT vec_id, angle, i, j FROM g UNION ALL SELECT vec_id, angle, j, i FROM g),
    c AS (SELECT vec_id, angle, i, j, count(*) AS n FROM y GROUP BY ALL),
    t AS (SELECT vec_id, angle, sum(n) AS t, sum(n * i) / sum(n) AS mu FROM c GROUP BY 1, 2),
    q AS (SELECT vec_id, angle, sum(n * (i - j) * (i - j)) / max(t) AS contrast, sum(n * abs(i - j)) / max(t) AS dissimilarity, sum(n / (1 + (i - j) * (i - j))) / max(t) AS homogeneity,
      sqrt(sum(n * n)) / max(t) AS energy, CASE WHEN sum(n * (i - mu) * (i - mu)) = 0 THEN 1 ELSE sum(n * (i - mu) * (j - mu)) / sum(n * (i - mu) * (i - mu)) END AS correlation
      FROM c JOIN t USING (vec_id, angle) GROUP BY 1, 2)
    SELECT vec_id, {', '.join(f'{r(f"avg({x})")} AS {x}' for x in ('contrast', 'dissimilarity', 'homogeneity', 'energy', 'correlation'))} FROM q GROUP BY vec_id""",
)
def glcm(spark, sf):
    out = wafer.texture(maps(spark, sf), "vec_id")
    return out.select("vec_id", *[rounded(c).alias(c) for c in out.columns if c != "vec_id"])


_COMPONENTS = f"""WITH RECURSIVE {DIES_SQL}, d AS (SELECT vec_id, "row" AS r, col AS c, "row" * 8 + col AS id FROM dies WHERE value = 1),
    reach AS (SELECT vec_id, id, id AS root FROM d UNION SELECT b.vec_id, b.id, a.root FROM reach a JOIN d p ON p.vec_id = a.vec_id AND p.id = a.id
      JOIN d b ON b.vec_id = p.vec_id AND abs(b.r - p.r) <= 1 AND abs(b.c - p.c) <= 1),
    l AS (SELECT vec_id, id, min(root) AS root FROM reach GROUP BY 1, 2), s AS (SELECT vec_id, root, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT e.vec_id, count(s.n) AS n_components, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS total_area, CAST(coalesce(max(s.n), 0) AS BIGINT) AS largest_area
    FROM embeddings e LEFT JOIN s USING (vec_id) GROUP BY e.vec_id"""


@query("components", _COMPONENTS)
def components(spark, sf):
    return wafer.components(maps(spark, sf), "vec_id")


@query("components_in_tiles", _COMPONENTS)
def components_in_tiles(spark, sf):
    """The same maps cut into tiles of 3 x 3 dies."""
    return tiled_components(good_dies(spark, sf), "vec_id", tile=3)


@query(
    "normalised_maps",
    f"""WITH {DIES_SQL}, m AS (SELECT min(x) AS lo, max(x) AS hi FROM dies) SELECT vec_id, "row", col, {r('(x - lo) / (hi - lo)')} AS value FROM dies, m""",
)
def normalised_maps(spark, sf):
    d = good_dies(spark, sf).select("vec_id", "row", "col", F.col("x").alias("value"))
    return wafer.normalise(d).withColumn("value", rounded("value"))


@query(
    "rotate_flip",
    f"""WITH {DIES_SQL}, t AS (SELECT vec_id, value, CASE vec_id % 4 WHEN 1 THEN 7 - col WHEN 2 THEN 7 - "row" WHEN 3 THEN col ELSE "row" END AS r,
      CASE vec_id % 4 WHEN 1 THEN "row" WHEN 2 THEN 7 - col WHEN 3 THEN 7 - "row" ELSE col END AS c FROM dies)
    SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN 7 - r ELSE r END AS INTEGER) AS "row", CAST(CASE WHEN vec_id % 2 = 0 THEN 7 - c ELSE c END AS INTEGER) AS col, value FROM t""",
)
def rotate_flip(spark, sf):
    d = good_dies(spark, sf).select("vec_id", "row", "col", "value")
    return wafer.augment(d, "vec_id", 8, F.col("vec_id") % 4, F.col("vec_id") % 2 == 0, F.col("vec_id") % 3 == 0)


@query("hashed_augmentation")
def hashed_augmentation(spark, sf):
    return wafer.hashed_augmentation(good_dies(spark, sf).select("vec_id", "row", "col", "value"), "vec_id", 8)


@query(
    "defect_summary",
    f"""WITH {DIES_SQL}, d AS (SELECT *, ("row" - 4) * ("row" - 4) + (col - 4) * (col - 4) AS d2 FROM dies)
    SELECT vec_id, {r('coalesce(avg(value) FILTER (d2 <= pow(8 / 6.0, 2)), 0)')} AS center_density,
    {r('coalesce(avg(value) FILTER (d2 >= pow(8 / 3.0, 2) AND d2 <= pow(8 / 2.2, 2)), 0)')} AS edge_density, {r('avg(value)')} AS defect_area_ratio,
    {r('coalesce(CASE WHEN sum(value) > 1 THEN stddev_pop("row") FILTER (value > 0) + stddev_pop(col) FILTER (value > 0) END, 0)')} AS defect_spread,
    count(*) AS total_pixels, CAST(sum(value) AS BIGINT) AS defect_pixels FROM d GROUP BY vec_id""",
)
def defect_summary(spark, sf):
    out = wafer.defect_summary(good_dies(spark, sf), "vec_id", 8)
    return out.withColumns({c: rounded(c) for c in ("center_density", "edge_density", "defect_area_ratio", "defect_spread")})


GRAD = f"""{DIES_SQL}, g1 AS (SELECT *, lead(x) OVER rw AS rn, lag(x) OVER rw AS rp, lead(x) OVER cl AS cn, lag(x) OVER cl AS cp FROM dies
    WINDOW rw AS (PARTITION BY vec_id, "row" ORDER BY col), cl AS (PARTITION BY vec_id, col ORDER BY "row")),
  g AS (SELECT *, sqrt(pow(CASE WHEN rp IS NULL THEN rn - x WHEN rn IS NULL THEN x - rp ELSE (rn - rp) / 2 END, 2)
    + pow(CASE WHEN cp IS NULL THEN cn - x WHEN cn IS NULL THEN x - cp ELSE (cn - cp) / 2 END, 2)) AS g, sqrt(("row" - 4) * ("row" - 4) + (col - 4) * (col - 4)) AS dist FROM g1),
  q AS (SELECT vec_id, quantile_cont(g, 0.95) AS p95 FROM g GROUP BY vec_id)"""
STATS_SQL = {
    "mean_intensity": "avg(x)", "std_intensity": "stddev_pop(x)", "min_intensity": "min(x)", "max_intensity": "max(x)",
    "median_intensity": "median(x)", "q25_intensity": "quantile_cont(x, 0.25)", "q75_intensity": "quantile_cont(x, 0.75)",
    "center_mean": 'avg(x) FILTER ("row" BETWEEN 2 AND 4 AND col BETWEEN 2 AND 4)', "center_std": 'stddev_pop(x) FILTER ("row" BETWEEN 2 AND 4 AND col BETWEEN 2 AND 4)',
    "edge_top_mean": 'avg(x) FILTER ("row" < 2)', "edge_bottom_mean": 'avg(x) FILTER ("row" >= 6)', "edge_left_mean": "avg(x) FILTER (col < 2)", "edge_right_mean": "avg(x) FILTER (col >= 6)",
    "grad_mean": "avg(g)", "grad_std": "stddev_pop(g)", "grad_max": "max(g)",
    "horizontal_variation": "avg(abs(rn - x))", "horizontal_variation_std": "stddev_pop(abs(rn - x))", "vertical_variation": "avg(abs(cn - x))", "vertical_variation_std": "stddev_pop(abs(cn - x))",
}
for _i, (_a, _b) in enumerate([(0, 0.3), (0.3, 0.6), (0.6, 0.9)]):
    STATS_SQL[f"radial_zone_{_i}_mean"] = f"coalesce(avg(x) FILTER (dist >= 4 * {_a} AND dist < 4 * {_b}), 0)"
    STATS_SQL[f"radial_zone_{_i}_std"] = f"coalesce(stddev_pop(x) FILTER (dist >= 4 * {_a} AND dist < 4 * {_b}), 0)"


@query(
    "map_statistics",
    f"WITH {GRAD} SELECT g.vec_id, {', '.join(f'{r(v)} AS {k}' for k, v in STATS_SQL.items())}, CAST(count(*) FILTER (g > p95) AS INTEGER) AS high_grad_count FROM g JOIN q ON g.vec_id = q.vec_id GROUP BY g.vec_id",
)
def map_statistics(spark, sf):
    d = good_dies(spark, sf).select("vec_id", "row", "col", F.col("x").alias("value"))
    out = wafer.map_statistics(d, "vec_id", 8, 8)
    return out.select("vec_id", *[rounded(c).alias(c) for c in STATS_SQL], "high_grad_count")


REGION = f"""{DIES_SQL}, e AS (SELECT vec_id, x, unnest(list_filter([CASE WHEN "row" < 4 AND col < 4 THEN 'top_left' END, CASE WHEN "row" < 4 AND col >= 4 THEN 'top_right' END,
    CASE WHEN "row" >= 4 AND col < 4 THEN 'bottom_left' END, CASE WHEN "row" >= 4 AND col >= 4 THEN 'bottom_right' END,
    CASE WHEN "row" BETWEEN 2 AND 4 AND col BETWEEN 2 AND 4 THEN 'center' END], lambda q: q IS NOT NULL)) AS region FROM dies),
  a AS (SELECT vec_id, region, avg(x) AS m, stddev_pop(x) AS s, max(x) - min(x) AS c FROM e GROUP BY 1, 2),
  rr AS (SELECT *, CASE WHEN c < 0.3 THEN 1 / (1 + s) ELSE 0.5 / (1 + s) END AS confidence, CASE WHEN s > 0.2 THEN 'high' WHEN s > 0.1 THEN 'medium' ELSE 'low' END AS risk FROM a)"""


def regions(spark, sf):
    d = good_dies(spark, sf).select("vec_id", "row", "col", F.col("x").alias("value"))
    return wafer.region_risk(d, "vec_id", 8, 8)


@query(
    "region_risk",
    f"WITH {REGION} SELECT vec_id, region, {r('m')} AS mean_intensity, {r('s')} AS std_intensity, {r('c')} AS contrast, {r('confidence')} AS confidence, risk AS anomaly_risk FROM rr",
)
def region_risk(spark, sf):
    return regions(spark, sf).withColumns({c: rounded(c) for c in ("mean_intensity", "std_intensity", "contrast", "confidence")})


@query(
    "region_summary",
    f"""WITH {REGION} SELECT vec_id, {r('avg(confidence)')} AS overall_spatial_confidence,
    coalesce(string_agg(region, ',' ORDER BY region) FILTER (risk = 'high'), '') AS high_risk_regions FROM rr GROUP BY vec_id""",
)
def region_summary(spark, sf):
    return wafer.region_summary(regions(spark, sf), "vec_id").withColumn("overall_spatial_confidence", rounded("overall_spatial_confidence"))


@query(
    "batch_quality",
    f"""WITH {DIES_SQL}, p AS (SELECT vec_id, count(*) FILTER (x > 0.2) AS d, count(*) AS n FROM dies GROUP BY 1), l AS (SELECT d, n, least(d / n, 0.95) AS l FROM p)
    SELECT {r('avg(1 - l)')} AS avg_yield_estimate, {r('avg(l) * 10000', 4)} AS avg_estimated_loss_usd, {r('stddev_pop(1 - l)')} AS yield_std, {r('avg(CAST(d > n * 0.1 AS DOUBLE))')} AS critical_defect_rate FROM l""",
)
def batch_quality(spark, sf):
    out = wafer.batch_quality(good_dies(spark, sf).select("vec_id", F.col("x").alias("value")), "vec_id")
    return out.select(rounded("avg_yield_estimate").alias("avg_yield_estimate"), rounded("avg_estimated_loss_usd", 4).alias("avg_estimated_loss_usd"), rounded("yield_std").alias("yield_std"), rounded("critical_defect_rate").alias("critical_defect_rate"))


@query(
    "batch_diversity",
    f"""WITH {DIES_SQL}, s AS (SELECT *, CAST("row" < 1 AS INT) + CAST("row" >= 7 AS INT) + CAST(col < 1 AS INT) + CAST(col >= 7 AS INT) AS k FROM dies),
    p AS (SELECT vec_id, avg(x) FILTER ("row" BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5) AS c, sum(x * k) / sum(k) AS e, avg(CAST(x > 0.3 AS DOUBLE)) AS d FROM s GROUP BY 1)
    SELECT count(*) AS num_analyzed, {r('avg(c)')} AS avg_center_intensity, {r('avg(e)')} AS avg_edge_intensity, {r('avg(d)')} AS avg_defect_coverage FROM p""",
)
def batch_diversity(spark, sf):
    d = good_dies(spark, sf).select("vec_id", "row", "col", F.col("x").alias("value"))
    out = wafer.batch_diversity(d, "vec_id", 8, (2, 6), 1)
    return out.withColumns({c: rounded(c) for c in out.columns if c != "num_analyzed"})


@query(
    "class_density",
    f"""WITH {DIES_SQL}, p AS (SELECT vec_id, label, avg(CAST(value = 0 AS DOUBLE)) AS d, count(*) FILTER (value = 1) AS g FROM dies GROUP BY 1, 2)
    SELECT label, count(*) AS count, {r('avg(d)')} AS mean_defect_density, {r('stddev_pop(d)')} AS std_defect_density, {r('avg(g)')} AS avg_good_dies FROM p GROUP BY label""",
)
def class_density(spark, sf):
    out = wafer.class_density(good_dies(spark, sf), "vec_id", "label")
    return out.withColumns({c: rounded(c) for c in ("mean_defect_density", "std_defect_density", "avg_good_dies")})


def masks(spark, sf):
    """Truth: x > 0.05; prediction: x > 0.1."""
    d = good_dies(spark, sf)
    return d.select("vec_id", "label", "row", "col", (F.col("x") > 0.05).cast("int").alias("truth"), (F.col("x") > 0.1).cast("int").alias("pred"))


MASK = f"""{DIES_SQL}, k AS (SELECT vec_id, max(label) AS label, count(*) AS n, count(*) FILTER (x > 0.05) AS t, count(*) FILTER (x > 0.1) AS p, count(*) FILTER (x > 0.1 AND x > 0.05) AS b FROM dies GROUP BY 1),
  mm AS (SELECT vec_id, label, coalesce(b / nullif(t + p - b, 0), 1) AS iou, (n - t - p + 2 * b) / n AS acc, CASE WHEN t = 0 THEN CAST(p = 0 AS DOUBLE) ELSE b / t END AS cov,
    coalesce((p - b) / nullif(n - t, 0), 0) AS fpr, coalesce(2 * b / nullif(t + p, 0), 1) AS dice FROM k)"""


@query(
    "mask_metrics",
    f"WITH {MASK} SELECT vec_id, {r('iou')} AS iou, {r('acc')} AS pixel_accuracy, {r('cov')} AS defect_coverage, {r('fpr')} AS false_positive_rate, {r('dice')} AS dice FROM mm",
)
def mask_metrics(spark, sf):
    out = images.mask_metrics(masks(spark, sf), "vec_id")
    return out.withColumns({c: rounded(c) for c in out.columns if c != "vec_id"})


@query(
    "segmentation_summary",
    f"WITH {MASK} SELECT {r('avg(iou)')} AS mean_iou, {r('avg(acc)')} AS pixel_accuracy, {r('avg(cov)')} AS defect_coverage, {r('avg(fpr)')} AS false_positive_rate, {r('avg(CAST(iou > 0.1 AS DOUBLE))')} AS defect_detection_rate FROM mm",
)
def segmentation_summary(spark, sf):
    out = images.segmentation_summary(images.mask_metrics(masks(spark, sf), "vec_id"))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "scores_by_type",
    f"WITH {MASK} SELECT label, {r('avg(dice)')} AS dice_mean, {r('stddev_samp(dice)')} AS dice_std, {r('avg(iou)')} AS iou_mean, {r('stddev_samp(iou)')} AS iou_std FROM mm GROUP BY label",
)
def scores_by_type(spark, sf):
    per = images.mask_metrics(masks(spark, sf), "vec_id").join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    out = images.scores_by_type(per, "label")
    return out.withColumns({c: rounded(c) for c in out.columns if c != "label"})


def boxes(spark, sf):
    """Three true and three shifted predicted boxes per image."""
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    x, y = (F.col("vec_id") * 7 + F.col("j") * 13) % 40, (F.col("vec_id") * 5 + F.col("j") * 17) % 40
    side, shift = 10 + F.col("j") * 3, (F.col("vec_id") + F.col("j")) % 5
    box = F.array(x, y, x + side, y + side)
    moved = F.transform(box, lambda v: v + shift)
    conf = F.lit(1.0) - shift / 10.0 - F.col("j") / 100.0
    truth = e.select("vec_id", F.col("j").cast("long").alias("det"), box.alias("bbox"))
    pred = e.select("vec_id", F.col("j").cast("long").alias("det"), moved.alias("bbox"), conf.alias("confidence"))
    return pred, truth


BOX = """bx AS (SELECT vec_id, j, (vec_id * 7 + j * 13) % 40 AS x, (vec_id * 5 + j * 17) % 40 AS y, 10 + j * 3 AS s, (vec_id + j) % 5 AS m FROM embeddings CROSS JOIN (SELECT unnest([0, 1, 2]) AS j)),
  ov AS (SELECT p.vec_id, p.j AS pj, t.j AS tj, greatest(0, least(p.x + p.m + p.s, t.x + t.s) - greatest(p.x + p.m, t.x)) * greatest(0, least(p.y + p.m + p.s, t.y + t.s) - greatest(p.y + p.m, t.y)) AS i,
    p.s * p.s + t.s * t.s AS a FROM bx p JOIN bx t ON p.vec_id = t.vec_id)"""


@query(
    "box_iou",
    f"WITH {BOX} SELECT vec_id, CAST(pj AS BIGINT) AS pred_det, CAST(tj AS BIGINT) AS true_det, {r('i / (a - i)')} AS iou FROM ov WHERE i > 0",
)
def box_iou(spark, sf):
    pred, truth = boxes(spark, sf)
    out = images.overlapping_boxes(pred.drop("confidence"), truth, "vec_id", cell=16)
    return out.select("vec_id", "pred_det", "true_det", rounded("iou").alias("iou"))


_STEP = """m{k} AS (SELECT ou.vec_id, {k} AS pj, arg_max(tj, (ou.iou, -tj)) AS tj FROM ou {joins} WHERE pj = {k} {free} GROUP BY ou.vec_id HAVING max(ou.iou) >= 0.5)"""
MATCH = f"""{BOX}, ou AS (SELECT vec_id, pj, tj, i / (a - i) AS iou FROM ov WHERE i > 0),
  {_STEP.format(k=0, joins='', free='')},
  {_STEP.format(k=1, joins='LEFT JOIN (SELECT vec_id, tj AS t0 FROM m0) p0 USING (vec_id)', free='AND (t0 IS NULL OR tj <> t0)')},
  {_STEP.format(k=2, joins='LEFT JOIN (SELECT vec_id, tj AS t0 FROM m0) p0 USING (vec_id) LEFT JOIN (SELECT vec_id, tj AS t1 FROM m1) p1 USING (vec_id)', free='AND (t0 IS NULL OR tj <> t0) AND (t1 IS NULL OR tj <> t1)')},
  hit AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2),
  mt AS (SELECT bx.vec_id, bx.j AS det, 1.0 - m / 10.0 - j / 100.0 AS confidence, CAST(hit.tj IS NOT NULL AS INT) AS is_tp, 0 AS missed FROM bx LEFT JOIN hit ON hit.vec_id = bx.vec_id AND hit.pj = bx.j
    UNION ALL SELECT bx.vec_id, bx.j, NULL, 0, 1 FROM bx WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.vec_id = bx.vec_id AND hit.tj = bx.j))"""


@query(
    "detection_matches",
    f"WITH {MATCH} SELECT vec_id, CAST(det AS BIGINT) AS det, {r('CAST(confidence AS DOUBLE)')} AS confidence, is_tp, missed FROM mt",
)
def detection_matches(spark, sf):
    pred, truth = boxes(spark, sf)
    return images.match_detections(pred, truth, "vec_id", cell=16).withColumn("confidence", rounded("confidence"))


@query(
    "detection_metrics",
    f"""WITH {MATCH}, c AS (SELECT CAST(sum(is_tp) AS BIGINT) AS tp, count(*) FILTER (missed = 0 AND is_tp = 0) AS fp, CAST(sum(missed) AS BIGINT) AS fn FROM mt),
    g AS (SELECT round(confidence, 9) AS s, sum(is_tp) AS pos, count(*) AS n FROM mt WHERE missed = 0 GROUP BY 1),
    k AS (SELECT pos, sum(pos) OVER w AS t, sum(n) OVER w AS q, sum(pos) OVER () AS np FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
    SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, {r('tp / (tp + fp)')} AS precision, {r('tp / (tp + fn)')} AS recall, {r('2 * tp / (2 * tp + fp + fn)')} AS f1_score,
      {r('tp / (tp + fp + fn) * 100')} AS pws_percent, {r('fp * 100.0 + fn * 1000.0')} AS estimated_loss_usd, (SELECT {r('sum(pos * t / q) / max(np)')} FROM k) AS map_50 FROM c""",
)
def detection_metrics(spark, sf):
    pred, truth = boxes(spark, sf)
    pred = pred.withColumn("confidence", F.round("confidence", 9))
    out = images.detection_metrics(images.match_detections(pred, truth, "vec_id", cell=16))
    names = ["precision", "recall", "f1_score", "pws_percent", "estimated_loss_usd", "map_50"]
    return out.withColumns({c: rounded(c) for c in names})


PIX = f"""{DIES_SQL}, n AS (SELECT d.vec_id, d."row", d.col, d.x, dr, dc, q.x AS v FROM dies d CROSS JOIN (SELECT unnest(range(-2, 3)) AS dr) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dc)
    JOIN dies q ON q.vec_id = d.vec_id AND q."row" = CASE WHEN d."row" + dr < 0 THEN -1 - (d."row" + dr) WHEN d."row" + dr > 7 THEN 15 - (d."row" + dr) ELSE d."row" + dr END
      AND q.col = CASE WHEN d.col + dc < 0 THEN -1 - (d.col + dc) WHEN d.col + dc > 7 THEN 15 - (d.col + dc) ELSE d.col + dc END),
  f AS (SELECT vec_id, "row", col, max(x) AS value, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi,
    coalesce(sum(v * dc * CASE dr WHEN 0 THEN 2 ELSE 1 END) FILTER (abs(dr) <= 1 AND abs(dc) <= 1), 0) AS gx,
    coalesce(sum(v * dr * CASE dc WHEN 0 THEN 2 ELSE 1 END) FILTER (abs(dr) <= 1 AND abs(dc) <= 1), 0) AS gy FROM n GROUP BY 1, 2, 3)"""


@query(
    "pixel_features",
    f"""WITH {PIX} SELECT vec_id, "row", col, {r('value')} AS value, {r('m')} AS local_mean, {r('s', 5)} AS local_std, {r('lo')} AS local_min, {r('hi')} AS local_max,
    {r('gx')} AS grad_x, {r('gy')} AS grad_y, {r('sqrt(gx * gx + gy * gy)')} AS grad_magnitude FROM f""",
)
def pixel_features(spark, sf):
    d = good_dies(spark, sf).select("vec_id", "row", "col", F.col("x").alias("value"))
    out = images.pixel_features(d, "vec_id", 8, 8)
    names = ["value", "local_mean", "local_min", "local_max", "grad_x", "grad_y", "grad_magnitude"]
    return out.select("vec_id", "row", "col", rounded("local_std", 5).alias("local_std"), *[rounded(c).alias(c) for c in names])

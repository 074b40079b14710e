"""Wafer-map analytics.

Two forms: a die table (wafer, row, col, value) and a map table with one array
per wafer (row-major ``values``, ``height``, ``width``). A wafer is bounded by
its number of dies, so per-wafer windows are safe; zone statistics are plain
conditional aggregates, which shrink to one row per wafer before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio_or
from .ranks import attach_stats


def dies_from_maps(maps: DataFrame, keep: list[str]) -> DataFrame:
    d = maps.select(*keep, "width", F.posexplode("values").alias("_p", "value"))
    return d.select(
        *keep, F.floor(F.col("_p") / F.col("width")).cast("int").alias("row"), (F.col("_p") % F.col("width")).cast("int").alias("col"), "value"
    )


def _share(cond: Column, good: Column) -> Column:
    """Percent good among dies of a zone, 0 for an empty zone."""
    return F.coalesce(F.avg(F.when(cond, good.cast("double"))) * 100, F.lit(0.0))


def _zones(h: int, w: int, edge_width: int) -> dict[str, Column]:
    r, c = F.col("row"), F.col("col")
    size = min(h, w) // 5
    mid_r, mid_c = h // 2, w // 2
    return {
        "center": (r >= mid_r - size) & (r < mid_r + size) & (c >= mid_c - size) & (c < mid_c + size),
        "edge": (r < edge_width) | (r >= h - edge_width) | (c < edge_width) | (c >= w - edge_width),
        "q1": (r < h // 2) & (c < w // 2),
        "q2": (r < h // 2) & (c >= w // 2),
        "q3": (r >= h // 2) & (c < w // 2),
        "q4": (r >= h // 2) & (c >= w // 2),
    }


def basic_metrics(dies: DataFrame, wafer: str, h: int, w: int, edge_width: int = 5) -> DataFrame:
    """Totals, yield, centre, edge and quadrant yields, one aggregate."""
    good = F.col("value")
    zones = _zones(h, w, edge_width)
    return dies.groupBy(wafer).agg(
        F.count(F.lit(1)).alias("total_die"),
        F.sum(good).cast("long").alias("good_die"),
        (F.avg(good.cast("double")) * 100).alias("yield_percentage"),
        *[_share(cond, good).alias(f"{name}_yield") for name, cond in zones.items()],
    )


def _distance(h: int, w: int) -> Column:
    dr, dc = F.col("row") - h // 2, F.col("col") - w // 2
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def ring_profile(dies: DataFrame, wafer: str, h: int, w: int, start: int = 5, step: int = 5, half_width: float = 2.0) -> DataFrame:
    """Mean value of the rings around the centre; rings may overlap, so a die
    can count in several."""
    radii = list(range(start, min(h, w) // 2, step))
    if not radii:
        return dies.select(wafer, F.lit(0).alias("radius"), F.lit(0.0).alias("ring_yield")).limit(0)
    hit = F.filter(F.array(*[F.lit(x) for x in radii]), lambda x: F.abs(x - _distance(h, w)) <= half_width)
    return dies.withColumn("radius", F.explode(hit)).groupBy(wafer, "radius").agg(F.avg(F.col("value").cast("double")).alias("ring_yield"))


def ring_pattern(rings: DataFrame, wafer: str, dip: float = 0.2) -> DataFrame:
    """Wafers whose ring yield dips below both neighbours; needs 3 rings."""
    o = Window.partitionBy(wafer).orderBy("radius")
    y = F.col("ring_yield")
    hit = (F.lag("ring_yield").over(o) - y > dip) & (F.lead("ring_yield").over(o) - y > dip)
    return rings.withColumn("_hit", F.coalesce(hit, F.lit(False))).groupBy(wafer).agg(F.bool_or("_hit").alias("ring_pattern"))


def failure_patterns(metrics: DataFrame, rings: DataFrame, wafer: str, dip: float = 0.2) -> DataFrame:
    """Labels of each wafer; ["normal"] when none applies."""
    m = attach_stats(metrics, ring_pattern(rings, wafer, dip), [wafer])
    q = [F.col(f"q{i}_yield") for i in range(1, 5)]
    gap = F.col("center_yield") - F.col("edge_yield")
    y = F.col("yield_percentage")
    found = F.array_compact(
        F.array(
            F.when(F.col("ring_pattern"), F.lit("ring_pattern")),
            F.when(gap > 10, F.lit("edge_loss")).when(gap < -10, F.lit("center_loss")),
            F.when(F.greatest(*q) - F.least(*q) > 15, F.lit("quadrant_imbalance")),
            F.when(y < 70, F.lit("low_yield")).when(y > 95, F.lit("excellent_yield")),
        )
    )
    return m.withColumn("failure_patterns", F.when(F.size(found) == 0, F.array(F.lit("normal"))).otherwise(found))


def radial_profile(dies: DataFrame, wafer: str, h: int, w: int, step: int = 3) -> DataFrame:
    """Yield in percent on rings every ``step``; the innermost is a disc of
    radius 2."""
    radii = list(range(0, min(h, w) // 2, step))
    dist = _distance(h, w)
    near = F.filter(F.array(*[F.lit(x) for x in radii]), lambda x: F.when(x == 0, dist <= 2).otherwise(F.abs(x - dist) <= 2))
    return dies.withColumn("radius", F.explode(near)).groupBy(wafer, "radius").agg((F.avg(F.col("value").cast("double")) * 100).alias("radial_yield"))


def radial_zones(dies: DataFrame, wafer: str, h: int, w: int, zones: int = 5) -> DataFrame:
    width = (h // 2) / zones
    zone = F.floor(_distance(h, w) / width)
    rows = dies.withColumn("zone", zone.cast("int")).filter(F.col("zone") < zones)
    return rows.groupBy(wafer, "zone").agg((F.avg(F.col("value").cast("double")) * 100).alias("zone_yield"))


def _full_histogram(cells: DataFrame, wafer: str, bins: int) -> DataFrame:
    """One array per wafer with 0 for empty bins."""
    listed = cells.groupBy(wafer).agg(F.map_from_entries(F.collect_list(F.struct("bin", "density"))).alias("_m"))
    return listed.select(
        wafer,
        F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias("histogram"),
    )


def radial_histogram(dies: DataFrame, wafer: str, h: int, w: int, bins: int = 10) -> DataFrame:
    dr, dc = F.col("row") - h // 2, F.col("col") - w // 2
    r = F.sqrt((dr * dr + dc * dc).cast("double"))
    top = min(h // 2, w // 2)
    rows = dies.filter(r < top).withColumn("bin", F.floor(r * bins / top).cast("int"))
    cells = rows.groupBy(wafer, "bin").agg(F.avg(F.col("value").cast("double")).alias("density"))
    return _full_histogram(cells, wafer, bins)


def angular_histogram(dies: DataFrame, wafer: str, h: int, w: int, bins: int = 8) -> DataFrame:
    """Density by angle; the full angle 2 pi falls outside the last bin."""
    a = F.atan2((F.col("row") - h // 2).cast("double"), (F.col("col") - w // 2).cast("double")) + F.lit(math.pi)
    rows = dies.withColumn("_a", a)
    # Lower edges as the histogram computes them, so edges fall the same way.
    edges = F.array(*[F.lit(i * 2 * math.pi / bins) for i in range(bins + 1)])
    rows = rows.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("_a"))) - 1).filter(F.col("bin") < bins)
    cells = rows.groupBy(wafer, "bin").agg(F.avg(F.col("value").cast("double")).alias("density"))
    return _full_histogram(cells, wafer, bins)


# Neighbour steps (row, column) of the four texture angles.
ANGLES = {0: (0, 1), 45: (1, 1), 90: (1, 0), 135: (1, -1)}


def _neighbour(angle: int, dr: int, dc: int):
    """Function of a position in the array: the pair it starts, or NULL."""

    def pair(p: Column) -> Column:
        w = F.col("width")
        ok = (F.floor(p / w) + dr < F.col("height")) & (p % w + dc < w) & (p % w + dc >= 0)
        other = F.get(F.col("values"), (p + dr * w + dc).cast("int"))
        return F.when(ok, F.struct(F.lit(angle).alias("angle"), F.get(F.col("values"), p).alias("i"), other.alias("j")))

    return pair


def cooccurrence(maps: DataFrame, wafer: str) -> DataFrame:
    """Symmetric neighbour counts (wafer, angle, i, j, n). Neighbours are found
    inside the array of the wafer, without a join."""
    idx = F.sequence(F.lit(0), F.size("values") - 1)
    parts = [F.array_compact(F.transform(idx, _neighbour(angle, dr, dc))) for angle, (dr, dc) in ANGLES.items()]
    pairs = maps.select(wafer, F.explode(F.concat(*parts)).alias("x")).select(wafer, "x.*")
    both = pairs.select(wafer, "angle", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("y"))
    return both.groupBy(wafer, "angle", F.col("y.i").alias("i"), F.col("y.j").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def texture(maps: DataFrame, wafer: str) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, energy and correlation, averaged
    over four angles. A constant map has correlation 1."""
    counts = cooccurrence(maps, wafer)
    n, i, j = F.col("n").cast("double"), F.col("i").cast("double"), F.col("j").cast("double")
    d = i - j
    total = F.sum(n)
    mean = F.sum(n * i) / total
    var = F.sum(n * i * i) / total - mean * mean
    cov = F.sum(n * i * j) / total - mean * mean
    per = counts.groupBy(wafer, "angle").agg(
        (F.sum(n * d * d) / total).alias("contrast"),
        (F.sum(n * F.abs(d)) / total).alias("dissimilarity"),
        (F.sum(n / (1 + d * d)) / total).alias("homogeneity"),
        (F.sqrt(F.sum(n * n)) / total).alias("energy"),
        F.when(var < 1e-15, 1.0).otherwise(F.try_divide(cov, var)).alias("correlation"),
    )
    names = ["contrast", "dissimilarity", "homogeneity", "energy", "correlation"]
    return per.groupBy(wafer).agg(*[F.avg(x).alias(x) for x in names])


def _label_components(grid: np.ndarray) -> np.ndarray:
    """Sizes of the 8-connected components of a small boolean grid: labels
    shrink to the smallest label of the neighbourhood until nothing moves."""
    h, w = grid.shape
    lab = np.where(grid, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        pad = np.pad(np.where(grid, lab, big), 1, constant_values=big)
        low = np.min([pad[a : a + h, b : b + w] for a in range(3) for b in range(3)], axis=0)
        new = np.where(grid, low, 0)
        if (new == lab).all():
            break
        lab = new
    return np.unique(lab[lab > 0], return_counts=True)[1]


def components(maps: DataFrame, wafer: str) -> DataFrame:
    """Number of components of non-zero dies, their total and largest area.
    Runs inside the row of a wafer: no shuffle."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("n_components", "total_area", "largest_area")])

    @F.pandas_udf(schema)
    def label(values: pd.Series, width: pd.Series) -> pd.DataFrame:
        rows = []
        for v, w in zip(values, width):
            sizes = _label_components(np.asarray(v).reshape(-1, int(w)) > 0)
            rows.append((len(sizes), int(sizes.sum()), int(sizes.max()) if len(sizes) else 0))
        return pd.DataFrame(rows, columns=["n_components", "total_area", "largest_area"])

    return maps.select(wafer, label("values", "width").alias("c")).select(wafer, "c.*")


def normalise(dies: DataFrame, value: str = "value") -> DataFrame:
    """Min-max over the whole stack; a constant stack is left as it is."""
    out = attach_stats(dies, dies.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), [])
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col(value))
    return out.withColumn(value, scaled).drop("_lo", "_hi")


def augment(dies: DataFrame, wafer: str, n: int, rotations: Column, flip_lr: Column, flip_ud: Column) -> DataFrame:
    """Rotation by quarter turns (counter-clockwise) of n x n maps, then
    flips, as a coordinate remap; the choices are columns of the wafer."""
    r, c, last = F.col("row"), F.col("col"), n - 1
    k = F.pmod(rotations, F.lit(4))
    row = F.when(k == 1, last - c).when(k == 2, last - r).when(k == 3, c).otherwise(r)
    col = F.when(k == 1, r).when(k == 2, last - c).when(k == 3, last - r).otherwise(c)
    col2 = F.when(flip_lr, last - col).otherwise(col)
    row2 = F.when(flip_ud, last - row).otherwise(row)
    return dies.withColumns({"row": row2.cast("int"), "col": col2.cast("int")})


def hashed_augmentation(dies: DataFrame, wafer: str, n: int, seed: int = 42) -> DataFrame:
    """Choices drawn from a hash of the wafer key with the usual odds: 70 %
    rotated, flips one half each."""
    def draw(salt: int, m: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(wafer)), F.lit(m))

    turns = F.when(draw(1, 10) < 7, draw(2, 3) + 1).otherwise(F.lit(0))
    return augment(dies, wafer, n, turns, draw(3, 2) == 0, draw(4, 2) == 0)


def defect_summary(dies: DataFrame, wafer: str, n: int) -> DataFrame:
    """Centre and edge defect density, area ratio and spread per wafer."""
    d, r, c, mid = F.col("value").cast("double"), F.col("row"), F.col("col"), n // 2
    d2 = ((r - mid) * (r - mid) + (c - mid) * (c - mid)).cast("double")
    hit = F.col("value") > 0

    def density(cond: Column) -> Column:
        return F.coalesce(F.avg(F.when(cond, d)), F.lit(0.0))

    spread = F.stddev_pop(F.when(hit, r)) + F.stddev_pop(F.when(hit, c))
    return dies.groupBy(wafer).agg(
        density(d2 <= (n / 6) ** 2).alias("center_density"),
        density((d2 >= (n / 3) ** 2) & (d2 <= (n / 2.2) ** 2)).alias("edge_density"),
        F.avg(d).alias("defect_area_ratio"),
        F.coalesce(F.when(F.sum(d) > 1, spread), F.lit(0.0)).alias("defect_spread"),
        F.count(F.lit(1)).alias("total_pixels"),
        F.sum(F.col("value")).cast("long").alias("defect_pixels"),
    )


def _gradient(value: str, w) -> Column:
    """Central difference, one-sided at the borders."""
    v, prev, nxt = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return F.when(prev.isNull() & nxt.isNull(), 0.0).when(prev.isNull(), nxt - v).when(nxt.isNull(), v - prev).otherwise((nxt - prev) / 2)


def map_statistics(dies: DataFrame, wafer: str, h: int, w: int) -> DataFrame:
    """Interpretable statistics per map: intensity, zones, gradients,
    neighbour variation and three radial zones."""
    # One shuffle by wafer serves both window directions.
    rows = dies.withColumn("value", F.col("value").cast("double")).repartition(wafer)
    along_row, along_col = Window.partitionBy(wafer, "row").orderBy("col"), Window.partitionBy(wafer, "col").orderBy("row")
    rows = rows.withColumns({"_gx": _gradient("value", along_row), "_dx": F.abs(F.lead("value").over(along_row) - F.col("value"))})
    rows = rows.withColumns({"_gy": _gradient("value", along_col), "_dy": F.abs(F.lead("value").over(along_col) - F.col("value"))})
    rows = rows.withColumn("_g", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")))
    r, c, v = F.col("row"), F.col("col"), F.col("value")
    centre = (r >= h // 3) & (r < 2 * h // 3) & (c >= w // 3) & (c < 2 * w // 3)
    top = min(h // 2, w // 2)
    dist = _distance(h, w)

    def zone(cond: Column, name: str, std: bool = True) -> list[Column]:
        out = [F.coalesce(F.avg(F.when(cond, v)), F.lit(0.0)).alias(f"{name}_mean")]
        return out + ([F.coalesce(F.stddev_pop(F.when(cond, v)), F.lit(0.0)).alias(f"{name}_std")] if std else [])

    radial = []
    for i, (a, b) in enumerate([(0.0, 0.3), (0.3, 0.6), (0.6, 0.9)]):
        radial += zone((dist >= top * a) & (dist < top * b), f"radial_zone_{i}")
    # Quantiles of one bounded map, so the value table of the aggregate is too.
    out = rows.groupBy(wafer).agg(
        F.avg(v).alias("mean_intensity"), F.stddev_pop(v).alias("std_intensity"), F.min(v).alias("min_intensity"), F.max(v).alias("max_intensity"),
        F.percentile(v, 0.5).alias("median_intensity"), F.percentile(v, 0.25).alias("q25_intensity"), F.percentile(v, 0.75).alias("q75_intensity"),
        *zone(centre, "center"),
        *zone(r < h // 4, "edge_top", False), *zone(r >= 3 * h // 4, "edge_bottom", False),
        *zone(c < w // 4, "edge_left", False), *zone(c >= 3 * w // 4, "edge_right", False),
        F.avg("_g").alias("grad_mean"), F.stddev_pop("_g").alias("grad_std"), F.max("_g").alias("grad_max"),
        F.percentile("_g", 0.95).alias("_p95"), F.collect_list("_g").alias("_gs"),
        F.avg("_dx").alias("horizontal_variation"), F.stddev_pop("_dx").alias("horizontal_variation_std"),
        F.avg("_dy").alias("vertical_variation"), F.stddev_pop("_dy").alias("vertical_variation_std"),
        *radial,
    )
    return out.withColumn("high_grad_count", F.size(F.filter("_gs", lambda g: g > F.col("_p95")))).drop("_gs", "_p95")


def region_risk(dies: DataFrame, wafer: str, h: int, w: int) -> DataFrame:
    """Mean, spread, contrast, confidence and risk of five regions; the centre
    overlaps the quarters."""
    r, c = F.col("row"), F.col("col")
    regions = {
        "top_left": (r < h // 2) & (c < w // 2),
        "top_right": (r < h // 2) & (c >= w // 2),
        "bottom_left": (r >= h // 2) & (c < w // 2),
        "bottom_right": (r >= h // 2) & (c >= w // 2),
        "center": (r >= h // 3) & (r < 2 * h // 3) & (c >= w // 3) & (c < 2 * w // 3),
    }
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in regions.items()]))
    v = F.col("value").cast("double")
    out = dies.withColumn("region", F.explode(names)).groupBy(wafer, "region").agg(
        F.avg(v).alias("mean_intensity"), F.stddev_pop(v).alias("std_intensity"), (F.max(v) - F.min(v)).alias("contrast")
    )
    even = 1 / (1 + F.col("std_intensity"))
    return out.withColumns(
        {
            "confidence": F.when(F.col("contrast") < 0.3, even).otherwise(even * 0.5),
            "anomaly_risk": F.when(F.col("std_intensity") > 0.2, "high").when(F.col("std_intensity") > 0.1, "medium").otherwise("low"),
        }
    )


def region_summary(regions: DataFrame, wafer: str) -> DataFrame:
    return regions.groupBy(wafer).agg(
        F.avg("confidence").alias("overall_spatial_confidence"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("anomaly_risk") == "high", F.col("region")))), ",").alias("high_risk_regions"),
    )


def batch_quality(dies: DataFrame, wafer: str, wafer_value: float = 10_000.0) -> DataFrame:
    """Yield estimate, loss and rate of critical maps over a batch of maps;
    a die is defective above 0.2."""
    per = dies.groupBy(wafer).agg(F.count_if(F.col("value") > 0.2).alias("d"), F.count(F.lit(1)).alias("n"))
    loss = F.least(F.col("d") / F.col("n"), F.lit(0.95))
    return per.agg(
        F.avg(1 - loss).alias("avg_yield_estimate"),
        (F.avg(loss) * wafer_value).alias("avg_estimated_loss_usd"),
        F.stddev_pop(1 - loss).alias("yield_std"),
        F.avg((F.col("d") > F.col("n") * 0.1).cast("double")).alias("critical_defect_rate"),
    )


def batch_diversity(dies: DataFrame, wafer: str, n: int, centre: tuple[int, int], edge: int) -> DataFrame:
    """Average centre and edge intensity and defect coverage of a batch. Edge
    strips overlap at the corners, which count once per strip."""
    r, c, v = F.col("row"), F.col("col"), F.col("value").cast("double")
    strips = (r < edge).cast("int") + (r >= n - edge).cast("int") + (c < edge).cast("int") + (c >= n - edge).cast("int")
    inside = (r >= centre[0]) & (r < centre[1]) & (c >= centre[0]) & (c < centre[1])
    per = dies.groupBy(wafer).agg(
        F.avg(F.when(inside, v)).alias("center"),
        ratio_or(F.sum(v * strips), F.sum(strips)).alias("edge"),
        F.avg((v > 0.3).cast("double")).alias("coverage"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("num_analyzed"),
        F.avg("center").alias("avg_center_intensity"),
        F.avg("edge").alias("avg_edge_intensity"),
        F.avg("coverage").alias("avg_defect_coverage"),
    )


def class_density(dies: DataFrame, wafer: str, label: str) -> DataFrame:
    """Per class: maps, mean and spread of the defect density (value 0), mean
    number of good dies."""
    per = dies.groupBy(wafer, label).agg(F.avg((F.col("value") == 0).cast("double")).alias("d"), F.count_if(F.col("value") == 1).alias("g"))
    return per.groupBy(label).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("d").alias("mean_defect_density"),
        F.stddev_pop("d").alias("std_defect_density"),
        F.avg("g").alias("avg_good_dies"),
    )

"""Density clustering through grid cells, and connected components."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of an undirected graph, by alternating large-star and
    small-star steps; every step is checkpointed. The label is the smallest
    id. ``edges`` has src, dst; self edges keep isolated nodes."""
    both = edges.select("src", "dst")
    nodes = both.select(F.col("src").alias("id")).union(both.select("dst")).distinct()
    e = cut_lineage(both.filter(F.col("src") != F.col("dst")).distinct())
    last = None
    while True:
        # Large star: larger neighbours point to the smallest one.
        sym = e.union(e.select("dst", "src"))
        low = sym.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        e = sym.join(low, "src").filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        # Small star: smaller neighbours and the node itself point to the smallest.
        down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter(F.col("src") != F.col("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        joined = down.join(low, "src")
        e = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(joined.select("src", F.col("m").alias("dst")))
        e = cut_lineage(e.filter(F.col("src") != F.col("dst")).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if last is not None and tuple(now) == last:
            break
        last = tuple(now)
    label = e.groupBy("src").agg(F.min("dst").alias("component")).withColumnRenamed("src", "id")
    return nodes.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _cell(cols: Sequence[str], side: float) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("long") for c in cols]


def _steps(d: int, reach: int) -> list[tuple[int, ...]]:
    return list(itertools.product(range(-reach, reach + 1), repeat=d))


def dbscan(df: DataFrame, key: str, columns: Sequence[str], eps: float, min_samples: int, levels: int = 40, leaf: int = 1024) -> DataFrame:
    """(key, cluster, is_core) of DBSCAN on a few columns; noise is -1, a
    border row takes the smallest cluster it reaches. Rows with a NULL or NaN
    coordinate are noise.

    Cells have a diagonal of eps: rows of one cell are neighbours without any
    comparison, and a cell with ``min_samples`` rows is all core. Only rows of
    thinner cells count neighbours, and a cell has few of those, so the work
    grows with the rows however dense a cell is. Two cells are linked by boxes
    that halve per level, up to ``levels`` times and until nothing is open; rows
    are compared only in pairs of boxes with at most ``leaf`` pairs of rows.
    """
    cols, d = list(columns), len(columns)
    side = eps / math.sqrt(d)
    reach = math.ceil(math.sqrt(d))
    names = [f"c{i}" for i in range(d)]
    xs = [f"x{i}" for i in range(d)]
    # Equal rows are one weighted point.
    pts = df.select(key, *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)]).na.drop(subset=xs)
    pts = pts.groupBy(*xs).agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("low_key"))
    pts = pts.withColumn("pid", F.concat_ws(",", *xs)).withColumns({n: c for n, c in zip(names, _cell(xs, side))})
    pts = cut_lineage(pts)
    sizes = pts.groupBy(*names).agg(F.sum("w").alias("cell_w"))
    pts = pts.join(sizes, names)
    dense = F.col("cell_w") >= min_samples

    # The row's own offset is left out: rows of its cell are all neighbours.
    offsets = [s for s in _steps(d, reach) if any(s)]
    near_cells = F.array(*[F.struct(*[(F.col(n) + o).alias(n) for n, o in zip(names, s)]) for s in offsets])

    def fan_out(rows: DataFrame, keep: list[str]) -> DataFrame:
        return rows.select(*keep, F.explode(near_cells).alias("_t")).select(*keep, *[F.col(f"_t.{n}").alias(n) for n in names])

    def close(a: str, b: str) -> Column:
        return sum(((F.col(f"{a}{x}") - F.col(f"{b}{x}")) * (F.col(f"{a}{x}") - F.col(f"{b}{x}")) for x in xs), F.lit(0.0)) <= eps * eps

    thin = pts.filter(~dense).select("pid", *names, *[F.col(x).alias(f"q_{x}") for x in xs])
    wanted = fan_out(thin, ["pid", *[f"q_{x}" for x in xs]])
    others = pts.select(*names, "w", *[F.col(x).alias(f"o_{x}") for x in xs])
    hits = wanted.join(others, names).filter(close("q_", "o_")).groupBy("pid").agg(F.sum("w").alias("outside"))
    core = pts.join(hits, "pid", "left").withColumn("is_core", dense | (F.col("cell_w") + F.coalesce("outside", F.lit(0)) >= min_samples))
    core = cut_lineage(core.drop("outside", "cell_w").withColumn("cell", F.concat_ws(",", *names)))

    cores = core.filter("is_core")
    # Candidate links: neighbouring cells with core rows, each pair once.
    cells = cores.select("cell", *names).distinct()
    pairs = fan_out(cells.withColumnRenamed("cell", "a"), ["a"]).join(cells.withColumnRenamed("cell", "b"), names).filter(F.col("a") < F.col("b")).select("a", "b")

    # Branch and bound: boxes of two cells halve until a pair of them is near
    # throughout, or two of their points are, or all are apart, or few points are left.
    found = []
    open_pairs = pairs.select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb"))
    sub = cores.select("cell", *xs)
    for lv in range(1, levels + 1):
        up, here = (F.concat_ws(",", "cell", *_cell(xs, side / 2**k)) if k else F.col("cell") for k in (lv - 1, lv))
        placed = sub.withColumns({"up": up, "sub": here})
        boxes = placed.groupBy("up", "sub").agg(
            *[f(x).alias(f"{t}{x}") for x in xs for f, t in ((F.min, "lo_"), (F.max, "hi_"))], F.count(F.lit(1)).alias("n"), F.min(F.struct(*xs)).alias("one")
        )

        def side_boxes(tag: str) -> DataFrame:
            return boxes.select(F.col("up").alias(f"s{tag}"), F.col("sub").alias(f"n{tag}"), *[F.col(c).alias(f"{tag}_{c}") for c in boxes.columns[2:]])

        kids = open_pairs.join(side_boxes("a"), "sa").join(side_boxes("b"), "sb")
        gap = [F.greatest(F.lit(0.0), F.col(f"a_lo_{x}") - F.col(f"b_hi_{x}"), F.col(f"b_lo_{x}") - F.col(f"a_hi_{x}")) for x in xs]
        far = [F.greatest(F.col(f"a_hi_{x}") - F.col(f"b_lo_{x}"), F.col(f"b_hi_{x}") - F.col(f"a_lo_{x}")) for x in xs]
        some = [F.col(f"a_one.{x}") - F.col(f"b_one.{x}") for x in xs]
        square = lambda parts: sum((v * v for v in parts), F.lit(0.0))
        kids = kids.filter(square(gap) <= eps * eps)
        sure = (square(far) <= eps * eps) | (square(some) <= eps * eps)
        few = (F.col("a_n") * F.col("b_n") <= leaf) | F.lit(lv == levels)
        kids = cut_lineage(kids.select("a", "b", "na", "nb", sure.alias("sure"), few.alias("few")))
        done = kids.filter("sure").select("a", "b").distinct()
        left = kids.filter(~F.col("sure")).join(done, ["a", "b"], "left_anti")
        # At most ``leaf`` comparisons a pair of boxes.
        pa = placed.select(F.col("sub").alias("na"), *[F.col(x).alias(f"q_{x}") for x in xs])
        pb = placed.select(F.col("sub").alias("nb"), *[F.col(x).alias(f"o_{x}") for x in xs])
        met = left.filter("few").join(pa, "na").join(pb, "nb").filter(close("q_", "o_")).select("a", "b").distinct()
        new = cut_lineage(done.union(met))
        found.append(new)
        open_pairs = cut_lineage(left.filter(~F.col("few")).join(new, ["a", "b"], "left_anti").select("a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb")))
        if open_pairs.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = edges.union(cells.select(F.col("cell").alias("src"), F.col("cell").alias("dst")))
    comp = connected_components(edges).select(F.col("id").alias("cell"), F.col("component").alias("root"))

    # A cluster is named after the smallest key of its core rows.
    with_root = cores.join(comp, "cell")
    names_of = with_root.groupBy("root").agg(F.min("low_key").alias("cluster"))
    named = with_root.join(names_of, "root")
    # Border rows: the clusters of core rows within eps; a row of a cell with a
    # core row is within eps of it.
    border = core.filter(~F.col("is_core"))
    same = border.select("pid", "cell").join(named.select("cell", "cluster").distinct(), "cell").select("pid", "cluster")
    q = border.select("pid", *names, *[F.col(x).alias(f"q_{x}") for x in xs])
    o = named.select(*names, "cluster", *[F.col(x).alias(f"o_{x}") for x in xs])
    reached = fan_out(q, ["pid", *[f"q_{x}" for x in xs]]).join(o, names).filter(close("q_", "o_")).select("pid", "cluster")
    found = named.select("pid", "cluster").union(same).union(reached).groupBy("pid").agg(F.min("cluster").alias("cluster"))
    labelled = core.join(found, "pid", "left").select(*xs, "is_core", "cluster")
    rows = df.select(key, *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)]).join(labelled, xs, "left")
    return rows.select(key, F.coalesce(F.col("cluster"), F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))

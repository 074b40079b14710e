"""Connected components of maps of any size, tile by tile.

A map is cut into square tiles. Components are labelled inside each tile; a
label is the smallest cell of its component. Only cells at tile borders meet
the neighbouring tiles, where touching labels become links, and a component
search over labels joins what the borders cut. A map with 10^8 cells is many
tasks, and a task holds one tile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .clustering import connected_components

ROW = 1 << 31  # a cell's number is row * ROW + column


def label_cells(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Per cell the place, among the given cells, of the first one of its
    component (neighbours also touch at corners)."""
    n = len(row)
    top, left, height, width = row.min(), col.min(), np.ptp(row) + 1, np.ptp(col) + 1
    grid = np.full((height + 1, width + 2), -1)
    grid[row - top, col - left + 1] = np.arange(n)
    here = grid[row - top, col - left + 1]
    a, b = [], []
    for down, right in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = grid[row - top + down, col - left + 1 + right]
        a.append(here[other >= 0])
        b.append(other[other >= 0])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def tiled_components(cells: DataFrame, image: str, value: str = "value", tile: int = 512) -> DataFrame:
    """(image, n_components, total_area, largest_area) of the cells (image, row,
    col, value) whose value is not zero; zeros for an image without any.

    Rows and columns are whole numbers from 0; a cell given twice counts once.
    """
    kind = cells.schema[image].dataType.simpleString()
    full = cells.filter(F.col(value) != 0).select(image, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    number = (F.col("row") * ROW + F.col("col")).alias("cell")
    tiles = full.groupBy(image, F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).agg(F.sort_array(F.collect_set(number)).alias("cells"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = b.column("cells")[i].values.to_numpy()
                row, col = np.divmod(at, ROW)
                root = label_cells(row, col)
                first, size = np.unique(root, return_counts=True)
                edge = np.flatnonzero((row % tile == 0) | (row % tile == tile - 1) | (col % tile == 0) | (col % tile == tile - 1))
                labels = np.concatenate([at[first], at[root[edge]]])
                border = np.concatenate([np.full(len(first), -1), at[edge]])
                sizes = np.concatenate([size, np.zeros(len(edge), np.int64)])
                name = pa.concat_arrays([b.column(image).slice(i, 1)] * len(labels)) if len(labels) else b.column(image).slice(0, 0)
                yield pa.RecordBatch.from_arrays([name, pa.array(labels), pa.array(border), pa.array(sizes)], names=[image, "label", "cell", "size"])

    found = cut_lineage(tiles.select(image, "cells").mapInArrow(run, f"`{image}` {kind}, label long, cell long, size long"))
    named = F.struct(F.col(image), F.col("label"))
    border = found.filter("cell >= 0").select(image, "label", "cell")
    steps = F.array(*[F.lit(r * ROW + c) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    sent = border.select(image, F.col("label").alias("from"), F.explode(F.transform(steps, lambda s: F.col("cell") + s)).alias("cell"))
    links = sent.join(border, [image, "cell"]).filter(F.col("from") != F.col("label"))
    edges = links.select(F.struct(F.col(image), F.col("from").alias("label")).alias("src"), named.alias("dst")).distinct()
    joined = connected_components(edges)
    sizes = found.filter("cell < 0").withColumn("id", named)
    sizes = sizes.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    areas = sizes.groupBy(image, "component").agg(F.sum("size").alias("area")).groupBy(image).agg(
        F.count(F.lit(1)).alias("n"), F.sum("area").alias("total"), F.max("area").alias("largest")
    )
    out = cells.select(image).distinct().join(areas, image, "left")
    return out.select(image, *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("n", "n_components"), ("total", "total_area"), ("largest", "largest_area"))])

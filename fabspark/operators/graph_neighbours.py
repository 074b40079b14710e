"""Approximate nearest neighbours by descent on a neighbour graph.

For many columns, where bounds by triangle inequality prune nothing. The first
graph joins rows exactly inside small blocks around random pivots. A round then
introduces the neighbours of a point, and the points it is a neighbour of, to
each other: for each point at most ``2 k`` vectors meet in one row, all their
distances are computed at once, and every member keeps the best it met, unless
they are beyond its k nearest so far. Pairs that have met before are skipped.
Rounds end when few neighbours change.

Work per row is bounded whatever the table: a vector is sent to at most 2 k
rows a round, a hub no more than any other. Distances are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _packed(points: DataFrame, kind: str) -> DataFrame:
    """(pid, vector) with the vector's bytes: four a number where that loses
    nothing, as with vectors that came as floats, else eight."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("vector")) if b.num_rows else np.zeros((0, 0))
            with np.errstate(over="ignore"):
                short = x.astype("<f4")
            exact = (short == x).all(1)
            made = [s.tobytes() if e else v.tobytes() for s, v, e in zip(short, x.astype("<f8"), exact)]
            yield pa.RecordBatch.from_arrays([b.column("pid"), pa.array(made, pa.binary())], names=["pid", "vector"])

    return points.select("pid", "vector").mapInArrow(run, f"pid {kind}, vector binary")


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Doubles of packed vectors of ``width`` numbers."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.empty((len(column), width))
    for kind, n in (("<f4", 4 * width), ("<f8", 8 * width)):
        some = np.flatnonzero(sizes == n)
        if len(some):
            part = column if len(some) == len(column) else column.take(pa.array(some))
            at = np.frombuffer(part.buffers()[1], np.int32)[part.offset]
            out[some] = np.frombuffer(part.buffers()[2], np.uint8)[at : at + n * len(some)].view(kind).reshape(-1, width)
    return out


def _close(x: np.ndarray, sizes: np.ndarray, fresh: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance) of lists of members that lie one after another.

    Products of all members of a list tell which pairs may count, within their
    rounding: the k nearest of a member, none farther than its bound. Those are
    measured by differences: equal pairs give equal distances in every list."""
    n = int(sizes.max())
    first = np.cumsum(sizes) - sizes
    place = np.arange(n)[None, :]
    valid = place < sizes[:, None]
    at = np.where(valid, first[:, None] + place, 0)
    v = np.where(valid[:, :, None], x[at], 0.0)
    new = fresh[at]
    with np.errstate(invalid="ignore", over="ignore"):
        sq = (v * v).sum(2)
        d = sq[:, :, None] + sq[:, None, :] - 2.0 * (v @ v.transpose(0, 2, 1))
        noise = 16 * np.finfo(float).eps * (x.shape[1] + 2) * np.where(np.isfinite(sq), sq, 0.0).max(1)
        d[np.isnan(d)] = np.inf
        d[~(valid[:, :, None] & valid[:, None, :] & (new[:, :, None] | new[:, None, :]))] = np.inf
        d[:, np.arange(n), np.arange(n)] = np.inf
        cut = bound[at] ** 2 * (1 + 1e-12)
        if k < n:
            cut = np.minimum(cut, np.partition(d, k - 1, axis=2)[:, :, k - 1])
        which, i, j = np.nonzero(np.isfinite(d) & (d <= (cut + noise[:, None])[:, :, None]))
        left, right = at[which, i], at[which, j]
        far = np.sqrt(((x[left] - x[right]) ** 2).sum(1))
    some = far <= bound[left]
    return left[some], right[some], far[some]


def _met(rows: DataFrame, k: int, kind: str, width: int) -> DataFrame:
    """(qid, nid, dist): per row of ``met`` (an array of pid, packed vector, fresh,
    bound) the k nearest of each member among those it meets anew, without those
    beyond the member's bound."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < len(sizes):
                # Lists are compared side by side, as long as their tables are small.
                hi, most = lo + 1, sizes[lo]
                while hi < len(sizes) and (hi + 1 - lo) * max(most, sizes[hi]) ** 2 <= 250_000:
                    most, hi = max(most, sizes[hi]), hi + 1
                members = batch.column(0).slice(lo, hi - lo).flatten()
                ids, fresh = members.field("pid"), members.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
                x, bound = _unpacked(members.field("vector"), width), members.field("bound").to_numpy(zero_copy_only=False)
                left, right, far = _close(x, sizes[lo:hi], fresh, bound, k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(far)], names=["qid", "nid", "dist"])
                lo = hi

    return rows.select("met").mapInArrow(run, f"qid {kind}, nid {kind}, dist double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest per point; ties go to the smaller id. ``fresh`` is true
    for pairs that no earlier round had."""
    once = pairs.groupBy("qid", "nid").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _first_graph(points: DataFrame, k: int, block: int, seed: int, kind: str, width: int) -> DataFrame:
    """Neighbours inside blocks of about ``block`` rows around random pivots."""
    total = points.count()
    n = min(1000, max(1, math.ceil(total / block)))
    spark = points.sparkSession
    if not total:
        return spark.createDataFrame([], f"qid {kind}, nid {kind}, dist double")
    chosen = points.orderBy(F.xxhash64("pid", F.lit(seed)), "pid").limit(n).select("vector").collect()  # at most 1,000
    pivots = spark.sparkContext.broadcast(_unpacked(pa.array([bytes(r["vector"]) for r in chosen], pa.binary()), width))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for b in batches:
            x = _unpacked(b.column("vector"), width)
            cell = ((p * p).sum(1)[None, :] - 2.0 * x @ p.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    placed = cut_lineage(points.select("pid", "vector").mapInArrow(near, f"pid {kind}, vector binary, cell int"))
    sizes = {r["cell"]: max(1, math.ceil(r["n"] / block)) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a pivot
    cuts = F.element_at(F.create_map(*[F.lit(v) for c, s in sizes.items() for v in (c, s)]), F.col("cell"))
    met = placed.groupBy("cell", F.pmod(F.xxhash64("pid"), cuts).alias("sub")).agg(F.collect_list(F.struct("pid", "vector", F.lit(True).alias("fresh"), F.lit(math.inf).alias("bound"))).alias("met"))
    return _met(met, k, kind, width)


def graph_neighbours(points: DataFrame, k: int, block: int = 512, rounds: int = 8, settled: float = 0.002, seed: int = 17) -> DataFrame:
    """(qid, nid, dist, rank) of the k nearest other points found.

    ``points`` has pid (each once) and vector, an array of doubles of one
    length. It ends after ``rounds`` or when less than ``settled`` of all
    neighbours change. A table of at most ``block`` rows is compared exactly;
    with at most k other points, all of them are returned.
    """
    kind = points.schema["pid"].dataType.simpleString()
    points = cut_lineage(points.select("pid", "vector"))
    one = points.first()
    width = len(one["vector"]) if one else 0
    points = cut_lineage(_packed(points, kind))
    starts = [_first_graph(points, k, block, seed + i, kind, width) for i in range(2)]
    graph = cut_lineage(_best(starts[0].unionByName(starts[1]).withColumn("fresh", F.lit(True)), k))
    edges = graph.count()
    for r in range(rounds):
        if points.count() <= block:
            break
        there = graph.select(F.col("qid").alias("at"), F.col("nid").alias("pid"), "fresh")
        back = graph.select(F.col("nid").alias("at"), F.col("qid").alias("pid"), "fresh")
        # Of those it is a neighbour of, a point meets k, new ones first.
        w = Window.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("pid", F.lit(r)))
        back = back.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
        around = there.unionByName(back).groupBy("at", "pid").agg(F.max("fresh").alias("fresh"))
        # A point takes no notice of others beyond its k nearest so far.
        kth = graph.filter(F.col("rank") == k).select(F.col("qid").alias("pid"), F.col("dist").alias("bound"))
        bounded = points.join(kth, "pid", "left").fillna(math.inf, ["bound"])
        met = around.join(bounded, "pid").groupBy("at").agg(F.collect_list(F.struct("pid", "vector", "fresh", "bound")).alias("met"))
        met = met.filter(F.exists("met", lambda m: m["fresh"]))
        found = _met(met, k, kind, width).withColumn("fresh", F.lit(True))
        graph = cut_lineage(_best(graph.select("qid", "nid", "dist", F.lit(False).alias("fresh")).unionByName(found), k))
        changed = graph.filter("fresh").count()
        if changed <= settled * edges:
            break
    return graph.select("qid", "nid", "dist", "rank")

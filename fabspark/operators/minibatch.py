"""Mini-batch k-means.

A bounded sample is drawn once by hash and cut into batches. Centres are seeded
in parallel: rounds draw candidates in proportion to their cost, candidates are
weighted by the rows nearest to them and thinned to k on the driver (a few
times k rows). Each batch then moves every centre towards the mean of its rows
with the centre's own rate, the share of the batch in all rows it has seen.
Centres (k x columns) are the only thing tasks are sent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre, the smaller on ties, and squared distance."""
    near, cost = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 1024):
        d = ((x[at : at + 1024, None, :] - centres[None]) ** 2).sum(2)
        near[at : at + 1024] = d.argmin(1)
        cost[at : at + 1024] = d.min(1)
    return near, cost


def with_nearest(rows: DataFrame, vector: str, centres: np.ndarray, cluster: str = "prediction", cost: str = "cost") -> DataFrame:
    """Rows with their nearest centre and the squared distance to it; NULL for
    a NULL vector. ``vector`` is an array of doubles."""
    schema = T.StructType([*rows.schema, T.StructField(cluster, T.IntegerType()), T.StructField(cost, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(vector)
            some = np.flatnonzero(np.array(given.is_valid()))
            near, far = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.nan)
            near[some], far[some] = _nearest(_matrix(given.take(pa.array(some))), centres)
            empty = np.ones(b.num_rows, bool)
            empty[some] = False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, mask=empty), pa.array(far, mask=empty)], names=[*b.schema.names, cluster, cost])

    return rows.mapInArrow(run, schema)


def _uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) by hash, the same in every run."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 30)) / float(1 << 30)


def _thin(points: np.ndarray, weights: np.ndarray, k: int, seed: int, tries: int = 8) -> np.ndarray:
    """k centres of some weighted points, the cheapest of a few tries."""
    found = [_thin_once(points, weights, k, np.random.default_rng((seed, t))) for t in range(tries)]
    return min(found, key=lambda c: (weights * _nearest(points, c)[1]).sum())


def _thin_once(points: np.ndarray, weights: np.ndarray, k: int, rnd: np.random.Generator) -> np.ndarray:
    """k of the points drawn by their cost, then refined among all."""
    chosen = [points[rnd.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < min(k, len(points)):
        cost = weights * _nearest(points, np.array(chosen))[1]
        if not cost.sum():
            break
        chosen.append(points[rnd.choice(len(points), p=cost / cost.sum())])
    centres = np.array(chosen)
    for _ in range(20):
        near, _ = _nearest(points, centres)
        total = np.bincount(near, weights, len(centres))
        sums = np.stack([np.bincount(near, weights * points[:, j], len(centres)) for j in range(points.shape[1])], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centres)
    return centres


def seed_centres(sample: DataFrame, k: int, seed: int, rounds: int = 3) -> np.ndarray:
    """k centres of a sample with ``id`` and ``x``: candidates by parallel
    rounds of about 2 k rows each, thinned on the driver."""
    first = sample.orderBy(F.xxhash64("id", F.lit(seed))).limit(1).collect()
    if not first:
        return np.zeros((0, 1))
    candidates = np.array([first[0]["x"]], float)
    for r in range(rounds):
        costs = with_nearest(sample, "x", candidates)
        total = costs.agg(F.sum("cost")).first()[0]
        if not total:
            break
        share = F.col("cost") * (2.0 * k / total)
        more = costs.filter(_uniform(F.col("id"), seed, r) < share).select("id", "x").collect()  # about 2 k rows
        more.sort(key=lambda m: (m["id"], m["x"]))
        candidates = np.concatenate([candidates, np.array([m["x"] for m in more], float).reshape(-1, candidates.shape[1])])
    counts = {c["prediction"]: c["n"] for c in with_nearest(sample, "x", candidates).groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([counts.get(i, 0) for i in range(len(candidates))], float)
    return _thin(candidates[weights > 0], weights[weights > 0], k, seed)


class MiniBatchModel:
    def __init__(self, centres: np.ndarray, vector: str):
        self.centres, self.vector = centres, vector

    def transform(self, df: DataFrame, cost: str = "cost") -> DataFrame:
        """All rows with ``prediction`` and the squared distance, by built-in
        functions; NULL for a NULL vector, the smaller number on ties."""
        x = _array(df, self.vector)
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in self.centres])
        far = F.transform(centres, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        out = df.withColumn("_far", F.when(x.isNotNull(), far)).withColumn(cost, F.array_min("_far"))
        return out.withColumn("prediction", (F.array_position("_far", F.col(cost)) - 1).cast("int")).drop("_far").select(*df.columns, "prediction", cost)


def _array(df: DataFrame, vector: str) -> Column:
    return F.col(vector).cast("array<double>") if isinstance(df.schema[vector].dataType, T.ArrayType) else vector_to_array(vector)


class MiniBatchKMeans:
    """``batches`` batches of about ``batch_rows`` rows each are all that is
    fitted on; both are the stated bound of the sample."""

    def __init__(self, k: int, batch_rows: int = 1024, batches: int = 30, seed: int = 42, vector: str = "features"):
        self.k, self.batch_rows, self.batches, self.seed, self.vector = k, batch_rows, batches, seed, vector

    def fit(self, df: DataFrame, keys: Sequence[str]) -> MiniBatchModel:
        """``keys`` name rows, so that the sample is the same in every run."""
        rows = df.filter(F.col(self.vector).isNotNull()).select(F.xxhash64(*keys).alias("id"), _array(df, self.vector).alias("x"))
        wanted = self.batch_rows * self.batches
        share = min(1.0, wanted / max(rows.count(), 1))
        sample = cut_lineage(rows.filter(_uniform(F.col("id"), self.seed) < share))
        centres = seed_centres(sample, self.k, self.seed)
        seen = np.zeros(len(centres))
        # A small table is walked in fewer rows a batch, as often.
        for b in range(self.batches if len(centres) else 0):
            batch = sample.filter(F.pmod(F.xxhash64("id", F.lit(self.seed + 1)), F.lit(self.batches)) == b)
            near = with_nearest(batch, "x", centres)
            sums = near.select("prediction", F.posexplode("x").alias("j", "v")).groupBy("prediction", "j").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # k x columns
            total, n = np.zeros_like(centres), np.zeros(len(centres))
            for r in sums:
                total[r["prediction"], r["j"]] = r["s"]
                n[r["prediction"]] = r["n"]
            seen += n
            moved = n > 0
            centres[moved] += (total[moved] - n[moved, None] * centres[moved]) / seen[moved, None]
        return MiniBatchModel(centres, self.vector)

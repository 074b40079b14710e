"""Adaptive baseline: every row against the rows before it.

A row is scored against mean, deviation, median and MAD of its own last
``window`` rows of the key. Rows are numbered inside their key, cut into chunks
of a fixed number of rows with the last rows of the chunk before in front, and
a chunk slides over its values in Arrow batches. A key with a third of all rows
is many chunks, and a chunk holds one batch and one window at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import POS, Ordered
from ..operators.windows import last_rows
from .sources import drain_batches

STATS = ("base_n", "base_mean", "base_std", "base_median", "base_mad")


def _middle(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of the first n values of ascending rows; NaN without any."""
    at = np.arange(len(n))
    last = ordered.shape[1] - 1
    low, high = ordered[at, np.clip((n - 1) // 2, 0, last)], ordered[at, np.clip(n // 2, 0, last)]
    return np.where(n > 0, (low + high) / 2, np.nan)


def sliding(values: np.ndarray, before: np.ndarray, window: int) -> list[np.ndarray]:
    """Mean, deviation, median and MAD of the ``window`` values before each of
    ``values``; ``before`` holds those before the first. NaN is missing."""
    padded = np.concatenate([np.full(window - len(before), np.nan), before, values[:-1]])
    frames = np.lib.stride_tricks.sliding_window_view(padded, window)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, len(values), 256):
        block = frames[at : at + 256]
        n = (~np.isnan(block)).sum(1)
        some = np.maximum(n, 1)
        mean = np.where(n > 0, np.nansum(block, axis=1) / some, np.nan)
        std = np.where(n > 1, np.sqrt(np.nansum((block - mean[:, None]) ** 2, axis=1) / np.maximum(n - 1, 1)), np.nan)
        median = _middle(np.sort(block, axis=1), n)
        mad = _middle(np.sort(np.abs(block - median[:, None]), axis=1), n)
        for x, y in zip(out, (mean, std, median, mad), strict=True):
            x.append(y)
    return [np.concatenate(x) for x in out]


def rolling_baseline(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, window: int = 1000, chunk: int = 20_000, slice_on: Column | None = None) -> DataFrame:
    """``df`` with ``base_n`` (rows in the frame) and the frame's statistics:
    the up to ``window`` rows before each row, by ``order`` inside the keys.

    NULL and NaN values are missing; statistics of a frame without values are
    NULL. A NULL key is a key of its own. Ties in the order must be broken by
    its last column.
    """
    keys = list(keys)
    numbered = Ordered(df, keys, order, slice_on=slice_on).positioned().result()
    home = F.floor(F.col(POS) / chunk)
    spread = numbered.withColumn("_v", F.col(value).cast("double"))
    spread = spread.withColumn("_chunk", F.explode(F.array_compact(F.array(home, F.when(F.col(POS) % chunk >= chunk - window, home + 1)))))
    dealt = spread.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", POS)
    schema = T.StructType([*numbered.schema, *[T.StructField(s, T.LongType() if s == "base_n" else T.DoubleType()) for s in STATS]])
    names = [f.name for f in numbered.schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, last = np.zeros(0), None
        for b in batches:
            pos, part = b.column(POS).to_numpy(), b.column("_chunk").to_numpy()
            values = b.column("_v").to_numpy(zero_copy_only=False).astype(float)
            # A chunk of a key is a run of consecutive numbers.
            cuts = [0, *(np.flatnonzero((np.diff(pos) != 1) | (np.diff(part) != 0)) + 1).tolist(), len(pos)]
            stats: list[list[np.ndarray]] = [[], [], [], []]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if last != (part[lo], pos[lo] - 1):
                    tail = np.zeros(0)
                for x, y in zip(stats, sliding(values[lo:hi], tail, window), strict=True):
                    x.append(y)
                tail = np.concatenate([tail, values[lo:hi]])[-window:]
                last = (part[hi - 1], pos[hi - 1])
            if not len(pos):
                continue
            cells = [b.column(n) for n in names]
            cells.append(pa.array(np.minimum(pos, window), pa.int64()))
            cells += [pa.array(np.concatenate(x), pa.float64(), from_pandas=True) for x in stats]
            yield pa.RecordBatch.from_arrays(cells, names=[*names, *STATS]).filter(pa.array(part == pos // chunk))

    return dealt.mapInArrow(run, schema).drop(POS)


def flagged(rows: DataFrame, value: str, needed: int = 100, z_limit: float = 3.0, m_limit: float = 3.5) -> DataFrame:
    """Z and modified z flags of rows with a baseline of ``needed`` rows; a
    deviation or MAD of zero never flags."""
    ready = F.col("base_n") >= needed
    z = F.abs(F.try_divide(F.col(value) - F.col("base_mean"), F.col("base_std"))) > z_limit
    m = 0.6745 * F.abs(F.try_divide(F.col(value) - F.col("base_median"), F.col("base_mad"))) > m_limit
    return rows.withColumns(
        {"has_baseline": ready, "zscore_flag": F.coalesce(ready & z, F.lit(False)), "modified_zscore_flag": F.coalesce(ready & m, F.lit(False))}
    )


def adaptive_baseline(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, row_id: str, window: int = 1000, needed: int = 100, name: str = "baseline", arrivals: Iterable | None = None
) -> DataFrame:
    """Streaming outlier detection of every row against its last ``window``
    rows of the key, from the ``needed``-th row on.

    A micro-batch is scored next to the newest rows of the batches before, a
    table of at most ``window`` rows per key, so rows that arrive in order of
    time get the same scores whatever the cuts between batches. Rows that
    arrive late are scored in the batch they come with. Each batch writes its
    scores and its buffer below its own id: a repeated batch reads the same
    older buffer and overwrites its own outputs.
    """
    keys = list(keys)

    def handle(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_new", F.lit(1))
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/buffer/{batch_id - 1}").withColumn("_new", F.lit(0)), allowMissingColumns=True)
        based = rolling_baseline(rows, keys, ["_new", ts, row_id], value, window, slice_on=F.unix_micros(F.col(ts).cast("timestamp")).cast("double") + F.col("_new") * 1e18)
        flagged(based.filter("_new = 1").drop("_new"), value, needed).write.mode("overwrite").parquet(f"{folder}/scored/batch={batch_id}")
        kept = last_rows(rows.select(*dict.fromkeys([*keys, ts, row_id, value]), "_new"), keys, [F.desc("_new"), F.desc(ts), F.desc(row_id)], window)
        # What was new is older than all of the next batch.
        kept.drop("_new").write.mode("overwrite").parquet(f"{folder}/buffer/{batch_id}")

    folder = drain_batches(df, name, handle, arrivals=arrivals)
    return df.sparkSession.read.parquet(f"{folder}/scored")

"""Order-dependent work on keyed rows, safe for very large keys.

A window partitioned by a key puts all rows of the key in one task. That is
fine for most keys and fatal for one that holds a third of the table. Keys
with more rows than ``hot_rows`` are therefore cut into slices of about equal
depth along the order column:

* running aggregates: window inside the slice, plus the combined aggregates of
  the earlier slices (a table of one row per key and slice);
* bounded frames: rows are numbered, numbered rows fall into chunks, and the
  rows near a chunk edge are copied into the neighbouring chunk.

When the count of rows per key finds no large key, the plain window is used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import micros

HOT_ROWS = 4_000_000

POS = "pos"
_SLICE, _CHUNK, _SLICE_ON = "_slice", "_chunk", "_slice_on"

_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


class Ordered:
    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str | Column],
        slice_on: Column | None = None,
        hot_rows: int = HOT_ROWS,
        bound: DataFrame | None = None,
    ):
        """``bound`` is a cheaper frame with at least as many rows per key; the
        rows of ``df`` itself are counted only if some key of it is large."""
        self.keys = list(keys)
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        self.hot_rows = hot_rows
        self.slice_on = slice_on if slice_on is not None else self._numeric(df, order[0])
        if bound is not None and not self._large(bound).take(1):
            self.df, self.sliced = df, False
        else:
            self.df, self.sliced = self._slice(df)

    def _large(self, df: DataFrame) -> DataFrame:
        counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        return counts.filter(F.col("_n") > self.hot_rows)

    @staticmethod
    def _numeric(df: DataFrame, order: str | Column) -> Column:
        if not isinstance(order, str):
            raise ValueError("pass slice_on for an order that is not a plain column")
        kind = df.schema[order].dataType.typeName()
        c = F.col(order)
        if kind == "date":
            return F.unix_date(c).cast("double")
        if kind.startswith("timestamp"):
            return micros(df, order).cast("double")
        return c.cast("double")

    def _slice(self, df: DataFrame) -> tuple[DataFrame, bool]:
        hot = self._large(df).persist()
        rows = hot.agg(F.sum("_n")).first()[0]
        if not rows:
            hot.unpersist()
            return df, False
        # At most rows / hot_rows keys pass the filter, so this side is small.
        if self.keys:
            marks = hot.select(*self.keys, F.lit(True).alias("_hot"))
            marked = df.join(F.broadcast(marks), self.keys, "left")
            # A null key never equals itself in a join; count it as large.
            null_key = F.lit(False)
            for k in self.keys:
                null_key = null_key | F.col(k).isNull()
            marked = marked.withColumn("_hot", F.coalesce(F.col("_hot"), null_key))
        else:
            marked = df.withColumn("_hot", F.lit(True))
        marked = marked.withColumn(_SLICE_ON, F.coalesce(self.slice_on, F.lit(float("-inf"))))
        n = math.ceil(rows / self.hot_rows) + 1
        finite = marked.filter(F.col("_hot") & (F.col(_SLICE_ON) > F.lit(float("-inf"))))
        cuts = finite.approxQuantile(_SLICE_ON, [i / n for i in range(1, n)], 1.0 / (4 * n))
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        if len(splits) < 3:
            splits = [float("-inf"), 0.0, float("inf")]
        out = Bucketizer(splits=splits, inputCol=_SLICE_ON, outputCol="_bucket", handleInvalid="keep").transform(marked)
        out = out.withColumn(_SLICE, F.when(F.col("_hot"), F.col("_bucket").cast("int")).otherwise(0))
        return out.drop("_hot", _SLICE_ON, "_bucket"), True

    def _prefix(self, aggs: dict[str, Column], combine: dict[str, Callable]) -> DataFrame:
        """Combined aggregates of all earlier slices of the key."""
        per_slice = self.df.groupBy(*self.keys, _SLICE).agg(*[c.alias(n) for n, c in aggs.items()])
        before = Window.partitionBy(*self.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        per_slice = per_slice.withColumns({n: combine[n](n).over(before) for n in aggs})
        return per_slice.filter(F.col(_SLICE) > 0)

    def _attach(self, df: DataFrame, prefix: DataFrame) -> DataFrame:
        cols = [c for c in prefix.columns if c not in self.keys and c != _SLICE]
        right = prefix.select(
            *[F.col(k).alias(f"_r_{k}") for k in self.keys], F.col(_SLICE).alias("_r_slice"), *cols
        )
        cond = F.col(_SLICE) == F.col("_r_slice")
        for k in self.keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return df.join(right, cond, "left").drop("_r_slice", *[f"_r_{k}" for k in self.keys])

    def _next(self, df: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.__dict__.update(self.__dict__)
        other.df = df
        return other

    def with_columns(self, columns: dict[str, Column]) -> "Ordered":
        return self._next(self.df.withColumns(columns))

    def running(self, aggs: dict[str, tuple[str, Column]], strict: bool = False) -> "Ordered":
        """Aggregates from the first row of the key to the current row; with
        ``strict`` over the rows whose whole-number order value is smaller."""
        spec = Window.partitionBy(*self.keys, *([_SLICE] if self.sliced else []))
        w = spec.orderBy(*self.order)
        w = w.rangeBetween(Window.unboundedPreceding, -1) if strict else w.rowsBetween(Window.unboundedPreceding, 0)
        if not self.sliced:
            return self._next(self.df.withColumns({n: _AGG[a](c).over(w) for n, (a, c) in aggs.items()}))
        prefix = self._prefix(
            {f"_p_{n}": _AGG[a](c) for n, (a, c) in aggs.items()},
            {f"_p_{n}": _COMBINE[a] for n, (a, _) in aggs.items()},
        )
        df = self._attach(self.df, prefix)
        out = {}
        for n, (a, c) in aggs.items():
            here, earlier = _AGG[a](c).over(w), F.col(f"_p_{n}")
            if a in ("sum", "count"):
                out[n] = F.when(earlier.isNull(), here).when(here.isNull(), earlier).otherwise(here + earlier)
            else:
                out[n] = (F.least if a == "min" else F.greatest)(here, earlier)
        return self._next(df.withColumns(out).drop(*[f"_p_{n}" for n in aggs]))

    def positioned(self) -> "Ordered":
        """Adds the 0-based row number of the row within its key."""
        w = Window.partitionBy(*self.keys, *([_SLICE] if self.sliced else [])).orderBy(*self.order)
        number = F.row_number().over(w).cast("long") - 1
        if not self.sliced:
            return self._next(self.df.withColumn(POS, number))
        prefix = self._prefix({"_before": F.count(F.lit(1))}, {"_before": F.sum})
        df = self._attach(self.df, prefix)
        return self._next(df.withColumn(POS, number + F.coalesce(F.col("_before"), F.lit(0))).drop("_before"))

    def windowed(
        self, before: int, after: int, build: Callable[[DataFrame, WindowSpec], DataFrame], chunk_rows: int | None = None
    ) -> "Ordered":
        """Runs ``build(df, window)`` whose frames reach at most ``before`` rows
        back and ``after`` rows ahead. The frame carries ``pos``; guards for
        short frames must use it, not a row number of the window."""
        seq = self if POS in self.df.columns else self.positioned()
        if not seq.sliced:
            return seq._next(build(seq.df, Window.partitionBy(*self.keys).orderBy(*self.order)))
        size = max(chunk_rows or self.hot_rows, before, after, 1)
        home, at = F.floor(F.col(POS) / size), F.col(POS) % size
        copies = F.array_compact(
            F.array(
                home,
                F.when(at >= size - before, home + 1),
                F.when((at < after) & (home > 0), home - 1),
            )
        )
        spread = seq.df.withColumn(_CHUNK, F.explode(copies))
        spec = Window.partitionBy(*self.keys, _CHUNK).orderBy(*self.order)
        out = build(spread, spec).filter(F.col(_CHUNK) == F.floor(F.col(POS) / size))
        return seq._next(out.drop(_CHUNK))

    def result(self) -> DataFrame:
        return self.df.drop(_SLICE)


def decayed_sum(seq: Ordered, values: dict[str, Column], ratio: float) -> Ordered:
    """For each row t the sum of ``ratio^(t-i) * value_i`` over all i <= t.

    Work is linear in the rows: sums inside blocks of a fixed number of rows
    plus the decayed total of the block before; older blocks weigh less than
    1e-18 and vanish in double precision.
    """
    block = max(2, math.ceil(math.log(1e-18) / math.log(ratio)))

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        at = (F.col(POS) % block).cast("double")
        df = df.withColumn("_block", F.floor(F.col(POS) / block))
        part = [*seq.keys, *([_CHUNK] if _CHUNK in df.columns else [])]
        # By value of pos: rows without a value share the pos of the row before.
        inside = Window.partitionBy(*part, "_block").orderBy(POS).rangeBetween(Window.unboundedPreceding, 0)
        earlier = Window.partitionBy(*part).orderBy("_block").rangeBetween(-1, -1)
        out = {}
        for name, value in values.items():
            v = F.coalesce(value.cast("double"), F.lit(0.0))
            local = F.sum(v * F.pow(F.lit(ratio), -at)).over(inside) * F.pow(F.lit(ratio), at)
            carry = F.sum(v * F.pow(F.lit(ratio), F.lit(block - 1.0) - at)).over(earlier)
            out[name] = local + F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(ratio), at + 1.0)
        return df.withColumns(out).drop("_block")

    # Two blocks of halo: the block before may start inside the halo.
    return seq.windowed(2 * block, 0, build)

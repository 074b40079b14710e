"""All statistics of a quality profile in two passes over a table.

The first pass keeps one mergeable state per column: counts, missing and special
values, moments, extremes and a quantile sketch; the number of missing values
of a row is one more column. The second pass refines what the sketches leave
open, for all columns at once: it counts what lies below each bracket of a
quartile and keeps the values inside, and it counts outliers that are beyond
any doubt and keeps the values near the fences. The exact quartiles follow from
the kept values, a few thousandths of the rows, and settle the fences.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns
from ..session import cut_lineage, spread
from .ordered import HOT_ROWS, Ordered
from .ranks import ACCURACY

PROBS = (0.25, 0.75)
BELOW, LOW_SURE, HIGH_SURE, FAR, FIVE = 0, 2, 3, 4, 5  # counters; BELOW + j for quartile j
INSIDE, LOW_OPEN, HIGH_OPEN = 10, 12, 13  # kept values; INSIDE + j for quartile j


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


class Profile:
    """``columns``: the numeric ones to profile; ``numeric`` and ``outliers``
    have a row for each, ``missing_by_column`` for each column of the table."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, hot_rows: int = HOT_ROWS):
        self.df, self.spark, self.hot_rows = df, df.sparkSession, hot_rows
        self.columns = list(columns or numeric_columns(df))

    @cached_property
    def states(self) -> dict[str | None, dict]:
        """Column states by name; the number of missing values of rows under None."""
        df = spread(self.df)
        flags = [missing(df, c).cast("int") for c in df.columns]
        cells = []
        for c, m in zip(df.columns, flags, strict=True):
            v = F.col(f"`{c}`").cast("double") if c in self.columns else F.lit(None).cast("double")
            cells.append(F.struct(F.lit(c).alias("column"), F.when(~F.isnan(v), v).alias("v"), m.alias("m")))
        cells.append(F.struct(F.lit(None).cast("string").alias("column"), sum(flags, F.lit(0)).cast("double").alias("v"), F.lit(0).alias("m")))
        v = F.col("v")
        marks = [min(1.0, max(0.0, p + side * 3 / ACCURACY)) for p in PROBS for side in (-1, 1)]
        found = df.select(F.inline(F.array(*cells))).groupBy("column").agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("m").alias("missing"),
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("std_pop"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.sum(v).alias("sum"),
            F.count_if(F.abs(v) == float("inf")).alias("infinite"),
            F.count_if(v < 0).alias("negative"),
            F.count_if(v == 0).alias("zero"),
            F.count_if(v == len(df.columns)).alias("full"),
            F.percentile_approx(v, F.array(*[F.lit(m) for m in marks]), F.lit(ACCURACY)).alias("marks"),
        )
        return {r["column"]: r.asDict() for r in found.collect()}  # one row per column of the schema

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def numeric(self) -> DataFrame:
        names = ("rows", "n", "mean", "std_pop", "std", "min", "max", "infinite", "negative", "zero")
        rows = [(c, *[self.states[c][n] for n in names]) for c in self.columns if c in self.states]
        return self._frame(rows, "column string, rows long, n long, mean double, std_pop double, std double, min double, max double, infinite long, negative long, zero long")

    @cached_property
    def missing_by_column(self) -> DataFrame:
        rows = []
        for c, s in self.states.items():
            if c is not None:
                pct = s["missing"] / s["rows"] * 100
                rows.append((c, s["rows"], s["missing"], pct, 100 - pct))
        return self._frame(rows, "column string, rows long, missing long, missing_pct double, completeness_pct double")

    @cached_property
    def missing_per_row(self) -> DataFrame:
        s = self.states.get(None)
        whole = lambda x: None if x is None else int(x)
        row = (s["rows"], whole(s["min"]), whole(s["max"]), s["mean"], s["zero"], s["full"], whole(s["sum"])) if s else (0, None, None, None, 0, 0, None)
        return self._frame([row], "rows long, min_missing long, max_missing long, avg_missing double, rows_none_missing long, rows_all_missing long, total_missing long")

    def _brackets(self) -> dict[int, tuple]:
        """Per column number: quartile brackets, fence brackets, mean, deviations."""
        out = {}
        for i, c in enumerate(self.columns):
            s = self.states.get(c)
            if not s or not s["n"]:
                continue
            a, b, lo, hi = s["marks"] if s["n"] > ACCURACY else (-math.inf, math.inf, -math.inf, math.inf)
            width, least = hi - a, max(0.0, lo - b)
            fences = (a - 1.5 * width, b - 1.5 * least, lo + 1.5 * least, hi + 1.5 * width)
            if not all(map(math.isfinite, fences)):
                fences = (-math.inf, math.inf, -math.inf, math.inf)  # few or infinite values: all stay open
            out[i] = ((a, b), (lo, hi), fences, s["mean"], s["std_pop"] or 0.0, s["std"] or 0.0)
        return out

    @cached_property
    def _refined(self) -> tuple[dict[tuple[int, int], int], DataFrame]:
        """Counters, and the kept values with their numbers of rows."""
        brackets = self._brackets()
        names = [f"_c{i}" for i in range(len(self.columns))]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col, kind, value, weight = [], [], [], []

                def put(i: int, k: int, v: np.ndarray | None, w) -> None:
                    n = 1 if v is None else len(v)
                    col.append(np.full(n, i))
                    kind.append(np.full(n, k))
                    value.append(np.full(1, np.nan) if v is None else v)
                    weight.append(np.atleast_1d(w))

                for i, (first, third, fence, mean, std_pop, std) in brackets.items():
                    v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                    v = v[~np.isnan(v)]
                    with np.errstate(invalid="ignore"):
                        off = np.abs(v - mean)
                    for j, (lo, hi) in enumerate((first, third)):
                        put(i, BELOW + j, None, int((v < lo).sum()))
                        put(i, INSIDE + j, *np.unique(v[(v >= lo) & (v <= hi)], return_counts=True))
                    put(i, LOW_SURE, None, int((v < fence[0]).sum()))
                    put(i, HIGH_SURE, None, int((v > fence[3]).sum()))
                    put(i, FAR, None, int((off / std_pop > 3).sum()) if std_pop > 0 else 0)
                    put(i, FIVE, None, int((off / std > 5).sum()) if std > 0 else 0)
                    put(i, LOW_OPEN, *np.unique(v[(v >= fence[0]) & (v <= fence[1])], return_counts=True))
                    put(i, HIGH_OPEN, *np.unique(v[(v >= fence[2]) & (v <= fence[3])], return_counts=True))
                cells = [pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in ((col, pa.int32()), (kind, pa.int32()), (value, pa.float64()), (weight, pa.int64()))]
                yield pa.RecordBatch.from_arrays(cells, names=["col", "kind", "v", "w"])

        typed = spread(self.df).select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(self.columns, names, strict=True)])
        seen = typed.mapInArrow(run, "col int, kind int, v double, w long").groupBy("col", "kind", "v").agg(F.sum("w").alias("w"))
        seen = cut_lineage(seen)
        counts = {(r["col"], r["kind"]): r["w"] for r in seen.filter(F.col("kind") < INSIDE).collect()}  # a few per column
        return counts, seen.filter(F.col("kind") >= INSIDE)

    @cached_property
    def quartiles(self) -> dict[str, tuple[float, float]]:
        counts, kept = self._refined
        inside = kept.filter(F.col("kind") < LOW_OPEN)
        ranked = Ordered(inside, ["col", "kind"], ["v"], hot_rows=self.hot_rows).running({"upto": ("sum", F.col("w"))}).result()
        cells = [(i, j) for i in self._brackets() for j in range(2)]
        picks = []
        for i, j in cells:
            at = PROBS[j] * (self.states[self.columns[i]]["n"] - 1)
            mine = (F.col("col") == i) & (F.col("kind") == INSIDE + j)
            for side, index in (("l", math.floor(at)), ("h", math.ceil(at))):
                picks.append(F.min(F.when(mine & (F.col("upto") > index - counts.get((i, BELOW + j), 0)), F.col("v"))).alias(f"{side}{i}_{j}"))
        row = ranked.agg(*picks).first() if picks else {}
        out: dict[str, list[float]] = {}
        for i, j in cells:
            at = PROBS[j] * (self.states[self.columns[i]]["n"] - 1)
            low, high = row[f"l{i}_{j}"], row[f"h{i}_{j}"]
            if low is None or high is None or counts.get((i, BELOW + j), 0) > math.floor(at):
                # The sketch missed: this column is ranked as a whole.
                name = self.columns[i]
                clean = self.df.select(F.col(f"`{name}`").cast("double").alias("v")).filter(~F.isnan("v"))
                value = clean.agg(F.percentile("v", PROBS[j])).first()[0]
            else:
                value = low + (high - low) * (at - math.floor(at)) if high != low else low
            out.setdefault(self.columns[i], []).append(value)
        return {c: (a, b) for c, (a, b) in out.items()}

    @cached_property
    def outliers(self) -> DataFrame:
        """(column, n, iqr_outliers, zscore_outliers, beyond_five) per column."""
        counts, kept = self._refined
        sums = []
        for i in self._brackets():
            q1, q3 = self.quartiles[self.columns[i]]
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            mine = F.col("col") == i
            beyond = (F.col("kind") == LOW_OPEN) & (F.col("v") < low) | (F.col("kind") == HIGH_OPEN) & (F.col("v") > high)
            sums.append(F.coalesce(F.sum(F.when(mine & beyond, F.col("w"))), F.lit(0)).alias(str(i)))
        row = kept.agg(*sums).first() if sums else {}
        rows = []
        for i, c in enumerate(self.columns):
            n = self.states[c]["n"] if c in self.states else 0
            if not n:
                rows.append((c, 0, 0, 0, 0))
                continue
            sure = counts.get((i, LOW_SURE), 0) + counts.get((i, HIGH_SURE), 0)
            rows.append((c, n, row[str(i)] + sure, counts.get((i, FAR), 0), counts.get((i, FIVE), 0)))
        rows = rows if self.states else []
        out = self._frame(rows, "column string, n long, iqr_outliers long, zscore_outliers long, beyond_five long")
        return out.withColumn("outlier_rate_pct", F.try_divide("iqr_outliers", "n") * 100)

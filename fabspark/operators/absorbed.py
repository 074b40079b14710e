"""Analysis of variance with a factor of very many levels.

The large factor is absorbed: its levels' means are taken out of the response
and of the columns of the other factors. The normal equations of what is left
are the plain sums of products less those of the level sums, both aggregated on
Spark, so one shuffle by the factor is all, and the driver sees columns x
columns of the small factors whatever the number of levels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_upper_p


def _solve(xx: np.ndarray, xy: np.ndarray, yy: float) -> tuple[float, int]:
    """Residual sum of squares and rank."""
    if not len(xy):
        return yy, 0
    size, axes = np.linalg.eigh(xx)
    real = size > max(size.max(), 0.0) * len(xy) * 1e-13
    coef = (axes[:, real] / size[real]) @ axes[:, real].T @ xy if real.any() else np.zeros(len(xy))
    return float(yy - coef @ xy), int(real.sum())


def absorbed_anova(df: DataFrame, value: str, factors: Sequence[str], absorb: str) -> DataFrame:
    """Type II table of main effects of ``factors`` (few levels each) and of
    ``absorb`` (any number of levels).

    Rows without a value or a level are left out. Columns and meaning are those
    of ``multi_way_anova`` without interactions.
    """
    factors = list(factors)
    rows = df.filter(F.col(value).isNotNull()).na.drop(subset=[*factors, absorb]).select(*[F.col(f).cast("string").alias(f) for f in factors], F.col(absorb).alias("_big"), F.col(value).cast("double").alias("_y"))
    mean = rows.agg(F.avg("_y")).first()[0] or 0.0
    owner: list[str] = []
    columns: list[Column] = []
    for f in factors:
        levels = [r[0] for r in rows.select(f).distinct().orderBy(f).collect()]  # few by contract
        owner += [f] * (len(levels) - 1)
        columns += [(F.col(f) == F.lit(v)).cast("double") for v in levels[1:]]
    p = len(columns)
    # The intercept is a column of its own, the last one; the response follows.
    wide = rows.select("_big", *[c.alias(f"_x{i}") for i, c in enumerate(columns)], F.lit(1.0).alias(f"_x{p}"), (F.col("_y") - mean).alias(f"_x{p + 1}"))
    names = [f"_x{i}" for i in range(p + 2)]
    pairs = [(i, j) for i in range(p + 2) for j in range(i, p + 2)]
    plain = wide.agg(*[F.coalesce(F.sum(F.col(names[i]) * F.col(names[j])), F.lit(0.0)).alias(f"{i}_{j}") for i, j in pairs]).first()
    sums = wide.groupBy("_big").agg(*[F.sum(n).alias(n) for n in names])
    by_level = sums.agg(F.count(F.lit(1)).alias("levels"), *[F.coalesce(F.sum(F.col(names[i]) * F.col(names[j]) / F.col(names[p])), F.lit(0.0)).alias(f"{i}_{j}") for i, j in pairs]).first()

    def square(row) -> np.ndarray:
        out = np.zeros((p + 2, p + 2))
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"{i}_{j}"]
        return out

    total, within = square(plain), square(plain) - square(by_level)
    n, levels = int(total[p, p]), by_level["levels"]

    def inside(keep: Sequence[str]) -> tuple[float, int]:
        at = [i for i in range(p) if owner[i] in keep]
        rss, rank = _solve(within[np.ix_(at, at)], within[at, p + 1], within[p + 1, p + 1])
        return rss, rank + levels

    rss, rank = inside(factors)
    dof = n - rank
    mse = rss / dof if dof else float("nan")
    table = []
    for f in factors:
        rss0, rank0 = inside([g for g in factors if g != f])
        table.append((f, rss0 - rss, rank - rank0))
    at = [*range(p), p]
    rss0, rank0 = _solve(total[np.ix_(at, at)], total[at, p + 1], total[p + 1, p + 1])
    table.append((absorb, rss0 - rss, rank - rank0))
    all_ss = sum(ss for _, ss, _ in table) + rss
    null = total[p + 1, p + 1] - total[p, p + 1] ** 2 / n if n else 0.0
    r2 = 1 - rss / null if null else 0.0
    adj = 1 - (1 - r2) * (n - 1) / dof if dof else float("nan")
    out = [(t, float(ss), d, float(ss / d / mse) if d and mse == mse and mse else None, float(ss / all_ss) if all_ss else 0.0, float(r2), float(adj)) for t, ss, d in table]
    out.append(("Residual", float(rss), dof, None, float(rss / all_ss) if all_ss else 0.0, float(r2), float(adj)))
    frame = df.sparkSession.createDataFrame(out, "term string, sum_sq double, dof int, f_stat double, eta_squared double, r_squared double, adj_r_squared double")
    return frame.withColumn("p_value", f_upper_p(F.col("f_stat"), F.col("dof").cast("double"), F.lit(float(dof))))

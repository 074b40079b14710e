"""Hypothesis tests from grouped sufficient statistics and value counts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import below_ladder, pearson
from ..functions.distributions import (
    chi2_upper_p,
    erfc,
    f_upper_p,
    ks_p,
    normal_cdf,
    normal_quantile,
    t_p_value,
    t_quantile,
    t_two_sided_p,
)
from .ordered import HOT_ROWS, POS, Ordered
from .pairs import unordered_pairs
from .ranks import attach_stats, distribution, quantiles

# Bounds of the effect size classes (eta squared).
EFFECT_SIZES = [(0.01, "Negligible"), (0.06, "Small"), (0.14, "Medium")]


def one_sample_t(df: DataFrame, keys: Sequence[str], value: str, null: float, alternative: str = "two-sided", confidence: float = 0.95) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    se = F.try_divide(F.col("std"), F.sqrt("n"))
    dof = (F.col("n") - 1).cast("double")
    out = out.withColumns({"t_stat": F.try_divide(F.col("mean") - null, se), "effect_size": F.try_divide(F.col("mean") - null, F.col("std"))})
    t = t_quantile(F.lit(1 - (1 - confidence) / 2), dof)
    return out.withColumns(
        {"p_value": t_p_value(F.col("t_stat"), dof, alternative), "ci_lower": F.col("mean") - t * se, "ci_upper": F.col("mean") + t * se}
    )


def two_sample_t(df: DataFrame, keys: Sequence[str], value: str, first: Column, equal_var: bool = True, alternative: str = "two-sided") -> DataFrame:
    """Rows where ``first`` is true against rows where it is false."""
    v = F.col(value)
    a, b = F.when(first, v), F.when(~first, v)
    out = df.groupBy(*keys).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
        F.var_samp(a).alias("var1"), F.var_samp(b).alias("var2"),
    )
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "var1", "var2"))
    if equal_var:
        pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
        se, dof, scale = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))), n1 + n2 - 2, F.sqrt(pooled)
    else:
        q1, q2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
        se = F.sqrt(q1 + q2)
        dof = F.try_divide((q1 + q2) * (q1 + q2), F.try_divide(q1 * q1, n1 - 1) + F.try_divide(q2 * q2, n2 - 1))
        scale = F.sqrt((v1 + v2) / 2)
    diff = F.col("mean1") - F.col("mean2")
    out = out.withColumns({"t_stat": F.try_divide(diff, se), "dof": dof, "effect_size": F.try_divide(diff, scale)})
    return out.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("dof"), alternative))


def _group_stats(df: DataFrame, keys: Sequence[str], factor: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, factor).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var")
    )


def anova(df: DataFrame, factor: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    groups = _group_stats(df, keys, factor, value)
    grand = groups.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_gm"))
    groups = attach_stats(groups, grand, keys)
    dev = F.col("mean") - F.col("_gm")
    out = groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("total_n"),
        F.sum(F.col("n") * dev * dev).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"),
    )
    d1, d2 = F.col("n_groups") - 1, F.col("total_n") - F.col("n_groups")
    out = out.withColumns(
        {
            "df_between": d1,
            "df_within": d2,
            "f_stat": F.try_divide(F.try_divide(F.col("ss_between"), d1), F.try_divide(F.col("ss_within"), d2)),
            "eta_squared": F.coalesce(F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")), F.lit(0.0)),
        }
    )
    return out.withColumns(
        {
            "p_value": f_upper_p(F.col("f_stat"), d1.cast("double"), d2.cast("double")),
            "effect_size": below_ladder("eta_squared", EFFECT_SIZES, "Large"),
        }
    )


class CellModel:
    """Least squares on categorical factors from its normal equations.

    Cells, cross products of the treatment-coded columns and their products
    with the response are aggregated on Spark; the driver holds columns x
    columns, the size of the model itself, never the cells.
    """

    def __init__(self, df: DataFrame, factors: Sequence[str], value: str, interactions: bool = True, full: bool = False):
        self.factors = list(factors)
        rows = df.filter(F.col(value).isNotNull()).na.drop(subset=self.factors)
        self.levels: dict[str, list[str]] = {}
        labels = {}
        for f in self.factors:
            found = rows.select(F.col(f).alias("v"), F.col(f).cast("string").alias("s")).distinct().orderBy("v").collect()
            self.levels[f] = [r["s"] for r in found]
            # NULL for the first level, which has no column.
            labels[f] = F.when(F.col(f).cast("string") != F.lit(self.levels[f][0] if found else ""), F.concat(F.lit(f"{f}["), F.col(f).cast("string"), F.lit("]")))
        mean = rows.agg(F.avg(F.col(value).cast("double"))).first()[0] or 0.0
        y = F.col(value).cast("double") - F.lit(mean)  # centred, so that sums of squares do not cancel
        cells = rows.groupBy(*self.factors).agg(
            F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum"), F.coalesce(F.var_samp(F.col(value).cast("double")), F.lit(0.0)).alias("var")
        )
        terms = [F.concat(*[x for k, f in enumerate(t) for x in ([F.lit(":")] if k else []) + [labels[f]]]) for t in self.terms(interactions, full)]
        cells = cells.withColumn("active", F.array_compact(F.array(F.lit("Intercept"), *terms)))
        one = cells.select(F.explode("active").alias("i"), "active", "n", "sum")
        moments = one.groupBy("i").agg(F.sum("sum").alias("xy")).collect()
        products = one.select("i", F.explode("active").alias("j"), "n").groupBy("i", "j").agg(F.sum("n").alias("xx")).collect()
        self.xy = {r["i"]: r["xy"] for r in moments}
        self.xx = {(r["i"], r["j"]): float(r["xx"]) for r in products}
        self.total, self.yy, self.within = cells.agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("sum") * F.col("sum") / F.col("n")), F.lit(0.0)), F.coalesce(F.sum((F.col("n") - 1) * F.col("var")), F.lit(0.0))
        ).first()

    def names(self, terms: Sequence[Sequence[str]]) -> list[str]:
        """Treatment-coded columns of main effects and interactions."""
        out = ["Intercept"]
        for t in terms:
            names = [""]
            for f in t:
                names = [f"{n}:{f}[{lv}]".lstrip(":") for n in names for lv in self.levels[f][1:]]
            out += names
        return out

    def fit(self, terms: Sequence[Sequence[str]]) -> tuple[np.ndarray, float, int, list[str], np.ndarray]:
        """Coefficients, residual sum of squares, rank, names, (X'X)^+; the
        intercept is relative to the mean."""
        names = self.names(terms)
        xx = np.array([[self.xx.get((a, b), 0.0) for b in names] for a in names])
        xy = np.array([self.xy.get(a, 0.0) for a in names])
        size, axes = np.linalg.eigh(xx)
        real = size > size.max() * len(names) * 1e-14
        inv = (axes[:, real] / size[real]) @ axes[:, real].T
        coef = inv @ xy
        return coef, float(self.yy - coef @ xy) + self.within, int(real.sum()), names, inv

    def terms(self, interactions: bool, full: bool = False) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = [(f,) for f in self.factors]
        top = 1
        if interactions:
            top = len(self.factors) if full and len(self.factors) <= 3 else 2
        for k in range(2, top + 1):
            out += list(combinations(self.factors, k))
        return out


def multi_way_anova(df: DataFrame, value: str, factors: Sequence[str], interactions: bool = True) -> DataFrame:
    """Type II table: a term against the model of all terms not containing it.
    Spark aggregates the normal equations, their solution is small."""
    m = CellModel(df, factors, value, interactions)
    terms = m.terms(interactions)
    _, rss, rank, _, _ = m.fit(terms)
    dof = m.total - rank
    mse = rss / dof
    rows = []
    for t in terms:
        without = [u for u in terms if not set(t) <= set(u)]
        _, rss0, rank0, _, _ = m.fit(without)
        _, rss1, rank1, _, _ = m.fit([*without, t])
        d = rank1 - rank0
        ss = rss0 - rss1
        rows.append((":".join(t), float(ss), d, float(ss / d / mse) if d else None))
    ss_total = sum(x[1] for x in rows) + rss
    _, rss_null, _, _, _ = m.fit([])
    r2 = 1 - rss / rss_null
    adj = 1 - (1 - r2) * (m.total - 1) / dof
    out = df.sparkSession.createDataFrame(
        [(t, ss, d, f, ss / ss_total, r2, adj) for t, ss, d, f in rows] + [("Residual", rss, dof, None, rss / ss_total, r2, adj)],
        "term string, sum_sq double, dof int, f_stat double, eta_squared double, r_squared double, adj_r_squared double",
    )
    return out.withColumn("p_value", f_upper_p(F.col("f_stat"), F.col("dof").cast("double"), F.lit(float(dof))))


def factorial_effects(df: DataFrame, value: str, factors: Sequence[str]) -> DataFrame:
    """Treatment-coded effects of the full factorial model, largest first."""
    m = CellModel(df, factors, value, full=True)
    coef, rss, rank, names, inv = m.fit(m.terms(True, full=True))
    dof = m.total - rank
    se = np.sqrt(np.diag(inv) * rss / dof)
    rows = [(n, float(c), float(s)) for n, c, s in zip(names[1:], coef[1:], se[1:])]
    out = df.sparkSession.createDataFrame(rows, "effect string, coefficient double, std_error double")
    out = out.withColumns(
        {
            "magnitude": F.abs("coefficient"),
            "p_value": t_two_sided_p(F.try_divide(F.col("coefficient"), F.col("std_error")), F.lit(float(dof))),
        }
    )
    return out.orderBy(F.desc("magnitude"), "effect")


def levene(df: DataFrame, factor: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median-centred Levene test."""
    rows = df.select(factor, value).filter(F.col(value).isNotNull())
    med = quantiles(rows, [factor], value, [0.5], hot_rows).select(factor, F.col("q50").alias("_med"))
    dev = attach_stats(rows, med, [factor]).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    return anova(dev, factor, "_dev").select(F.col("f_stat").alias("w_stat"), "df_between", "df_within", "p_value")


def durbin_watson(df: DataFrame, keys: Sequence[str], order: Sequence[str], residual: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("_step", F.col(residual) - F.lag(residual).over(w))

    rows = Ordered(df, keys, order, hot_rows=hot_rows).windowed(1, 0, build).result()
    e, s = F.col(residual), F.col("_step")
    out = rows.groupBy(*keys).agg(F.count(e).alias("n"), F.try_divide(F.sum(s * s), F.sum(e * e)).alias("dw"))
    return out.withColumn(
        "interpretation",
        F.when((F.col("dw") > 1.5) & (F.col("dw") < 2.5), "No autocorrelation").otherwise("Possible autocorrelation"),
    )


def studentised_range_tail(q: float, k: int, dof: float) -> float:
    """P(Q > q) for the range of k standard normals over an independent
    deviation estimate, by quadrature."""
    z, zw = np.polynomial.legendre.leggauss(96)
    z, zw = z * 8.0, zw * 8.0
    cdf = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def at(width: float) -> float:
        return float(k * np.sum(zw * phi * np.power(np.clip(cdf(z) - cdf(z - width), 0, 1), k - 1)))

    # The deviation is 1 + e with e of order 1 / sqrt(2 dof); its log density is
    # written in e, so that nothing cancels for large dof.
    half = dof / 2
    if half < 50:
        stirling = math.lgamma(half) - (half - 0.5) * math.log(half) + half - 0.5 * math.log(2 * math.pi)
    else:
        stirling = 1 / (12 * half) - 1 / (360 * half**3)
    spread = 8.0 / math.sqrt(2 * dof)
    lo, hi = max(1e-6 - 1, -spread), spread + (4.0 if dof < 10 else 0.0)
    e, sw = np.polynomial.legendre.leggauss(64)
    e, sw = (hi - lo) / 2 * e + (hi + lo) / 2, sw * (hi - lo) / 2
    s = 1 + e
    log_f = math.log(2) + 0.5 * math.log(half) - 0.5 * math.log(2 * math.pi) - stirling + half * (2 * (np.log1p(e) - e) - e * e) - np.log1p(e)
    inner = np.array([at(q * x) for x in s])
    return float(min(1.0, max(0.0, 1.0 - np.sum(sw * np.exp(log_f) * inner))))


@F.pandas_udf(T.DoubleType())
def tukey_p(q: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([studentised_range_tail(float(a), int(b), float(c)) for a, b, c in zip(q, k, dof)], dtype="float64")


def pairwise_groups(df: DataFrame, factor: str, value: str, block: int = 1000) -> DataFrame:
    """All pairs of factor levels: difference, pooled t with Bonferroni p,
    Tukey q with its p. The pairs are of levels, not of rows; levels meet in
    blocks of about ``block``."""
    groups = _group_stats(df, [], factor, value)
    pool = groups.agg(
        F.count(F.lit(1)).alias("_k"), (F.sum("n") - F.count(F.lit(1))).alias("_dof"), F.sum((F.col("n") - 1) * F.col("var")).alias("_ssw")
    )
    both = unordered_pairs(groups.select(F.col(factor).alias("g"), "n", "mean", "var"), "g", block)
    pairs = both.select(
        F.col("a.g").alias("group1"), F.col("a.n").alias("n1"), F.col("a.mean").alias("m1"), F.col("a.var").alias("v1"),
        F.col("b.g").alias("group2"), F.col("b.n").alias("n2"), F.col("b.mean").alias("m2"), F.col("b.var").alias("v2"),
    )
    pairs = attach_stats(pairs, pool, [])
    diff = F.col("m2") - F.col("m1")
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), (F.col("n1") + F.col("n2") - 2).cast("double"))
    inv_n = 1 / F.col("n1") + 1 / F.col("n2")
    out = pairs.select(
        "group1",
        "group2",
        diff.alias("mean_diff"),
        F.try_divide(-diff, F.sqrt(pooled * inv_n)).alias("t_stat"),
        (F.col("n1") + F.col("n2") - 2).cast("double").alias("t_dof"),
        F.try_divide(F.abs(diff), F.sqrt(F.try_divide(F.col("_ssw"), F.col("_dof").cast("double")) / 2 * inv_n)).alias("q_stat"),
        F.col("_k"),
        F.col("_dof"),
    )
    n_pairs = F.col("_k") * (F.col("_k") - 1) / 2
    return out.withColumns(
        {
            "bonferroni_p": F.least(F.lit(1.0), t_two_sided_p(F.col("t_stat"), F.col("t_dof")) * n_pairs),
            "tukey_p": tukey_p(F.col("q_stat"), F.col("_k"), F.col("_dof")),
        }
    ).drop("_k", "_dof")


def _rank_sums(df: DataFrame, factor: str, value: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rank sum and size per group; one-row tie term and total."""
    rows = df.select(factor, value).filter(F.col(value).isNotNull() & F.col(factor).isNotNull())
    dist = distribution(rows, [], value, hot_rows=hot_rows)
    counts = rows.groupBy(factor, value).agg(F.count(F.lit(1)).alias("w"))
    ranks = dist.select(value, "avg_rank")
    sums = counts.join(ranks, value).groupBy(factor).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("avg_rank")).alias("rank_sum"))
    n = F.col("n").cast("double")
    ties = dist.agg(F.sum(n * n * n - n).alias("ties"), F.max("total").alias("total"))
    return sums, ties


def kruskal(df: DataFrame, factor: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    sums, ties = _rank_sums(df, factor, value, hot_rows)
    out = attach_stats(
        sums.agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_s")), ties, []
    )
    n = F.col("total").cast("double")
    h = F.try_divide(F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("_s") - 3 * (n + 1), 1 - F.try_divide(F.col("ties"), n * n * n - n))
    out = out.select("n_groups", F.col("total").alias("total_n"), h.alias("h_stat"))
    return out.withColumn("p_value", chi2_upper_p(F.col("h_stat"), (F.col("n_groups") - 1).cast("double")))


def mann_whitney(df: DataFrame, factor: str, first: object, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """U of the rows with ``factor == first`` against the others, two-sided
    normal approximation with tie and continuity correction."""
    rows = df.withColumn("_g", (F.col(factor) == F.lit(first)).cast("int"))
    sums, ties = _rank_sums(rows, "_g", value, hot_rows)
    one = sums.agg(
        F.sum(F.when(F.col("_g") == 1, F.col("n"))).alias("n1"),
        F.sum(F.when(F.col("_g") == 0, F.col("n"))).alias("n2"),
        F.sum(F.when(F.col("_g") == 1, F.col("rank_sum"))).alias("_r1"),
    )
    out = attach_stats(one, ties, [])
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = out.withColumn("u_stat", F.col("_r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    u = F.greatest(F.col("u_stat"), n1 * n2 - F.col("u_stat"))
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, sd)
    return out.select("n1", "n2", "u_stat", z.alias("z_stat"), F.least(F.lit(1.0), erfc(z / math.sqrt(2.0))).alias("p_value"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence test. sum(O^2/E) - N needs no empty cells; one degree of
    freedom uses the continuity correction."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("_ra"))
    rb = cells.groupBy(b).agg(F.sum("o").alias("_rb"))
    total = ra.agg(F.sum("_ra").alias("_n"), F.count(F.lit(1)).alias("_ka"), F.sum(1 / F.col("_ra")).alias("_ia"))
    other = rb.agg(F.count(F.lit(1)).alias("_kb"), F.sum(1 / F.col("_rb")).alias("_ib"))
    rows = attach_stats(attach_stats(cells, ra, [a]), rb, [b])
    rows = attach_stats(attach_stats(rows, total, []), other, [])
    e = F.col("_ra") * F.col("_rb") / F.col("_n")
    out = rows.agg(
        F.max("_n").alias("n"),
        ((F.max("_ka") - 1) * (F.max("_kb") - 1)).alias("dof"),
        (F.sum(F.col("o") * F.col("o") / e) - F.max("_n")).alias("_plain"),
        F.max(F.abs(F.col("o") - e)).alias("_gap"),
        (F.max("_n") * F.max("_ia") * F.max("_ib")).alias("_inv"),
    )
    gap = F.greatest(F.lit(0.0), F.col("_gap") - 0.5)
    out = out.select("n", "dof", F.when(F.col("dof") == 1, gap * gap * F.col("_inv")).otherwise(F.col("_plain")).alias("chi2"))
    return out.withColumn("p_value", chi2_upper_p(F.col("chi2"), F.col("dof").cast("double")))


def goodness_of_fit(df: DataFrame, column: str, shares: dict[object, float]) -> DataFrame:
    """Observed counts of listed values against expected shares."""
    names = list(shares)
    row = df.agg(*[F.count_if(F.col(column) == F.lit(v)).alias(f"_c{i}") for i, v in enumerate(names)])
    n = sum((F.col(f"_c{i}") for i in range(len(names))), F.lit(0)).cast("double")
    chi2 = F.lit(0.0)
    for i, v in enumerate(names):
        e = n * F.lit(float(shares[v]))
        chi2 = chi2 + (F.col(f"_c{i}") - e) * (F.col(f"_c{i}") - e) / e
    out = row.select(n.cast("long").alias("n"), F.lit(len(names) - 1).alias("dof"), chi2.alias("chi2"))
    return out.withColumn("p_value", chi2_upper_p(F.col("chi2"), F.col("dof").cast("double")))


def _with_fit(df: DataFrame, value: str, hot_rows: int) -> DataFrame:
    rows = df.select(value).filter(F.col(value).isNotNull())
    stats = rows.agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return attach_stats(distribution(rows, [], value, hot_rows=hot_rows), stats, [])


def ks_normal(df: DataFrame, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Kolmogorov-Smirnov distance to the fitted normal distribution."""
    d = _with_fit(df, value, hot_rows).withColumn("_f", normal_cdf(value, F.col("_mu"), F.col("_sd")))
    gap = F.greatest(F.col("upto") / F.col("total") - F.col("_f"), F.col("_f") - F.col("below") / F.col("total"))
    out = d.agg(F.max("total").alias("n"), F.max(gap).alias("ks_stat"))
    return out.withColumn("p_value", ks_p(F.col("ks_stat"), F.col("n").cast("double")))


def anderson_darling(df: DataFrame, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A-squared for normality. A block of equal values covers the ranks
    (below, upto]; its rank weights sum to differences of squares."""
    d = _with_fit(df, value, hot_rows)
    z = (F.col(value) - F.col("_mu")) / F.col("_sd")
    low, high = normal_cdf(z), normal_cdf(-z)
    n = F.col("total").cast("double")
    up, below = F.col("upto").cast("double"), F.col("below").cast("double")
    rest_b, rest_u = n - below, n - up
    term = F.ln(low) * (up * up - below * below) + F.ln(high) * (rest_b * rest_b - rest_u * rest_u)
    return d.agg(F.max("total").alias("n"), (-F.max(n) - F.sum(term) / F.max(n)).alias("a2"))


def dagostino(df: DataFrame, value: str) -> DataFrame:
    """K-squared from sample skewness and kurtosis."""
    s = df.agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("b2"))
    n = F.col("n").cast("double")
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    ya = y / alpha
    z1 = delta * F.ln(ya + F.sqrt(ya * ya + 1))
    mean_b2 = 3 * (n - 1) / (n + 1)
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("b2") - mean_b2) / F.sqrt(var_b2)
    sb1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb1 * (2 / sb1 + F.sqrt(1 + 4 / (sb1 * sb1)))
    base = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(base) * F.pow(F.abs((1 - 2 / a) / base), 1 / 3)
    z2 = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    out = s.select("n", z1.alias("z_skew"), z2.alias("z_kurtosis"), (z1 * z1 + z2 * z2).alias("k2"))
    return out.withColumn("p_value", F.exp(-F.col("k2") / 2))


def fit_distributions(df: DataFrame, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Normal, lognormal (origin fixed at 0) and exponential fits with KS,
    AIC and BIC, ranked by AIC. Parameters counted with the location."""
    v = F.col(value)
    rows = df.select(value).filter(v.isNotNull())
    dist = distribution(rows, [], value, hot_rows=hot_rows)
    s = rows.agg(
        F.count(v).cast("double").alias("_n"),
        F.avg(v).alias("_m"),
        F.var_pop(v).alias("_v"),
        F.min(v).alias("_lo"),
        F.avg(F.when(v > 0, F.ln(v))).alias("_lm"),
        F.var_pop(F.when(v > 0, F.ln(v))).alias("_lv"),
    )
    d = attach_stats(dist, s, [])
    cdf = {
        "normal": normal_cdf(v, F.col("_m"), F.sqrt("_v")),
        "lognormal": F.when(v > 0, normal_cdf(F.ln(F.when(v > 0, v)), F.col("_lm"), F.sqrt("_lv"))).otherwise(0.0),
        "exponential": 1 - F.exp(-(v - F.col("_lo")) / (F.col("_m") - F.col("_lo"))),
    }

    def gap(c: Column) -> Column:
        return F.max(F.greatest(F.col("upto") / F.col("total") - c, c - F.col("below") / F.col("total")))

    one = attach_stats(d.agg(*[gap(c).alias(f"_ks_{n}") for n, c in cdf.items()]), s, [])
    n = F.col("_n")
    two_pi = math.log(2 * math.pi)
    loglik = {
        "normal": -n / 2 * (two_pi + F.ln("_v") + 1),
        "lognormal": F.when(F.col("_lo") > 0, -n / 2 * (two_pi + F.ln("_lv") + 1) - n * F.col("_lm")),
        "exponential": -n * (F.ln(F.col("_m") - F.col("_lo")) + 1),
    }
    k = {"normal": 2, "lognormal": 3, "exponential": 2}
    items = [
        F.struct(
            F.lit(name).alias("distribution"),
            F.col(f"_ks_{name}").alias("ks_stat"),
            ll.alias("log_likelihood"),
            (2 * k[name] - 2 * ll).alias("aic"),
            (k[name] * F.ln(n) - 2 * ll).alias("bic"),
        )
        for name, ll in loglik.items()
    ]
    out = one.select(F.inline(F.array(*items))).filter(F.col("log_likelihood").isNotNull())
    return out.orderBy("aic")


def qq_linearity(df: DataFrame, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Correlation of the ordered values with normal quantiles of Filliben's
    order statistic medians."""
    rows = df.select(value).filter(F.col(value).isNotNull())
    seq = Ordered(rows, [], [value], hot_rows=hot_rows).positioned().result()
    d = attach_stats(seq, rows.agg(F.count(F.lit(1)).cast("double").alias("_n")), [])
    n, i = F.col("_n"), F.col(POS) + 1
    last = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    return d.withColumn("_q", normal_quantile(p)).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(value).cast("double"), F.col("_q")).alias("r"))

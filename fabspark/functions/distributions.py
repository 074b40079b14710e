"""Distribution functions.

The normal distribution is a plain column expression, so it stays in generated
code and may run on every row. The t, F and chi-square tails need iterations;
they are Arrow-batched and meant for already aggregated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_col

# Rational approximations of erf and erfc (W. J. Cody, 1969).
_ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
_ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
_MID_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
_MID_DEN = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3]
_FAR_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
_FAR_DEN = [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _horner(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def erfc(x: Column | str) -> Column:
    x = as_col(x)
    y = F.abs(x)
    sq = x * x
    near = F.lit(1.0) - x * _horner(_ERF_NUM, sq) / _horner(_ERF_DEN, sq)
    mid = F.exp(-sq) * _horner(_MID_NUM, y) / _horner(_MID_DEN, y)
    inv = F.lit(1.0) / sq
    tail = inv * _horner(_FAR_NUM, inv) / _horner(_FAR_DEN, inv)
    far = F.exp(-sq) / y * (F.lit(1.0 / math.sqrt(math.pi)) - tail)
    upper = F.when(y <= 4.0, mid).otherwise(far)
    return F.when(y <= 0.46875, near).when(x > 0, upper).otherwise(F.lit(2.0) - upper)


def normal_cdf(x: Column | str, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    z = (as_col(x) - mean) / sd
    return F.lit(0.5) * erfc(-z / F.lit(math.sqrt(2.0)))


# Rational approximation of the normal quantile (P. J. Acklam),
# relative error below 1.2e-9.
_Q_CENTRE_NUM = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0]
_Q_CENTRE_DEN = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0]
_Q_TAIL_NUM = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0]
_Q_TAIL_DEN = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0]


def normal_quantile(p: Column | str) -> Column:
    p = as_col(p)
    r = p - 0.5
    s = r * r
    centre = r * _horner(_Q_CENTRE_NUM, s) / _horner(_Q_CENTRE_DEN, s)
    ql = F.sqrt(F.lit(-2.0) * F.ln(p))
    qh = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    low = _horner(_Q_TAIL_NUM, ql) / _horner(_Q_TAIL_DEN, ql)
    high = -_horner(_Q_TAIL_NUM, qh) / _horner(_Q_TAIL_DEN, qh)
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(centre)


def _lentz(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 20_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _lentz(a, b, x) / a
    return 1.0 - math.exp(log_front) * _lentz(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_upper(t: float, df: float) -> float:
    if df <= 0:
        return math.nan
    tail = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_inverse(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the upper tail."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if 1.0 - t_upper(mid, df) < p else (low, mid)
    return (low + high) / 2.0


def ks_tail(d: float, n: float) -> float:
    """Asymptotic Kolmogorov tail for statistic d with effective size n."""
    z = d * math.sqrt(n)
    if z < 0.2:
        return 1.0
    if z < 1.18:
        v = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * z * z)) for k in range(1, 20))
        return 1.0 - math.sqrt(2 * math.pi) / z * v
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * z * z) for k in range(1, 101))))


def _batched(fn, *cols: pd.Series) -> pd.Series:
    rows = zip(*[c.astype("float64").to_numpy() for c in cols])
    return pd.Series([fn(*r) if not any(np.isnan(r)) else np.nan for r in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _batched(lambda a, b: min(1.0, 2.0 * t_upper(abs(a), b)), t, df)


@F.pandas_udf(T.DoubleType())
def t_upper_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _batched(t_upper, t, df)


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return _batched(t_inverse, p, df)


@F.pandas_udf(T.DoubleType())
def f_upper_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _batched(lambda x, a, b: beta_inc(b / 2.0, a / 2.0, b / (b + a * x)) if x > 0 else 1.0, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_upper_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _batched(lambda v, k: gamma_upper(k / 2.0, v / 2.0), x, df)


@F.pandas_udf(T.DoubleType())
def ks_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return _batched(ks_tail, d, n)


def t_p_value(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    t, df = t.cast("double"), df.cast("double")
    if alternative == "two-sided":
        return t_two_sided_p(t, df)
    if alternative == "greater":
        return t_upper_p(t, df)
    if alternative == "less":
        return t_upper_p(-t, df)
    raise ValueError(f"unknown alternative {alternative!r}")

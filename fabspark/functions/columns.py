"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def half_even(c: Column | str, digits: int) -> Column:
    """Half-even rounding of the double itself; ``bround`` rounds its shortest
    decimal text, so 66.025 (a little more in binary) would be a tie there."""
    scale = F.lit(10.0**digits)
    return F.rint(as_col(c) * scale) / scale


def exact_sum(c: Column | str) -> Column:
    """Sum of doubles as decimals of 12 places, the same in any order of the
    rows; plain where a value is no such decimal (NaN, infinite, huge)."""
    c = as_col(c).cast("double")
    d = c.try_cast("decimal(28,12)")
    return F.when(F.count(d) == F.count(c), F.sum(d).cast("double")).otherwise(F.sum(c))


def finite(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def safe_ratio(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    return as_col(a) / (as_col(b) + F.lit(eps))


def ratio_or(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or ``default`` where b is zero or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of complete pairs; NULL where a side is constant."""
    a, b = as_col(a), as_col(b)
    sd = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), sd)


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(as_col(c), F.lit(low)), F.lit(high))


def ladder(c: Column | str, steps: Sequence[tuple[float, object]], otherwise: object, strict: bool = False) -> Column:
    """First step (highest bound first) whose bound the value reaches."""
    c = as_col(c)
    out = None
    for bound, value in steps:
        cond = (c > bound) if strict else (c >= bound)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def below_ladder(c: Column | str, steps: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First step (lowest bound first) that the value stays under."""
    c = as_col(c)
    out = None
    for bound, value in steps:
        out = F.when(c < bound, value) if out is None else out.when(c < bound, value)
    return out.otherwise(otherwise)


def minutes_seconds(seconds: Column | str) -> Column:
    """125 -> '2m 5s'."""
    s = as_col(seconds).cast("long")
    return F.format_string("%dm %ds", F.floor(s / 60), s % 60)


def calendar_features(ts: Column | str, prefix: str = "") -> dict[str, Column]:
    """Hour, day of week with Monday = 0, weekend flag."""
    ts = as_col(ts)
    dow = F.weekday(ts)
    return {
        f"{prefix}hour": F.hour(ts),
        f"{prefix}day_of_week": dow,
        f"{prefix}is_weekend": dow.isin(5, 6).cast("int"),
    }


def recode(c: Column | str, mapping: dict) -> Column:
    c = as_col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two [x1, y1, x2, y2] arrays."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = (w * h).cast("double")
    area_a = (a[2] - a[0]) * (a[3] - a[1])
    area_b = (b[2] - b[0]) * (b[3] - b[1])
    return ratio_or(inter, area_a + area_b - inter)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a time column; a zone-free timestamp keeps its wall clock."""
    c = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    seconds = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    whole = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
    return whole * 60_000_000 + seconds


def hash_bucket(cols: Sequence[str], buckets: int, seed: int = 0) -> Column:
    """Deterministic bucket of a row key, for splits and sampling."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(buckets))


def parse_record(c: Column | str, schema: str) -> Column:
    """One JSON record into typed features."""
    return F.from_json(as_col(c), schema)

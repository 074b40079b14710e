"""Statistical process control: subgroup charts, run rules, EWMA, CUSUM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, POS, Ordered, decayed_sum
from .ranks import attach_stats

# Control chart constants by subgroup size, as (A2, D3, D4, d2).
CHART_CONSTANTS = {
    2: (1.880, 0.0, 3.267, 1.128),
    3: (1.023, 0.0, 2.574, 1.693),
    4: (0.729, 0.0, 2.282, 2.059),
    5: (0.577, 0.0, 2.114, 2.326),
    6: (0.483, 0.0, 2.004, 2.534),
    7: (0.419, 0.076, 1.924, 2.704),
    8: (0.373, 0.136, 1.864, 2.847),
    9: (0.337, 0.184, 1.816, 2.970),
    10: (0.308, 0.223, 1.777, 3.078),
}

# Rule texts of the signal list.
RULE_TEXT = {
    1: "Rule 1: Point beyond control limits",
    2: "Rule 2: 9 consecutive points on one side",
    3: "Rule 3: 6 consecutive trending points",
    4: "Rule 4: 14 consecutive alternating points",
    5: "Rule 5: 2 of 3 points in Zone A",
    6: "Rule 6: 4 of 5 points in Zone B or beyond",
}
LONGEST_RULE = 14


def above(a: Column, b: Column) -> Column:
    """a > b beyond the rounding of means whose sums were taken in any order: a
    point on its centre line or on a limit is on neither side."""
    return a - b > F.lit(1e-11) * F.greatest(F.abs(a), F.abs(b))


def consecutive_subgroups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Numbers rows per key and cuts them into subgroups of ``size`` rows."""
    seq = Ordered(df, keys, order, hot_rows=hot_rows).positioned()
    return seq.result().withColumn("subgroup", F.floor(F.col(POS) / size)).drop(POS)


def subgroup_stats(df: DataFrame, keys: Sequence[str], value: str, size: int | None = None) -> DataFrame:
    """Mean and range per subgroup; incomplete subgroups go when size is given."""
    out = df.groupBy(*keys, "subgroup").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("xbar"),
        (F.max(value) - F.min(value)).alias("range"),
    )
    return out if size is None else out.filter(F.col("n") == size)


def control_limits(subgroups: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """X-bar and R limits per key from subgroup means and ranges."""
    if size not in CHART_CONSTANTS:
        raise ValueError(f"no control chart constants for subgroup size {size}")
    a2, d3, d4, _ = CHART_CONSTANTS[size]
    base = subgroups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_subgroups"),
        F.avg("xbar").alias("xbar_center"),
        F.avg("range").alias("r_center"),
    )
    x, r = F.col("xbar_center"), F.col("r_center")
    return base.withColumns(
        {
            "xbar_ucl": x + F.lit(a2) * r,
            "xbar_lcl": x - F.lit(a2) * r,
            "r_ucl": F.lit(d4) * r,
            "r_lcl": F.lit(d3) * r,
        }
    )


def run_rules(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    charts: dict[str, tuple[str, str, str, str]],
    hot_rows: int = HOT_ROWS,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Adds the boolean columns <chart>_rule_1 .. <chart>_rule_6 for each chart
    (value, centre, upper, lower column); all charts share one window pass.
    ``bound``: see :class:`Ordered`."""
    seq = Ordered(df, keys, order, hot_rows=hot_rows, bound=bound)
    pos = F.col(POS)

    def rules(d: DataFrame, w, chart: str, value: str, center: str, ucl: str, lcl: str) -> DataFrame:
        v, c, u, low = F.col(value), F.col(center), F.col(ucl), F.col(lcl)

        def back(n: int):
            return w.rowsBetween(-n, 0)

        def all_of(flag: Column, n: int) -> Column:
            return F.min(flag.cast("int")).over(back(n - 1)) == 1

        d = d.withColumns(
            {
                "_was": F.lag(v).over(w),
                "_a": above(v, c + 2 * (u - c) / 3) | above(c - 2 * (c - low) / 3, v),
                "_b": above(v, c + (u - c) / 3) | above(c - (c - low) / 3, v),
            }
        ).withColumn("_d", F.when(above(v, F.col("_was")), 1).when(above(F.col("_was"), v), -1).when(v.isNotNull() & F.col("_was").isNotNull(), 0))
        d = d.withColumn("_swing", F.col("_d") * F.lag("_d").over(w))
        one_side = all_of(above(v, c), 9) | all_of(above(c, v), 9)
        trend = all_of(F.col("_d") > 0, 5) | all_of(F.col("_d") < 0, 5)
        swings = F.max("_swing").over(back(11)) < 0
        zone_a = F.sum(F.col("_a").cast("int")).over(back(2)) >= 2
        zone_b = F.sum(F.col("_b").cast("int")).over(back(4)) >= 4
        found = [above(v, u) | above(low, v), (pos >= 8) & one_side, (pos >= 5) & trend, (pos >= 13) & swings, (pos >= 2) & zone_a, (pos >= 4) & zone_b]
        return d.withColumns({f"{chart}_rule_{i}": f for i, f in enumerate(found, start=1)}).drop("_was", "_d", "_a", "_b", "_swing")

    def build(d: DataFrame, w) -> DataFrame:
        for chart, cols in charts.items():
            d = rules(d, w, chart, *cols)
        return d

    return seq.windowed(LONGEST_RULE, 0, build).result().drop(POS)


def signal_list(df: DataFrame, charts: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """One row (chart, value, rule, signal) per fired rule."""
    items = [
        F.when(F.col(f"{chart}_rule_{i}"), F.struct(F.lit(chart).alias("chart"), F.col(cols[0]).cast("double").alias("value"), F.lit(i).alias("rule"), F.lit(text).alias("signal")))
        for chart, cols in charts.items()
        for i, text in RULE_TEXT.items()
    ]
    drop = [f"{chart}_rule_{i}" for chart in charts for i in RULE_TEXT]
    rows = df.withColumn("_s", F.explode(F.array_compact(F.array(*items)))).drop(*drop)
    return rows.select(*[c for c in rows.columns if c != "_s"], "_s.*")


XBAR_R = {
    "xbar": ("xbar", "xbar_center", "xbar_ucl", "xbar_lcl"),
    "r": ("range", "r_center", "r_ucl", "r_lcl"),
}


def phase_signals(
    subgroups: DataFrame, keys: Sequence[str], size: int, phase1: Column, hot_rows: int = HOT_ROWS, bound: DataFrame | None = None
) -> DataFrame:
    """Limits from phase I subgroups applied to phase II: fired rules of the
    X-bar and the R chart. ``bound`` may be the measurements, which are at
    least as many per key as their subgroups."""
    # Both phases read the subgroups; they are far fewer than the rows.
    subgroups = subgroups.persist()
    limits = control_limits(subgroups.filter(phase1), keys, size)
    rows = attach_stats(subgroups.filter(~phase1), limits, keys)
    found = signal_list(run_rules(rows, keys, ["subgroup"], XBAR_R, hot_rows, bound), XBAR_R)
    return found.select(*keys, "subgroup", "chart", "value", "rule", "signal")


def stability(subgroups: DataFrame, signals: DataFrame, keys: Sequence[str], phase1: Column) -> DataFrame:
    """Signal counts and in-control flags per key of phase II."""
    seen = subgroups.filter(~phase1).groupBy(*keys).agg(F.count(F.lit(1)).alias("phase2_subgroups"))
    hits = signals.groupBy(*keys).agg(
        F.count_if(F.col("chart") == "xbar").alias("xbar_signals"),
        F.count_if(F.col("chart") == "r").alias("r_signals"),
    )
    out = attach_stats(seen, hits, keys)
    x, r = F.coalesce("xbar_signals", F.lit(0)), F.coalesce("r_signals", F.lit(0))
    return out.withColumns(
        {
            "xbar_signals": x,
            "r_signals": r,
            "total_signals": x + r,
            "xbar_in_control": x == 0,
            "r_in_control": r == 0,
            "overall_in_control": (x + r) == 0,
        }
    )


def ewma_chart(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    lam: float = 0.2,
    width: float = 3.0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """EWMA seeded with the first value; limits widen with the number of values.

    A NULL keeps the last EWMA (NULL before the first value) and ``pos`` counts
    values only. Limits have a relative tolerance, so a flat series never alarms.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sigma"))
    seq = Ordered(df, keys, order, hot_rows=hot_rows).running({POS: ("count", F.col(value))})
    seq = seq.with_columns({POS: F.col(POS) - 1})
    weighted = F.col(value) * F.when(F.col(POS) == 0, F.lit(1.0)).otherwise(F.lit(lam))
    rows = attach_stats(decayed_sum(seq, {"ewma": weighted}, 1 - lam).result(), stats, keys)
    rows = rows.withColumn("ewma", F.when(F.col(POS) >= 0, F.col("ewma")))
    t = (F.col(POS) + 1).cast("double")
    spread = F.lit(width) * F.col("_sigma") * F.sqrt(
        F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * t))
    )
    out = rows.withColumns({"ucl": F.col("_mu") + spread, "lcl": F.col("_mu") - spread})
    slack = F.abs("_mu") * 1e-12
    flag = (F.col("ewma") > F.col("ucl") + slack) | (F.col("ewma") < F.col("lcl") - slack)
    return out.withColumn("ewma_flag", F.coalesce(flag, F.lit(False))).drop("_mu", "_sigma")


def cusum_chart(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    h: float = 5.0,
    k: float = 0.5,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Two-sided CUSUM. The clipped recursion equals the running sum minus its
    running minimum (maximum on the lower side), both starting at zero."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sigma"))
    rows = attach_stats(df, stats, keys)
    z = F.try_divide(F.col(value) - F.col("_mu"), F.col("_sigma"))
    seq = Ordered(rows, keys, order, hot_rows=hot_rows).positioned()
    first = F.col(POS) == 0
    seq = seq._next(
        seq.df.withColumns(
            {
                "_up": F.when(first, F.lit(0.0)).otherwise(z - F.lit(k)),
                "_down": F.when(first, F.lit(0.0)).otherwise(z + F.lit(k)),
            }
        )
    )
    seq = seq.running({"_cu": ("sum", F.col("_up")), "_cd": ("sum", F.col("_down"))})
    seq = seq.running({"_mu_min": ("min", F.col("_cu")), "_md_max": ("max", F.col("_cd"))})
    out = seq.result().withColumns(
        {"c_plus": F.col("_cu") - F.col("_mu_min"), "c_minus": F.col("_cd") - F.col("_md_max")}
    )
    out = out.withColumn("cusum_flag", (F.col("c_plus") > h) | (F.col("c_minus") < -h))
    return out.drop("_mu", "_sigma", "_up", "_down", "_cu", "_cd", "_mu_min", "_md_max")


def rolling_defect_rule(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    defect: Column,
    window: int = 10,
    limit: int = 3,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Violation at a defect when more than ``limit`` of the last ``window``
    rows are defects, once more than ``window`` rows were seen."""

    def build(d: DataFrame, w) -> DataFrame:
        recent = F.sum(defect.cast("int")).over(w.rowsBetween(-(window - 1), 0))
        return d.withColumn("recent_defects", recent).withColumn(
            "violation", defect & (F.col(POS) + 1 > window) & (F.col("recent_defects") > limit)
        )

    return Ordered(df, keys, order, hot_rows=hot_rows).windowed(window, 0, build).result()


def consecutive_violations(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], violated: Column, needed: int = 2, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Alert once ``needed`` rows in a row are violations."""

    def build(d: DataFrame, w) -> DataFrame:
        streak = F.min(violated.cast("int")).over(w.rowsBetween(-(needed - 1), 0)) == 1
        return d.withColumn("alert", streak & (F.col(POS) + 1 >= needed))

    return Ordered(df, keys, order, hot_rows=hot_rows).windowed(needed, 0, build).result()

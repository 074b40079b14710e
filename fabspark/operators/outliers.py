"""Outlier detectors, consensus and alerts.

A detector is a pair of functions: ``fit(df) -> stats DataFrame`` (one row per
key, or one row) and ``apply(df, stats) -> df`` with ``<name>_flag`` and
``<name>_score``. With keys, groups below ``min_rows`` or without a key value
stay unfitted and their rows get false and 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ladder
from ..session import cut_lineage, spread
from .ordered import HOT_ROWS
from .ranks import attach_stats, quantile_name, quantiles, wide_quantiles

MIN_GROUP_ROWS = 10


class Detector(Protocol):
    name: str

    def fit(self, df: DataFrame) -> DataFrame: ...

    def apply(self, df: DataFrame, stats: DataFrame) -> DataFrame: ...


@dataclass
class _Keyed:
    columns: Sequence[str]
    keys: Sequence[str] = ()
    min_rows: int = MIN_GROUP_ROWS
    hot_rows: int = HOT_ROWS

    def _fitted_groups(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        if not self.keys:
            return stats
        sizes = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_rows"))
        out = attach_stats(stats, sizes, self.keys).filter(F.col("_rows") >= self.min_rows)
        for k in self.keys:
            out = out.filter(F.col(k).isNotNull())
        return out.drop("_rows")

    def _finish(self, rows: DataFrame, stats: DataFrame, flag: Column, score: Column, name: str) -> DataFrame:
        drop = [c for c in stats.columns if c not in self.keys]
        out = rows.withColumns({"_f": flag, "_s": score}).drop(*drop)
        return out.withColumns(
            {f"{name}_flag": F.coalesce(F.col("_f"), F.lit(False)), f"{name}_score": F.coalesce(F.col("_s"), F.lit(0.0))}
        ).drop("_f", "_s")


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def _most(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


@dataclass
class ZScore(_Keyed):
    threshold: float = 3.0
    name: str = "zscore"

    def fit(self, df: DataFrame) -> DataFrame:
        aggs = []
        for c in self.columns:
            aggs += [F.avg(c).alias(f"_mean_{c}"), F.stddev_samp(c).alias(f"_std_{c}")]
        return self._fitted_groups(df, df.groupBy(*self.keys).agg(*aggs))

    def apply(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        rows = attach_stats(df, stats, self.keys)
        z = [F.abs(F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_std_{c}"))) for c in self.columns]
        return self._finish(rows, stats, _any([x > self.threshold for x in z]), _most(z), self.name)


@dataclass
class ModifiedZScore(_Keyed):
    """0.6745 * |x - median| / MAD; a MAD of zero never flags."""

    threshold: float = 3.5
    name: str = "modified_zscore"

    def fit(self, df: DataFrame) -> DataFrame:
        keys, cols = list(self.keys), list(self.columns)
        med = wide_quantiles(df, keys, cols, [0.5])
        dev = attach_stats(df.select(*keys, *cols), med, keys)
        dev = dev.select(*keys, *[F.abs(F.col(c) - F.col(f"{c}_q50")).alias(c) for c in cols])
        mad = wide_quantiles(dev, keys, cols, [0.5])
        med = med.select(*keys, *[F.col(f"{c}_q50").alias(f"_med_{c}") for c in cols])
        mad = mad.select(*keys, *[F.col(f"{c}_q50").alias(f"_mad_{c}") for c in cols])
        return self._fitted_groups(df, attach_stats(med, mad, keys))

    def apply(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        rows = attach_stats(df, stats, self.keys)
        z = [0.6745 * F.abs(F.try_divide(F.col(c) - F.col(f"_med_{c}"), F.col(f"_mad_{c}"))) for c in self.columns]
        return self._finish(rows, stats, _any([x > self.threshold for x in z]), _most(z), self.name)


@dataclass
class IQRFence(_Keyed):
    """Outside k interquartile ranges; score = distance outside the fence."""

    k: float = 1.5
    name: str = "iqr"

    def fit(self, df: DataFrame) -> DataFrame:
        q = wide_quantiles(df, self.keys, self.columns, [0.25, 0.75])
        cols = []
        for c in self.columns:
            lo, hi = F.col(f"{c}_q25"), F.col(f"{c}_q75")
            cols += [(lo - self.k * (hi - lo)).alias(f"_low_{c}"), (hi + self.k * (hi - lo)).alias(f"_high_{c}")]
        return self._fitted_groups(df, q.select(*self.keys, *cols))

    def apply(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        rows = attach_stats(df, stats, self.keys)
        flags = [(F.col(c) < F.col(f"_low_{c}")) | (F.col(c) > F.col(f"_high_{c}")) for c in self.columns]
        zero = F.lit(0.0)
        dist = [F.greatest(zero, F.col(f"_low_{c}") - F.col(c), F.col(c) - F.col(f"_high_{c}")) for c in self.columns]
        return self._finish(rows, stats, _any(flags), _most(dist), self.name)


@dataclass
class Mahalanobis(_Keyed):
    """Distance by the pseudo-inverse covariance of complete rows. Rows with
    missing values use the columns they have; fewer than two give distance 0.
    The cut is a distance itself, so a row is above it only beyond the noise of
    sums that were taken in another order."""

    percentile: float = 95.0
    name: str = "mahalanobis"

    def _distance(self) -> Column:
        d, total = len(self.columns), F.lit(0.0)
        have = sum((F.col(c).isNotNull().cast("int") for c in self.columns), F.lit(0))
        delta = [F.coalesce(F.col(c) - F.col("_mean")[i], F.lit(0.0)) for i, c in enumerate(self.columns)]
        for i in range(d):
            for j in range(d):
                total = total + delta[i] * delta[j] * F.col("_inv")[i * d + j]
        return F.when(have < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(total, F.lit(0.0))))

    def fit(self, df: DataFrame) -> DataFrame:
        keys, cols, d = list(self.keys), list(self.columns), len(self.columns)
        complete = df.na.drop(subset=cols)
        cov = [F.covar_samp(cols[min(i, j)], cols[max(i, j)]) for i in range(d) for j in range(d)]
        stats = complete.groupBy(*keys).agg(F.array(*[F.avg(c) for c in cols]).alias("_mean"), F.array(*cov).alias("_cov"))
        stats = self._fitted_groups(complete, stats)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def inverse(c: pd.Series) -> pd.Series:
            def one(v):
                m = np.asarray(v, dtype=float).reshape(d, d)
                return np.linalg.pinv(m).ravel().tolist() if np.isfinite(m).all() else None

            return c.map(lambda v: one(v) if v is not None else None)

        stats = stats.withColumn("_inv", inverse("_cov")).drop("_cov").filter(F.col("_inv").isNotNull())
        dist = attach_stats(complete.select(*keys, *cols), stats, keys).select(*keys, self._distance().alias("_d"))
        cut = quantiles(dist, keys, "_d", [self.percentile / 100], self.hot_rows)
        cut = cut.select(*keys, F.col(quantile_name(self.percentile / 100)).alias("_cut"))
        return attach_stats(stats, cut, keys)

    def apply(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        rows = attach_stats(df, stats, self.keys).withColumn("_dist", self._distance())
        return self._finish(rows, stats, F.col("_dist") > F.col("_cut") * (1 + 1e-10), F.col("_dist"), self.name).drop("_dist")


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng: np.random.Generator, nodes: list) -> int:
    """Appends the nodes (feature, cut, left, right, path) of one tree."""
    me = len(nodes)
    nodes.append(None)
    low, high = x.min(axis=0), x.max(axis=0)
    open_cols = np.flatnonzero(high > low)
    if depth >= limit or len(x) <= 1 or len(open_cols) == 0:
        nodes[me] = (-1, 0.0, -1, -1, depth + _average_path(len(x)))
        return me
    f = int(rng.choice(open_cols))
    cut = float(rng.uniform(low[f], high[f]))
    left = x[:, f] < cut
    if left.all() or not left.any():
        nodes[me] = (-1, 0.0, -1, -1, depth + _average_path(len(x)))
        return me
    a = _grow(x[left], depth + 1, limit, rng, nodes)
    b = _grow(x[~left], depth + 1, limit, rng, nodes)
    nodes[me] = (f, cut, a, b, 0.0)
    return me


@dataclass
class IsolationForest:
    """Isolation forest: trees grow in parallel from at most ``sample`` rows
    each, the forest (bounded by trees x sample) is broadcast, every row is
    scored in Arrow batches. The cut is the exact quantile of the scores."""

    columns: Sequence[str]
    row_key: Sequence[str]
    trees: int = 100
    sample: int = 256
    contamination: float = 0.1
    seed: int = 42
    name: str = "isolation_forest"
    hot_rows: int = HOT_ROWS
    forest_: list = field(default_factory=list, repr=False)

    def _samples(self, df: DataFrame) -> DataFrame:
        """About ``sample`` rows per tree, chosen by a hash of the row key."""
        rows = df.select(*self.row_key, *self.columns).na.drop(subset=list(self.columns))
        total = max(rows.count(), 1)
        # Every tree expects 1.3 * sample rows (or all). A row goes to trees * share
        # trees, the fraction settled by its hash; they follow a stride that has no
        # factor in common with their number, so they are distinct.
        share = min(1.0, 1.3 * self.sample / total)
        strides = F.array(*[F.lit(s) for s in range(1, self.trees + 1) if math.gcd(s, self.trees) == 1])
        draw = lambda n, mod: F.pmod(F.xxhash64(F.lit(self.seed + n), *[F.col(k) for k in self.row_key]), mod)
        copies = F.floor(F.lit(self.trees * share) + draw(0, F.lit(1_000_000_000)) / 1e9).cast("int")
        stride = F.get(strides, draw(3, F.size(strides)).cast("int"))
        step = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))
        some = rows.withColumns({"_copies": F.least(copies, F.lit(self.trees)), "_stride": stride, "_from": draw(1, F.lit(self.trees))}).filter("_copies > 0")
        drawn = some.withColumn("_step", step).withColumn("tree", ((F.col("_from") + F.col("_step") * F.col("_stride")) % self.trees).cast("int"))
        drawn = drawn.drop("_copies", "_stride", "_from", "_step")
        key = [F.col(k) for k in self.row_key]
        return drawn.withColumn("_h", F.xxhash64(F.lit(self.seed + 2), F.col("tree"), *key))

    def fit(self, df: DataFrame) -> "IsolationForest":
        cols, size, seed = list(self.columns), self.sample, self.seed
        limit = math.ceil(math.log2(max(size, 2)))

        def plant(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            x = pdf.sort_values("_h")[cols].to_numpy(dtype=float)[:size]
            nodes: list = []
            _grow(x, 0, limit, np.random.default_rng(seed + tree), nodes)
            out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
            out.insert(0, "node", range(len(out)))
            out.insert(0, "tree", tree)
            out["rows"] = len(x)
            return out

        schema = "tree int, node int, feature int, cut double, left int, right int, path double, rows int"
        nodes = self._samples(df).groupBy("tree").applyInPandas(plant, schema).toPandas()
        self.forest_ = [g.sort_values("node") for _, g in nodes.groupby("tree")]
        return self

    def apply(self, df: DataFrame, stats: object = None) -> DataFrame:
        # All trees in one node table, so that every row walks them side by side;
        # a leaf points to itself.
        roots, feature, cut, left, right, path = [], [], [], [], [], []
        for g in self.forest_:
            base, own = sum(map(len, feature)), np.arange(len(g))
            leaf = g["feature"].to_numpy() < 0
            roots.append(base)
            feature.append(np.where(leaf, 0, g["feature"].to_numpy()))
            cut.append(g["cut"].to_numpy(dtype=float))
            left.append(base + np.where(leaf, own, g["left"].to_numpy()))
            right.append(base + np.where(leaf, own, g["right"].to_numpy()))
            path.append(g["path"].to_numpy(dtype=float))
        steps = math.ceil(math.log2(max(self.sample, 2))) + 1
        parts = np.array(roots), *(np.concatenate(v) for v in (feature, cut, left, right, path))
        scale = _average_path(float(np.mean([g["rows"].iloc[0] for g in self.forest_])))
        shared = df.sparkSession.sparkContext.broadcast(parts)

        @F.pandas_udf(T.DoubleType())
        def score(*cols: pd.Series) -> pd.Series:
            roots, feature, cut, left, right, path = shared.value
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            out = np.empty(len(x))
            for lo in range(0, len(x), 1000):
                part = x[lo : lo + 1000]
                row, at = np.arange(len(part))[:, None], np.broadcast_to(roots, (len(part), len(roots)))
                for _ in range(steps):
                    at = np.where(part[row, feature[at]] < cut[at], left[at], right[at])
                out[lo : lo + 1000] = path[at].sum(1)
            return pd.Series(np.power(2.0, -out / len(roots) / scale))

        # The scores are read twice, for the cut and for the flags: keep them.
        scored = spread(df).withColumn(f"{self.name}_score", score(*[F.col(c).cast("double") for c in self.columns])).persist()
        cut = quantiles(scored, [], f"{self.name}_score", [1 - self.contamination], self.hot_rows)
        cut = cut.select(F.col(quantile_name(1 - self.contamination)).alias("_cut"))
        out = attach_stats(scored, cut, [])
        return out.withColumn(f"{self.name}_flag", F.col(f"{self.name}_score") > F.col("_cut")).drop("_cut")


def group_breakdown(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(flag).alias("n_outliers"),
        F.count(F.lit(1)).alias("n_samples"),
        (F.count_if(flag) / F.count(F.lit(1)) * 100).alias("outlier_percentage"),
    )


def unfitted_groups(df: DataFrame, key: str, stats: DataFrame) -> DataFrame:
    """Groups that no statistics exist for."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).join(stats.select(key), key, "left_anti")


def consensus(df: DataFrame, flags: Sequence[str], share: float = 0.5) -> DataFrame:
    """Votes of the methods; consensus from ``share`` of them on."""
    votes = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    out = df.withColumn("votes", votes)
    return out.withColumns(
        {
            "vote_percentage": F.col("votes") / len(flags) * 100,
            "consensus": F.col("votes") >= len(flags) * share,
        }
    )


# Default rules as (high column, low column).
PHYSICS_RULES = {
    "temperature_pressure": ("temperature", "pressure"),
    "flow_pressure": ("flow_rate", "pressure"),
    "power_temperature": ("power", "temperature"),
}


def physics_rules(
    df: DataFrame, rules: dict[str, tuple[str, str] | Column], high: float = 0.9, low: float = 0.1, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """A flag per rule. A pair (a, b) means a above its high quantile while b
    is below its low quantile; a Column is used as it is. Pairs whose columns
    are absent give false."""
    pairs = {n: r for n, r in rules.items() if isinstance(r, tuple) and set(r) <= set(df.columns)}
    out = df
    if pairs:
        cols = sorted({c for p in pairs.values() for c in p})
        stats = wide_quantiles(df, [], cols, [low, high])
        out = attach_stats(df, stats, [])
    flags = {}
    for n, rule in rules.items():
        if n in pairs:
            a, b = pairs[n]
            cond = (F.col(a) > F.col(f"{a}_{quantile_name(high)}")) & (F.col(b) < F.col(f"{b}_{quantile_name(low)}"))
        elif isinstance(rule, tuple):
            cond = F.lit(False)
        else:
            cond = rule
        flags[f"rule_{n}"] = F.coalesce(cond, F.lit(False))
    return out.withColumns(flags).select(*df.columns, *flags)


def validated(df: DataFrame, consensus_flag: str, rules: Sequence[str]) -> DataFrame:
    return df.withColumn("validated", _any([F.col(consensus_flag), *[F.col(f"rule_{n}") for n in rules]]))


# Recommended actions by alert level.
CRITICAL_ACTIONS = [
    "Stop current production lot",
    "Notify process engineer",
    "Check equipment status",
    "Review recent parameter changes",
]
WARNING_ACTIONS = [
    "Increase sampling frequency",
    "Monitor related parameters",
    "Prepare for potential intervention",
    "Document observations",
]


def alerts(df: DataFrame, flags: Sequence[str], critical: float = 0.8) -> DataFrame:
    """Rows whose share of agreeing methods reaches 0.6 x critical (WARNING)
    or critical (CRITICAL), with the methods and a recommendation."""
    score = sum((F.col(f).cast("int") for f in flags), F.lit(0)) / len(flags)
    level = ladder("consensus_score", [(critical, "CRITICAL"), (critical * 0.6, "WARNING")], None)
    out = df.withColumn("consensus_score", score).withColumn("level", level).filter(F.col("level").isNotNull())
    methods = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f.removesuffix("_flag"))) for f in flags]))

    def advice(action: str, priority: int, actions: list[str]) -> Column:
        return F.struct(
            F.lit(action).alias("action"), F.lit(priority).alias("priority"), F.array(*[F.lit(a) for a in actions]).alias("actions")
        )

    return out.withColumns(
        {
            "methods": methods,
            "recommendation": F.when(F.col("level") == "CRITICAL", advice("IMMEDIATE_INVESTIGATION", 1, CRITICAL_ACTIONS)).otherwise(
                advice("MONITOR_CLOSELY", 2, WARNING_ACTIONS)
            ),
        }
    )


def score_alerts(df: DataFrame, score: str, warning: float = -0.5, critical: float = -1.0) -> DataFrame:
    """Level of a decision score where lower is worse."""
    s = F.col(score)
    return df.withColumn("alert_level", F.when(s <= critical, "critical").when(s <= warning, "warning").otherwise("normal"))


def recent_alerts(df: DataFrame, ts: str, as_of: Column, hours: int = 1) -> DataFrame:
    since = as_of - F.make_interval(hours=F.lit(hours))
    return df.filter((F.col(ts) >= since) & (F.col("alert_level") != "normal"))


def alert_summary(df: DataFrame, score: str, anomaly: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(anomaly).alias("detected_anomalies"),
        F.count_if(F.col("alert_level") == "warning").alias("warning_alerts"),
        F.count_if(F.col("alert_level") == "critical").alias("critical_alerts"),
        F.coalesce(F.try_divide(F.count_if(anomaly), F.count(F.lit(1))), F.lit(0.0)).alias("anomaly_rate"),
        F.avg(score).alias("avg_anomaly_score"),
    )


def weighted_points(df: DataFrame, columns: Sequence[str], part_rows: int = 250_000) -> DataFrame:
    """(columns, weight): each distinct row once, with its number, for fits of many
    passes. Partitions hold about ``part_rows`` rows; they and their order depend
    on the values alone, so a seed picks the same rows on any cluster."""
    points = cut_lineage(df.groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    parts = max(16, math.ceil(points.count() / part_rows))
    return points.repartition(parts, *columns).sortWithinPartitions(*columns)


def mixture_outliers(df: DataFrame, columns: Sequence[str], k: int = 2, contamination: float = 0.1, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Gaussian mixture on Spark ML, fitted on the distinct rows with their
    numbers as weights; the rows of lowest log density are flagged. The k x d x d parameters are literals of the score expression."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    cols = list(columns)
    vec = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="skip").transform(weighted_points(df, cols))
    model = GaussianMixture(k=k, seed=seed, featuresCol="_v", weightCol="weight").fit(vec)
    gauss = model.gaussiansDF.collect()
    parts = []
    for weight, g in zip(model.weights, gauss):
        mean, cov = g["mean"].toArray(), g["cov"].toArray()
        inv = np.linalg.pinv(cov)
        norm = math.log(max(weight, 1e-300)) - 0.5 * (len(cols) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1])
        quad = F.lit(0.0)
        for i, a in enumerate(cols):
            for j, b in enumerate(cols):
                quad = quad + (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j])) * float(inv[i, j])
        parts.append(F.lit(float(norm)) - 0.5 * quad)
    top = _most(parts)
    density = top + F.ln(sum((F.exp(p - top) for p in parts), F.lit(0.0)))
    # One element, exploded: filters on the density stay above it. Pushed below, they would
    # repeat the long expression in one method, too large for the JVM to compile.
    names = [F.col(f"`{c}`") for c in df.columns if c != "log_density"]
    scored = df.select(*names, F.explode(F.array(density)).alias("log_density"))
    cut = quantiles(scored, [], "log_density", [contamination], hot_rows).select(F.col(quantile_name(contamination)).alias("_cut"))
    out = attach_stats(scored, cut, [])
    return out.withColumn("mixture_flag", F.col("log_density") < F.col("_cut")).drop("_cut")


def context_zscore(df: DataFrame, columns: Sequence[str], value: str, k: int = 4, threshold: float = 2.5, seed: int = 42) -> DataFrame:
    """Z-scores inside k-means contexts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    # NULL and NaN rows have no context: they are kept, unflagged and with score 0.
    whole = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])
    vec = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df.filter(whole))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="context").fit(vec)
    rest = df.filter(~whole).withColumn("context", F.lit(None).cast("int"))
    rows = model.transform(vec).drop("_v").unionByName(rest)
    det = ZScore([value], ["context"], threshold=threshold, name="context")
    # At most k rows: a join on the context would put all rows into k tasks.
    return det.apply(rows, F.broadcast(det.fit(rows)))

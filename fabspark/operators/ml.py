"""Model pipelines on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    IDF,
    PCA,
    CountVectorizerModel,
    Imputer,
    NGram,
    Normalizer,
    PolynomialExpansion,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
    UnivariateFeatureSelector,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket
from ..session import bounded, cut_lineage
from .metrics import binary_scores, confusion, curve, regression, roc_pr_auc, threshold_by_f1
from .minibatch import MiniBatchKMeans
from .ordered import HOT_ROWS, Ordered
from .ranks import attach_stats, quantile_name, quantiles


def preparation(features: Sequence[str], k_best: int | None = None, pca: int | None = None, target: str = "categorical", scale: bool = True, label: str = "label") -> list:
    """Median imputation, assembling, scaling, selection, PCA."""
    cols = list(features)
    filled = [f"_f_{c}" for c in cols]
    stages = [
        Imputer(strategy="median", inputCols=cols, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
    ]
    last = "_raw"
    if scale:
        stages.append(StandardScaler(inputCol=last, outputCol="_scaled", withMean=True, withStd=True))
        last = "_scaled"
    if k_best:
        sel = UnivariateFeatureSelector(featuresCol=last, outputCol="_best", labelCol=label, selectionMode="numTopFeatures")
        sel.setFeatureType("continuous").setLabelType(target).setSelectionThreshold(k_best)
        stages.append(sel)
        last = "_best"
    if pca:
        stages.append(PCA(k=pca, inputCol=last, outputCol="_pca"))
        last = "_pca"
    # A plain alias of the last step, so that every model reads "features".
    stages.append(SQLTransformer(statement=f"SELECT *, {last} AS features FROM __THIS__"))
    return stages


def regressor(kind: str, label: str = "label", **params):
    made = {
        "linear": lambda: R.LinearRegression(labelCol=label, **params),
        "ridge": lambda: R.LinearRegression(labelCol=label, elasticNetParam=0.0, **{"regParam": 1.0, **params}),
        "lasso": lambda: R.LinearRegression(labelCol=label, elasticNetParam=1.0, **{"regParam": 0.1, **params}),
        "elastic_net": lambda: R.LinearRegression(labelCol=label, **{"regParam": 0.1, "elasticNetParam": 0.5, **params}),
        "forest": lambda: R.RandomForestRegressor(labelCol=label, **{"numTrees": 50, "seed": 42, **params}),
        "boosted": lambda: R.GBTRegressor(labelCol=label, **{"maxIter": 20, "seed": 42, **params}),
    }
    return made[kind]()


def classifier(kind: str, label: str = "label", weight: str | None = None, **params):
    w = {"weightCol": weight} if weight else {}
    made = {
        "logistic": lambda: C.LogisticRegression(labelCol=label, **{"maxIter": 50, **w, **params}),
        "svm": lambda: C.LinearSVC(labelCol=label, **{"maxIter": 50, **w, **params}),
        "tree": lambda: C.DecisionTreeClassifier(labelCol=label, **{"seed": 42, **w, **params}),
        "forest": lambda: C.RandomForestClassifier(labelCol=label, **{"numTrees": 50, "seed": 42, **w, **params}),
        "boosted": lambda: C.GBTClassifier(labelCol=label, **{"maxIter": 20, "seed": 42, **w, **params}),
    }
    return made[kind]()


def _rows_to_keep(df: DataFrame, columns: Sequence[str], kind: str, part_rows: int = 500_000) -> DataFrame:
    """Trees keep every partition of their rows as objects over all levels."""
    return bounded(df.select(*columns), part_rows) if kind in ("tree", "forest", "boosted") else df


def fit_regression(df: DataFrame, features: Sequence[str], kind: str = "ridge", k_best: int | None = None, pca: int | None = None, **params) -> PipelineModel:
    prepared = Pipeline(stages=preparation(features, k_best, pca, target="continuous")).fit(df)
    rows = _rows_to_keep(df, [*features, "label"], kind)
    return PipelineModel([*prepared.stages, regressor(kind, **params).fit(prepared.transform(rows))])


def fit_regressions(df: DataFrame, features: Sequence[str], kinds: Sequence[str], k_best: int | None = None, pca: int | None = None, **params) -> dict[str, PipelineModel]:
    """One model per kind on one preparation, which is fitted once."""
    prepared = Pipeline(stages=preparation(features, k_best, pca, target="continuous")).fit(df)
    rows = prepared.transform(df).select("features", "label")
    return {kind: PipelineModel([*prepared.stages, regressor(kind, **params).fit(rows)]) for kind in kinds}


def class_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = attach_stats(counts, totals, []).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias(name))
    # A row a class: a join on the label would put all rows into as many tasks.
    return attach_stats(df, F.broadcast(w), [label])


def fit_classification(df: DataFrame, features: Sequence[str], kind: str = "logistic", balanced: bool = True, k_best: int | None = None, pca: int | None = None, **params) -> PipelineModel:
    rows = class_weights(df) if balanced else df
    prepared = Pipeline(stages=preparation(features, k_best, pca)).fit(rows)
    rows = _rows_to_keep(rows, [*features, "label", *(["weight"] if balanced else [])], kind)
    return PipelineModel([*prepared.stages, classifier(kind, weight="weight" if balanced else None, **params).fit(prepared.transform(rows))])


def with_probability(scored: DataFrame, name: str = "p") -> DataFrame:
    """Probability of class 1; from the margin where a model has none."""
    if "probability" in scored.columns:
        return scored.withColumn(name, vector_to_array("probability")[1])
    return scored.withColumn(name, 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def evaluate_binary(scored: DataFrame, label: str = "label", p: str = "p", threshold: float = 0.5, **costs) -> DataFrame:
    """ROC AUC, PR AUC and all counts-based scores in one row."""
    rows = scored.withColumn("_pred", (F.col(p) >= threshold).cast("int"))
    out = binary_scores(confusion(rows, label, "_pred"), **costs)
    return attach_stats(out, roc_pr_auc(curve(rows, label, p)), [])


def tuned_threshold(scored: DataFrame, label: str = "label", p: str = "p", **floors) -> DataFrame:
    return threshold_by_f1(curve(scored, label, p), **floors)


def hash_split(df: DataFrame, key: Sequence[str], train_pct: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The same rows fall on the same side in every run and on any cluster."""
    train = hash_train(key, train_pct, seed)
    return df.filter(train), df.filter(~train)


def hash_train(key: Sequence[str], train_pct: int = 80, seed: int = 42) -> Column:
    """Whether :func:`hash_split` puts a row on the training side."""
    return hash_bucket(key, 100, seed) < train_pct


def stratified_split(df: DataFrame, key: str, label: str, train_share: float = 0.8, seed: int = 42, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``is_train`` with exactly floor(share * n) rows per class."""
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)).cast("double"))
    seq = Ordered(rows, [label], ["_h", key], hot_rows=hot_rows).positioned().result()
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    out = attach_stats(seq, sizes, [label])
    return out.withColumn("is_train", F.col("pos") < F.floor(F.col("_n") * F.lit(train_share))).drop("_h", "pos", "_n")


def importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Tree feature importances, largest first."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, map(float, values)), key=lambda kv: (-kv[1], kv[0]))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def _explained(scaled: DataFrame, width: int) -> np.ndarray:
    return PCA(k=width, inputCol="_scaled", outputCol="_p").fit(scaled).explainedVariance.toArray()


def explained_variance(df: DataFrame, vector: str) -> DataFrame:
    """(component, share, cumulative) of the scaled vectors, a row per component."""
    scaler = StandardScaler(inputCol=vector, outputCol="_scaled", withMean=True, withStd=True).fit(df)
    shares = _explained(scaler.transform(df), scaler.mean.size)
    rows = [(k, float(s), float(c)) for k, (s, c) in enumerate(zip(shares, np.cumsum(shares)), start=1)]
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def fit_clusters(df: DataFrame, vector: str, k: int, kind: str = "kmeans", variance: float | None = 0.95, seed: int = 42, keys: Sequence[str] | None = None):
    """Scaling, PCA up to a share of variance, then clustering. Returns the
    preparation model, the cluster model and the prepared rows. As many
    components are kept as the share takes, up to the vector's width. Kinds are
    ``kmeans``, ``gmm`` and ``minibatch``; the last samples rows by ``keys``."""
    scaler = StandardScaler(inputCol=vector, outputCol="_scaled", withMean=True, withStd=True).fit(df)
    stages, last = [scaler], "_scaled"
    if variance:
        explained = _explained(scaler.transform(df), scaler.mean.size)
        n = int(np.searchsorted(np.cumsum(explained), variance)) + 1
        stages.append(PCA(k=min(n, scaler.mean.size), inputCol="_scaled", outputCol="_p"))
        last = "_p"
    prep = Pipeline(stages=stages).fit(df)
    ready = prep.transform(df).withColumnRenamed(last, "features")
    if kind == "kmeans":
        model = KMeans(k=k, seed=seed).fit(ready)
    elif kind == "gmm":
        model = GaussianMixture(k=k, seed=seed).fit(ready)
    elif kind == "minibatch":
        model = MiniBatchKMeans(k, seed=seed).fit(ready, keys or [c for c in df.columns if c != vector])
    else:
        raise ValueError(f"unknown clustering {kind!r}")
    return prep, model, ready


def silhouettes(df: DataFrame, features: str, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """(k, silhouette) for k-means, best first. Fits run one after another,
    each over the whole table."""
    df = df.persist()
    rows = []
    for k in ks:
        scored = KMeans(k=k, seed=seed, featuresCol=features).fit(df).transform(df)
        n = scored.select("prediction").distinct().count()
        rows.append((k, float(ClusteringEvaluator(featuresCol=features).evaluate(scored)) if n > 1 else None))
    out = df.sparkSession.createDataFrame(rows, "k int, silhouette double")
    return out.orderBy(F.desc("silhouette"), "k")


def low_score_flag(df: DataFrame, score: str, share: float = 0.05, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Anomalies are scores below the exact lower quantile."""
    cut = quantiles(df, [], score, [share], hot_rows).select(F.col(quantile_name(share)).alias("_cut"))
    return attach_stats(df, cut, []).withColumn("is_anomaly", F.col(score) < F.col("_cut")).drop("_cut")


def multilabel_models(df: DataFrame, features: Sequence[str], labels: Sequence[str], chain: bool = False, kind: str = "logistic") -> list[tuple[str, PipelineModel]]:
    """One model per label; a chain feeds the true earlier labels in training
    and the predicted ones in scoring."""
    models, inputs = [], list(features)
    for y in labels:
        rows = df.withColumn("label", F.col(y).cast("double"))
        rows = rows.withColumns({f"chain_{x}": F.col(x).cast("double") for x in labels if f"chain_{x}" in inputs})
        models.append((y, Pipeline(stages=[*preparation(inputs), classifier(kind)]).fit(rows)))
        if chain:
            inputs.append(f"chain_{y}")
    return models


def multilabel_predict(df: DataFrame, models: list[tuple[str, PipelineModel]], chain: bool = False) -> DataFrame:
    keep = df.columns
    for y, model in models:
        scored = model.transform(df)
        df = scored.select(*keep, F.col("prediction").cast("int").alias(f"{y}_pred"))
        keep = df.columns
        if chain:
            df = df.withColumn(f"chain_{y}", F.col(f"{y}_pred").cast("double"))
            keep = df.columns
    return df.drop(*[f"chain_{y}" for y, _ in models])


def powerset(df: DataFrame, labels: Sequence[str], name: str = "combination") -> DataFrame:
    """Active labels as one text, NONE without any."""
    active = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in labels]))
    joined = F.array_join(F.array_sort(active), "+")
    return df.withColumn(name, F.when(joined == "", "NONE").otherwise(joined))


def powerset_index(df: DataFrame, name: str = "combination", output: str = "label") -> DataFrame:
    return StringIndexer(inputCol=name, outputCol=output, stringOrderType="frequencyDesc").fit(df).transform(df)


def compare_training(train_sets: dict[str, DataFrame], test: DataFrame, features: Sequence[str], kind: str = "logistic", base: str = "baseline") -> DataFrame:
    """One row per training set: accuracy and F1 on the test rows and the
    gain over the base."""
    out = None
    for name, train in train_sets.items():
        model = Pipeline(stages=[*preparation(features), classifier(kind)]).fit(train)
        scores = evaluate_binary(with_probability(model.transform(test)))
        row = scores.select(F.lit(name).alias("training"), F.lit(train.count()).alias("train_rows"), "accuracy", "f1", "roc_auc")
        out = row if out is None else out.unionByName(row)
    ref = out.filter(F.col("training") == base).select(F.col("accuracy").alias("_a"))
    return attach_stats(out, ref, []).withColumn("accuracy_gain", F.col("accuracy") - F.col("_a")).drop("_a")


def polynomial_search(df: DataFrame, features: Sequence[str], degrees: Sequence[int], folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-validated R2 by polynomial degree."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    poly = PolynomialExpansion(inputCol="_x", outputCol="features")
    grid = ParamGridBuilder().addGrid(poly.degree, list(degrees)).build()
    return _search(df, features, [assembler], [poly, R.LinearRegression(labelCol="label")], grid, folds, seed, [(f"degree={x}",) for x in degrees])


def grid_search(df: DataFrame, features: Sequence[str], reg: Sequence[float], mix: Sequence[float], folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-validated R2 over penalty and elastic-net mix."""
    lr = R.LinearRegression(labelCol="label")
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg)).addGrid(lr.elasticNetParam, list(mix)).build()
    names = [(",".join(f"{p.name}={v:g}" for p, v in sorted(g.items(), key=lambda kv: kv[0].name)),) for g in grid]
    return _search(df, features, preparation(features, target="continuous"), [lr], grid, folds, seed, names)


def _search(df: DataFrame, features: Sequence[str], steady: list, varied: list, grid: list, folds: int, seed: int, names: list) -> DataFrame:
    scores = cross_scores(df, features, steady, varied, grid, folds, seed)
    rows = [(n[0], v) for n, v in zip(names, scores, strict=True)]
    return df.sparkSession.createDataFrame(rows, "params string, mean_r2 double").orderBy(F.desc("mean_r2"))


def cross_scores(df: DataFrame, features: Sequence[str], steady: list, varied: list, grid: list, folds: int, seed: int) -> list[float]:
    """Mean R2 on the held-out rows per entry of ``grid``. Folds are those of
    CrossValidator. ``steady`` stages, which no entry changes, are fitted once a
    fold; one pass over a fold's held-out rows scores all entries."""
    rows = df.select(*features, "label").withColumn("_fold", F.floor(F.rand(seed) * folds))

    def one(i: int) -> list[float]:
        train, held = rows.filter(F.col("_fold") != i), rows.filter(F.col("_fold") == i)
        prepared = Pipeline(stages=steady).fit(train)
        ready, scored = prepared.transform(train), prepared.transform(held)
        kept = scored.columns
        for n, params in enumerate(grid):
            made = Pipeline(stages=varied).fit(ready, params).transform(scored)
            scored = made.select(*kept, F.col("prediction").alias(f"_p{n}"))
            kept = scored.columns
        y = F.col("label")
        lost = [F.sum((y - F.col(f"_p{n}")) ** 2).alias(f"_e{n}") for n in range(len(grid))]
        found = scored.agg((F.var_pop("label") * F.count("label")).alias("_all"), *lost).first()
        return [1 - found[f"_e{n}"] / found["_all"] if found["_all"] else math.nan for n in range(len(grid))]

    # Folds side by side, as CrossValidator runs its fits.
    with ThreadPool(min(folds, 4)) as pool:
        return np.mean(pool.map(inheritable_thread_target(df.sparkSession)(one), range(folds)), axis=0).tolist()


def time_folds(df: DataFrame, order: Column, folds: int) -> DataFrame:
    """Adds ``fold`` 0..folds by time; cuts are approximate quantiles, so no
    global sort is needed."""
    probe = df.withColumn("_t", order.cast("double"))
    cuts = probe.approxQuantile("_t", [i / (folds + 1) for i in range(1, folds + 1)], 0.001)
    return probe.withColumn("fold", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_t")))).drop("_t")


def expanding_validation(df: DataFrame, features: Sequence[str], order: Column, reg: Sequence[float], folds: int = 3, inner: int = 3) -> DataFrame:
    """Nested validation: each fold trains on all earlier ones, with an inner
    search for the penalty, and is scored on its own rows."""
    rows, out = time_folds(df, order, folds).persist(), None
    for i in range(1, folds + 1):
        train, test = rows.filter(F.col("fold") < i), rows.filter(F.col("fold") == i)
        lr = R.LinearRegression(labelCol="label")
        grid = ParamGridBuilder().addGrid(lr.regParam, list(reg)).build()
        steady = preparation(features, target="continuous")
        scores = cross_scores(train, features, steady, [lr], grid, inner, 42)
        best = reg[max(range(len(reg)), key=lambda j: scores[j])]
        model = Pipeline(stages=[*steady, lr.copy({lr.regParam: best})]).fit(train)
        score = regression(model.transform(test), "label", "prediction").select(
            F.lit(i).alias("fold"), F.lit(float(best)).alias("best_reg"), "n", "rmse", "r2"
        )
        out = score if out is None else out.unionByName(score)
    return out


def ratio_sweep(train: DataFrame, extra: DataFrame, test: DataFrame, features: Sequence[str], key: str, ratios: Sequence[float], kind: str = "logistic") -> DataFrame:
    """Metrics with a growing share of additional rows in training."""
    sets: dict[str, DataFrame] = {"baseline": train}
    for x in ratios:
        part = extra.filter(hash_bucket([key], 1000, 7) < int(x * 1000))
        sets[f"ratio_{x:g}"] = train.unionByName(part)
    return compare_training(sets, test, features, kind)


def text_terms(df: DataFrame, ngrams: int = 2) -> DataFrame:
    """Adds ``_all``: the words without stop words and their runs of up to ``ngrams``."""
    tokens = RegexTokenizer(inputCol="text", outputCol="_t", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    stop = StopWordsRemover(inputCol="_t", outputCol="_w")
    found = stop.transform(tokens.transform(df.withColumn("text", F.coalesce("text", F.lit("")))))
    grams = ["_w", *[f"_g{n}" for n in range(2, ngrams + 1)]]
    for n, name in enumerate(grams[1:], 2):
        found = NGram(n=n, inputCol="_w", outputCol=name).transform(found)
    return found.withColumn("_all", F.concat(*grams)).drop("_t", *grams)


def term_counts(words: DataFrame, column: str = "_all") -> DataFrame:
    """(term, n) over all rows; a batch's equal terms are counted before they leave Arrow."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                found = pc.value_counts(batch.column(0).slice(lo, 2000).flatten())
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["term", "n"])

    return words.select(column).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def score_texts(df: DataFrame, is_train: Column, terms: int, ngrams: int = 2, weight: str | None = "weight") -> DataFrame:
    """TF-IDF of words and word pairs with a logistic model, fitted on the rows
    under ``is_train``: the other rows with its prediction, without their texts.
    Texts are read for the vocabulary (the most frequent terms in training, ties
    to the smaller term) and for the counts; later passes read the checkpointed
    counts."""
    rows = text_terms(df.withColumn("_train", is_train), ngrams)
    top = term_counts(rows.filter("_train")).orderBy(F.desc("n"), "term").limit(terms)
    vocabulary = [r["term"] for r in top.collect()]  # at most ``terms``
    if not vocabulary:
        raise ValueError("no terms in the training texts")
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_all", outputCol="_c")
    rows = cut_lineage(counts.transform(rows).drop("text", "_all"))
    stages = [IDF(inputCol="_c", outputCol="_i"), Normalizer(inputCol="_i", outputCol="features"), classifier("logistic", weight=weight)]
    return Pipeline(stages=stages).fit(rows.filter("_train")).transform(rows.filter(~F.col("_train"))).drop("_train")

"""Model-based queries: rows-only checks, SQL where counts are exact."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import clustering, incremental, ml, neighbours
from ..operators.graph_neighbours import graph_neighbours
from ..operators.metrics import multilabel, regression
from ..session import stream_folder, table
from ..sources.writers import load_model, save_model
from ..streaming.sources import Replay
from .registry import query, r

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def prices(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", *[F.col(c).cast("double").alias(c) for c in FEATURES], (F.col("l_extendedprice") / 1000).alias("label"))


def quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    both = docs.join(table(spark, sf, "labels"), "doc_id")
    words = F.size(F.split("text", " ")).cast("double")
    return both.select(
        "doc_id",
        "text",
        F.col("n_chars").cast("double").alias("chars"),
        words.alias("words"),
        (F.col("lang") == "en").cast("double").alias("english"),
        F.col("quality").cast("double").alias("label"),
        "quality",
        "toxic",
    )


DOC = ["chars", "words", "english"]


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))


@query("regression")
def regression_models(spark, sf):
    rows = prices(spark, sf)
    train, test = ml.hash_split(rows, ["l_orderkey", "l_partkey"])
    out = None
    for kind, model in ml.fit_regressions(train, FEATURES, ("linear", "ridge", "lasso"), k_best=3).items():
        row = regression(model.transform(test), "label", "prediction").withColumn("model", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


LINEAR = """e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_extendedprice AS DOUBLE) / 1000 AS y FROM lineitem),
    s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM e {train}),
    c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
    p AS (SELECT e.*, my + ca * (a - ma) + cb * (b - mb) AS prediction FROM e, c)"""


@query(
    "linear_holdout",
    f"""WITH {LINEAR.format(train='WHERE l_orderkey % 5 <> 0')}, t AS (SELECT y, prediction, prediction - y AS d FROM p WHERE l_orderkey % 5 = 0)
    SELECT count(*) AS n, {r('avg(abs(d))')} AS mae, {r('sqrt(avg(d * d))')} AS rmse, {r('1 - sum(d * d) / (var_pop(y) * count(y))')} AS r2, {r('avg(abs(d) / greatest(abs(y), 1e-8)) * 100')} AS mape FROM t""",
)
def linear_holdout(spark, sf):
    """Fitted on orders whose key is no multiple of five, judged on the others."""
    rows = prices(spark, sf)
    model = ml.fit_regression(rows.filter(F.col("l_orderkey") % 5 != 0), ["l_quantity", "l_discount"], "linear")
    out = regression(model.transform(rows.filter(F.col("l_orderkey") % 5 == 0)), "label", "prediction")
    return out.select("n", *[rounded(c).alias(c) for c in ("mae", "rmse", "r2", "mape")])


@query("saved_linear_scores", f"WITH {LINEAR.format(train='')} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('prediction', 4)} AS prediction, 'linear' AS kind FROM p")
def saved_linear_scores(spark, sf):
    """Fit, save with metadata, load again, score in one batch."""
    rows = prices(spark, sf)
    folder = stream_folder(spark, "model")
    save_model(ml.fit_regression(rows, ["l_quantity", "l_discount"], "linear"), folder, {"kind": "linear"})
    model, meta = load_model(folder)
    out = model.transform(rows).withColumns({"prediction": rounded("prediction", 4), "kind": F.lit(meta["kind"])})
    return out.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", "l_suppkey", "prediction", "kind")


@query("boosted_regression")
def boosted_regression(spark, sf):
    rows = prices(spark, sf)
    train, test = ml.hash_split(rows, ["l_orderkey", "l_partkey"])
    model = ml.fit_regression(train, FEATURES, "boosted", maxIter=5)
    return regression(model.transform(test), "label", "prediction")


@query("feature_importance")
def feature_importance(spark, sf):
    return ml.importance(ml.fit_regression(prices(spark, sf), FEATURES, "forest", numTrees=10), FEATURES)


@query("classification")
def classification(spark, sf):
    rows = quality(spark, sf)
    train, test = ml.hash_split(rows, ["doc_id"])
    out = None
    for kind in ("logistic", "svm", "tree"):
        scored = ml.with_probability(ml.fit_classification(train, DOC, kind).transform(test))
        row = ml.evaluate_binary(scored).withColumn("model", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


@query("classification_threshold")
def classification_threshold(spark, sf):
    rows = quality(spark, sf)
    scored = ml.with_probability(ml.fit_classification(rows, DOC, "logistic", pca=2).transform(rows))
    return ml.tuned_threshold(scored, min_recall=0.5)


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    _, model, ready = ml.fit_clusters(vectors(spark, sf), "vector", 5)
    return model.transform(ready).select("vec_id", "prediction")


@query(
    "pca_variance",
    f"""WITH c AS (SELECT abs(corr(CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE))) AS c FROM lineitem)
    SELECT 1 AS component, {r('(1 + c) / 2')} AS share, {r('(1 + c) / 2')} AS cumulative FROM c UNION ALL SELECT 2, {r('(1 - c) / 2')}, 1.0 FROM c""",
)
def pca_variance(spark, sf):
    """Two scaled columns: the axes carry 1 + |r| and 1 - |r|."""
    li = table(spark, sf, "lineitem").select(array_to_vector(F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"))).alias("v"))
    return ml.explained_variance(li, "v").withColumns({c: rounded(c) for c in ("share", "cumulative")})


@query(
    "knn_graph",
    f"""WITH p AS (SELECT min(vec_id) AS pid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings GROUP BY 2),
    d AS (SELECT a.pid AS qid, b.pid AS nid, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.pid ORDER BY list_distance(a.v, b.v), b.pid) AS rank FROM p a JOIN p b ON a.pid <> b.pid)
    SELECT qid, nid, {r('dist')} AS dist, rank FROM d WHERE rank <= 10""",
)
def knn_graph(spark, sf):
    """Neighbours in all 64 columns; tables of a block are compared exactly."""
    points = neighbours.distinct_points(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return graph_neighbours(points, 10).withColumn("dist", rounded("dist"))


@query("lof_graph")
def lof_graph(spark, sf):
    return neighbours.local_outlier_factor(table(spark, sf, "embeddings"), "vec_id", "embedding", kind="graph")


@query("kmeans_mini_batch")
def kmeans_mini_batch(spark, sf):
    _, model, ready = ml.fit_clusters(vectors(spark, sf), "vector", 5, kind="minibatch", keys=["vec_id"])
    return model.transform(ready).select("vec_id", "prediction", "cost")


def _batches(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "value", (F.hour("ts") / 24.0).alias("day_part"), (F.col("user_id") % 10 / 10.0).alias("user_part"))
    return Replay(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", 7 * 24 * 3600)


EQUATIONS = """e AS (SELECT *, hour(ts) / 24.0 AS a, user_id % 10 / 10.0 AS b, value AS y FROM events)"""


@query(
    "incremental_least_squares",
    f"""WITH {EQUATIONS}, s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM e),
    c AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ca, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS cb FROM s)
    SELECT 'intercept' AS term, {r('my - ca * ma - cb * mb')} AS coefficient, n FROM c UNION ALL SELECT 'day_part', {r('ca')}, n FROM c UNION ALL SELECT 'user_part', {r('cb')}, n FROM c""",
)
def incremental_least_squares(spark, sf):
    source = _batches(spark, sf)
    out = incremental.fit_least_squares(source.stream(), ["day_part", "user_part"], "value", arrivals=source)
    return out.withColumn("coefficient", rounded("coefficient"))


@query(
    "incremental_gradient",
    f"""WITH RECURSIVE {EQUATIONS}, k AS (SELECT *, CAST(epoch_us(ts) AS BIGINT) // 604800000000 AS week FROM e),
    s AS (SELECT dense_rank() OVER (ORDER BY week) - 1 AS batch, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_ FROM k GROUP BY week),
    w AS (SELECT CAST(-1 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb UNION ALL
      SELECT s.batch, s.n, w0 - 0.3 * (s.n * w0 + s.a * wa + s.b * wb - s.y) / s.n, wa - 0.3 * (s.a * w0 + s.aa * wa + s.ab * wb - s.ay) / s.n, wb - 0.3 * (s.b * w0 + s.ab * wa + s.bb * wb - s.by_) / s.n
      FROM w JOIN s ON s.batch = w.batch + 1)
    SELECT batch, n, unnest(['intercept', 'day_part', 'user_part']) AS term, round(unnest([w0, wa, wb]), 6) + 0.0 AS coefficient FROM w WHERE batch >= 0""",
)
def incremental_gradient(spark, sf):
    source = _batches(spark, sf)
    out = incremental.fit_gradient(source.stream(), ["day_part", "user_part"], "value", rate=0.3, arrivals=source)
    return out.select(F.col("batch").cast("long").alias("batch"), "n", "term", rounded("coefficient").alias("coefficient"))


@query("mixture_clusters")
def mixture_clusters(spark, sf):
    _, model, ready = ml.fit_clusters(vectors(spark, sf), "vector", 3, kind="gmm", variance=0.3)
    return model.transform(ready).select("vec_id", "prediction", F.array_max(vector_to_array("probability")).alias("confidence"))


@query("kmeans_k")
def kmeans_k(spark, sf):
    return ml.silhouettes(vectors(spark, sf), "vector", range(2, 6))


@query(
    "anomaly_below_p5",
    "WITH c AS (SELECT quantile_cont(c_acctbal, 0.05) AS cut FROM customer) SELECT c_custkey, c_acctbal < cut AS is_anomaly FROM customer, c",
)
def anomaly_below_p5(spark, sf):
    return ml.low_score_flag(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal")


def plane(spark, sf):
    """Documents by length and words per character, on a common scale."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.ln(F.col("n_chars") + 1.0).alias("a"), (F.size(F.split("text", " ")) * 10.0 / (F.col("n_chars") + 1)).alias("b"))


DB_SQL = r"""p AS (SELECT doc_id, ln(n_chars + 1.0) AS a, len(string_split(text, ' ')) * 10.0 / (n_chars + 1) AS b FROM documents),
  e AS (SELECT x.doc_id AS i, y.doc_id AS j FROM p x JOIN p y ON (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= 0.05 * 0.05),
  k AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 8),
  ce AS (SELECT i, j FROM e WHERE i IN (SELECT i FROM k) AND j IN (SELECT i FROM k)),
  rc AS (SELECT i, i AS root FROM k UNION SELECT ce.j, rc.root FROM rc JOIN ce ON ce.i = rc.i),
  cl AS (SELECT i, min(root) AS cluster FROM rc GROUP BY i)"""


@query(
    "dbscan",
    f"""WITH RECURSIVE {DB_SQL}, b AS (SELECT e.i, min(cl.cluster) AS cluster FROM e JOIN cl ON cl.i = e.j WHERE e.i NOT IN (SELECT i FROM k) GROUP BY e.i)
    SELECT p.doc_id, coalesce(cl.cluster, b.cluster, -1) AS cluster, cl.i IS NOT NULL AS is_core FROM p LEFT JOIN cl ON cl.i = p.doc_id LEFT JOIN b ON b.i = p.doc_id""",
)
def dbscan(spark, sf):
    return clustering.dbscan(plane(spark, sf), "doc_id", ["a", "b"], 0.05, 8)


@query(
    "lof",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    d AS (SELECT a.vec_id AS q, b.vec_id AS n, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    nb AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, n) <= 20), kd AS (SELECT q, max(d) AS kd FROM nb GROUP BY q),
    lr AS (SELECT nb.q, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.q = nb.n GROUP BY nb.q),
    f AS (SELECT nb.q AS vec_id, avg(o.lrd) / max(s.lrd) AS lof FROM nb JOIN lr o ON o.q = nb.n JOIN lr s ON s.q = nb.q GROUP BY nb.q)
    SELECT vec_id, {r('lof', 7)} AS lof, lof > (SELECT quantile_cont(lof, 0.9) FROM f) AS lof_flag FROM f""",
)
def lof(spark, sf):
    out = neighbours.local_outlier_factor(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", k=20)
    return out.withColumn("lof", rounded("lof", 7))


@query(
    "oversample",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, (SELECT max(n) FROM c) AS n, n AS distinct_rows FROM c""",
)
def oversample(spark, sf):
    rows = neighbours.oversample(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")
    per = rows.groupBy("label", "vec_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("label").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct_rows"))


@query(
    "smote",
    """WITH c AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality) SELECT quality, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS synthetic FROM c""",
)
def smote(spark, sf):
    rows = quality(spark, sf).select("doc_id", "quality", F.array("chars", "words", "english").alias("v"))
    out = neighbours.smote(rows, "quality", "doc_id", "v")
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("synthetic"))


@query(
    "stratified_split",
    "SELECT label, CAST(floor(count(*) * 0.8) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.8) AS BIGINT) AS test FROM embeddings GROUP BY label",
)
def stratified_split(spark, sf):
    out = ml.stratified_split(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label")
    return out.groupBy("label").agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"))


@query("label_models")
def label_models(spark, sf):
    rows = quality(spark, sf)
    labels = ["quality", "toxic"]
    out = None
    for chain in (False, True):
        models = ml.multilabel_models(rows, DOC, labels, chain)
        pred = ml.multilabel_predict(rows, models, chain)
        pred = pred.withColumns({f"{c}_true": F.col(c) for c in labels})
        row = multilabel(pred, labels)[0].withColumn("method", F.lit("chain" if chain else "binary relevance"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "powerset",
    f"""WITH c AS (SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'quality+toxic' WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'NONE' END AS combination FROM labels)
    SELECT combination, count(*) AS n, {r('count(*) / (SELECT count(*) FROM labels)')} AS share FROM c GROUP BY combination ORDER BY n DESC, combination LIMIT 10""",
)
def powerset(spark, sf):
    from ..operators.describe import value_shares

    rows = ml.powerset(table(spark, sf, "labels"), ["quality", "toxic"])
    return value_shares(rows, "combination").withColumn("share", rounded("share")).orderBy(F.desc("n"), "combination").limit(10)


@query("powerset_target")
def powerset_target(spark, sf):
    return ml.powerset_index(ml.powerset(table(spark, sf, "labels"), ["quality", "toxic"]))


@query("augmentation_gain")
def augmentation_gain(spark, sf):
    rows = quality(spark, sf).select("doc_id", *DOC, "label")
    train, test = ml.hash_split(rows, ["doc_id"])
    more = neighbours.oversample(train, "label", "doc_id").drop("copy")
    return ml.compare_training({"baseline": train, "oversampled": more.select(*train.columns)}, test, DOC)


@query("augmentation_ratios")
def augmentation_ratios(spark, sf):
    rows = quality(spark, sf).select("doc_id", *DOC, "label")
    train, test = ml.hash_split(rows, ["doc_id"])
    extra = neighbours.oversample(train, "label", "doc_id").filter(F.col("copy") > 0).select(*train.columns)
    return ml.ratio_sweep(train, extra, test, DOC, "doc_id", [0.5, 1.0])


@query("polynomial_search")
def polynomial_search(spark, sf):
    return ml.polynomial_search(prices(spark, sf), ["l_quantity", "l_discount"], [1, 2], folds=3)


@query("grid_search")
def grid_search(spark, sf):
    return ml.grid_search(prices(spark, sf), FEATURES, [0.01, 1.0], [0.0, 1.0], folds=3)


@query("expanding_validation")
def expanding_validation(spark, sf):
    rows = prices(spark, sf)
    return ml.expanding_validation(rows, FEATURES, F.unix_date(F.col("l_shipdate").cast("date")), [0.01, 1.0], folds=2, inner=2)


@query("saved_model_scores")
def saved_model_scores(spark, sf):
    """Fit, save with metadata, load again, score in one batch."""
    rows = prices(spark, sf)
    folder = stream_folder(spark, "model")
    save_model(ml.fit_regression(rows, FEATURES, "ridge"), folder, {"kind": "ridge", "features": FEATURES})
    model, meta = load_model(folder)
    return model.transform(rows).select(*ID, rounded("prediction", 4).alias("prediction"), F.lit(meta["kind"]).alias("kind"))


@query("tfidf_logistic")
def tfidf_logistic(spark, sf):
    rows = ml.class_weights(quality(spark, sf).select("doc_id", "text", "label"))
    scored = ml.score_texts(rows, ml.hash_train(["doc_id"]), 1000)
    return ml.evaluate_binary(ml.with_probability(scored))

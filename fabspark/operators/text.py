"""Text and log analytics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio_or
from ..session import spread
from .joins import word_overlap
from .ranks import attach_stats, stacked

# Optimum and tolerance by parameter and process.
OPTIMA = {
    "temperature": {"etch": (220.0, 10.0), "deposition": (400.0, 20.0), "cleaning": (80.0, 5.0)},
    "pressure": {"etch": (2.5, 0.5), "deposition": (0.1, 0.02), "cleaning": (2.0, 0.3)},
}
# Keywords looked for in maintenance texts.
KEYWORDS = [
    "emergency", "shutdown", "alarm", "critical", "failure",
    "temperature", "pressure", "flow", "vibration", "contamination",
    "maintenance", "routine", "check", "calibration", "cleaning",
]
EQUIPMENT_ID = r"[A-Z]+-\d+"
WORD = r"[\p{L}\p{N}_]{2,}"


def process_summary(logs: DataFrame, process: str = "process") -> DataFrame:
    return logs.groupBy(process).agg(
        F.count(F.lit(1)).alias("total_runs"), F.avg((F.col("severity") == "ERROR").cast("double")).alias("error_rate")
    )


def parameter_stats(logs: DataFrame, params: Sequence[str], process: str = "process") -> DataFrame:
    """Per process and parameter: mean, std, min, max, stability = std / mean."""
    long = stacked(logs, [process], params).withColumnRenamed("column", "parameter")
    v = F.col("value")
    return long.filter(v.isNotNull()).groupBy(process, "parameter").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.coalesce(F.try_divide(F.stddev_samp(v), F.avg(v)), F.lit(float("inf"))).alias("stability"),
    )


def parameter_recommendations(stats: DataFrame, process: str = "process", optima: dict = OPTIMA) -> DataFrame:
    """Off-optimum and variability findings with their priority. The knowledge
    base is a literal map, so nothing is joined."""
    entries = [x for param, procs in optima.items() for proc, (best, tol) in procs.items() for x in (F.lit(f"{proc}|{param}"), F.struct(F.lit(best).alias("best"), F.lit(tol).alias("tol")))]
    known = F.try_element_at(F.create_map(*entries), F.concat_ws("|", F.col(process), F.col("parameter")))
    rows = stats.withColumn("_k", known)
    gap = F.abs(F.col("mean") - F.col("_k.best"))
    tol = F.col("_k.tol")

    def finding(issue: str, measure: Column, target: Column, high: Column) -> Column:
        return F.struct(F.lit(issue).alias("issue"), measure.alias("measure"), target.alias("recommended_value"), F.when(high, "high").otherwise("medium").alias("priority"))

    found = F.array_compact(
        F.array(
            F.when(gap > tol, finding("off_optimum", gap, F.col("_k.best"), gap > 2 * tol)),
            F.when(F.col("stability") > 0.15, finding("high_variability", F.col("stability"), F.lit(None).cast("double"), F.col("stability") > 0.25)),
        )
    )
    return rows.select(process, "parameter", F.explode(found).alias("f")).select(process, "parameter", "f.*")


def failure_patterns(logs: DataFrame, ts: str, shift: str = "shift", process: str = "process", chamber: str = "chamber_id") -> DataFrame:
    """Error counts by hour (top 3), shift, process and chamber (top 5), from
    one pass with grouping sets."""
    errors = logs.filter(F.col("severity") == "ERROR").select(
        F.hour(ts).cast("string").alias("hour"), F.col(shift).alias("shift"), F.col(process).alias("process"), F.col(chamber).alias("chamber")
    )
    kinds = ["hour", "shift", "process", "chamber"]
    facts = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in kinds]
    # Four facts per error collapse in the partial aggregation.
    counts = errors.select(F.explode(F.array(*facts)).alias("x")).select("x.*").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "key")
    keep = F.when(F.col("kind") == "hour", 3).when(F.col("kind") == "chamber", 5)
    top = counts.filter(F.col("kind").isin("hour", "chamber")).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 5)
    top = top.filter(F.col("_rn") <= keep).drop("_rn")
    return counts.filter(F.col("kind").isin("shift", "process")).unionByName(top)


def opportunities(summary: DataFrame, recommendations: DataFrame, process: str = "process") -> DataFrame:
    """Unstable processes (error rate above 0.1) and processes with
    high-priority findings, with their parameters."""
    unstable = summary.filter(F.col("error_rate") > 0.1).select(
        F.lit("process_stability").alias("type"), F.col(process), F.array().cast("array<string>").alias("parameters")
    )
    high = recommendations.filter(F.col("priority") == "high").groupBy(process).agg(F.array_sort(F.collect_list("parameter")).alias("parameters"))
    return unstable.unionByName(high.select(F.lit("parameter_optimization").alias("type"), process, "parameters"))


def success_failure(logs: DataFrame, params: Sequence[str], process: str = "process") -> DataFrame:
    """Mean and deviation of each parameter in INFO and ERROR rows."""
    long = stacked(logs, [process, "severity"], params).withColumnRenamed("column", "parameter")
    ok, bad = (F.when(F.col("severity") == s, F.col("value")) for s in ("INFO", "ERROR"))
    out = long.groupBy(process, "parameter").agg(
        F.avg(ok).alias("success_mean"), F.avg(bad).alias("failure_mean"), F.stddev_samp(ok).alias("success_std"), F.stddev_samp(bad).alias("failure_std")
    )
    out = out.filter(F.col("success_mean").isNotNull() & F.col("failure_mean").isNotNull())
    return out.withColumn("difference", F.abs(F.col("success_mean") - F.col("failure_mean")))


def process_rules(comparison: DataFrame, process: str = "process", share: float = 0.1) -> DataFrame:
    """Rule texts where the difference passes a share of the success mean."""
    m = F.col("success_mean")
    hit = comparison.filter(F.col("difference") > m * share)
    text = F.when(
        m > F.col("failure_mean"),
        F.format_string("For %s: Maintain %s above %.2f for optimal results", F.col(process), F.col("parameter"), m),
    ).otherwise(F.format_string("For %s: Keep %s below %.2f to avoid failures", F.col(process), F.col("parameter"), m))
    return hit.select(process, "parameter", text.alias("rule"))


def equipment_ids(text: Column | str) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(EQUIPMENT_ID), F.lit(0))


def keywords(text: Column | str, words: Sequence[str] = KEYWORDS) -> Column:
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def keyword_counts(df: DataFrame, text: str, words: Sequence[str] = KEYWORDS, top: int = 10) -> DataFrame:
    rows = df.select(F.explode(keywords(text, words)).alias("keyword"))
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(top)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def text_stats(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    n, words = F.length(text), F.size(word_list(F.col(text)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("texts"), F.avg(n).alias("avg_length"), F.avg(words).alias("avg_words"), F.min(n).alias("min_length"), F.max(n).alias("max_length")
    )


def term_lists(df: DataFrame, text: str, ngrams: int = 1, stop_words: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Adds one array column per gram size: lower-case words of two or more
    characters without stop words, and their runs of up to ``ngrams`` words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    # Each step is a column of its own, so no word list is built twice.
    out = df.withColumn("_g1", words)
    for n in range(2, ngrams + 1):
        rest = F.slice(F.col("_g1"), n, F.greatest(F.size("_g1"), F.lit(1)))
        pairs = F.zip_with(F.col(f"_g{n - 1}"), rest, lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
        out = out.withColumn(f"_g{n}", F.array_compact(pairs))
    return out, [f"_g{n}" for n in range(1, ngrams + 1)]


def with_terms(df: DataFrame, text: str, name: str = "term", ngrams: int = 1, stop_words: Sequence[str] = ()) -> DataFrame:
    """One row per term of the text."""
    out, grams = term_lists(df, text, ngrams, stop_words)
    return out.withColumn(name, F.explode(F.concat(*grams))).drop(*grams)


# Distinct terms that a task counts before it hands them on.
FLUSH = 100_000


def runs_of(words: list[str], ngrams: int, stops: frozenset[str]) -> list[str]:
    """Words that are no stop words, and their runs of up to ``ngrams`` words."""
    if stops:
        words = [w for w in words if w not in stops]
    out = words
    for n in range(2, ngrams + 1):
        out = out + [" ".join(run) for run in zip(*(words[i:] for i in range(n)), strict=False)]
    return out


def inverse_frequencies(df: DataFrame, text: str, max_terms: int, ngrams: int = 1, stop_words: Sequence[str] = ()) -> DataFrame:
    """The most frequent terms with ln((1 + n) / (1 + df)) + 1."""
    # Words hold no white space, so a text travels as one string; terms are
    # counted per batch, and at most FLUSH of them are held by a task.
    words = df.select(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), " ").alias("words"))
    stops = frozenset(stop_words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf, df = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            terms = list(tf)
            numbers = [pa.array([c[t] for t in terms], pa.int64()) for c in (tf, df)]
            tf.clear()
            df.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *numbers], names=["term", "tf", "df"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for line in batch.column(0).slice(at, 256).to_pylist():
                    terms = runs_of((line or "").split(" "), ngrams, stops) if line else []
                    tf.update(terms)
                    df.update(set(terms))
                    if len(tf) > FLUSH:
                        yield rows()
        yield rows()

    counts = words.mapInArrow(run, "term string, tf long, df long").groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))
    top = counts.orderBy(F.desc("total"), "term").limit(max_terms)
    docs = df.agg(F.count(F.lit(1)).alias("_n"))
    out = attach_stats(top, docs, [])
    return out.select("term", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def sentences(df: DataFrame, key: str, text: str, min_length: int = 10) -> DataFrame:
    """(key, pos, sentence): parts between full stops longer than the limit."""
    parts = F.split(F.regexp_replace(text, "\n", " "), r"\.")
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.filter(trimmed, lambda s: F.length(s) > min_length)
    return df.select(key, F.posexplode(kept).alias("pos", "sentence"))


def extractive_summary(
    df: DataFrame, key: str, text: str, max_terms: int, take: int = 2, ngrams: int = 1, stop_words: Sequence[str] = ()
) -> DataFrame:
    """The best sentences by summed, length-normalised TF-IDF, in their order.

    Texts with at most ``take`` sentences stay whole; equal scores prefer the
    later sentence. Only the term table (at most ``max_terms`` rows) is shuffled
    and sent to all tasks; a text is scored where it is read.
    """
    df = spread(df.select(key, text))
    idf = {r["term"]: r["idf"] for r in inverse_frequencies(df, text, max_terms, ngrams, stop_words).collect()}  # at most max_terms
    known, stops = df.sparkSession.sparkContext.broadcast(idf), frozenset(stop_words)
    kept = F.filter(
        F.transform(F.split(F.regexp_replace(text, "\n", " "), r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 10
    )
    rows = df.withColumn("_kept", kept)
    # One string a text: a line a sentence, its words with spaces between.
    lines = F.transform("_kept", lambda s: F.array_join(F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)), " "))
    rows = rows.withColumn("_words", F.when(F.size("_kept") > take, F.array_join(lines, "\n")))

    def score(line: str) -> float:
        idf = known.value
        counts: dict[str, int] = {}
        for term in runs_of(line.split(" "), ngrams, stops):
            if term in idf:
                counts[term] = counts.get(term, 0) + 1
        weights = [c * idf[t] for t, c in counts.items()]
        # Rounding keeps ties ties whatever the order of summation.
        return round(math.fsum(weights) / math.sqrt(math.fsum([w * w for w in weights])), 9) if weights else 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = []
                for row, (whole, words) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    if words is None:
                        out.append(whole)
                        continue
                    scores = [score(w) for w in words.split("\n")]
                    best = sorted(range(len(scores)), key=lambda i: (-scores[i], -i))[:take]
                    parts = b.column(2)[row].values
                    out.append(". ".join(parts[i].as_py() for i in sorted(best)) + ".")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "summary"])

    return rows.select(key, text, "_kept", "_words").mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, summary string")


def summary_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Length similarity, word overlap and review loss of summaries."""
    nt, np_ = F.size(word_list(F.col(truth))), F.size(word_list(F.col(pred)))
    return df.agg(
        F.greatest(F.lit(0.0), 1 - ratio_or(F.avg(F.abs(nt - np_)), F.avg(nt))).alias("length_similarity"),
        F.avg(word_overlap(F.col(pred), F.col(truth))).alias("word_overlap"),
        (F.avg(F.abs(F.length(pred) - F.length(truth))) * 0.1).alias("estimated_loss"),
    )

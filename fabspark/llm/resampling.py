"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words, neighbouring words, runs of
characters in words) are counted: the target, over a bounded sample of rows
labelled good, and the raw text, over every document. A document's log weight is the sum of log ratios of target and raw
probability over its features, each drawn towards 0 the less it stands out of
its sampling error, so that many weak features add up. Documents are drawn without
replacement by Gumbel top-k: noise that depends on id and seed alone is added
to the log weights and the k largest keys stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, map_batches, pairs_schema, slices, texts_of

TOKEN = re.compile(r"\w+|[^\w\s]+")
GRAM = 5  # bytes; five of them fill a hash key exactly
WORDS, GRAMS, PAIRS = 1 << 17, 1 << 18, 1 << 16
BUCKETS = WORDS + GRAMS + PAIRS
RUNS = 8
MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier of 2^64 / golden ratio


class Hashes(dict):
    """Word hashes of a worker; starts anew when it holds ``room`` words."""

    room = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


HASHES = Hashes()


def hashes_of(words: Iterable[str], n: int) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every word and of the ``GRAM`` bytes around each
    of its bytes; two marks stand on either side of a word."""
    data = np.frombuffer(("\n\n" + "\n\n".join(words) + "\n\n").encode(), np.uint8)
    centre = np.flatnonzero(data != 10)
    key = np.zeros(len(centre), np.uint64)
    for k in range(GRAM):
        key |= data[centre + (k - GRAM // 2)].astype(np.uint64) << np.uint64(8 * k)
    owner = np.cumsum(data == 10)[centre] // 2 - 1
    grams = WORDS + ((key * MIX) >> np.uint64(46)).astype(np.int64)
    own = (hashes_of(words, len(words)) & np.uint64(WORDS - 1)).astype(np.int64)
    return np.concatenate([np.arange(len(words)), owner]), np.concatenate([own, grams])


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words from their hashes. Where a word
    repeats the one before, the bucket is the length of the run so far (up to
    ``RUNS`` repeats) whatever the word."""
    mixed = ((hashes[:-1] * MIX) ^ (hashes[1:] + (hashes[:-1] >> np.uint64(29)))) * MIX
    other = RUNS + ((mixed >> np.uint64(48)) % np.uint64(PAIRS - RUNS)).astype(np.int64)
    same = hashes[:-1] == hashes[1:]
    total = np.cumsum(same)
    run = total - np.maximum.accumulate(np.where(same, 0, total)) if len(total) else total
    return WORDS + GRAMS + np.where(same, np.minimum(run, RUNS) - 1, other)


def words_and_pairs(text: str) -> tuple[set[str], np.ndarray]:
    """Distinct words, and distinct buckets of neighbours: a text counts a
    feature once, so that repetition inside one text is no evidence."""
    words = TOKEN.findall(text.lower())
    return set(words), np.unique(pair_buckets(hashes_of(words, len(words))))


def labelled_sample(labels: DataFrame, id_col: str, quality_col: str, toxic_col: str, sample: int) -> dict:
    """{id: good} of at most ``sample`` labelled ids, those of smallest hash.
    A row is good with quality 1 that is not toxic; of repeated ids every row
    must be good. Null labels count as not given, null ids are left out."""
    good = (F.coalesce(col(quality_col), F.lit(1)) == 1) & (F.coalesce(col(toxic_col), F.lit(0)) == 0)
    known = labels.filter(col(id_col).isNotNull() & (col(quality_col).isNotNull() | col(toxic_col).isNotNull()))
    rows = known.groupBy(col(id_col).alias("id")).agg(F.min(good.cast("int")).alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample)
    return {r["id"]: bool(r["good"]) for r in rows.collect()}


def held_out(id_: object) -> bool:
    return xxhash.xxh64_intdigest(repr(id_), 3) % 5 == 0


def count_features(docs: DataFrame, target: set) -> DataFrame:
    """(bucket, raw, target): counts over all documents and over the target."""
    sent = docs.sparkSession.sparkContext.broadcast(target)  # at most the label sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        raw_words, aim_words = Counter(), Counter()

        def settle(words: Counter, sums: np.ndarray):
            owner, bucket = word_buckets(list(words))
            n = np.fromiter(words.values(), np.int64, len(words))
            sums += np.bincount(bucket, weights=n[owner], minlength=BUCKETS).astype(np.int64)
            words.clear()

        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), texts_of(b, 1), strict=True):
                words, pairs = words_and_pairs(t)
                raw_words.update(words)
                raw[pairs] += 1
                if i in sent.value:
                    aim_words.update(words)
                    aim[pairs] += 1
            if len(raw_words) > 400_000:
                settle(raw_words, raw)
                settle(aim_words, aim)
        settle(raw_words, raw)
        settle(aim_words, aim)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(aim[used])], names=["bucket", "raw", "target"])

    counts = map_batches(docs.select("id", "text"), run, "bucket int, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, smooth: float = 1.0, error: float = 4.0, common: float = 0.7) -> np.ndarray:
    """Log ratio per bucket, shrunk: by half at ``error`` deviations of the
    sampling error, and by half where it is ``common``, an error that all words
    of a language or a topic may share; none is set to 0. The table has one row
    per bucket at most."""
    rows = counts.toPandas()
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], aim[rows["bucket"]] = rows["raw"], rows["target"]
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORDS), slice(WORDS, WORDS + GRAMS), slice(WORDS + GRAMS, BUCKETS)):
        want = raw[part] * (aim[part].sum() / max(raw[part].sum(), 1))
        ratio = np.log((aim[part] + smooth) / (want + smooth))
        z = (aim[part] - want) / np.sqrt(want + 1)
        out[part] = ratio * z**4 / (z**4 + error**4) * ratio**2 / (ratio**2 + common**2)
    return out


def gumbel(id_: object, seed: int) -> float:
    u = (xxhash.xxh64_intdigest(repr(id_), seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def log_weights(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """(id, log_weight, key) per row."""
    kind = pairs_schema(docs, "id", "id", "log_weight double, key double")
    sent = docs.sparkSession.sparkContext.broadcast(ratios)  # a fixed number of buckets

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = sent.value
        weight: dict[str, float] = {}
        for b in slices(batches):
            found = [words_and_pairs(t) for t in texts_of(b, 1)]
            new = list(set().union(*(w for w, _ in found)).difference(weight))
            if len(weight) + len(new) > 300_000:
                weight.clear()
                new = list(set().union(*(w for w, _ in found)))
            owner, bucket = word_buckets(new)
            weight.update(zip(new, np.bincount(owner, weights=ratios[bucket], minlength=len(new)).tolist(), strict=True))
            w = np.array([sum(map(weight.__getitem__, words)) + float(ratios[pairs].sum()) for words, pairs in found], float)
            noise = np.array([gumbel(i, seed) for i in b.column(0).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(w + noise)], names=["id", "log_weight", "key"])

    return map_batches(docs.select("id", "text"), run, kind)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut that tells good from bad best: largest sum of the two rates of
    right answers, the middle of the gap. Without both kinds all is kept."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    right = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum() + 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    edge = np.concatenate([[True], s[1:] > s[:-1], [True]])  # between equal scores no cut is possible
    k = int(np.argmax(np.where(edge, right, -1)))
    return float(-np.inf if k == 0 else np.inf if k == len(s) else (s[k - 1] + s[k]) / 2)


def informative(weights: np.ndarray, good: np.ndarray, least: float = 2.33) -> bool:
    """Whether good labels have larger weights than bad ones beyond chance: the
    rank sum of the good ones, ties sharing their rank, against ``least``
    deviations (one in a hundred by chance)."""
    n, g = len(good), int(good.sum())
    _, which, times = np.unique(weights, return_inverse=True, return_counts=True)
    if not 0 < g < n or len(times) < 2:
        return False
    ranks = (np.cumsum(times) - (times - 1) / 2)[which]
    spread = g * (n - g) / 12 * (n + 1 - (times**3 - times).sum() / (n * (n - 1)))
    return bool(ranks[good].sum() - g * (n + 1) / 2 > least * np.sqrt(spread))


def kth_largest(scores: DataFrame, key: str, k: int, bins: int = 1024) -> float:
    """The k-th largest key, exactly: counts per bin narrow its interval."""
    low, high, n = scores.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return -np.inf
    while high > low and np.nextafter(low, high) < high:
        width = (high - low) / bins
        inside = scores.filter((F.col(key) >= low) & (F.col(key) <= high))
        bin_ = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1)).alias("bin")
        rows = inside.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("bin")).collect()  # one row per bin
        for r in rows:
            if k <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
        if len(rows) == 1 and r["n"] == 1:
            break
    return float(high if k == 1 else low)


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", sample: int = 20_000, seed: int = 7
) -> DataFrame:
    """(id, log_weight, key, kept) per row, ``kept`` for the k largest keys.

    Without ``k`` it is the number of documents above the cut that tells held
    out good and bad labels apart best, all where the weights do not tell them
    apart beyond chance. ``sample`` bounds the labelled rows used
    for fitting; the raw model and the draw cover every document. Null texts
    have no features and weight 0; ties at the k-th key all stay; rows that
    repeat an id share their noise; without labels all weights are 0 and every
    row stays; an empty table gives no rows.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    known = labelled_sample(labels, id_col, quality_col, toxic_col, sample)
    target = {i for i, good in known.items() if good and not held_out(i)}
    ratios = log_ratios(count_features(rows, target)) if target else np.zeros(BUCKETS)
    scores = cut_lineage(log_weights(rows, ratios, seed))
    if k is None:
        judged = scores.sparkSession.createDataFrame([(i, g) for i, g in known.items() if held_out(i)] or [(None, None)], f"id {rows.schema['id'].dataType.simpleString()}, good boolean")
        both = scores.join(F.broadcast(judged), "id").select("key", "good", "log_weight").collect()  # at most the label sample, and copies of its ids
        good = np.array([r[1] for r in both], bool)
        told = informative(np.array([r[2] for r in both], float), good)
        cut = best_cut(np.array([r[0] for r in both], float), good) if told else -np.inf
    else:
        cut = kth_largest(scores, "key", k) if k else np.inf
    return scores.withColumn("kept", F.col("key") >= F.lit(float(cut)))


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows whose id is drawn; a row without an id stays."""
    gone = resample(docs, labels, id_col=id_col, **options).filter(~F.col("kept")).select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[col(c) for c in docs.columns])

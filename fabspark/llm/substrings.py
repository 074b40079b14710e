"""Substring de-duplication by sliding spans of sentences.

Every run of consecutive sentences (at least ``least`` of them and ``words``
words, or one sentence of so many words; from each sentence the shortest run
that starts there and the shortest that ends there) is hashed to 128 bits. A global join finds the runs
that stand in several documents; the document with the smallest id keeps a run,
elsewhere, and on repeats inside a document, its sentences go. A passage that
repeats is covered by runs from its first whole sentence to its last.

Longer sentences are cut inside, so "sentence" means a part of at most ``LONG``
words here. Wherever a repeated passage begins and ends, at most ``LONG`` words
at either end lie in parts that it shares with other text. Every passage of
over 50 words therefore has 21 words or more in common parts: at least two of
them, a run with the defaults of ``least`` and ``words``.

Runs are shuffled once: their count and the equi-join back read the same
shuffle. A run that n documents hold is n rows of some 30 bytes there, which
are counted and joined as they stream by; no group is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, map_batches, slices, sql_type, texts_of

SENTENCE = re.compile("[.!?…][\"'”’)\\]]*\\s+|[。！？｡]+[\"'”’)\\]」』）】》〉]*\\s*|\n\\s*")
CLAUSE = re.compile(r"[,;:]\s+|[，、；：､]\s*")
# Scripts without spaces between words (Thai to Myanmar, Khmer, kana, ideographs): a character is a word.
BARE = "\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
ANY_BARE = re.compile(f"[{BARE}]")
UNIT = re.compile(rf"[{BARE}]|[^\s{BARE}]+")
WORD = re.compile(rf"(?:[{BARE}]|[^\s{BARE}]+)\s*")
LONG, WINDOW = 15, 10
# Odd multipliers of two polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def sentences(text: str, places: bool = True) -> tuple[list[int], list[str], list[int]]:
    """Ends of the sentences (white space after them included), their text
    lower-cased with single spaces, and their numbers of words. Without
    ``places`` ends inside a clause are not worked out. In scripts without
    spaces each character counts as a word.

    Of sentences above ``LONG`` words the clauses stand for sentences, and a
    clause above ``LONG`` words is cut after the word of smallest hash of every
    ``WINDOW`` neighbouring ones: cuts depend on the words at hand, so equal
    passages are cut alike anywhere, at least once in ``WINDOW`` words.
    """
    ends: list[int] = []
    parts: list[str] = []
    counts: list[int] = []
    long: list[tuple[int, int, list[str]]] = []
    split = UNIT.findall if not text.isascii() and ANY_BARE.search(text) else str.split

    def put(words: list[str], end: int) -> None:
        ends.append(end)
        parts.append(" ".join(words).lower())
        counts.append(len(words))

    for lo, hi in _cuts(SENTENCE, text, 0, len(text)):
        words = split(text[lo:hi])
        if len(words) <= LONG:
            put(words, hi)
            continue
        for a, b in _cuts(CLAUSE, text, lo, hi):
            words = split(text[a:b])
            put(words, b)
            if len(words) > LONG:
                long.append((len(parts) - 1, a, parts[-1].split(" ")))
    if not long:
        return ends, parts, counts
    cuts = _smallest([words for *_, words in long])
    out: tuple[list[int], list[str], list[int]] = ([], [], [])
    done = 0
    for (at, start, words), stops in zip(long, cuts, strict=True):
        for one, all_ in zip((ends, parts, counts), out, strict=True):
            all_ += one[done:at]
        stops = [*stops, len(words)] if not stops or stops[-1] < len(words) else stops
        place = [m.end() for m in WORD.finditer(text, start, ends[at])] if places else None
        before = 0
        for stop in stops:
            out[0].append(place[stop - 1] if place else ends[at])
            out[1].append(" ".join(words[before:stop]))
            out[2].append(stop - before)
            before = stop
        done = at + 1
    for one, all_ in zip((ends, parts, counts), out, strict=True):
        all_ += one[done:]
    return out


def _smallest(clauses: list[list[str]]) -> list[list[int]]:
    """Per clause the numbers of words up to each cut: behind the word of
    smallest hash, the last of equal ones, of every window of words."""
    sizes = np.fromiter(map(len, clauses), np.int64, len(clauses))
    n = int(sizes.sum())
    hashes = np.fromiter((xxhash.xxh32_intdigest(w) for words in clauses for w in words), np.uint64, n)
    least = (hashes << np.uint64(32)) | np.arange(n, 0, -1, dtype=np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    owner = np.repeat(np.arange(len(clauses)), sizes)
    inside = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    found = n - np.unique(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)[::-1]
    start = np.cumsum(sizes) - sizes
    of = owner[found]
    edges = np.searchsorted(of, np.arange(len(clauses) + 1))
    after = (found + 1 - start[of]).tolist()
    return [after[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _cuts(pattern: re.Pattern, text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    at = lo
    for m in pattern.finditer(text, lo, hi):
        yield at, m.end()
        at = m.end()
    if at < hi:
        yield at, hi


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs(parts: list[str], counts: list[int], least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence and the 128-bit hash (two columns) of each run."""
    n = len(parts)
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    at = np.arange(n)
    alone = np.diff(upto) >= words
    end = np.where(alone, at + 1, np.maximum(np.searchsorted(upto, upto[:-1] + words), at + least))  # shortest run from here on
    start = np.where(alone, at, np.minimum(np.searchsorted(upto, upto[1:] - words, side="right") - 1, at + 1 - least))  # shortest run up to here
    ahead, back = end <= n, start >= 0
    pairs = np.unique(np.concatenate([at[ahead] * (n + 1) + end[ahead] - 1, start[back] * (n + 1) + at[back]]))
    first, last = np.divmod(pairs, n + 1)
    own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p.encode()) for p in parts), "<u8").reshape(n, 2)
    hashes = np.empty((len(first), 2), np.uint64)
    for k, base in enumerate(BASES):
        # Sums of own[i] * base^i; a difference, moved to start at power 0, is the run's hash.
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own[:, k] * _powers(base, n), dtype=np.uint64)])
        hashes[:, k] = (total[last + 1] - total[first]) * _powers(pow(base, -1, 1 << 64), n)[first]
    return first, last, hashes


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, words: int = 15) -> DataFrame:
    """(high, low, id, again): each document's distinct runs, ``again`` for
    those that it holds more than once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, found, again = [], [], []
            for n, t in enumerate(texts_of(b, 1)):
                _, parts, counts = sentences(t, places=False)
                if sum(counts) < words:
                    continue
                _, _, hashes = runs(parts, counts, least, words)
                high, first, times = np.unique(hashes[:, 0], return_index=True, return_counts=True)
                row.append(np.full(len(high), n))
                found.append(hashes[first])
                again.append(times > 1)
            if row:
                both = np.concatenate(found).view(np.int64)
                cells = [pa.array(both[:, 0]), pa.array(both[:, 1]), b.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(again))]
                yield pa.RecordBatch.from_arrays(cells, names=["high", "low", "id", "again"])

    rows = docs.filter(col(id_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"))
    return map_batches(rows, run, f"high long, low long, id {sql_type(docs, id_col)}, again boolean")


def clean(text: str, repeated: list[int], least: int, words: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without sentences of ``repeated`` runs (by the high half of
    their hash) and of runs that stand further up in the same text; with the
    character ranges removed."""
    ends, parts, counts = sentences(text)
    first, last, hashes = runs(parts, counts, least, words)
    high = hashes[:, 0].view(np.int64)
    once = np.zeros(len(high), bool)
    once[np.unique(high, return_index=True)[1]] = True
    bad = ~once | np.isin(high, np.array(repeated, np.int64))
    change = np.zeros(len(parts) + 1, np.int64)
    np.add.at(change, first[bad], 1)
    np.add.at(change, last[bad] + 1, -1)
    gone = np.cumsum(change) > 0
    ranges: list[tuple[int, int]] = []
    kept, start = [], 0
    for n, end in enumerate(ends):
        if not gone[n]:
            kept.append(text[start:end])
        elif ranges and ranges[-1][1] == start:
            ranges[-1] = (ranges[-1][0], end)
        else:
            ranges.append((start, end))
        start = end
    return "".join(kept).rstrip() if ranges else text, ranges


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, words: int = 15) -> DataFrame:
    """``docs`` with the cleaned text and _removed, an array of start and end of
    the character ranges taken out of the given text; a column of that name is
    replaced.

    Texts without a repeated run come back as they are; null stays null, a text
    that is all repeats becomes empty. Rows that repeat an id count as one
    document and keep what that document keeps; rows without an id take no part
    and stay. An empty table gives none.
    """
    docs = docs.drop("_removed")
    mark = fresh(docs, "_repeated")
    # Dealt out once: count and join read the same shuffle, so texts are cut once. The
    # join would filter one side by id: filtered here, both sides stay the same plan.
    found = spans(docs, id_col, text_col, least, words).filter("high IS NOT NULL AND low IS NOT NULL AND id IS NOT NULL").repartition("high", "low")
    more = F.sum(F.when(F.col("again"), 2).otherwise(1))
    first = found.groupBy("high", "low").agg(F.min("id").alias("first"), more.alias("n")).filter("n > 1").drop("n")
    hits = found.join(first, ["high", "low"]).filter((F.col("id") != F.col("first")) | F.col("again"))
    later = hits.groupBy("id").agg(F.collect_set(F.when(F.col("id") != F.col("first"), F.col("high"))).alias(mark))
    rows = docs.join(later.withColumnRenamed("id", id_col), id_col, "left").select(*[col(c) for c in docs.columns], col(mark))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, removed = b.column(at).to_pylist(), []
            for n, repeated in enumerate(b.column(b.num_columns - 1).to_pylist()):
                ranges = []
                if texts[n] and repeated is not None:
                    texts[n], ranges = clean(texts[n], repeated, least, words)
                removed.append([{"start": s, "end": e} for s, e in ranges])
            cells = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*cells, pa.array(removed, kind)], names=[*names, "_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(rows, run, f"{schema}, _removed array<struct<start:bigint,end:bigint>>")



"""Benchmark decontamination over a positional inverted index of the corpus.

The corpus is indexed in blocks of whole documents. A block is one row: its
documents, its terms (64-bit word hashes, sorted) and, per term, the ascending
positions where it stands; a document starts one position after the end of the
one before, so no phrase crosses documents. The index does not depend on the
benchmark, is stored once and has no shuffle: a frequent word only makes longer
lists inside blocks of bounded size.

Phrases are broadcast in slices of at most ``SLICE`` words. In a block, the
terms of a phrase are ordered by the length of their lists there; the positions
of the rarest, moved back by its offset, are the candidate starts, and each
further list, moved by its own offset, is intersected with what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, map_batches, slices, sql_type, texts_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SLICE = 1_000_000


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; a word is a run of a-z, 0-9 and all that is not ASCII."""
    return WORD.findall(text.encode().lower())


def term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = 400_000) -> DataFrame:
    """One row per block: block (any number), ids, n_words and starts per
    document, terms, offsets into positions per term, positions."""
    kind = sql_type(docs, id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        vocabulary: dict[bytes, int] = {}
        ids, counts, held, size = [], [], [], 0

        def row():
            stream = np.concatenate(held)
            hashes = np.fromiter((term(w) for w in vocabulary), np.uint64, len(vocabulary))
            rank = np.argsort(hashes, kind="stable")
            place = np.empty(len(rank) + 1, np.int32)
            place[rank] = np.arange(len(rank), dtype=np.int32)
            place[-1] = len(rank)  # the position between documents
            coded = place[stream]
            positions = np.argsort(coded, kind="stable").astype(np.int32)
            offsets = np.searchsorted(coded[positions], np.arange(len(rank) + 1)).astype(np.int32)
            starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)[:-1]]).astype(np.int64)
            data = [np.int64(block), pa.array(ids, type=id_type), counts, starts, hashes[rank].tobytes(), offsets.tobytes(), positions[: offsets[-1]].tobytes()]
            cells = [pa.array([data[0]], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], data[1])]
            cells += [pa.array([x], pa.list_(pa.int64())) for x in data[2:4]] + [pa.array([x], pa.binary()) for x in data[4:]]
            return pa.RecordBatch.from_arrays(cells, names=["block", "ids", "n_words", "starts", "terms", "offsets", "positions"])

        id_type = None
        for b in slices(batches):
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), texts_of(b, 1), strict=True):
                found = words_of(t)
                add = vocabulary.setdefault
                coded = [add(w, len(vocabulary)) for w in found]
                held.append(np.array([*coded, -1], np.int32))
                ids.append(i)
                counts.append(len(found))
                size += len(found) + 1
                if size >= block_words:
                    yield row()
                    block, size = block + 1, 0
                    vocabulary.clear(), ids.clear(), counts.clear(), held.clear()
        if ids:
            yield row()

    schema = f"block long, ids array<{kind}>, n_words array<bigint>, starts array<bigint>, terms binary, offsets binary, positions binary"
    # Stored at once: block numbers must not change between uses.
    return cut_lineage(map_batches(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), run, schema))


class Block:
    """The postings of one block for a sorted set of terms."""

    def __init__(self, terms: bytes, offsets: bytes, positions: bytes, wanted: np.ndarray):
        known, offsets, positions = np.frombuffer(terms, np.uint64), np.frombuffer(offsets, np.int32), np.frombuffer(positions, np.int32)
        at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        here = known[at] == wanted if len(known) else np.zeros(len(wanted), bool)
        self.start = np.where(here, offsets[at], 0).astype(np.int64)
        self.length = np.where(here, offsets[at + 1] - offsets[at] if len(known) else 0, 0).astype(np.int64)
        self.positions = positions
        self.span = int(positions.max(initial=0)) + 1
        have = np.flatnonzero(self.length)
        picked = np.repeat(self.start[have] - np.cumsum(self.length[have]) + self.length[have], self.length[have]) + np.arange(self.length[have].sum())
        # (term, position) as one ascending key: the lists joined end to end.
        self.keys = np.repeat(have, self.length[have]) * self.span + positions[picked]

    def expand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) for every posting of each row's term."""
        n = self.length[terms]
        row = np.repeat(np.arange(len(terms)), n)
        return row, self.positions[np.repeat(self.start[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)

    def holds(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = terms * self.span + at
        ok = (at >= 0) & (at < self.span)
        if not len(self.keys):
            return np.zeros(len(key), bool)
        return ok & (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key)

    def phrases(self, table: np.ndarray, tile: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence; rows of ``table`` are term
        numbers, -1 after a phrase's end."""
        size = np.where(table < 0, np.iinfo(np.int64).max, self.length[np.maximum(table, 0)])
        rows = np.flatnonzero(size.min(1) > 0)
        order = np.argsort(size[rows], axis=1, kind="stable")
        lists = size[rows, order[:, 0]] if len(rows) else np.zeros(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(lists[lo:]), tile, side="right")) + lo)
            pick, by = rows[lo:hi], order[lo:hi]
            row, at = self.expand(table[pick, by[:, 0]])
            start = at - by[row, 0]
            for k in range(1, table.shape[1]):
                offset = by[row, k]
                t = table[pick[row], offset]
                ok = (t < 0) | self.holds(np.maximum(t, 0), start + offset)
                row, start = row[ok], start[ok]
                if not len(row):
                    break
            found.append((pick[row], start))
            lo = hi
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Phrases:
    """Windows of the items of one slice, ready for lookups in blocks."""

    def __init__(self, items: list[tuple[object, str]], window: int | None):
        self.items = [i for i, _ in items]
        rows, owner = [], []
        for n, (_, text) in enumerate(items):
            w = [term(x) for x in words_of(text or "")]
            size = window or max(len(w), 1)
            for at in range(max(len(w) - size, 0) + 1) if w else ():
                rows.append(w[at : at + size])
                owner.append(n)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.owner = np.array(owner, np.int64)
        self.terms = np.unique(np.array([t for r in rows for t in r], np.uint64))
        self.table = np.full((len(rows), int(self.lengths.max(initial=0))), -1, np.int64)
        for r, words in enumerate(rows):
            self.table[r, : len(words)] = np.searchsorted(self.terms, np.array(words, np.uint64))


def phrase_slices(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Items in slices of at most ``SLICE`` bytes of text (or one item)."""
    held, size = [], 0
    for r in benchmark.select(col(item_col).alias("i"), col(text_col).alias("t")).filter("t IS NOT NULL").toLocalIterator():
        if held and size + len(r.t) > SLICE:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t)
    if held:
        yield held


def phrase_matches(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int | None = 13) -> DataFrame:
    """(block, at, items, spans) per document with a match and slice of items:
    the items found and the merged (start, end) word ranges their windows cover.

    An item with fewer words than a window is one window; ``window=None`` takes
    whole items. Items without words match nothing.
    """
    spark, kind = index.sparkSession, sql_type(benchmark, item_col)
    schema = f"block long, at int, items array<{kind}>, spans array<struct<start:bigint,end:bigint>>"
    out = spark.createDataFrame([], schema)
    for items in phrase_slices(benchmark, item_col, text_col):
        key = spark.sparkContext.broadcast(Phrases(items, window))

        def run(batches: Iterable[pa.RecordBatch], key=key) -> Iterator[pa.RecordBatch]:
            p = key.value
            if not len(p.table):
                return
            for b in slices(batches, 1):
                starts = b.column("starts")[0].values.to_numpy()
                blk = Block(*(b.column(c)[0].as_py() for c in ("terms", "offsets", "positions")), p.terms)
                phrase, at = blk.phrases(p.table)
                if not len(at):
                    continue
                doc = np.searchsorted(starts, at, side="right") - 1
                by = np.lexsort((at, doc))
                rows = []
                cuts = np.flatnonzero(np.diff(doc[by])) + 1
                for part in np.split(by, cuts):
                    d = int(doc[part[0]])
                    spans = []
                    for s, e in sorted(zip(at[part].tolist(), (at[part] + p.lengths[phrase[part]]).tolist(), strict=True)):
                        if spans and s <= spans[-1]["end"]:
                            spans[-1]["end"] = max(spans[-1]["end"], e)
                        else:
                            spans.append({"start": s, "end": e})
                    items = [p.items[o] for o in np.unique(p.owner[phrase[part]])]
                    rows.append({"block": b.column("block")[0].as_py(), "at": d, "items": items, "spans": [{k: v - int(starts[d]) for k, v in s.items()} for s in spans]})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out.schema)
        out = out.union(map_batches(index.select("block", "starts", "terms", "offsets", "positions"), run, schema))
    return out


def proximity_matches(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", slack: int = 5) -> DataFrame:
    """(block, at, item, start, end) for places where all distinct words of an
    item stand within its word count plus ``slack`` words, in any order; each is
    the shortest such range that ends at its last word."""
    spark, kind = index.sparkSession, sql_type(benchmark, item_col)
    schema = f"block long, at int, item {kind}, start long, end long"
    out = spark.createDataFrame([], schema)
    for items in phrase_slices(benchmark, item_col, text_col):
        key = spark.sparkContext.broadcast(Phrases(items, None))

        def run(batches: Iterable[pa.RecordBatch], key=key) -> Iterator[pa.RecordBatch]:
            p = key.value
            for b in slices(batches, 1):
                starts = b.column("starts")[0].values.to_numpy()
                blk = Block(*(b.column(c)[0].as_py() for c in ("terms", "offsets", "positions")), p.terms)
                rows = []
                for r in range(len(p.table)):
                    terms = np.unique(p.table[r, : p.lengths[r]])
                    if blk.length[terms].min() == 0:
                        continue
                    reach = int(p.lengths[r]) + slack
                    which, at = blk.expand(terms)
                    rare = np.sort(at[which == np.argmin(blk.length[terms])])
                    # Only postings within reach of the rarest word can take part.
                    side = np.searchsorted(rare, at)
                    gap = np.minimum(np.abs(rare[np.minimum(side, len(rare) - 1)] - at), np.abs(rare[np.maximum(side - 1, 0)] - at))
                    near = gap < reach
                    which, at = which[near], at[near]
                    by = np.argsort(at, kind="stable")
                    last: dict[int, int] = {}
                    for w, x in zip(which[by].tolist(), at[by].tolist(), strict=True):
                        last.pop(w, None)
                        last[w] = x  # ordered by last place: the first entry is the oldest
                        low = next(iter(last.values()))
                        if len(last) == len(terms) and x - low < reach:
                            d = int(np.searchsorted(starts, low, side="right")) - 1
                            if d == int(np.searchsorted(starts, x, side="right")) - 1:
                                rows.append({"block": b.column("block")[0].as_py(), "at": d, "item": p.items[p.owner[r]], "start": low - int(starts[d]), "end": x + 1 - int(starts[d])})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out.schema)
        out = out.union(map_batches(index.select("block", "starts", "terms", "offsets", "positions"), run, schema))
    return out


def indexed_documents(index: DataFrame) -> DataFrame:
    """(block, at, id, n_words): the documents of an index."""
    return index.select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("at", "d")).select("block", "at", F.col("d.ids").alias("id"), F.col("d.n_words").alias("n_words"))


def _covered(spans: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(s["end"] - F.greatest(a["upto"], s["start"]), F.lit(0).cast("long"))).alias("n")),
        lambda a: a["n"],
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20
) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) per row of ``docs``.

    A word is hit inside any occurrence of an item's window; a document is
    contaminated from one hit word in ``share`` on. Null and empty texts have no
    words and are clean; rows that repeat an id stay rows of their own; without
    items every document is clean; without documents there are no rows.
    """
    index = build_index(docs, id_col, text_col)
    found = phrase_matches(index, benchmark, item_col, item_text, window)
    merged = found.groupBy("block", "at").agg(_covered(F.flatten(F.collect_list("spans"))).alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    all_docs = indexed_documents(index).join(merged, ["block", "at"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast(merged.schema["items"].dataType))
    return all_docs.select("id", "n_words", n_hit.alias("n_hit"), items.alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose id has no contaminated text; rows without an id stay."""
    bad = contamination(docs, benchmark, id_col, text_col, **options).filter("contaminated").select(F.col("id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*[col(c) for c in docs.columns])

"""Near-duplicates by 64-bit SimHash fingerprints, compared in bit slices.

Equal fingerprints are merged first. Two fingerprints within the radius agree
on at least ``blocks - radius`` of ``blocks`` bit blocks, so each is posted
under every choice of that many blocks and only fingerprints of one bucket are
compared; no link can be missed. With 7 blocks a bucket shares 27 bits, so chance
company stays rare up to some 10^8 fingerprints; more ask for 8 blocks. Buckets above ``chunk`` fingerprints are cut
into chunks, and a task compares two chunks at a time. A bucket is stored as
64 bit planes: one machine word holds one bit of 64 fingerprints, distances of
64 candidates are summed at once by carry-save adders, and words whose 64
distances all exceed the radius are abandoned. Each comparison returns a
spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, map_batches, pairs_schema, slices, texts_of
from .components import components, with_group_min

BITS = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """Majority of the bits of all shingle hashes; zero for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.dtype("<u8"), n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) per row; A-Z lower-cased, words end at ASCII white space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts_of(b, 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return map_batches(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), run, pairs_schema(docs, id_col, "id", "fp long"))


class Links:
    """Union of numbered nodes from arrays of links; roots are smallest numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class Distances:
    """Counters of 64 distances per word, one bit plane per binary digit."""

    def __init__(self, n: int, radius: int):
        self.radius = radius
        self.digits = [np.zeros(n, np.uint64) for _ in range(radius.bit_length())]
        self.high = np.zeros(n, np.uint64)

    def add_three(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
        half = x ^ y
        one = half ^ z
        two = (x & y) | (half & z)
        carries = [one]
        for k, digit in enumerate(self.digits):
            # A full adder of the digit, the carry from below and, at weight two, the adder's own carry.
            terms = carries + ([two] if k == 1 else [])
            total, carries = digit, []
            for t in terms:
                carries.append(total & t)
                total = total ^ t
            self.digits[k] = total
        if len(self.digits) < 2:
            carries = [*carries, two]
        for c in carries:
            self.high |= c

    def beyond(self) -> np.ndarray:
        """Bits set where the distance exceeds the radius."""
        above, equal = self.high, ~self.high
        for k in reversed(range(len(self.digits))):
            if self.radius >> k & 1:
                equal = equal & self.digits[k]
            else:
                above = above | (equal & self.digits[k])
                equal = equal & ~self.digits[k]
        return above

    def keep(self, rows: np.ndarray) -> None:
        self.digits = [d[rows] for d in self.digits]
        self.high = self.high[rows]


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit k of every fingerprint; the length is a multiple of 64."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def forest(groups: list[tuple[np.ndarray, np.ndarray]], radius: int, tile: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of every group: fingerprints of one array
    against each other, or of the first array against the second.

    ``groups`` holds (left, right); an empty right means within left.
    """
    lanes, starts, queries, query_node, first, count = [], 0, [], [], [], []
    valid = []
    for left, right in groups:
        other = right if len(right) else left
        words = -(-len(other) // BITS)
        pad = np.zeros(words * BITS, np.uint64)
        pad[: len(other)] = other
        lanes.append(pad)
        ok = np.zeros(words * BITS, np.uint8)
        ok[: len(other)] = 1
        valid.append(ok)
        queries.append(left)
        # Within one array a fingerprint meets only the words from its own on.
        skip = np.arange(len(left)) // BITS if not len(right) else np.zeros(len(left), np.int64)
        first.append(starts + skip)
        count.append(words - skip)
        query_node.append(starts * BITS + np.arange(len(left)) if not len(right) else np.full(len(left), -1))
        starts += words
    lane_fp, q = np.concatenate(lanes), np.concatenate(queries).astype(np.uint64)
    bits, ok = planes(lane_fp), np.packbits(np.concatenate(valid), bitorder="little").view("<u8")
    node = np.concatenate(query_node)
    extra = np.flatnonzero(node < 0)
    node[extra] = len(lane_fp) + np.arange(len(extra))
    all_fp = np.concatenate([lane_fp, q[extra]])
    links = Links(len(all_fp))
    first, count = np.concatenate(first), np.concatenate(count)
    ends = np.cumsum(count)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, tile):
        item = np.arange(lo, min(lo + tile, int(ends[-1])))
        who = np.searchsorted(ends, item, side="right")
        word = first[who] + item - (ends[who] - count[who])
        d = Distances(len(item), radius)
        for k in range(0, BITS, 3):
            part = [bits[j][word] ^ (np.uint64(0) - (q[who] >> np.uint64(j) & np.uint64(1))) if j < BITS else np.zeros(len(word), np.uint64) for j in (k, k + 1, k + 2)]
            d.add_three(*part)
            if k % 9 == 6:
                alive = (d.beyond() | ~ok[word]) != ONES
                if alive.sum() < 0.7 * len(alive):
                    d.keep(alive)
                    who, word = who[alive], word[alive]
                    if not len(who):
                        break
        near = ~d.beyond() & ok[word]
        hit = np.flatnonzero(near)
        if len(hit):
            lane = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, at = np.nonzero(lane)
            a, b = node[who[hit[row]]], word[hit[row]] * BITS + at
            links.join(a[a != b], b[a != b])
    child = np.flatnonzero(links.root != np.arange(len(all_fp)))
    return all_fp[child], all_fp[links.root[child]]


def near_links(distinct: DataFrame, radius: int = 4, blocks: int = 7, chunk: int = 4096) -> DataFrame:
    """(src, dst): links that connect the same fingerprints as all links within
    the radius. ``distinct`` holds each fingerprint once as ``fp``."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        keys.append(F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    posted = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.bits")
    shared = posted.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark sizes ``posted`` as if it had a row per fingerprint; unless told to merge, it would send all of it through the driver.
    cut = posted.hint("merge").join(shared.hint("merge"), ["t", "bits"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    cut = cut.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("c", j).alias("lo"), F.greatest("c", j).alias("hi")))
    sent = cut.select("t", "bits", "fp", "c", F.explode(pairs).alias("p")).select("t", "bits", "p.lo", "p.hi", "c", "fp")
    groups = sent.groupBy("t", "bits", "lo", "hi").agg(
        F.collect_list(F.when(F.col("c") == F.col("lo"), F.col("fp"))).alias("a"),
        F.collect_list(F.when(F.col("c") != F.col("lo"), F.col("fp"))).alias("b"),
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def flush():
                if held:
                    found.append(forest(held, radius))
                    held.clear()

            lo, hi = b.column("lo").to_numpy(), b.column("hi").to_numpy()
            for i in range(b.num_rows):
                left, right = (b.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b"))
                if lo[i] != hi[i] and not (len(left) and len(right)):
                    continue
                held.append((left, right))
                size += len(left) + len(right)
                if size > 4096:
                    flush()
                    size = 0
            flush()
            if found:
                src, dst = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return map_batches(groups.select("lo", "hi", "a", "b"), compare, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42, blocks: int = 7) -> DataFrame:
    """(id, fp, component) per row: the smallest id that links reach.

    Null and word-free texts have fingerprint zero and link like any other.
    Rows that repeat an id stay rows of their own. A null id gets the component
    of its texts; a component without any id is null. Very long texts are whole;
    further columns, of any name, take no part. An empty table gives none.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("smallest"))
    linked = components(cut_lineage(near_links(distinct.select("fp"), radius, blocks)))
    classed = distinct.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp")).drop("component")
    of = with_group_min(classed, "class", "smallest", "component", "fp").select("fp", "component")
    return prints.join(of, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of each group's smallest id; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.filter(F.col("id") != F.col("component")).select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[col(c) for c in docs.columns])

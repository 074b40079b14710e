"""Near-duplicates by exact Jaccard similarity, found by chosen paths.

A document's set of word shingles has ``tokens`` minwise hashes. A tree sends
the documents of a node to children by ``picks`` of these, chosen anew by the
node's name, so that a pair parts only if it differs in all that are picked. A
node of at most ``leaf`` documents is compared exhaustively; a larger one is
branched again while that at least halves its comparisons, and is else compared
in blocks of bounded size. Independent trees bring the share of links missed at
the threshold below 1e-7 (:func:`missed`). Nodes with the same members in
several trees are compared once.

Comparisons in a node count equal minwise hashes, one byte each, against a
bound that a true link misses with a chance below 1e-9; a node returns a
spanning forest of its likely links. Texts then travel once to the likely
component they are in, where links are confirmed on the full sets, skipping
pairs that are already connected. Components above ``block`` documents are
confirmed block against block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, map_batches, pairs_schema, slices, texts_of
from .components import components, with_group_min
from .simhash import Links

TOKENS = 128
_SEED = np.random.default_rng(13)
MIX = _SEED.integers(0, 1 << 64, (2, TOKENS), np.uint64) | np.uint64(1)
POWERS = _SEED.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the runs of ``words`` words; of the
    whole sequence if it is shorter; none without words."""
    split = text.encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
    size = min(words, len(split))
    runs = np.full(len(split) - size + 1, size, np.uint64)
    for i in range(size):
        runs += hashes[i : i + len(runs)] * POWERS[i]
    return np.unique(runs ^ (runs >> np.uint64(29)))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """``TOKENS`` minwise hashes of 32 bits."""
    low = np.full(TOKENS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[at : at + 1024, None] ^ MIX[0]) * MIX[1]
        np.minimum(low, (mixed >> np.uint64(32)).min(0), out=low)
    return low.astype("<u4")


def agree_at_least(percent: int, risk: float = 1e-9) -> int:
    """Equal tokens that a pair of that similarity fails to have with a chance
    of at most ``risk``."""
    p = percent / 100
    total = 0.0
    for k in range(TOKENS + 1):
        total += comb(TOKENS, k) * p**k * (1 - p) ** (TOKENS - k)
        if total > risk:
            return k
    return TOKENS


def missed(percent: int, trees: int, picks: int, depth: int) -> float:
    """Chance that no tree of that depth brings a pair of that similarity together."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - (1 - percent / 100 * meet) ** picks
    return (1 - meet) ** trees


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, key, n, tokens, bytes) per row: the text's hash, the size of its
    set, its minwise hashes, and a byte of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, words) for t in texts_of(b, 2)]
            tokens = [minwise(s) for s in sets]
            cells = [pa.array([len(s) for s in sets], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array([t.astype(np.uint8).tobytes() for t in tokens], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], names=["id", "key", "n", "tokens", "bytes"])

    return map_batches(_keyed(docs, text_col, col(id_col).alias("id")), run, pairs_schema(docs, id_col, "id", "key binary, n long, tokens binary, bytes binary"))


def _keyed(docs: DataFrame, text_col: str, *first) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(*first, F.unhex(F.left(F.sha2(text.cast("binary"), 256), F.lit(32))).alias("key"), text.alias("text"))


def _token(at: int | None) -> Column:
    return F.expr("substring(tokens, 4 * pick + 1, 4)") if at is None else F.substring("tokens", 4 * at + 1, 4)


def _of_nodes(rows: DataFrame, nodes: DataFrame, bound: int = 100_000) -> DataFrame:
    """Rows of the given nodes, each once in ``nodes``: sent to all tasks if
    they are at most ``bound`` rows of a few numbers, else joined by a shuffle."""
    few = nodes.limit(bound + 1).count() <= bound
    return rows.join(F.broadcast(nodes) if few else nodes, "node")


def leaves(texts: DataFrame, trees: int, picks: int, leaf: int, dense: int, depth: int = 8) -> DataFrame:
    """(node, sid, blocks): members of the nodes to compare; ``blocks`` is 1
    for small nodes, else the number of blocks of about ``dense`` to cut it into."""
    roots = [F.xxhash64(F.lit(t), F.lit(t * picks + i), _token((t * picks + i) % TOKENS)) for t in range(trees) for i in range(picks)]
    rows = texts.select("sid", F.explode(F.array(*roots)).alias("node"))
    out = []
    for level in range(depth + 1):
        name = F.xxhash64("sid", F.lit(1))
        counted = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(name).alias("y")).filter("n > 1")
        counted = cut_lineage(counted)
        # Trees that find the same members have one leaf for them.
        small = counted.filter(F.col("n") <= leaf).groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node", F.lit(1).alias("blocks"))
        out.append(_of_nodes(rows, small).select("node", "sid", "blocks"))
        large = counted.filter(F.col("n") > leaf).select("node", "n")
        blocks = F.ceil(F.col("n") / dense).cast("int").alias("blocks")
        if large.isEmpty():
            break
        if level == depth:
            out.append(_of_nodes(rows, large.select("node", blocks)).select("node", "sid", "blocks"))
            break
        start = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(TOKENS)).cast("int")
        chosen = F.array(*[F.pmod(start + i * (TOKENS // picks - 1), F.lit(TOKENS)) for i in range(picks)])
        kids = _of_nodes(rows, large).join(texts.select("sid", "tokens"), "sid").select("node", "n", "sid", "tokens", F.posexplode(chosen).alias("turn", "pick"))
        kids = cut_lineage(kids.select("node", "n", "sid", "turn", F.xxhash64("node", "pick", _token(None)).alias("kid")))
        sizes = kids.groupBy("node", "n", "kid").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("node", "n").agg(F.sum(F.col("k") * F.col("k")).alias("work"))
        split = cut_lineage(sizes.select("node", (F.col("work") <= F.lit(0.5) * F.col("n") * F.col("n")).alias("split")))
        # Each member once, where its node stays whole; else once for each child.
        out.append(_of_nodes(kids.filter("turn = 0"), split.filter(~F.col("split"))).select("node", "sid", blocks))
        rows = _of_nodes(kids, split.filter("split")).select("sid", F.col("kid").alias("node"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with ``sid`` and ``blocks`` once for each pair of blocks (lo, hi)
    their own block ``own`` is in."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("lo"), F.greatest("own", j).alias("hi")))
    return rows.withColumn("p", F.explode(pairs)).withColumns({"lo": F.col("p.lo"), "hi": F.col("p.hi")}).drop("p", "blocks")


class Bound:
    """What two documents must have in common to be compared further."""

    def __init__(self, percent: int):
        self.percent = percent
        self.agree = agree_at_least(percent)

    def partners(self, i: int, others: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[100 * low >= self.percent * high]
        return others[(marks[others] == marks[i]).sum(1) >= self.agree]


def _candidates(sizes: np.ndarray, marks: np.ndarray, left: np.ndarray, links: Links, bound: Bound) -> Iterator[tuple[int, np.ndarray]]:
    """Per row its likely partners that it is not connected with yet, among all
    rows, or only across if ``left`` marks a proper part of them."""
    across = left.any() and not left.all()
    index = np.arange(len(sizes))
    for i in np.flatnonzero(left).tolist() if across else range(len(sizes) - 1):
        others = index[~left] if across else index[i + 1 :]
        others = others[links.root[others] != links.root[i]]
        if len(others):
            found = bound.partners(i, others, sizes, marks)
            if len(found):
                yield i, found


def likely_links(members: DataFrame, percent: int) -> DataFrame:
    """(src, dst): a forest that connects what likely links connect in each
    node; ``members`` has node, sid, blocks, n, bytes."""
    bound = Bound(percent)
    row = F.struct("sid", (F.col("own") == F.col("lo")).alias("left"), "n", "bytes")
    groups = in_blocks(members).groupBy("node", "lo", "hi").agg(F.collect_list(row).alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            src, dst = [], []
            across = (b.column("lo").to_numpy() != b.column("hi").to_numpy()).tolist()
            for i in range(b.num_rows):
                rows = b.column("rows")[i].values
                sid, sizes = (rows.field(c).to_numpy() for c in ("sid", "n"))
                left = rows.field("left").to_numpy(zero_copy_only=False)
                if across[i] and (left.all() or not left.any()):
                    continue
                marks = np.frombuffer(b"".join(rows.field("bytes").to_pylist()), np.uint8).reshape(-1, TOKENS)
                links = Links(len(sid))
                for a, found in _candidates(sizes, marks, left, links, bound):
                    links.join(np.full(len(found), a), found)
                kid = np.flatnonzero(links.root != np.arange(len(sid)))
                src.append(sid[kid])
                dst.append(sid[links.root[kid]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (src, dst)], names=["src", "dst"])

    return map_batches(groups.select("lo", "hi", "rows"), run, "src long, dst long").distinct()


def _confirm(sid: list[int], sets: list[np.ndarray], marks: list[bytes], left: list[bool], bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """A forest of confirmed links among the documents of one group."""
    links = Links(len(sid))
    sizes = np.array([len(s) for s in sets])
    table = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, TOKENS)
    for i, found in _candidates(sizes, table, np.array(left), links, bound):
        for j in found.tolist():
            if links.root[i] == links.root[j]:
                continue
            a, b = sorted((sets[i], sets[j]), key=len)
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if 100 * both >= bound.percent * (len(a) + len(b) - both):
                links.join(np.array([i]), np.array([j]))
    kid = np.flatnonzero(links.root != np.arange(len(sid)))
    names = np.array(sid, np.int64)
    return names[kid], names[links.root[kid]]


def confirmed_links(members: DataFrame, docs: DataFrame, text_col: str, percent: int, words: int) -> DataFrame:
    """(src, dst): links confirmed on full sets; ``members`` has sid, key,
    bytes, component and blocks. One text of each key travels."""
    bound = Bound(percent)
    texts = _keyed(docs, text_col).groupBy("key").agg(F.first("text").alias("text"))
    sent = in_blocks(members.join(texts, "key")).select("component", "lo", "hi", (F.col("own") == F.col("lo")).alias("left"), "sid", "bytes", "text")
    order = ["component", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [], [])

        def close() -> Iterator[pa.RecordBatch]:
            if len(held[0]) > 1 and (group[1] == group[2] or len(set(held[3])) == 2):
                src, dst = _confirm(*held, bound)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
            for x in held:
                x.clear()

        for b in slices(batches):
            names = list(zip(*(b.column(c).to_pylist() for c in order), strict=True))
            cells = [b.column(c).to_pylist() for c in ("sid", "text", "bytes", "left")]
            for name, sid, text, marks, left in zip(names, *cells, strict=True):
                if name != group:
                    yield from close()
                    group = name
                for x, y in zip(held, (sid, shingle_set(text, words), marks, left), strict=True):
                    x.append(y)
        yield from close()

    return map_batches(sent.repartition(*order).sortWithinPartitions(*order), run, "src long, dst long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = 5, trees: int = 5, picks: int = 2, leaf: int = 256, dense: int = 2048, block: int = 1024
) -> DataFrame:
    """(id, n, component) per row: the size of its shingle set, and the smallest
    id that links of at least ``percent`` reach.

    Null texts and texts without words have empty sets and link with nothing.
    Rows that repeat an id stay rows of their own. A null id gets the component
    of its text; a component without any id is null. Very long texts are whole.
    Extra columns, of any name, take no part. An empty table gives no rows.
    """
    rows = cut_lineage(sketches(docs, id_col, text_col, words))
    texts = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("smallest"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("bytes").alias("bytes"))
    texts = cut_lineage(texts).withColumn("sid", F.monotonically_increasing_id())
    nodes = leaves(texts, trees, picks, leaf, dense)
    likely = cut_lineage(likely_links(nodes.join(texts.select("sid", "n", "bytes"), "sid"), percent))
    parts = cut_lineage(components(likely).withColumnRenamed("id", "sid").join(texts.select("sid", "key", "n", "bytes"), "sid"))
    # Blocks are bounded by documents and by shingles.
    sizes = parts.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / F.lit(4096 * block))).cast("int").alias("blocks"))
    links = cut_lineage(confirmed_links(parts.join(sizes, "component"), docs, text_col, percent, words))
    linked = components(links).withColumnRenamed("id", "sid")
    classed = texts.select("sid", "key", "smallest").join(linked, "sid", "left").withColumn("class", F.coalesce("component", "sid")).drop("component")
    of = with_group_min(classed, "class", "smallest", "component", "sid").select("key", "component")
    own = rows.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    return rows.filter("n > 0").join(of, "key").select("id", "n", "component").unionByName(own)

"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

Digests enter their parent as 64 hex characters, which is one SHA-256 block, so
a parent's hash state before any child slot is eight words that can be stored
and sent. Parents keep a copy of that state before each slot. A changed leaf is
folded upwards by resuming the state before its slot with the replacement and
the siblings to its right; what stands to its left is never hashed again.

Rows are numbered inside their group by one range shuffle of digests, so a
group with a third of all rows is spread like any other. Groups are cut into
aligned blocks of ``fanout ** height`` leaves, the tops of blocks into blocks
again until a group has one node, and the groups' nodes form one more tree. A
path from a block to the root holds the states before its slots and the
siblings there; paths are handed down to the leaf blocks, where all leaves are
folded at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut_lineage, map_batches, sql_type

WORD = 0xFFFFFFFF


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


# SHA-256 constants are fractions of square and cube roots of the first primes.
START = np.array([[isqrt(p << 64) & WORD] for p in _primes(8)], np.uint32)
ROUND = [np.array([_cube_root(p << 96) & WORD], np.uint32) for p in _primes(64)]
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def resume(state: np.ndarray, block: list[np.ndarray]) -> np.ndarray:
    """States (8, n) after one more block of 16 words, n lanes at once."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (ROUND[t] + w[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([np.broadcast_to(x, state.shape[1:]) for x in (a, b, c, d, e, f, g, h)])


def hex_text(digests: np.ndarray) -> np.ndarray:
    """(n, 64) characters of digests (8, n)."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8).reshape(-1, 32)
    return HEX[np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, 64)]


def hex_words(digests: np.ndarray) -> list[np.ndarray]:
    return list(np.ascontiguousarray(hex_text(digests).view(">u4").astype(np.uint32).T))


def finish(state: np.ndarray, blocks: int) -> np.ndarray:
    """Digests of states after that many whole blocks."""
    last = [1 << 31, *[0] * 13, blocks * 512 >> 32, blocks * 512 & WORD]
    return resume(state, [np.array([x], np.uint32) for x in last])


def from_bytes(digests: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).T.astype(np.uint32))


def to_bytes(digests: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(digests.T).astype(">u4").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


class Subtree:
    """Levels of digests above some leaves, and before each child slot of every
    parent a copy of its hash state. ``height`` None: up to a single node."""

    def __init__(self, leaves: np.ndarray, fanout: int, height: int | None):
        self.fanout = fanout
        self.levels = [leaves]
        self.states: list[np.ndarray] = []
        while len(self.states) < height if height is not None else self.levels[-1].shape[1] > 1:
            nodes = self.levels[-1]
            n = nodes.shape[1]
            parents = -(-n // fanout)
            state = np.repeat(START, parents, axis=1)
            kept = []
            for slot in range(fanout):
                kept.append(state.copy())
                children = nodes[:, slot::fanout]
                if children.shape[1]:
                    state[:, : children.shape[1]] = resume(state[:, : children.shape[1]], hex_words(children))
            last = n - (parents - 1) * fanout
            self.states.append(np.stack(kept))
            self.levels.append(np.concatenate([finish(state[:, :-1], fanout), finish(state[:, -1:], last)], axis=1) if last < fanout else finish(state, fanout))

    @property
    def top(self) -> np.ndarray:
        return self.levels[-1]

    def fold(self, replaced: np.ndarray) -> np.ndarray:
        """Digests that each leaf's replacement, alone, gives the top."""
        at = np.arange(replaced.shape[1])
        for nodes, states in zip(self.levels, self.states, strict=False):
            n = nodes.shape[1]
            parent, slot = np.divmod(at, self.fanout)
            size = np.minimum(n - parent * self.fanout, self.fanout)
            state = resume(np.ascontiguousarray(states[slot, :, parent].T), hex_words(replaced))
            for step in range(1, self.fanout):
                more = np.flatnonzero(slot + step < size)
                if len(more):
                    state[:, more] = resume(state[:, more], hex_words(nodes[:, at[more] + step]))
            replaced = np.empty_like(state)
            for k in np.unique(size).tolist():
                of = np.flatnonzero(size == k)
                replaced[:, of] = finish(state[:, of], k)
            at = parent
        return replaced

    def siblings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per level and slot: places of the leaves' siblings, and which of
        them there are."""
        at = np.arange(self.levels[0].shape[1])
        for nodes in self.levels[:-1]:
            parent, slot = np.divmod(at, self.fanout)
            for s in range(self.fanout):
                place = parent * self.fanout + s
                there = (place < nodes.shape[1]) & (s != slot)
                yield np.where(there, place, 0), there
            at = parent

    def sibling_texts(self) -> list[bytes]:
        """Per leaf: hex digests of its siblings, level by level, left to right."""
        texts, masks = [], []
        for i, (place, there) in enumerate(self.siblings()):
            texts.append(hex_text(self.levels[i // self.fanout])[place])
            masks.append(there)
        if not texts:
            return [b""] * self.levels[0].shape[1]
        table, mask = np.stack(texts, axis=1), np.stack(masks, axis=1)
        return [table[i][mask[i]].tobytes() for i in range(len(table))]

    def steps(self) -> list[bytes]:
        """Per leaf its path: for each level the state before its slot, the
        numbers of siblings at its left and right, and their digests."""
        n = self.levels[0].shape[1]
        out = [b""] * n
        at = list(range(n))
        for nodes, states in zip(self.levels, self.states, strict=False):
            digests = to_bytes(nodes)
            before = [to_bytes(s) for s in states]
            for i in range(n):
                parent, slot = divmod(at[i], self.fanout)
                run = digests[parent * self.fanout : (parent + 1) * self.fanout]
                out[i] += before[slot][parent] + bytes([slot, len(run) - slot - 1]) + b"".join(run[:slot] + run[slot + 1 :])
                at[i] = parent
        return out


def path_steps(path: bytes) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    at = 0
    while at < len(path):
        left, right = path[at + 32], path[at + 33]
        digests = [path[at + 34 + 32 * i : at + 66 + 32 * i] for i in range(left + right)]
        yield from_bytes([path[at : at + 32]]), digests[:left], digests[left:]
        at += 34 + 32 * (left + right)


def fold_path(replaced: np.ndarray, path: bytes) -> np.ndarray:
    """Roots that replacements of one node give along its path."""
    for state, left, right in path_steps(path):
        state = resume(np.repeat(state, replaced.shape[1], axis=1), hex_words(replaced))
        for digest in right:
            state = resume(state, hex_words(from_bytes([digest])))
        replaced = finish(state, len(left) + 1 + len(right))
    return replaced


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 in hex of the fields: ``-`` for null, else the byte count, a
    colon and the value, joined without anything between."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]).cast("binary"), 256)


def _numbered(rows: DataFrame) -> DataFrame:
    """grp, id, leaf, changed with ``pos`` inside the group and its ``total``.

    The sorted rows are checkpointed, so that partition and row numbers stay.
    """
    order = ["grp", "id", "leaf", "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # parts rows that are equal
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row"))
    placed = placed.withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    runs = placed.groupBy("p", "grp").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    runs = runs.withColumns({"before": F.sum("n").over(group.orderBy("p")) - F.col("n"), "total": F.sum("n").over(group)})
    runs = runs.select(F.col("p").alias("p2"), F.col("grp").alias("grp2"), (F.col("before") - F.col("first")).alias("shift"), "total")
    met = placed.join(runs, (F.col("p") == F.col("p2")) & F.col("grp").eqNullSafe(F.col("grp2")))
    return met.select("grp", "id", "leaf", "changed", (F.col("i") + F.col("shift")).alias("pos"), "total")


def _cut(numbered: DataFrame, size: int, *more: str) -> DataFrame:
    """Aligned blocks of nodes: grp, block, total, nodes (an array by place)."""
    row = F.struct("pos", "leaf", *more)
    out = numbered.groupBy("grp", F.expr(f"pos div {size}").alias("block")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(row)).alias("nodes"))
    return cut_lineage(out)


def _subtrees(batch: pa.RecordBatch, fanout: int, height: int) -> Iterator[tuple[int, pa.StructArray, Subtree]]:
    totals = batch.column("total").to_pylist()
    for i in range(batch.num_rows):
        nodes = batch.column("nodes")[i].values
        yield i, nodes, Subtree(from_bytes(nodes.field("leaf").to_pylist()), fanout, height if totals[i] > fanout**height else None)


def _tops(blocks: DataFrame, fanout: int, height: int, kind: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [to_bytes(t.top)[0] for _, _, t in _subtrees(b, fanout, height)]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("block"), b.column("total"), pa.array(tops, pa.binary())], names=["grp", "pos", "total", "leaf"])

    tops = map_batches(blocks.select("grp", "block", "total", "nodes"), run, f"grp {kind}, pos long, total long, leaf binary")
    return tops.withColumn("total", F.ceil(F.col("total") / fanout**height).cast("long"))


def _levels(blocks: DataFrame, fanout: int, height: int, kind: str) -> tuple[list[DataFrame], DataFrame]:
    """Block tables from the leaves up, and (grp, leaf) of every group's node."""
    levels = [blocks]
    largest = blocks.agg(F.max("total")).first()[0] or 1
    while True:
        tops = _tops(levels[-1], fanout, height, kind)
        largest = -(-largest // fanout**height)
        if largest <= 1:
            return levels, cut_lineage(tops.select("grp", "leaf"))
        levels.append(_cut(tops, fanout**height))


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks next to the path of their top; ``paths`` has grp2, pos2, path, subroot."""
    return blocks.join(paths, F.col("grp").eqNullSafe(F.col("grp2")) & (F.col("block") == F.col("pos2"))).drop("grp2", "pos2")


def _paths(blocks: DataFrame, fanout: int, height: int, kind: str, more: str = "") -> DataFrame:
    """(grp2, pos2, path, subroot) of all nodes in blocks that know their own
    path; nodes named by ``more`` are groups' nodes, and so their own subroots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, nodes, tree in _subtrees(b, fanout, height):
                above = b.column("path")[i].as_py()
                grp = nodes.field(more) if more else pa.concat_arrays([b.column("grp").slice(i, 1)] * len(nodes))
                subroot = nodes.field("leaf") if more else pa.concat_arrays([b.column("subroot").slice(i, 1)] * len(nodes))
                cells = [grp, nodes.field("pos"), pa.array([x + above for x in tree.steps()], pa.binary()), subroot]
                yield pa.RecordBatch.from_arrays(cells, names=["grp2", "pos2", "path", "subroot"])

    return map_batches(blocks, run, f"grp2 {kind}, pos2 long, path binary, subroot binary")


def manifest(leaves: DataFrame, fanout: int = 2, height: int = 10) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded, verified) per row of ``leaves``,
    which has grp, id, leaf and changed (digests of 32 bytes; changed null: as
    leaf). Digests are returned in hex; ``proof`` is the digest of the siblings
    on the way to the root, ``folded`` the root that ``changed`` gives.

    Leaves ascend by id inside a group, null first; rows that repeat an id
    ascend by digest. A null group is a group of its own, the first one. A
    group of one row is its own subroot, a table of one group has the root of
    that group. An empty table gives no rows. Texts never leave the scan: only
    their digests are shuffled.
    """
    kind, id_kind = sql_type(leaves, "grp"), sql_type(leaves, "id")
    size = fanout**height
    blocks = _cut(_numbered(leaves), size, "id", "changed")
    levels, groups = _levels(blocks, fanout, height, kind)
    # The groups' nodes are the leaves of one more tree.
    above = _numbered(groups.select(F.lit(0).alias("grp"), F.col("grp").alias("id"), "leaf", F.lit(None).cast("binary").alias("changed")))
    forest, top = _levels(_cut(above, size, "id"), fanout, height, "int")
    found = top.first()
    root = found["leaf"] if found else b""

    paths = top.select(F.col("grp").alias("grp2"), F.lit(0).cast("long").alias("pos2"), F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))
    for level in reversed(forest[1:]):
        paths = _paths(_with_paths(level, paths), fanout, height, "int")
    paths = _paths(_with_paths(forest[0], paths), fanout, height, kind, "id").withColumn("pos2", F.lit(0).cast("long"))
    for level in reversed(levels[1:]):
        paths = _paths(_with_paths(level, paths), fanout, height, kind)
    met = _with_paths(blocks, paths).select("grp", "total", "nodes", "path", "subroot")
    # A block is some 100 KB, but seconds of hashing: spread by number, not by bytes.
    met = met.repartition(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, nodes, tree in _subtrees(b, fanout, height):
                path = b.column("path")[i].as_py()
                suffix = b"".join(x.hex().encode() for _, left, right in path_steps(path) for x in left + right)
                original = nodes.field("leaf").to_pylist()
                changed = [x or y for x, y in zip(nodes.field("changed").to_pylist(), original, strict=True)]
                # Leaves as they were all give one top, which is folded on once.
                tops, which = np.unique(tree.fold(from_bytes(changed)), axis=1, return_inverse=True)
                folded = [x.hex() for x in to_bytes(fold_path(tops, path))]
                roots = [folded[x] for x in which.ravel().tolist()]
                n = len(original)
                proofs = [hashlib.sha256(x + suffix).hexdigest() for x in tree.sibling_texts()]
                cells = [nodes.field("id"), pa.array([x.hex() for x in original]), pa.array([b.column("subroot")[i].as_py().hex()] * n), pa.array([root.hex()] * n)]
                cells += [pa.array(proofs), pa.array(roots), pa.array([x == root.hex() for x in roots])]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "leaf", "subroot", "root", "proof", "folded", "verified"])

    return map_batches(met, run, f"id {id_kind}, leaf string, subroot string, root string, proof string, folded string, verified boolean")


def tampered_manifest(rows: DataFrame, fields: list[str], changes: dict[str, Column], when: Column, id_col: str = "doc_id", group_col: str = "lang", **options) -> DataFrame:
    """:func:`manifest` of rows whose leaf is the digest of ``fields``; where
    ``when`` holds, the columns of ``changes`` are replaced before folding.
    Further columns, of any name, take no part."""
    before = [col(c) for c in fields]
    after = [changes.get(c, col(c)) for c in fields]
    leaves = rows.select(
        col(group_col).alias("grp"),
        col(id_col).alias("id"),
        F.unhex(leaf_digest(before)).alias("leaf"),
        F.when(when, F.unhex(leaf_digest(after))).alias("changed"),
    )
    return manifest(leaves, **options)

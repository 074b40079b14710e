"""Prefix trie of conversations from padded matrices of turn ids.

A conversation is the string of its turns' ids (16 bytes each), so all that
share a prefix stand together in sorted order. Rows are dealt to range shards
by that string and, where it is equal, by conversation; a shard is read in
bounded chunks. A chunk is a padded matrix of turn ids: a lexsort puts its rows
in order, a mask of changed columns, accumulated by OR from the left, marks
where the nodes of each depth start, and ``reduceat`` over those starts
aggregates every depth.

Nodes on the path of a chunk's first or last row may go on in a neighbour. A
chunk reports all others and hands these two paths on, each with what its
nodes have gathered: members, smallest member, and the children, leaves and
savings already reported below. Paths are rows of the same kind with weights,
so they recombine by the same step in groups until one chunk is left.

The digest of a node's own members is a chain over ascending ids; of nodes
that cross chunks only the pieces of joined text travel, in order, and are
hashed one after the other without being held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, map_batches

CELLS = 1 << 20
GROUP = 512
NONE = np.iinfo(np.int64).max
WEIGHTS = ("members", "low", "kids", "leaves", "saved")
NODE, PATH, PIECE = 0, 1, 2
SCHEMA = (
    "kind int, depth int, conv_id long, parent_conv_id long, parent_node binary, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends string, node binary, seq long, key binary, sizes array<long>, " + ", ".join(f"{w} array<long>" for w in WEIGHTS)
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
FIELDS = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in SCHEMA.split(", ")])
EMPTY = hashlib.sha256().hexdigest()


def rebuilt(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = 5, heads: int = 9) -> DataFrame:
    """(conv, key, sizes): conversations whose first turns come from a sibling.

    Conversation c takes its first h = crc32(decimal c) % ``heads`` turns from
    conversation c - c % ``family`` (all if fewer, none if absent), and then its
    own after the first h. ``key`` joins the 16-byte ids of the turns' role and
    text, ``sizes`` has the UTF-8 bytes of the texts.

    A null turn comes first; null role and text are empty; equal turn numbers
    are ordered by role, the text's first 64 characters and its hash. Rows
    without a key belong to no conversation; keys are whole numbers. Only ids
    and sizes of turns are kept, so a long conversation is a small row.
    """
    named = turns.filter(col(key).isNotNull()).select(
        col(key).cast("long").alias("c"),
        col(turn).alias("turn"),
        F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    )
    told = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    row = F.struct("c", "turn", "role", F.left("text", F.lit(64)).alias("head"), F.left(F.sha2(told.cast("binary"), 256), F.lit(32)).alias("id"), F.octet_length("text").cast("long").alias("size"))
    grouped = named.groupBy((F.col("c") - F.col("c") % family).alias("base")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    each = grouped.select("base", "rows", F.explode(F.array_distinct(F.transform("rows", lambda x: x["c"]))).alias("conv"))
    of = lambda c: F.filter("rows", lambda x: x["c"] == F.col(c))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    each = each.select("conv", of("conv").alias("own"), of("base").alias("first"), h.alias("h"))
    path = F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    each = each.select("conv", path.alias("path"))
    return each.select("conv", F.unhex(F.array_join(F.transform("path", lambda x: x["id"]), "")).alias("key"), F.transform("path", lambda x: x["size"]).alias("sizes"))


def _prefix_ids(key: bytes) -> list[bytes]:
    """Names of the nodes on a path, the root first."""
    h = hashlib.sha256()
    out = [h.digest()[:16]]
    for at in range(0, len(key), 16):
        h.update(key[at : at + 16])
        out.append(h.copy().digest()[:16])
    return out


class Chunk:
    """Rows as padded matrices: ``lanes`` (rows, width, 2) holds turn ids,
    ``sizes`` (rows, width) bytes of texts, ``weights`` (rows, width + 1) what a
    row brings to the node at each depth of its path."""

    def __init__(self, keys: list[bytes], sizes: list[np.ndarray], weights: dict[str, list[np.ndarray]], convs: np.ndarray | None):
        n = len(keys)
        self.keys = keys
        self.lens = np.array([len(k) // 16 for k in keys], np.int64)
        width = int(self.lens.max())
        lanes = np.zeros((n, width, 2), np.uint64)
        self.sizes = np.zeros((n, width), np.int64)
        for i, (k, s) in enumerate(zip(keys, sizes, strict=True)):
            lanes[i, : len(s)] = np.frombuffer(k, ">u8").reshape(-1, 2)
            self.sizes[i, : len(s)] = s
        self.lanes = lanes
        self.convs = convs
        self.valid = self.lens[:, None] >= np.arange(width + 1)
        self.weights: dict[str, np.ndarray] = {}
        for name in WEIGHTS:
            if convs is not None:
                fill = {"members": self.valid.astype(np.int64), "low": np.where(self.valid, convs[:, None], NONE)}
                self.weights[name] = fill.get(name, np.zeros((n, width + 1), np.int64))
            else:
                table = np.full((n, width + 1), NONE if name == "low" else 0, np.int64)
                for i, w in enumerate(weights[name]):
                    table[i, : len(w)] = w
                self.weights[name] = table
        self._sort()

    def _sort(self) -> None:
        by = [self.lens, *[self.lanes[:, d, lane] for d in reversed(range(self.lanes.shape[1])) for lane in (1, 0)]]
        if self.convs is not None:
            by.insert(0, self.convs)
        order = np.lexsort(by)
        self.keys = [self.keys[i] for i in order]
        for name in ("lens", "lanes", "sizes", "valid"):
            setattr(self, name, getattr(self, name)[order])
        self.convs = self.convs[order] if self.convs is not None else None
        self.weights = {k: v[order] for k, v in self.weights.items()}
        self.change = np.zeros(self.valid.shape, bool)
        self.change[0] = True
        differ = (self.lanes[1:] != self.lanes[:-1]).any(2) | (self.valid[1:, 1:] != self.valid[:-1, 1:])
        self.change[1:, 1:] = np.logical_or.accumulate(differ, axis=1)

    def ends(self) -> dict[int, str]:
        """First row of each run of equal conversations: their ids, joined."""
        n = len(self.keys)
        start = self.change[np.arange(n), self.lens]
        start[1:] |= self.lens[1:] != self.lens[:-1]
        edges = [*np.flatnonzero(start).tolist(), n]
        ids = list(map(str, self.convs.tolist()))
        return {a: ",".join(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)}

    def report(self, seq: int, last_round: bool) -> Iterator[pa.RecordBatch]:
        """Nodes that end here, the two open paths, and pieces of open ends."""
        n, width = len(self.keys), self.lanes.shape[1]
        ends = self.ends() if self.convs is not None else None
        ids = {i: _prefix_ids(self.keys[i]) for i in (range(n) if ends is None else {0, n - 1})}
        open_paths: dict[int, list[dict[str, int]]] = {0: [], n - 1: []}
        below: dict | None = None
        for d in reversed(range(width + 1)):
            rows = np.flatnonzero(self.valid[:, d])
            starts = np.flatnonzero(self.change[rows, d])
            first = rows[starts]
            t = {k: (np.minimum if k == "low" else np.add).reduceat(v[rows, d], starts) for k, v in self.weights.items()}
            node_of = np.full(n, -1)
            node_of[rows] = np.cumsum(self.change[rows, d]) - 1
            open_ = np.zeros(len(first), bool)
            if not last_round:
                for row in (0, n - 1):
                    if node_of[row] >= 0:
                        open_[node_of[row]] = True
            size = self.sizes[first, d - 1] if d else np.zeros(len(first), np.int64)
            if below is not None:
                parent = node_of[below["first"]]
                done = ~below["open"]
                t["kids"] += np.bincount(parent[done], minlength=len(first))
                np.add.at(t["leaves"], parent[done], below["leaves"][done])
                np.add.at(t["saved"], parent[done], below["saved"][done])
                yield from self._nodes(d + 1, below, ids, ends, d, t["low"][parent], open_[parent], parent == node_of[0])
            closed = ~open_
            t["leaves"] += closed & (t["kids"] == 0)
            t["saved"] += np.where(closed, (t["members"] - 1) * size, 0)
            for row in open_paths:
                if not last_round and (k := node_of[row]) >= 0:
                    own = row == 0 or k != node_of[0]  # a node on both paths is handed on once
                    open_paths[row].insert(0, {w: int(t[w][k]) if own else (NONE if w == "low" else 0) for w in WEIGHTS})
            below = {**t, "first": first, "open": open_}
        yield from self._nodes(0, below, ids, ends)
        if last_round:
            return
        paths, pieces = [], []
        for which, row in enumerate(sorted(open_paths)):
            if which and self.keys[0] == self.keys[-1]:
                continue
            path = {"kind": PATH, "seq": seq + which, "key": self.keys[row], "sizes": self.sizes[row, : self.lens[row]].tolist()}
            paths.append(path | {w: [x[w] for x in open_paths[row]] for w in WEIGHTS})
        if ends is not None:
            seen = set()
            for row in sorted(open_paths):
                for d in range(self.lens[row] + 1):
                    # A node's own members come first among its rows.
                    at = int(np.flatnonzero(self.change[: row + 1, d])[-1])
                    if self.lens[at] == d and (at, d) not in seen:
                        seen.add((at, d))
                        pieces.append({"kind": PIECE, "node": ids[row][d], "seq": seq, "ends": ends[at]})
        yield pa.RecordBatch.from_pylist(paths + pieces, FIELDS)

    def _nodes(self, d: int, t: dict, ids: dict, ends: dict | None, parent_depth: int = -1, parent_low=None, parent_open=None, parent_first=None) -> Iterator[pa.RecordBatch]:
        pick = np.flatnonzero(~t["open"])
        if not len(pick):
            return
        first = t["first"][pick]
        out = {"kind": np.full(len(pick), NODE), "depth": np.full(len(pick), d), "conv_id": t["low"][pick], "n_convs": t["members"][pick]}
        out |= {"n_children": t["kids"][pick], "n_leaves": t["leaves"][pick], "saved_tokens": t["saved"][pick]}
        out = {k: pa.array(v, FIELDS.field(k).type) for k, v in out.items()}
        if parent_low is not None:
            up = parent_open[pick]
            out["parent_conv_id"] = pa.array(parent_low[pick], pa.int64(), mask=up)
            # An open parent lies on the first row's path or on the last one's.
            last = len(self.keys) - 1
            names = [ids[0 if on_first else last][parent_depth] if is_open else None for is_open, on_first in zip(up.tolist(), parent_first[pick].tolist(), strict=True)]
            out["parent_node"] = pa.array(names, pa.binary())
        if ends is not None:
            texts = [ends.get(r, "") if self.lens[r] == d else "" for r in first.tolist()]
            out["ends"] = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else EMPTY for x in texts])
        else:
            out["node"] = pa.array([ids[r][d] for r in first.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([out.get(f.name, pa.nulls(len(pick), f.type)) for f in FIELDS], schema=FIELDS)


def _bounded(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose padded matrix has at most ``CELLS`` cells, or one row."""
    at = 0
    while at < len(lens):
        wide = np.maximum.accumulate(lens[at:]) + 1
        n = max(1, int(np.searchsorted(wide * np.arange(1, len(wide) + 1), CELLS, side="right")))
        yield at, at + n
        at += n


def _step(rows: DataFrame, first_round: bool, last_round: bool) -> DataFrame:
    """One round over sorted partitions; ``rows`` has key, sizes and either
    conv or the weights."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 33
        batches = iter(batches)
        if not first_round:
            held = [b for b in batches if b.num_rows]  # a group of paths, bounded by its making
            batches = iter([pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if held else [])
        for b in batches:
            keys = b.column("key").to_pylist()
            lists = {c: b.column(c) for c in ("sizes", *(() if first_round else WEIGHTS))}
            parts = {c: [x.values.to_numpy(zero_copy_only=False) for x in v] for c, v in lists.items()}
            lens = np.array([len(k) // 16 for k in keys], np.int64)
            for lo, hi in _bounded(lens) if first_round else [(0, len(keys))]:
                weights = {w: parts[w][lo:hi] for w in WEIGHTS} if not first_round else {}
                convs = b.column("conv").to_numpy()[lo:hi] if first_round else None
                yield from Chunk(keys[lo:hi], parts["sizes"][lo:hi], weights, convs).report(seq, last_round)
                seq += 2

    return cut_lineage(map_batches(rows, run, SCHEMA))


def _chained(pieces: DataFrame) -> DataFrame:
    """(node, digest): pieces of text of a node hashed in order, comma-joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for name, text in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if name != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["node", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "digest"])

    return map_batches(pieces.select("node", "seq", "ends").repartition("node").sortWithinPartitions("node", "seq"), run, "node binary, digest string")


def trie(paths: DataFrame, salts: int = 32) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv long, key, sizes; see
    :func:`rebuilt`): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root only; equal ones are
    members of the same nodes. Without conversations there are no nodes. A long
    conversation widens its chunk's matrix, which then takes fewer rows.
    """
    spark = paths.sparkSession
    shards = paths.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    rounds = [_step(shards, True, False)]
    while True:
        handed = rounds[-1].filter(F.col("kind") == PATH).select("seq", "key", "sizes", *WEIGHTS)
        n, deepest = handed.agg(F.count(F.lit(1)), F.max(F.size("sizes"))).first()
        if not n:
            break
        group = max(16, min(GROUP, CELLS // (deepest + 1)))
        last = n <= group
        # A range leaves two paths at most, so each round has an eighth of them or fewer.
        dealt = handed.repartition(1) if last else handed.repartitionByRange(max(1, n // group), "seq")
        rounds.append(_step(dealt.sortWithinPartitions("seq"), False, last))
        if last:
            break
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    nodes = [r.filter(F.col("kind") == NODE).select(*out, "parent_node", "node", "ends") for r in rounds]
    if len(nodes) == 1:
        return nodes[0].select(*out, F.col("ends").alias("ends_sha256"))
    later = nodes[1]
    for more in nodes[2:]:
        later = later.unionByName(more)
    chained = _chained(rounds[0].filter(F.col("kind") == PIECE))
    later = later.join(chained, "node", "left").withColumn("ends", F.coalesce("digest", F.lit(EMPTY))).drop("digest")
    later = cut_lineage(later)
    all_ = nodes[0].unionByName(later)
    # Few nodes were ever open, but one may have most nodes as children.
    known = later.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("found"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    sought = all_.filter(F.col("parent_node").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(salts)).cast("int"))
    met = sought.join(known, ["parent_node", "salt"]).withColumn("parent_conv_id", F.col("found"))
    done = all_.filter(F.col("parent_node").isNull())
    return done.select(*out, F.col("ends").alias("ends_sha256")).unionByName(met.select(*out, F.col("ends").alias("ends_sha256")))

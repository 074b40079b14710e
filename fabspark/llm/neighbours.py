"""Approximate nearest neighbours by a permutation index.

A vector is represented by the ranks of its ``depth`` nearest pivots. Blocks of
vectors hold one inverted file per pivot: the vectors that have it among their
nearest, with its rank. A query walks the files of its own pivots and adds up,
for every pivot in common, how much closer the ranks make the footrule distance
(a pivot outside the first ``depth`` counts as rank ``depth``). The nearest
``share`` of a block by footrule is ranked again by the exact cosine.

Pivots are drawn from a bounded sample; every row is indexed. Queries meet all
blocks in chunks, and a pair of a chunk and a block returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut_lineage, map_batches, sql_type

BLOCK = 8192


def usable(vector: Column) -> Column:
    """Not null, not zero and made of finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Unit vectors by dimension: up to ``pivots`` distinct ones among the
    4 * ``pivots`` rows of smallest hash (a bounded sample)."""
    rows = vectors.orderBy(F.xxhash64("id", "vector"), "id").limit(4 * pivots).collect()
    out: dict[int, dict[tuple, None]] = {}
    for r in rows:
        out.setdefault(len(r["vector"]), {})[tuple(r["vector"])] = None
    return {d: unit(np.array(list(v)[:pivots], float)) for d, v in out.items()}


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish;
    no digit of a cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """(rows, depth): pivot numbers from the nearest on."""
    return np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.int32)


def _blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(dimension, ids, matrix) of at most ``rows`` vectors of one dimension."""
    held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
    for b in batches:
        lists = b.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes).tolist():
            pick = pa.array(np.flatnonzero(sizes == d))
            part = lists.take(pick).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            group = held.setdefault(d, [])
            group.append((b.column(0).take(pick), part))
            while sum(len(x) for _, x in group) >= rows:
                ids, x = pa.concat_arrays([i for i, _ in group]), np.concatenate([x for _, x in group])
                yield d, ids[:rows], x[:rows]
                group[:] = [(ids[rows:], x[rows:])]
    for d, group in held.items():
        if n := sum(len(x) for _, x in group):
            yield d, pa.concat_arrays([i for i, _ in group])[:n], np.concatenate([x for _, x in group])


def build_index(vectors: DataFrame, pivots: dict[int, np.ndarray], depth: int) -> DataFrame:
    """One row per block: part, dim, ids, vectors, and the inverted files as
    offsets per pivot, members and ranks. ``vectors`` has id and vector."""
    kind = sql_type(vectors, "id")
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most ``pivots`` vectors

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for d, ids, x in _blocks(batches, BLOCK):
            if d not in sent.value:
                sent.value[d] = unit(x[:1])
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")  # members ascend by id
            ids, x = ids.take(pa.array(order)), x[order]
            near = nearest_pivots(x, sent.value[d], depth)
            member, rank = np.divmod(np.argsort(near.ravel(), kind="stable").astype(np.int32), near.shape[1])
            offsets = np.searchsorted(np.sort(near.ravel()), np.arange(len(sent.value[d]) + 1)).astype(np.int32)
            cells = [pa.array([part], pa.int32()), pa.array([d], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids)]
            cells += [pa.array([v.tobytes()], pa.binary()) for v in (x, offsets, member, rank.astype(np.int16))]
            yield pa.RecordBatch.from_arrays(cells, names=["part", "dim", "ids", "vectors", "offsets", "members", "ranks"])

    return map_batches(vectors, run, f"part int, dim int, ids array<{kind}>, vectors binary, offsets binary, members binary, ranks binary")


def _search_block(ids, x, offsets, members, ranks, qids, q, near, k: int, share: float):
    """Per query: numbers of its k best members by exact cosine. Members of
    equal ids, which stand together, count once, by their nearest vector."""
    depth, n = near.shape[1], len(x)
    x, q = scaled(x), scaled(q)
    norm, base = np.sqrt((x * x).sum(1)), min(n, max(64 * k, int(np.ceil(share * n))))
    repeats = bool((ids[1:] == ids[:-1]).any())
    for row in range(len(q)):
        shared = np.zeros(n, np.int64)
        for rank, p in enumerate(near[row].tolist()):
            lo, hi = offsets[p], offsets[p + 1]
            shared[members[lo:hi]] += depth - np.maximum(ranks[lo:hi], rank)
        take = base
        while True:
            if take < n:
                # Largest gain is smallest footrule; ties go to the smaller id.
                found = np.argpartition(-shared * n + np.arange(n), take - 1)[:take]
            else:
                found = np.arange(n)
            found = found[ids[found] != qids[row]]
            # Copies of one id may fill the list: then it grows.
            if take >= n or not repeats or len(np.unique(ids[found])) >= min(take, 64 * k):
                break
            take = min(n, 2 * take)
        score = (x[found] * q[row]).sum(1) / (norm[found] * np.sqrt((q[row] * q[row]).sum()))
        best = np.lexsort((found, -score))
        if repeats:
            best = best[np.sort(np.unique(ids[found[best]], return_index=True)[1])]
        yield row, found[best[:k]], score[best[:k]]


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 512, depth: int = 128, share: float = 0.1) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each row that
    ``queries`` selects, by cosine, ties to the smaller id.

    Null, zero and non-finite vectors and null ids take no part; vectors of
    another dimension are no candidates. Rows that repeat an id count as one
    candidate, by their nearest vector. Fewer than k candidates: all of them.
    """
    rows = vectors.filter(usable(col(vector_col)) & col(id_col).isNotNull())
    kept = rows.select(col(id_col).alias("id"), col(vector_col).alias("vector"))
    kind = sql_type(kept, "id")
    chosen = choose_pivots(kept, pivots)
    index = cut_lineage(build_index(kept, chosen, depth))
    parts = index.rdd.getNumPartitions()
    sent = vectors.sparkSession.sparkContext.broadcast(chosen)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, ids, x in _blocks(batches, 1024):
            cells = [pa.array([d], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([x.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["dim", "qids", "queries"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = {c: b.column(c)[i] for c in b.schema.names}
                d = get["dim"].as_py()
                x, q = (np.frombuffer(get[c].as_py(), float).reshape(-1, d) for c in ("vectors", "queries"))
                offsets, members = (np.frombuffer(get[c].as_py(), np.int32) for c in ("offsets", "members"))
                ids, qids = get["ids"].values, get["qids"].values
                if d not in sent.value:
                    near = np.zeros((len(q), 1), np.int32)
                else:
                    near = nearest_pivots(q, sent.value[d], depth)
                left, right, score, rank = [], [], [], []
                args = ids.to_numpy(zero_copy_only=False), x, offsets, members, np.frombuffer(get["ranks"].as_py(), np.int16), qids.to_numpy(zero_copy_only=False)
                for row, found, s in _search_block(*args, q, near, k, share):
                    left += [row] * len(found)
                    right += found.tolist()
                    score += s.tolist()
                    rank += range(len(found))
                cells = [qids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64())), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cells, names=["query_id", "id", "score"])

    chunks = map_batches(rows.filter(queries).select(col(id_col).alias("id"), col(vector_col).alias("vector")), pack, f"dim int, qids array<{kind}>, queries binary")
    chunks = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(parts - 1, 0)))))
    met = index.join(chunks, ["part", "dim"]).select("dim", "ids", "vectors", "offsets", "members", "ranks", "qids", "queries")
    found = map_batches(met, run, f"query_id {kind}, id {kind}, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")

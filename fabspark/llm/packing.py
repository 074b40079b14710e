"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths reaches the driver: at most ``capacity``
counts, whatever the number of pieces. Over it, the fractional covering program
(choose configurations, multisets of lengths that fit, so that every piece is
covered by the fewest sequences) is solved by multiplicative weights: lengths
that are covered lose weight, and a knapsack dynamic program over the weights
prices new configurations until all is covered. Where the weights do not prove a
small gap, priced configurations replace those of a basis until they do. Numbers are
rounded without placing a piece twice, and what is left is placed best-fit,
still as counts; the result is never worse than best-fit alone. Ranks inside
each length then assign pieces to slots; a frequent length is ranked in slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut_lineage, map_batches, pairs_schema, slices, sql_type, texts_of, tokenizer

# Letters, digits and marks of these blocks have one category in every Unicode
# version, so both libraries split such texts alike; others take the reference one.
PLAIN = regex.compile(r"[\x00-\x7F\xA0-ɏ‐-‧]*+")
_FAST: dict = {}


def fast_encoding(name: str, end: str):
    """The same byte-level vocabulary in a faster library, once per worker."""
    if name not in _FAST:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _FAST[name] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end: len(ranks)})
    return _FAST[name]


def encode(text: str, name: str, ranks: str, end: str) -> np.ndarray:
    if PLAIN.fullmatch(text):
        return fast_encoding(ranks, end).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    return np.array(tokenizer(name).encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", end: str = "<|endoftext|>", end_id: int = 2
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents as token ids plus
    ``end_id``; those above ``capacity`` are cut so that only the first piece
    may be shorter. Null texts count as empty and give the end alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            take, piece, start, length, crc = [], [], [], [], []
            for row, t in enumerate(texts_of(b, 1)):
                data = np.append(encode(t, name, ranks, end), np.uint32(end_id)).astype("<u4").tobytes()
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i in range(len(cuts) - 1):
                    take.append(row)
                    piece.append(i)
                    start.append(cuts[i])
                    length.append(cuts[i + 1] - cuts[i])
                    crc.append(zlib.crc32(data[4 * cuts[i] : 4 * cuts[i + 1]]))
            out = [b.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "piece", "start", "length", "ids_crc32"])

    schema = pairs_schema(docs, id_col, "id", "piece int, start long, length long, ids_crc32 long")
    return map_batches(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), run, schema)


def price(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: int, least: float = 0.0) -> tuple[list[dict[int, int]], float]:
    """Configurations of high total worth per sequence: one unbounded knapsack
    program gives the best filling of every room. The best one around each of
    up to ``most`` lengths is returned, from the share ``least`` of the highest
    worth there is on, and that worth."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):
        fit = int(np.searchsorted(sizes, room, side="right"))
        value = best[room - sizes[:fit]] + worth[:fit]
        k = int(np.argmax(value))
        if value[k] > best[room - 1]:
            best[room], pick[room] = value[k], k
        else:
            best[room] = best[room - 1]
    used = np.maximum.accumulate(np.where(pick >= 0, np.arange(capacity + 1), 0))  # the part of a room that its best filling takes
    ends = best[capacity - sizes] + worth
    out: dict[tuple, dict[int, int]] = {}
    for k in np.argsort(-ends, kind="stable")[:most].tolist():
        if ends[k] < least * best[capacity]:
            break
        config: dict[int, int] = {k: 1}
        room = int(used[capacity - int(sizes[k])])
        while room:
            j = int(pick[room])
            config[j] = config.get(j, 0) + 1
            room = int(used[room - int(sizes[j])])
        out.setdefault(tuple(sorted(config.items())), config)
    return list(out.values()), float(best[capacity])


def weigh(sizes: np.ndarray, want: np.ndarray, capacity: int, step: float, rate: float, power: float) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Multiplicative weights in large steps: fractional numbers of
    configurations that cover every piece exactly once, and the best lower bound
    to the number of sequences that the weights gave.

    A round prices configurations by the lengths' weights; each is taken as
    often as its scarcest length allows, up to the share ``step`` of a length,
    and lowers the weights of what it covers. First weights grow with the
    length, by ``power``. It ends when all is covered.
    """
    done = np.zeros(len(sizes))
    amounts: dict[tuple, float] = {}
    bound = 0.0
    while True:
        live = np.flatnonzero(done < want)
        if not len(live):
            return [(dict(c), a) for c, a in amounts.items()], bound
        share = done[live] / want[live]
        worth = (sizes[live] / capacity) ** power * np.exp(-rate * (share - share.min()))
        configs, top = price(sizes[live], worth, capacity, 24, 0.97)
        bound = max(bound, float(worth @ want[live]) / top)
        for config in configs:
            key = tuple(sorted((int(live[k]), n) for k, n in config.items()))
            amount = min(min(step * want[k], want[k] - done[k]) / n for k, n in key)
            if amount <= 0:
                continue
            for k, n in key:
                done[k] += amount * n
                if want[k] - done[k] < 1e-9 * want[k]:
                    done[k] = want[k]
            amounts[key] = amounts.get(key, 0.0) + amount


class Basis:
    """As many configurations as lengths, whose numbers cover all pieces; a
    priced one that is worth more than one sequence replaces another.

    Wanted numbers are raised by up to a millionth, each by another share: equal
    numbers would let a replacement gain nothing.
    """

    def __init__(self, sizes: np.ndarray, want: np.ndarray, capacity: int, refresh: int):
        per = (capacity // sizes).astype(float)
        self.want = want * (1 + 1e-6 * (np.arange(len(sizes)) * 0.6180339887498949 % 1))
        self.configs = np.diag(per)
        self.inverse, self.amounts, self.worth = np.diag(1 / per), self.want / per, 1 / per
        self.age, self.refresh = 0, refresh

    def enter(self, config: dict[int, int]) -> bool:
        """Takes the configuration in, if it is worth more than one sequence."""
        at, times = list(config), np.array(list(config.values()), float)
        gain = float(self.worth[at] @ times) - 1
        if gain <= 1e-9:
            return False
        share = self.inverse[:, at] @ times
        ratio = np.full(len(share), np.inf)
        np.divide(self.amounts, share, out=ratio, where=share > 1e-7)
        out = int(np.argmin(ratio))
        row = self.inverse[out] / share[out]
        self.amounts = np.maximum(self.amounts - ratio[out] * share, 0)
        self.amounts[out] = ratio[out]
        self.worth = self.worth - gain * row
        rows = np.flatnonzero(np.abs(share) > 1e-13)
        rows = rows[rows != out]
        self.inverse[rows] -= np.outer(share[rows], row)
        self.inverse[out] = row
        self.configs[:, out] = 0
        self.configs[at, out] = times
        self.age += 1
        if self.age % self.refresh == 0:  # errors of the updates add up
            self.inverse = np.linalg.inv(self.configs)
            self.amounts, self.worth = np.maximum(self.inverse @ self.want, 0), self.inverse.sum(0)
        return True


def settled(value: float, bound: float, gap: float) -> bool:
    """Whether a better covering is ruled out: by the gap, or as whole numbers of
    sequences leave no room."""
    return value <= max(bound * (1 + gap), np.ceil(bound - 1e-6))


def covering(sizes: np.ndarray, want: np.ndarray, capacity: int, start: list[dict[int, int]], bound: float, goal: int, gap: float = 0.001, smooth: float = 0.5, refresh: int = 300) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Fractional numbers of configurations that cover all pieces, and a lower
    bound to the number of sequences, at most ``gap`` below theirs.

    The lengths' weights, those of the known configurations drawn towards the
    ones that gave the best ``bound``, price new configurations by the knapsack
    program. There is no limit of rounds: it ends when the weights prove the
    gap, that no configuration at all betters the covering, or that ``goal``
    sequences are the fewest.
    """
    basis = Basis(sizes, want, capacity, refresh)
    for config in start:
        basis.enter(config)
    proof = sizes / capacity
    bound, draw = max(bound, float(proof @ want)), smooth
    while not settled(float(basis.amounts.sum()), bound, gap) and not settled(goal, bound, 0):
        worth = draw * proof + (1 - draw) * basis.worth
        configs, top = price(sizes, worth, capacity, 100)
        positive = np.maximum(worth, 0) / top
        if float(positive @ want) > bound:
            bound, proof = float(positive @ want), positive
        if any([basis.enter(c) for c in configs]):
            draw = smooth
        elif draw:
            draw = draw / 2 if draw > 0.05 else 0.0
        else:
            break  # the basis' own weights price nothing above one sequence
    found = [({int(k): int(basis.configs[k, i]) for k in np.flatnonzero(basis.configs[:, i])}, float(x)) for i, x in enumerate(basis.amounts) if x > 1e-9]
    return sorted(found, key=lambda c: -c[1]), bound


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal open sequences are one group."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for k in reversed(range(len(sizes))):
        size, n = int(sizes[k]), int(left[k])
        while n:
            room = min((r for r, g in by_room.items() if r >= size and g), default=None)
            if room is None:
                per = min(capacity // size, n)
                by_room.setdefault(capacity - per * size, []).append(({k: per}, n // per))
                n %= per
                continue
            # The sequence just filled is the fullest that fits, so it takes the next piece too.
            config, count = by_room[room].pop()
            per = min(room // size, n)
            used = min(count, n // per)
            if count > used:
                by_room[room].append((config, count - used))
            grown = {**config, k: config.get(k, 0) + per}
            by_room.setdefault(room - per * size, []).append((grown, used))
            n -= per * used
    return [x for g in by_room.values() for x in g]


def rounded(sizes: np.ndarray, want: np.ndarray, capacity: int, chosen: list[tuple[dict[int, int], float]], up: bool) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations that place every piece once: amounts are
    rounded (``up``: to the nearest, one at least; else down), what is left is
    placed best-fit."""
    out, left = [], want.astype(np.int64).copy()
    for config, amount in chosen:
        n = min(max(1, round(amount)) if up else int(amount + 1e-6), *(int(left[k]) // m for k, m in config.items()))
        if n > 0:
            out.append((config, n))
            for k, m in config.items():
                left[k] -= n * m
    some = np.flatnonzero(left)
    return out + [({int(some[k]): m for k, m in c.items()}, n) for c, n in best_fit(sizes[some], left[some], capacity)]


def plan(histogram: dict[int, int], capacity: int = 1024, refresh: int = 300, gap: float = 0.001) -> list[tuple[dict[int, int], int]]:
    """(configuration {length: pieces}, number of sequences) that place every
    piece of the histogram exactly once: the fewest sequences among the rounded
    programs and best-fit alone. The number of pieces does not add to the work."""
    left = {int(s): int(n) for s, n in histogram.items() if n}
    whole = [({capacity: 1}, left.pop(capacity))] if capacity in left else []
    if not left:
        return whole
    sizes = np.array(sorted(left), np.int64)
    want = np.array([left[int(s)] for s in sizes], float)
    count = lambda p: sum(n for _, n in p)
    plain = best_fit(sizes, want.astype(np.int64), capacity)
    plans, known, value, bound = [plain], plain, float(count(plain)), float(sizes @ want) / capacity

    for step, rate, power in ((1.0, 0.3, 1.2), (1.0, 0.0, 1.05), (0.2, 4.0, 1.05)):
        if not settled(min(map(count, plans)), bound, 0):
            found, low = weigh(sizes, want, capacity, step, rate, power)
            found.sort(key=lambda c: -c[1])
            plans += [rounded(sizes, want, capacity, found, up) for up in (False, True)]
            bound = max(bound, low)
            if sum(a for _, a in found) < value:
                known, value = found, sum(a for _, a in found)
    if not settled(value, bound, gap) and not settled(min(map(count, plans)), bound, 0):
        start = [c for c, _ in sorted(known, key=lambda c: -c[1])]
        found, bound = covering(sizes, want, capacity, start, bound, min(map(count, plans)), gap, refresh=refresh)
        plans += [rounded(sizes, want, capacity, found, up) for up in (False, True)]
    out: dict[tuple, int] = {}
    for config, n in min(plans, key=count):
        key = tuple(sorted((int(sizes[k]), m) for k, m in config.items() if m))
        out[key] = out.get(key, 0) + n
    return whole + [(dict(k), n) for k, n in out.items()]


def slots(configs: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, pieces and place per sequence of
    each configuration that holds it, in rank order."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for config, n in configs:
        place = 0
        for size, m in sorted(config.items(), reverse=True):
            rows.setdefault(size, []).append((taken.get(size, 0), sequence, m, place))
            taken[size] = taken.get(size, 0) + n * m
            place += size * m
        sequence += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in rows.items()}


def ranked(pieces: DataFrame, slice_rows: int = 500) -> DataFrame:
    """Pieces with ``rank``, from 0 inside each length. A length is ranked in
    slices of about ``slice_rows`` pieces, so none fills a task."""
    counts = pieces.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("cuts")).collect()  # one row per length
    cuts = F.create_map(*[F.lit(x) for r in counts for x in (r["length"], r["cuts"])]) if counts else F.create_map(F.lit(0).cast("long"), F.lit(1))
    cut = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.element_at(cuts, F.col("length"))).cast("int"))
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "piece", "ids_crc32")) - 1
    return cut.withColumn("inside", inside).join(sizes, ["length", "slice"]).withColumn("rank", F.col("inside") + F.col("base")).drop("inside", "base", "slice")


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; sequences are gapless from 0
    and hold at most ``capacity`` tokens."""
    pieces = cut_lineage(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    key = pieces.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                first, seq, per, place = key.value[size]
                c = np.searchsorted(first, rank[rows], side="right") - 1
                k = rank[rows] - first[c]
                sequence[rows] = seq[c] + k // per[c]
                offset[rows] = place[c] + k % per[c] * size
            cols = [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = f"id {sql_type(pieces, 'id')}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked(pieces).select("id", "piece", "start", "length", "ids_crc32", "rank"), run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all rows.

    Rows that repeat an id or a text are packed each on their own; null ids stay
    null; very long texts are pieces of ``capacity``; further columns, of any
    name, take no part; an empty table gives no rows.
    """
    return pack_pieces(token_pieces(docs, id_col, text_col, capacity, **options), capacity)

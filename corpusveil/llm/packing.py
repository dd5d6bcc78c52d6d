"""Packing token sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fit one sequence. The program asks for the fewest
configurations, in fractions, that cover the histogram. It is solved by multiplicative weights: each round
prices the lengths by how far they are covered, a knapsack dynamic program finds the dearest configuration
that holds each length at these prices, and lengths that lag behind the round's target buy theirs if it is
among the dearest of all. Targets grow by a constant factor, so that early rounds at bad prices weigh little.
Rounds end when the uses, scaled to cover the histogram, are within GAP of the dual bound, or after ROUNDS.

The scaled uses are rounded down along the sorted configurations, each taking over what its predecessors'
fractions or exhausted lengths left unused. Only the pieces that this leaves go to best fit, longest first.

Only the histogram (at most `capacity` numbers) reaches the driver, and the plan's size depends on the
capacity and the rounds alone. Pieces find their sequences by their rank among the pieces of a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, scratch, small_or_plain, texts, tune
from .tokens import encoder

#: Most rounds of multiplicative weights, and the gap to the dual bound at which they end.
ROUNDS, GAP = 400, 0.02
#: The weights' step, the growth of the targets, and how far below the dearest a configuration may be.
STEP, GROWTH, SLACK = 0.1, 1.02, 0.1


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest total price for each capacity up to this one, and a length to take for it (0: none); prices[l] is 0 for lengths not wanted."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    wanted = np.flatnonzero(prices > 0)
    price, fit = prices[wanted], np.searchsorted(wanted, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fit[c]:
            value = best[c - wanted[:n]] + price[:n]
            i = int(value.argmax())
            if value[i] >= best[c]:
                best[c], last[c] = value[i], wanted[i]
    return best, last


def filled(last: list[int], capacity: int) -> list[int]:
    """The lengths that the knapsack program takes for a capacity."""
    out, c = [], capacity
    while c > 0:
        if last[c]:
            out.append(last[c])
            c -= last[c]
        else:
            c -= 1
    return out


def dearest(prices: np.ndarray, capacity: int) -> list[int]:
    """The lengths (repeats allowed) of largest total price that fit the capacity; prices[l] is 0 for lengths not wanted."""
    return filled(knapsack(prices, capacity)[1].tolist(), capacity)


def best_fit(need: dict[int, int], capacity: int) -> Counter[tuple[int, ...]]:
    """Best fit, longest lengths first, on counts: equal sequences are filled together, so the work does not grow with the counts."""
    uses: Counter[tuple[int, ...]] = Counter()
    room: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(config: tuple[int, ...], free: int, n: int) -> None:
        if free == 0:
            uses[config] += n
            return
        if free not in open_:
            insort(room, free)
        open_.setdefault(free, []).append((config, n))

    for length in sorted(need, reverse=True):
        n = need[length]
        while n:
            i = bisect_left(room, length)
            if i == len(room):
                k = capacity // length
                if n >= k:
                    put((length,) * k, capacity - k * length, n // k)
                if n % k:
                    put((length,) * (n % k), capacity - n % k * length, 1)
                break
            free = room[i]
            config, m = open_[free].pop()
            if not open_[free]:
                del open_[free], room[i]
            if n < m:
                put(config, free, m - n)
            put((*config, length), free - length, min(n, m))
            n -= min(n, m)
    for held in open_.values():
        for config, n in held:
            uses[config] += n
    return uses


def fractional(need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional uses of configurations that cover need[l] pieces of each length l, and the dual bound: no cover uses less in all."""
    lengths = np.flatnonzero(need)
    if not len(lengths):
        return {}, 0.0
    n, at = need[lengths].astype(float), np.zeros(capacity + 1, dtype=np.int64)
    at[lengths] = np.arange(len(lengths))
    cover, weights, prices = np.zeros(len(lengths)), lengths / capacity, np.zeros(capacity + 1)
    uses: dict[tuple[int, ...], float] = {}
    bound, target = 0.0, 1.0
    for done in range(1, rounds + 1):
        prices[lengths] = weights
        best, last = knapsack(prices, capacity)
        bound = max(bound, float(n @ weights) / best[capacity])
        near = (weights + best[capacity - lengths] >= (1 - SLACK) * best[capacity]) | (done == rounds)
        take = last.tolist()
        for i in np.argsort(cover, kind="stable").tolist():
            lack = target - cover[i]
            if lack <= 0 or not near[i]:
                continue
            length = int(lengths[i])
            config = tuple(sorted([length, *filled(take, capacity - length)], reverse=True))
            counts = Counter(config)
            times = lack * n[i] / counts[length]
            uses[config] = uses.get(config, 0.0) + times
            for x, k in counts.items():
                cover[at[x]] += k * times / n[at[x]]
        least = float(cover.min())
        if least > 0 and sum(uses.values()) <= (1 + GAP) * bound * least:
            break
        weights = lengths / capacity * np.exp(-STEP * (cover - least) / target)
        target *= GROWTH
    return {config: x / least for config, x in uses.items()}, bound


def rounded(uses: dict[tuple[int, ...], float], need: np.ndarray) -> tuple[Counter[tuple[int, ...]], np.ndarray]:
    """Whole uses, in all no more than the fractional ones and of no length more than needed, and the pieces that they leave."""
    left, out, total, done = need.copy(), Counter(), 0.0, 0
    for config in sorted(uses, reverse=True):
        total += uses[config]
        counts = Counter(config)
        times = min(int(total + 1e-9) - done, *(int(left[x]) // k for x, k in counts.items()))
        if times > 0:
            out[config] = times
            done += times
            for x, k in counts.items():
                left[x] -= k * times
    return out, left


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Configurations and their uses, which hold each length exactly as often as the histogram says, and a lower bound of their number.

    The bound is the program's dual value at the best prices met, so no packing needs fewer sequences.
    """
    need = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        need[length] = n
    full, need[capacity] = int(need[capacity]), 0
    fractions, bound = fractional(need, capacity, rounds)
    uses, left = rounded(fractions, need)
    uses += best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, capacity)
    if full:
        uses[(capacity,)] = full
    return sorted(uses.items(), reverse=True), full + int(np.ceil(bound - 1e-9))


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, capacity: int, end_id: int, large: bool = False) -> DataFrame:
    """One row per piece of a document: k, piece, start, length, ids_crc32, and its place (part, rank) among the pieces of its length.

    A document is its ids with the end id. Longer ones than the capacity are cut from the end into pieces
    of the capacity, so only the first piece may be shorter. A null text is as an empty one. `large`: workers keep a large cache of chunks.
    """
    schema = pa.schema([("k", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, True, large), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            rows: list[tuple] = []
            for k, ids in zip(b.column("k").to_pylist(), enc.encode([t or "" for t in b.column("t").to_pylist()]), strict=True):
                ids, n = ids + end, len(ids) // 4 + 1
                first = (n - 1) % capacity + 1
                at = 0
                for i in range((n - 1) // capacity + 1):
                    length = capacity if i else first
                    rows.append((k, i, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, int(seen[length])))
                    seen[length] += 1
                    at += length
            yield batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True))) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return texts(docs, key, text).mapInArrow(run, "k long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def slots(uses: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length its runs of places, as rows (first rank, first sequence, places a sequence, first offset)."""
    runs: dict[int, list[list[int]]] = {}
    filled: Counter[int] = Counter()
    base = 0
    for config, n in uses:
        offset = 0
        for length, k in sorted(Counter(config).items(), reverse=True):
            runs.setdefault(length, []).append([filled[length], base, k, offset])
            filled[length] += k * n
            offset += k * length
        base += n
    return {length: np.array(r, dtype=np.int64) for length, r in runs.items()}


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str, capacity: int = 1024, end_id: int = 2, large: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the method finds.

    Returns one row per piece: k, piece, start, length, ids_crc32, sequence_id, offset. Every row of `docs`
    is packed, repeated keys and null keys too; an empty table gives no rows. `large` is for jobs whose workers
    have their memory to themselves: they keep more chunks of text, for less time.
    """
    tune(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _packed(pieces(docs, key, text, tokenizer, capacity, end_id, large), capacity)


def _packed(found: DataFrame, capacity: int) -> DataFrame:
    cut_ = cut(found, "pieces", keep=True)
    counts = cut(cut_.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = slots(solve(histogram, capacity)[0])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base"), "bases", keep=True)
    ranked = cut_.join(small_or_plain(bases), ["part", "length"]).select("k", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    schema = pa.schema([("k", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                runs = plan[int(length)]
                run_ = runs[np.searchsorted(runs[:, 0], ranks[mine], side="right") - 1]
                at = ranks[mine] - run_[:, 0]
                sequence[mine] = run_[:, 1] + at // run_[:, 2]
                offset[mine] = run_[:, 3] + at % run_[:, 2] * length
            yield batch(schema, k=b.column("k"), piece=b.column("piece"), start=b.column("start"), length=lengths, ids_crc32=b.column("ids_crc32"), sequence_id=sequence, offset=offset)

    return ranked.mapInArrow(run, "k long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

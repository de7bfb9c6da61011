"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

A document is its token ids and an end id. Documents over the sequence length are
cut: full-length pieces from the end, so only the first piece is shorter. Full
pieces fill sequences of their own; the others are packed.

Pieces of one length are interchangeable, so the packing problem is the histogram
of lengths (at most ``capacity`` numbers, whatever the corpus), and a packing is a
set of patterns (lengths that share a sequence) with multiplicities. Each island
evolves packings in a Spark task: crossover injects whole well-filled patterns of
one parent into the other, which loses what would then be packed twice, and the
displaced pieces are put back best fit, longest first. Between epochs each island
sends its elite on to the next. The plan (one row a pattern and slot) then places
pieces by their rank among those of equal length; ranks come from counts by task,
so no length, however common, is gathered in one place.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, given_back, read, small_batches
from .tokens import Encoder

CAPACITY, END = 1024, 2
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 2, 6, 4

Packing = dict[tuple[int, ...], int]


# --- pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(df: DataFrame, vocabulary: str, text: str = "text", id_: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece; ``nth`` counts those of equal length in the task before it. Null text is empty: one piece of the end id."""
    small_batches(df.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        encoder = _encoder(vocabulary)
        for x in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, raw in zip(x.column(0).to_pylist(), encoder.raw([t or "" for t in x.column(1).to_pylist()]), strict=True):
                raw += tail
                n = len(raw) // 4
                first = n % capacity or min(n, capacity)
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    for c, v in zip(rows, (doc, k, a, z - a, zlib.crc32(memoryview(raw)[4 * a : 4 * z]), task, seen[z - a]), strict=True):
                        c.append(v)
                    seen[z - a] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return df.select(F.col(id_).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


# --- the problem and its solutions, by length


def bins(packing: Packing) -> int:
    return sum(packing.values())


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer sequences, then fuller ones (by the square of the fill)."""
    return -bins(packing), sum(m * (sum(p) / capacity) ** 2 for p, m in packing.items()) / max(1, bins(packing))


def bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer: total length, and pieces over half a sequence need one each."""
    return max(-(-sum(s * c for s, c in counts.items()) // capacity), sum(c for s, c in counts.items() if 2 * s > capacity))


def _fill(first: int, counts: Counter, capacity: int, rng: random.Random) -> tuple[int, ...]:
    """A pattern with ``first`` and few others that leaves as little room as it can."""
    room = capacity - first
    best: tuple[int, ...] = ()
    sizes = sorted(s for s, c in counts.items() if c > (s == first))
    if not sizes:
        return (first,)
    for _ in range(6):
        left, got, used = room, [], Counter([first])
        depth = rng.randint(0, 3)
        while left >= sizes[0]:
            i = bisect_left(sizes, left + 1) - 1
            if depth > len(got):
                i = rng.randint(0, i)
            while i >= 0 and used[sizes[i]] >= counts[sizes[i]]:
                i -= 1
            if i < 0:
                break
            got.append(sizes[i])
            used[sizes[i]] += 1
            left -= sizes[i]
        if not best or sum(got) > sum(best):
            best = tuple(got)
        if sum(best) == room:
            break
    return tuple(sorted((first, *best), reverse=True))


def greedy(counts: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """Longest first; a pattern is used as often as its lengths last, so each step ends one length."""
    left, out = Counter({s: c for s, c in counts.items() if c}), Counter()
    while left:
        first = max(left)
        pattern = _fill(first, left, capacity, rng)
        need = Counter(pattern)
        times = min(left[s] // n for s, n in need.items())
        out[pattern] += times
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return dict(out)


def best_fit(packing: Packing, displaced: Counter, capacity: int, rng: random.Random) -> Packing:
    """The displaced pieces, longest first, each to the fullest sequence that has room; what no sequence holds opens new ones."""
    out = Counter(packing)
    room: dict[int, list] = {}
    for p in out:
        room.setdefault(capacity - sum(p), []).append(p)
    gaps = sorted(g for g in room if g)
    rest: Counter = Counter()
    for s in sorted(displaced, reverse=True):
        n = displaced[s]
        while n:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                rest[s] += n
                break
            gap = gaps[i]
            p = room[gap].pop()
            if not room[gap]:
                del room[gap], gaps[i]
            m = min(n, out[p])
            if not m:
                continue
            n -= m
            out[p] -= m
            new = tuple(sorted((*p, s), reverse=True))
            if out[p]:
                if gap not in room:
                    insort(gaps, gap)
                room.setdefault(gap, []).append(p)
            fresh = new not in out or not out[new]
            out[new] += m
            if fresh and gap > s:
                if gap - s not in room:
                    insort(gaps, gap - s)
                room.setdefault(gap - s, []).append(new)
    for p, m in greedy(rest, capacity, rng).items():
        out[p] += m
    return {p: m for p, m in out.items() if m}


def cross(a: Packing, b: Packing, counts: dict[int, int], capacity: int, rng: random.Random) -> Packing:
    """b's well-filled patterns, a share of them, whole; then a's as far as pieces are left; then the displaced ones."""
    left, child = Counter(counts), Counter()

    def take(p: tuple[int, ...], m: int) -> None:
        need = Counter(p)
        m = min(m, *(left[s] // n for s, n in need.items()))
        if m > 0:
            child[p] += m
            for s, n in need.items():
                left[s] -= n * m

    full = sorted(b, key=lambda p: -sum(p))
    full = full[: max(1, len(full) * 3 // 4)]
    for p in rng.sample(full, max(1, len(full) // 2)):
        take(p, b[p])
    for p in sorted(a, key=lambda p: -sum(p)):
        if sum(p) * 50 >= capacity * 49 or rng.random() < 0.5:
            take(p, a[p])
    return best_fit(dict(child), +left, capacity, rng)


def mutate(packing: Packing, capacity: int, rng: random.Random) -> Packing:
    """The emptiest patterns and a few others are taken apart and their pieces put back."""
    by = sorted(packing, key=sum)
    gone = set(by[: max(1, len(by) // 10)]) | set(rng.sample(by, max(1, len(by) // 20)))
    displaced: Counter = Counter()
    for p in gone:
        for s in p:
            displaced[s] += packing[p]
    return best_fit({p: m for p, m in packing.items() if p not in gone}, displaced, capacity, rng)


def evolve(counts: dict[int, int], seeds: list[Packing], seed: int, capacity: int = CAPACITY) -> list[Packing]:
    """An island's epoch: the population, best first."""
    rng, least = random.Random(seed), bound(counts, capacity)
    people = [*seeds]
    while len(people) < POPULATION:
        people.append(greedy(counts, capacity, rng))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: fitness(p, capacity), reverse=True)
        if bins(people[0]) <= least:
            break
        a, b = rng.sample(people[: max(2, POPULATION // 2 + 1)], 2)
        people = [*people[: POPULATION - 2], cross(a, b, counts, capacity, rng), mutate(people[0], capacity, rng)]
    return sorted(people, key=lambda p: fitness(p, capacity), reverse=True)[:POPULATION]


def plan(spark, counts: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """The best packing of the islands. counts: pieces by length, under ``capacity`` each."""
    if not counts:
        return {}
    elites: list[Packing] = []
    for epoch in range(EPOCHS):
        seeds = elites

        @given_back
        def island(batches: Iterator[pa.RecordBatch], epoch: int = epoch, seeds: list = seeds) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for k in x.column(0).to_pylist():
                    own = [seeds[k], seeds[(k + 1) % len(seeds)]] if seeds else []
                    best = evolve(counts, own, 1000 * epoch + k, capacity)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(best), pa.int64()), pa.array(map(list, best), pa.list_(pa.int32())), pa.array(best.values(), pa.int64())], ["k", "pattern", "times"])

        got: dict[int, Packing] = {}
        for r in spark.range(0, ISLANDS, 1, ISLANDS).mapInArrow(island, "k long, pattern array<int>, times long").collect():
            got.setdefault(r.k, {})[tuple(r.pattern)] = r.times
        elites = [got[k] for k in sorted(got)]
        best = max(elites, key=lambda p: fitness(p, capacity))
        if bins(best) <= bound(counts, capacity):
            break
    return best


def slots(packing: Packing) -> dict[int, np.ndarray]:
    """By length: rows (rank from, sequence of that rank, offset); the next row's rank ends the range."""
    out: dict[int, list] = {}
    rank: Counter = Counter()
    base = 0
    for p in sorted(packing, reverse=True):
        at = 0
        for s in p:
            out.setdefault(s, []).append((rank[s], base, at))
            rank[s] += packing[p]
            at += s
        base += packing[p]
    return {s: np.array(v, np.int64) for s, v in out.items()}


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of `pieces`, with sequence_id and offset. Full pieces come after the packed sequences."""
    spark = made.sparkSession
    made = cut(made)
    counted = cut(made.groupBy("task", "length").count())
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    packing = plan(spark, {s: c for s, c in counts.items() if s < capacity}, capacity)
    table, after = slots(packing), bins(packing)
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("task", "length", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    ranked = made.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    @given_back
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            length, rank = x.column(3).to_numpy(), x.column(5).to_numpy()
            sequence, offset = after + rank, np.zeros(len(rank), np.int64)
            for s in np.unique(length[length < capacity]).tolist():
                own, t = np.flatnonzero(length == s), table[s]
                row = np.searchsorted(t[:, 0], rank[own], "right") - 1
                sequence[own] = t[row, 1] + rank[own] - t[row, 0]
                offset[own] = t[row, 2]
            yield pa.RecordBatch.from_arrays([*x.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    from .tokens import public

    return pack(pieces(docs, vocabulary or public("byte_bpe_50k.tiktoken")))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))

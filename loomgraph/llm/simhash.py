"""SimHash near-dedup: 64-bit fingerprints, linked at a Hamming distance by pigeonhole blocks.

A fingerprint's bits are cut into ``blocks`` blocks. Two fingerprints that differ
in at most ``distance`` bits agree on blocks - distance of them at least, so each
fingerprint is sent once for each choice of that many blocks, and only those that
agree on a whole choice (about half of the bits, by default) meet and are verified.
Equal fingerprints are one row from the start, so copies cost nothing. Rows that meet
lie in order, so a task holds one block list at a time. No link is lost and no list is
capped: the rows of a list over ``SPLIT`` fingerprints are dealt again by choices of
blocks of their remaining bits; what agrees on those too has some 16 bits left, so such
lists are bounded. What leaves a task is one link a node, not the pairs. Null and empty
texts have the fingerprint zero and are linked like any other.

The query has no SQL twin: DuckDB has no XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, cut, given_back, partitions, read, small_batches, spread_join
from .components import connected_components, local_roots
from .words import chunks

WORDS, DISTANCE, BLOCKS, SEED = 3, 3, 6, 42
SPLIT = 4096
#: Lists up to this length are compared many at a time.
LIST = 128
_HELD = 200_000


def simhash(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """Fingerprints, unsigned; shingles count as often as they occur."""
    parts = [np.empty(0, np.uint64)]
    for i, j, w in chunks(texts, lower=True):
        joined, length = w.join(), w.ends - w.starts
        at = np.concatenate([[0], np.cumsum(length + 1)])
        count = np.diff(w.first)
        n = np.where(count >= words, count - words + 1, (count > 0).astype(count.dtype))
        upto = np.concatenate([[0], np.cumsum(n)])
        word = np.arange(upto[-1]) + np.repeat(w.first[:-1] - upto[:-1], n)
        last = word + np.repeat(np.minimum(count, words), n)
        spans = zip(at[word].tolist(), (at[last] - 1).tolist(), strict=True)
        raw = np.frombuffer(b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
        out = np.zeros((j - i, 64), bool)
        bits = np.unpackbits(raw, axis=1)
        for d in np.flatnonzero(n).tolist():
            out[d] = bits[upto[d] : upto[d + 1]].sum(axis=0, dtype=np.uint32) * 2 > n[d]
        parts.append(np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64))
    return np.concatenate(parts)


def masks(bits: list[int], blocks: int, agree: int) -> list[int]:
    """One mask for each choice of ``agree`` of the blocks that ``bits`` are cut into."""
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    ones = [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(ones, agree)]


def finer(mask: int, blocks: int, agree: int) -> list[int]:
    """The mask with each choice of blocks of the bits outside it."""
    return [mask | m for m in masks([b for b in range(64) if not mask >> b & 1], blocks, agree)]


def _in_groups(group: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows of equal ``group``, which lie together."""
    live, d = np.arange(len(fp)), 1
    while True:
        live = live[live + d < len(fp)]
        live = live[group[live] == group[live + d]]
        if not len(live):
            return
        near = np.bitwise_count(fp[live] ^ fp[live + d]) <= distance
        if near.any():
            yield live[near], live[near] + d
        d += 1


def _roots(fp: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of one list the place of the first that links lead to. What is joined is kept, not the links,
    so a list takes memory in proportion to its length; it ends early once all are joined."""
    label = np.arange(len(fp))
    for d in range(1, len(fp)):
        a = np.flatnonzero(np.bitwise_count(fp[:-d] ^ fp[d:]) <= distance)
        apart = label[a] != label[a + d]
        if apart.any():
            nodes, roots = local_roots(label[a[apart]], label[a[apart] + d])
            table = np.arange(len(fp))
            table[nodes] = roots
            label = table[label]
            if not label.any():
                break
    return label


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(df: DataFrame, text: str = "text", id_: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(doc_id, f0): the fingerprint as a signed long."""
    small_batches(df.sparkSession)

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(simhash(x.column(1), words).view(np.int64))], ["doc_id", "f0"])

    return df.select(F.col(id_).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, f0 long")


def links(unique: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """Links (u, v) of column ``node`` that join all rows whose fingerprints (f0, distinct) are at the distance or nearer."""
    table = masks(list(range(64)), blocks, blocks - distance)
    choices = [F.struct(F.lit(c).alias("c"), F.col("f0").bitwiseAND(F.lit(_signed(m))).alias("key")) for c, m in enumerate(table)]
    rows = unique.select("node", "f0", F.explode(F.array(*choices)).alias("k")).select("k.c", "k.key", "node", "f0")

    @given_back
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            node, f0, c = (x.column(k).to_numpy() for k in range(3))
            for own in np.unique(c).tolist():
                at = c == own
                for k, m in enumerate(finer(table[own], blocks, blocks - distance)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(at.sum(), own * 1000 + k, np.int32)), pa.array(f0[at] & np.int64(_signed(m))), pa.array(node[at]), pa.array(f0[at])], ["c", "key", "node", "f0"])

    out = cut(_linked(rows, distance, split))
    found, long = out.where("c is null").select("u", "v"), out.where("c is not null")
    if long.take(1):
        found = found.union(_linked(long.mapInArrow(again, "c int, key long, node long, f0 long"), distance, None).select("u", "v"))
    return found


def _linked(rows: DataFrame, distance: int, split: int | None) -> DataFrame:
    """Links (u, v, null) within block lists, contracted task by task; rows of lists over ``split`` come back as (node, f0, c)."""
    dealt = rows.repartition(partitions(rows.sparkSession), "c", "key").sortWithinPartitions("c", "key")

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        c, key, node, f0 = none.astype(np.int32), none, none, none
        passing: tuple | None = None  # the list, too long, that is being passed on
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def batch(u: np.ndarray, v: np.ndarray, c: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int32()) if c is None else pa.array(c)], ["u", "v", "c"])

        for x in _with_end(batches):
            if x is not None:
                c, key, node, f0 = (np.concatenate([old, x.column(k).to_numpy()]) for k, old in enumerate((c, key, node, f0)))
            if not len(c):
                continue
            fresh = np.append(True, (c[1:] != c[:-1]) | (key[1:] != key[:-1]))
            start = np.flatnonzero(fresh)
            size = np.diff(start, append=len(c))
            whole = len(c) if x is None else int(start[-1])  # the last list may go on
            long = size > split if split else np.zeros(len(size), bool)
            if passing is not None:
                long[0] |= passing == (int(c[0]), int(key[0]))
            on = np.repeat(long, size)
            passing = (int(c[-1]), int(key[-1])) if long[-1] else None
            if on.any():
                yield batch(node[on], f0[on], c[on])
            done = ~on & (np.arange(len(c)) < whole)
            for g in np.flatnonzero((size > LIST) & ~long & (start < whole)).tolist():
                a, z = int(start[g]), int(start[g] + size[g])
                roots = _roots(f0[a:z].view(np.uint64), distance)
                far = np.flatnonzero(roots != np.arange(z - a))
                held.append((node[a:z][far], node[a:z][roots[far]]))
            few = done & np.repeat(size <= LIST, size)
            group, own = np.repeat(np.arange(len(size)), size)[few], node[few]
            for a, b in _in_groups(group, f0[few].view(np.uint64), distance):
                held.append((own[a], own[b]))
            if sum(len(a) for a, _ in held) > _HELD:
                held = [_contracted(held)]
            stay = ~on & ~done
            c, key, node, f0 = c[stay], key[stay], node[stay], f0[stay]
        if held:
            yield batch(*_contracted(held))

    return dealt.mapInArrow(run, "u long, v long, c int")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _contracted(held: list) -> tuple[np.ndarray, np.ndarray]:
    nodes, roots = local_roots(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
    far = nodes != roots
    return nodes[far], roots[far]


def components(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """(doc_id, f0, component_id) of fingerprints: the smallest doc_id of those reachable by links, itself included; null ids count last."""
    fps = cut(fps)
    unique = fps.groupBy("f0").agg(F.min("doc_id").alias("low"))
    unique = cut(unique.withColumn("node", F.monotonically_increasing_id()))
    found = connected_components(links(unique.select("node", "f0"), distance, blocks, split)).withColumnRenamed("root", "to")
    rooted = cut(unique.join(found, "node", "left").select("f0", "low", F.coalesce("to", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return spread_join(fps, spread_join(rooted, least, "root").select("f0", "component_id"), "f0").select("doc_id", "f0", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies (`near`): of each group the document with the smallest doc_id stays (null ids count last),
    and of rows of a group that repeat that id the one with the least text. Rows go by id and text, so that another text
    of the same id is not touched."""
    from .near import groups  # which links by fingerprints itself

    rows = groups(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("low"))
    again = rows.where(stays).groupBy("group").count().where("count > 1").select("group")
    again = cut(rows.where(stays).join(again, "group").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_of"), F.col("group").alias("_group")).distinct())
    gone = checked(rows.where(~stays).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_of")).union(again.select("_id", "_of")).distinct())
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))
    left = hashed.join(gone, same, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    least = F.min(F.struct("text", *(c for c in docs.columns if c != "text"))).alias("row")
    return left.union(hashed.join(again, same).groupBy("_group").agg(least).select(*(F.col(f"row.{c}") for c in docs.columns)))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(fingerprints(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")

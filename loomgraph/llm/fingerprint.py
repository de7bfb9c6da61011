"""Document fingerprints: bottom-k sketches of five-word shingles.

A sketch is the k smallest distinct 48-bit hashes of a text's shingles. Sketches
of parts merge into that of the union (`merge`); two of them estimate resemblance
and containment, one the number of distinct shingles. Texts of one to four words
have one shingle, their whole sequence; null, empty and blank texts have the empty
sketch. Repeated shingles count once. Text length only costs time: each text is
hashed whole, and texts are cut into bounded runs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, read, small_batches
from .words import U, chunks, shingles

K, WORDS = 128, 5
_TOP = 1 << 48


def bottom_k(h: np.ndarray, k: int = K) -> np.ndarray:
    n = len(h)
    if n > 8 * k:
        few = h[h < U(int(3 * k / n * _TOP))]
        few = np.unique(few)
        if len(few) >= k:
            return few[:k]
    return np.unique(h)[:k]


def sketches(texts: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i, j, w in chunks(texts):
        h, at = shingles(w, words)
        h >>= U(16)
        out += [bottom_k(h[at[d] : at[d + 1]], k) for d in range(j - i)]
    return out


def to_text(sketch: np.ndarray) -> str:
    """Six bytes a value, big-endian, in base64."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(U)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _TOP / float(sketch[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets; two empty sets are alike, 1."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(common, both, assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; the empty set is contained, 1."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * distinct(merge(a, b, k), k) / distinct(a, k))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, words: int = WORDS) -> DataFrame:
    """df with a sketch of each row's text, as text in column ``out`` (which replaces one of that name)."""
    from pyspark.sql.types import StringType, StructField, StructType

    kept = [c for c in df.columns if c != out]
    schema = StructType([*(df.schema[c] for c in kept), StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = pa.array([to_text(s) for s in sketches(x.column(x.schema.get_field_index(text)), k, words)], pa.string())
            yield pa.RecordBatch.from_arrays([*(x.column(x.schema.get_field_index(c)) for c in kept), made], [*kept, out])

    return df.mapInArrow(run, schema)


def merge_by(df: DataFrame, by: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One merged sketch a group: values are exploded, made distinct map-side, and the k least kept per salted part before the parts meet."""
    raw = F.unbase64(fingerprint)
    value = F.explode_outer(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(raw) / 6).cast("int") - 1)), lambda i: F.hex(F.substring(raw, i * 6 + 1, F.lit(6)))))
    rows = df.select(*by, value.alias("v")).where("v <> ''").distinct()
    part = rows.groupBy(*by, F.substring("v", -2, 2).alias("salt")).agg(F.slice(F.sort_array(F.collect_list("v")), 1, k).alias("vs"))
    return part.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("vs"))), 1, k).alias("vs")).select(*by, F.translate(F.base64(F.unhex(F.array_join("vs", ""))), "\r\n", "").alias(fingerprint))


# --- the query's edited texts: each document with its neighbour in id order

_LOW = -(1 << 63)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _key(id_: Column) -> Column:
    return F.coalesce(id_.cast("long"), F.lit(_LOW))


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last floor(n/2) code
    points replaced by as many first ones of the next document, or all it has).

    Order is by descending doc_id, null ids last, equal ids by text; after the last
    comes the first. Id ranges (bounded in number by the partitions) hold contiguous
    documents; the first document of each range is also sent to the range before it,
    so each text is shuffled once and no task sees more than its ranges. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = docs.select(F.percentile_approx(_key(F.col("doc_id")), [i / (4 * n) for i in range(1, 4 * n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    asc = np.array(cuts, np.int64)
    ids = docs.select(_key(F.col("doc_id")).alias("key"))

    def ranges(keys: np.ndarray) -> np.ndarray:
        return len(asc) - np.searchsorted(asc, keys, "right")

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for x in batches:
            keys = x.column(0).to_numpy(zero_copy_only=False)
            if len(keys):
                b = ranges(keys)
                order = np.lexsort((keys, b))
                last = np.flatnonzero(np.diff(b[order], append=-1))
                for q, v in zip(b[order][last].tolist(), keys[order][last].tolist(), strict=True):
                    top[q] = max(v, top.get(q, _LOW))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array(list(top.values()), pa.int64())], ["b", "head"])

    heads = sorted((r.b, r.head) for r in ids.mapInArrow(range_of, "b long, head long").groupBy("b").agg(F.max("head").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = np.array(sorted(before), np.int64)
        for x in batches:
            keys = x.column(2).to_numpy(zero_copy_only=False)
            own = ranges(keys)
            yield _dealt(x, own, 0)
            also = np.flatnonzero(np.isin(keys, special))
            if len(also):
                yield _dealt(x.take(pa.array(also)), np.array([before[int(v)] for v in keys[also]], np.int64), 1)

    def _dealt(x: pa.RecordBatch, b: np.ndarray, copy: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(b.astype(np.int64)), pa.array(np.full(len(b), copy, np.int32))], ["doc_id", "text", "key", "b", "copy"])

    dealt = docs.select("doc_id", "text", _key(F.col("doc_id")).alias("key")).mapInArrow(deal, "doc_id long, text string, key long, b long, copy int")
    rows = dealt.repartition(n, "b").sortWithinPartitions("b", "copy", F.desc("key"), "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held, size = None, 0
        for x in batches:
            for row in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(3).to_pylist(), x.column(4).to_pylist(), strict=True):
                if held is not None and held[2] == row[2] and not held[3]:
                    ids.append(held[0])
                    texts += [held[1], row[1]]
                    size += len(held[1])
                    if size > 4_000_000 or len(ids) >= 2000:
                        yield _compared(ids, texts, k)
                        ids, texts, size = [], [], 0
                held = row
        if ids:
            yield _compared(ids, texts, k)

    return rows.mapInArrow(pairs, OUT)


def _compared(ids: list, texts: list[str], k: int) -> pa.RecordBatch:
    own, following = texts[0::2], texts[1::2]
    new = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(own, following, strict=True)]
    a, c = sketches(pa.array(own, pa.large_string()), k), sketches(pa.array(new, pa.large_string()), k)
    same = [i + 1 < len(own) and following[i] is own[i + 1] for i in range(len(own))]
    lone = [i for i, s in enumerate(same) if not s]
    rest = dict(zip(lone, sketches(pa.array([following[i] for i in lone], pa.large_string()), k), strict=True))
    b = [a[i + 1] if s else rest[i] for i, s in enumerate(same)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array(map(to_text, a), pa.string()),
            pa.array(map(to_text, c), pa.string()),
            pa.array([resemblance(x, y, k) for x, y in zip(a, c, strict=True)], pa.float64()),
            pa.array([resemblance(x, y, k) for x, y in zip(a, b, strict=True)], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited(read(spark, sf_dir, "documents"))

"""Language identification by fusion of evidence.

Text: naive Bayes over hashed byte trigrams, fitted on a bounded sample of labelled
rows (about ``SAMPLE`` of each of the ``LABELS`` commonest labels, by hash of id and text,
whole texts, equal rows once); its log likelihood is tempered, as neighbouring trigrams aren't independent: n of them weigh
as n * SURE / (n + SURE). Declared markup language and address suffix: how often each
goes with each language, counted over the whole input by grouped aggregation and
smoothed. Host prior: the language counts of the host, smoothed towards those of its
suffix, which are smoothed towards those of all rows; a row's own count is left out.
The posterior multiplies these; the language is the likeliest, ties to the first by
name. Text without any letter has no text evidence and is undetermined, ``und``, with
confidence 0; so is text of ``ENOUGH`` trigrams or more that even its best language
explains worse than trigrams drawn evenly would be, and everything if the sample holds
no labelled text.

Nulls: null text is empty; null hosts, suffixes and declarations count as the empty
string. Hosts are counted map-side first, so a hot host is as many rows as tasks. The
``BROADCAST`` largest hosts are broadcast; rows of others, if there are more, are joined by
shuffle, so no host there holds more than a small share of all rows. Existing columns of the names added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import cut, given_back, graded_join, read, small_batches
from .words import CHUNK

BITS, SAMPLE, LABELS, SURE, ENOUGH = 15, 1000, 64, 60.0, 30
HOST, SUFFIX, TABLE = 8.0, 50.0, 1.0
BROADCAST = 20_000
ADDED = ["lang", "lang_confidence", "text_lang"]

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_NONE = 1 << BITS


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2 ** BITS + 1, languages): log probability of a trigram; the last row is nothing


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashed trigrams, where each text's begin); trigrams never span texts and those without a letter don't count."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(size)
    i = 0
    while i < len(texts):
        base = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        data = _FOLD[np.frombuffer("".join(t + "  " for t in texts.slice(i, j - i).to_pylist()).encode(), np.uint8)]
        a = np.concatenate([[0], ends[i:j] - base])
        key = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << 8 | data[2:].astype(np.uint32) << 16
        h = (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        letter = data != 32
        full = np.append(np.where(letter[:-2] | letter[1:-1] | letter[2:], h, _NONE), [_NONE, _NONE]).astype(np.int32)
        full[a[1:] - 1] = full[a[1:] - 2] = _NONE
        yield i, j, full, a
        i = j


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Trigram counts by language of about ``sample`` labelled rows each; what comes to the driver is one number a language and trigram."""
    rows = labelled.select(F.xxhash64(id_, text).alias("h"), F.trim(F.lower(lang)).alias("lang"), F.col(text).alias("text")).where("lang is not null and lang <> ''")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).collect()}
    if not sizes:
        return Model([], np.zeros((_NONE + 1, 0)))
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("lang") == name) & (F.pmod("h", F.lit(1 << 30)) < F.lit(int(min(1.0, sample / n) * (1 << 30)))))
    rows = rows.where(chosen & F.col("text").isNotNull()).dropDuplicates(["lang", "h"])

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for x in batches:
            names = np.array(x.column(0).to_pylist(), object)
            for i, j, h, a in trigrams(x.column(1)):
                each = np.repeat(np.arange(j - i), np.diff(a))
                for name in set(names[i:j]):
                    own = h[(names[i:j] == name)[each]]
                    counts[name] = counts.get(name, 0) + np.bincount(own, minlength=_NONE + 1)
        for name, c in counts.items():
            at = np.flatnonzero(c[:_NONE])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "t", "n"])

    small_batches(labelled.sparkSession)
    got = rows.select("lang", "text").mapInArrow(run, "lang string, t int, n long").groupBy("lang", "t").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column(0).to_pylist()))
    if not names:
        return Model([], np.zeros((_NONE + 1, 0)))
    table = np.zeros((_NONE, len(names)))
    index = {n: k for k, n in enumerate(names)}
    table[got.column(1).to_numpy(), [index[n] for n in got.column(0).to_pylist()]] = got.column(2).to_numpy()
    table = np.log((table + 0.5) / (table.sum(0) + 0.5 * _NONE))
    return Model(names, np.vstack([table, np.zeros(len(names))]))


def likelihoods(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log likelihoods (rows x languages) and the number of trigrams, 0 where they are of no known language."""
    out, count = [np.zeros((0, len(model.languages)))], [np.zeros(0, np.int64)]
    for _, _, h, a in trigrams(texts):
        n = np.add.reduceat((h != _NONE).astype(np.int64), a[:-1])
        total = np.column_stack([np.add.reduceat(w[h], a[:-1]) for w in model.weights.T]) if model.languages else np.zeros((len(n), 0))
        out.append(total * (SURE / (n + SURE))[:, None])
        foreign = (n >= ENOUGH) & (total.max(axis=1, initial=-np.inf) < -n * BITS * np.log(2)) if model.languages else n > 0
        count.append(np.where(foreign, 0, n))
    return np.concatenate(out), np.concatenate(count)


def scored(df: DataFrame, model: Model, text: str, drop_text: bool = False) -> DataFrame:
    """df with ``_ll`` and ``_n``."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in ("_ll", "_n") and not (drop_text and c == text)]
    which = df.columns.index(text)
    places = [df.columns.index(c) for c in kept]
    schema = StructType([*(df.schema[c] for c in kept), StructField("_ll", ArrayType(DoubleType())), StructField("_n", LongType())])

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ll, n = likelihoods(x.column(which), model)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * ll.shape[1]), pa.array(ll.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in places), flat, pa.array(n)], [*kept, "_ll", "_n"])

    return df.mapInArrow(run, schema)


def _best(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def identify(df: DataFrame, model: Model, text: str, host: Column, suffix: Column, declared: Column, keep_text: bool = True) -> DataFrame:
    """df (without its text unless keep_text) with lang, lang_confidence and text_lang."""
    names = model.languages
    kept = [c for c in df.columns if c not in ADDED and (keep_text or c != text)]
    rows = df.select(*[c for c in df.columns if c not in ADDED], *(F.lower(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((host, "_host"), (suffix, "_suffix"), (declared, "_declared"))))
    if not names:
        return rows.select(*kept, F.lit("und").alias("lang"), F.lit(0.0).alias("lang_confidence"), F.lit("und").alias("text_lang"))
    rows = scored(rows, model, text, drop_text=not keep_text)
    if not keep_text:
        rows = cut(rows)
    declared_as = F.when(F.col("_declared").isin(*names), F.col("_declared")).when(F.col("_declared") == "", "").otherwise("?")
    rows = rows.withColumn("_declared", declared_as).withColumn("_t", F.when(F.col("_n") > 0, _best(F.col("_ll"))).otherwise(-1))
    narrow = rows.select("_host", "_suffix", "_declared", "_t").where("_t >= 0")
    counted = cut(narrow.groupBy("_host", "_suffix", "_declared", "_t").agg(F.count("*").alias("n")))
    each = [F.sum(F.when(F.col("_t") == k, F.col("n")).otherwise(0)).cast("double") for k in range(len(names))]
    total = np.array(counted.agg(*each).first(), float) if counted.take(1) else np.zeros(len(names))
    total = np.nan_to_num(total) + 1
    base = F.array(*(F.lit(float(v)) for v in total / total.sum()))
    by_suffix = counted.groupBy("_suffix").agg(F.array(*each).alias("_sn"))
    by_host = counted.groupBy("_host", "_suffix").agg(F.array(*each).alias("_hn"))
    table = cut(by_host.join(by_suffix, "_suffix"))
    confusion = {r[0]: np.array(r[1], float) for r in counted.groupBy("_declared").agg(F.array(*each)).collect()}  # at most one row a language, and two
    seen = sum(confusion.values(), np.zeros(len(names)))
    odds = {d: np.log((c + TABLE) / (seen + TABLE * (len(names) + 2))) for d, c in confusion.items()}
    said = F.lit(None).cast("array<double>")
    for d, v in odds.items():
        said = F.when(F.col("_declared") == d, F.array(*(F.lit(float(z)) for z in v))).otherwise(said)
    weigh = F.aggregate("_hn", F.lit(0.0), lambda a, v: a + v)
    joined = graded_join(rows, table, ["_host", "_suffix"], weigh, BROADCAST)
    ks = range(len(names))

    def at(c: str, k: int) -> Column:
        return F.coalesce(F.col(c)[k], F.lit(0.0)) - F.when(F.col("_t") == k, 1.0).otherwise(0.0)

    def share(c: str, weight: float, parent: list[Column]) -> list[Column]:
        n = sum((at(c, k) for k in ks), F.lit(0.0))
        return [(at(c, k) + weight * parent[k]) / (n + weight) for k in ks]

    joined = joined.withColumn("_sn", F.coalesce("_sn", F.array(*[F.lit(0.0)] * len(names)))).withColumn("_hn", F.coalesce("_hn", F.array(*[F.lit(0.0)] * len(names))))
    joined = joined.withColumn("_sp", F.array(*share("_sn", SUFFIX, [base[k] for k in ks])))
    joined = joined.withColumn("_hp", F.array(*share("_hn", HOST, [F.col("_sp")[k] for k in ks])))
    zero = F.array(*[F.lit(0.0)] * len(names))
    post = F.zip_with(F.zip_with("_ll", F.coalesce(said, zero), lambda a, b: a + b), F.col("_hp"), lambda a, b: a + F.log(F.greatest(b, F.lit(1e-12))))
    joined = joined.withColumn("_post", post).withColumn("_b", _best(F.col("_post")))
    top = F.array_max("_post")
    sure = F.lit(1.0) / F.aggregate("_post", F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    name = F.array(*map(F.lit, names))
    some = F.col("_n") > 0
    return joined.select(
        *kept,
        F.when(some, name[F.col("_b")]).otherwise("und").alias("lang"),
        F.when(some, sure).otherwise(0.0).alias("lang_confidence"),
        F.when(some, name[F.greatest(F.col("_t"), F.lit(0))]).otherwise("und").alias("text_lang"),
    )


# --- pages


def visible(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]{1,8};", " ")


def declared_language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)


def suffix_of(host: Column) -> Column:
    """The last label; addresses of numbers and names without a dot have none."""
    return F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)\.?$", 1)


def of_pages(pages: DataFrame, model: Model) -> DataFrame:
    rows = pages.select("page_id", visible(F.col("html")).alias("_text"), host_of(F.col("url")).alias("host"), declared_language(F.col("html")).alias("declared"))
    return identify(rows, model, "_text", F.col("host"), suffix_of(F.col("host")), F.col("declared"), keep_text=False)


def of_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Documents have a source for a host and their own label for a declaration."""
    return identify(docs.withColumnRenamed("lang", "_label"), model, "text", F.col("source"), F.lit(""), F.col("_label"))


def op9_langid(spark, sf_dir: str) -> DataFrame:
    found = of_pages(read(spark, sf_dir, "pages"), fit(read(spark, sf_dir, "documents")))
    return found.select("page_id", "lang", F.round("lang_confidence", 6).alias("confidence"), "text_lang", "declared", "host")

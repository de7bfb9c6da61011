"""Substring dedup by recompression: words covered by a window that occurs elsewhere are removed.

Each text's words are parsed into symbols in rounds. A symbol's first form is a word or
a run of up to ``RUN`` equal words; then neighbours whose names fall on the left and the
right side of an alphabet split become pairs, up to a length cap for each round. What a
symbol is made of hashes to its candidate name, and a Spark round over the distinct
candidates of all texts decides: those that occur more than once become global names,
the others mark their place as unique. Pairs of the next round are formed of global
names only. Round 1 names words, runs and their pairs, round 2 pairs of those.

What lies outside a window can change the parse only within a margin of its edges (run
cap + the longest symbol before each pair round), so equal windows have equal interior
symbols, and a window with a unique symbol inside can't occur twice. (The margins take
up the rest of the window, so a symbol of ``CAPS[-1]`` words is the longest that every
window of 35 is sure to hold.) The windows left, whose symbols of the highest level are
all shared, are filed under the least of these (by name, then leftmost) with the words
around it that all windows filed there share. Two more Spark rounds follow: which filed
places occur elsewhere, and which of their windows do, verified over all their words by
two hashes of independent families (64 bits and the bucket's).

Every round works alike: a batch of texts sends its distinct keys to buckets, and gets
back one bit a key; a key is sent once a batch however often it occurs there, so common
passages are small. Texts travel once, as compressed batches of some MB, and lie in the
shared folder by batch; only keys and bits move after that.

Nulls are texts without words. Texts shorter than a window lose nothing. Equal rows
are separate texts, so their windows occur elsewhere. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, given_back, partitions, placed, read, runs, small_batches
from .words import U, Words, chunks, mix, windows

WINDOW = 35
RUN, CAPS = 2, (4, 8)
#: Words at a window's edges where the parse of each round may depend on what is outside.
MARGINS = (2 * RUN, 2 * RUN + CAPS[0])
BATCH = 4_000_000
#: Keys of a bucket, about: what a task holds at a time.
BUCKET = 1_000_000
_SALT = [U(0x8C3F5A91D2E6B70D), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
_OTHER = U(0xA0761D6478BD642F)


def _paired(at: np.ndarray, name: np.ndarray, shared: np.ndarray, head: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where symbols start after a round of pairs, their names, and which were made now. Only shared symbols are paired."""
    n = len(head)
    length = np.diff(at, append=n)
    right = mix(name ^ _SALT[turn]) >> U(63) == 1
    pair = ~right[:-1] & right[1:] & shared[:-1] & shared[1:] & ~head[at[1:]] & (length[:-1] + length[1:] <= CAPS[turn - 1])
    left = np.flatnonzero(pair)
    name = name.copy()
    name[left] = mix(name[left] * _SALT[turn] + (name[left + 1] ^ _OTHER))
    made, stay = np.zeros(len(at), bool), np.ones(len(at), bool)
    made[left] = True
    stay[left + 1] = False
    return at[stay], name[stay], made[stay]


class Filed:
    """The windows of one run of texts, narrowed round by round by what is shared with other places."""

    def __init__(self, words: Words, window: int = WINDOW):
        self.words, self.window = words, window
        self.h = words.hashes()
        n, first = len(self.h), words.first
        count = np.diff(first)
        ok = np.flatnonzero(count >= window)
        size = count[ok] - window + 1
        upto = np.concatenate([[0], np.cumsum(size)])
        self.starts = np.arange(upto[-1]) + np.repeat(first[:-1][ok] - upto[:-1], size)
        self.head = np.zeros(n, bool)
        self.head[first[:-1][count > 0]] = True
        fresh = np.ones(n, bool)
        fresh[1:] = (self.h[1:] != self.h[:-1]) | self.head[1:]
        run = np.flatnonzero(fresh)
        many = np.diff(run, append=n)
        short = (many >= 2) & (many <= RUN)
        start = np.ones(n, bool)
        start[~fresh & np.repeat(short, many)] = False
        name = self.h.copy()
        name[run[short]] = mix(self.h[run[short]] * _SALT[0] + many[short].astype(U))
        at = np.flatnonzero(start)
        self.at, self.name, _ = _paired(at, name[at], np.ones(len(at), bool), self.head, 1) if n else (at, name, None)
        self.keys, self.of = np.empty(0, U), np.empty(0, np.int64)

    def symbols(self) -> np.ndarray:
        """Candidate names of round 1, one a symbol."""
        return self.name

    def named(self, shared: np.ndarray) -> np.ndarray:
        """Round 1's answer, one a symbol; returns the candidate names of the pairs made of shared symbols."""
        self._drop(self.at[~shared], np.diff(self.at, append=len(self.h))[~shared], MARGINS[0])
        if len(self.at):
            self.at, self.name, self.made = _paired(self.at, self.name, shared, self.head, 2)
        else:
            self.made = np.empty(0, bool)
        return self.name[self.made]

    def pairs_named(self, shared: np.ndarray) -> np.ndarray:
        """Round 2's answer, one a pair; returns the keys under which the windows left are filed."""
        alone = np.flatnonzero(self.made)[~shared]
        self._drop(self.at[alone], np.diff(self.at, append=len(self.h))[alone], MARGINS[1])
        if len(self.starts):
            value = np.full(len(self.h), ~U(0))
            value[self.at] = mix(self.name ^ _OTHER) >> U(1)
            zone = self.window - 2 * MARGINS[1] - CAPS[1] + 1
            best = _least(value, zone)[self.starts + MARGINS[1]]
            new = np.flatnonzero(np.diff(best, prepend=-1) != 0)
            self.of = np.repeat(np.arange(len(new)), np.diff(new, append=len(best)))
            self.keys = windows(self.h, self.window - zone + 1)[best[new] - MARGINS[1]]
        return self.keys

    def _drop(self, at: np.ndarray, length: np.ndarray, margin: int) -> None:
        """Windows that hold one of these symbols within the margins go."""
        edge = np.zeros(len(self.h) + self.window + 1, np.int64)
        low = np.maximum(at + length - self.window + margin, 0)
        high = at - margin + 1
        ok = high > low
        np.add.at(edge, low[ok], 1)
        np.add.at(edge, high[ok], -1)
        self.starts = self.starts[np.cumsum(edge)[self.starts] == 0]

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of these windows, over all their words."""
        if not len(which):
            return np.empty(0, U), np.empty(0, U)
        s = self.starts[which]
        return windows(self.h, self.window)[s], windows(self.words.hashes(1), self.window, 1)[s]


def _least(value: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of value[i : i + width], the leftmost of equal ones."""
    at, run, have = np.arange(len(value)), value, 1
    while have < width:
        step = min(have, width - have)
        later = run[step:] < run[: len(run) - step]
        at = np.where(later, at[step:], at[: len(at) - step])
        run = np.where(later, run[step:], run[: len(run) - step])
        have += step
    return at


# --- batches of whole rows


def batches_of(df: DataFrame) -> DataFrame:
    """(batch, data): some MB of df's rows each, as a compressed Arrow stream, written once."""
    names = df.columns

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0
        for x in batches:
            i = 0
            while i < x.num_rows:
                step = max(1, int(x.num_rows * BATCH / max(BATCH, x.nbytes)))
                part = x.slice(i, step)
                i += step
                held.append(part)
                size += part.get_total_buffer_size() if part.num_rows == x.num_rows else x.nbytes * part.num_rows // x.num_rows
                if size >= BATCH:
                    yield packed(held, task, k)
                    held, size, k = [], 0, k + 1
        if held:
            yield packed(held, task, k)

    def packed(held: list, task: int, k: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held).rename_columns([f"c{i}" for i in range(len(names))]).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
            w.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "data"])

    return placed(df.mapInArrow(run, "batch long, data binary"), "batch")


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _column(table: pa.Table, i: int) -> pa.Array:
    got = table.column(i).combine_chunks()
    return got.chunk(0) if isinstance(got, pa.ChunkedArray) and got.num_chunks else (got if isinstance(got, pa.Array) else pa.array([], table.column(i).type))


# --- a round: keys go to buckets, bits come back


class Sent:
    """The distinct keys of one batch in order of bucket, and which occur twice there."""

    def __init__(self, bucket: np.ndarray, low: np.ndarray):
        order = np.lexsort((low, bucket))
        b, k = bucket[order], low[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        self.at = np.flatnonzero(new)
        self.bucket, self.low = b[self.at], k[self.at]
        self.twice = np.diff(self.at, append=len(b)) > 1
        self.order, self.new = order, new

    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return edge, np.append(edge[1:], len(self.bucket))[: len(edge)]

    def rows(self, batch: int) -> pa.RecordBatch:
        edge, ends = self._spans()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.bucket[edge].astype(np.int32)),
                pa.array(np.full(len(edge), batch, np.int64)),
                pa.array([self.low[a:z].tobytes() for a, z in zip(edge, ends, strict=True)], pa.binary()),
                pa.array([np.packbits(self.twice[a:z]).tobytes() for a, z in zip(edge, ends, strict=True)], pa.binary()),
            ],
            ["bucket", "batch", "keys", "twice"],
        )

    def answered(self, answers: list) -> np.ndarray:
        """For each key as given: does it occur elsewhere? answers: (bucket, bits) of this batch."""
        bits = dict(answers)
        edge, ends = self._spans()
        own = np.zeros(len(self.bucket), bool)
        for a, z in zip(edge.tolist(), ends.tolist(), strict=True):
            got = bits.get(int(self.bucket[a]))
            if got is not None:
                own[a:z] = np.unpackbits(np.frombuffer(got, np.uint8), count=z - a)
        out = np.empty(len(self.order), bool)
        out[self.order] = own[np.cumsum(self.new) - 1]
        return out


_SENT = "bucket int, batch long, keys binary, twice binary"


def answers(sent: DataFrame, width: int, name: str) -> DataFrame:
    """(batch, name) of rows of Sent: for each batch its buckets with any repeated key, and their bits."""
    kind = np.dtype(f"u{width}")

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            bucket, batch, sent, twice = (table.column(i).to_pylist() for i in range(4))
            each = [len(k) // width for k in sent]
            keys = np.frombuffer(b"".join(sent), kind)
            again = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for n, t in zip(each, twice, strict=True)])
            _, own, count = np.unique(keys, return_inverse=True, return_counts=True)
            more = count > 1
            more[own[again > 0]] = True
            bits = more[own]
            some = [(i, np.packbits(part).tobytes()) for i, part in zip(batch, np.split(bits, np.cumsum(each)[:-1]), strict=True) if part.any()]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([bucket[0]] * len(some), pa.int32()), pa.array([z for _, z in some], pa.binary())], ["batch", "bucket", "bits"])

    dealt = sent.repartition(partitions(sent.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "batch long, bucket int, bits binary")
    return dealt.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def _pairs(got: list | None) -> list:
    return [(g["bucket"], g["bits"]) for g in got or []]


def repeats(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """df's rows with ``kept`` (words outside repeated windows, joined by one space; null if all stay),
    ``n_words`` and ``n_removed``; columns of df with those names are replaced."""
    if window - 2 * MARGINS[1] < 2 * CAPS[1]:
        raise ValueError(f"windows of {window} words are too short for the symbols used")
    spark = df.sparkSession
    small_batches(spark)
    names = [c for c in df.columns if c not in ("kept", "n_words", "n_removed")]
    which = names.index(text)
    df = df.select(*names)
    blobs = batches_of(df)
    bits = max(4, (partitions(spark) - 1).bit_length(), (blobs.count() * BATCH // 10 // BUCKET).bit_length())

    def short(keys: list[np.ndarray]) -> Sent:
        """Keys by their first bits: the bucket and 32 more. Two that agree by chance are told as shared, which costs a later round."""
        k = np.concatenate([np.empty(0, U), *keys])
        return Sent((k >> U(64 - bits)).astype(np.int64), (k >> U(32 - bits)).astype(np.uint32))

    def parted(sent: Sent, got: list | None, like: list[np.ndarray]) -> list[np.ndarray]:
        return np.split(sent.answered(_pairs(got)), np.cumsum([len(x) for x in like])[:-1]) if like else []

    def taken(data: pa.Buffer, got: list, upto: int) -> tuple[pa.Table, list[Filed], Sent, list]:
        """The texts of a batch brought up to a round: what it sends, and for the last what each key stands for."""
        table = _rows(data)
        parts = [Filed(w, window) for _, _, w in chunks(_column(table, which))]
        like = [p.symbols() for p in parts]
        for turn in range(upto):
            sent = short(like)
            answer = parted(sent, got[turn], like)
            if turn == 0:
                like = [p.named(a) for p, a in zip(parts, answer, strict=True)]
            elif turn == 1:
                like = [p.pairs_named(a) for p, a in zip(parts, answer, strict=True)]
            else:
                like = [np.flatnonzero(a[p.of]) if len(p.of) else np.empty(0, np.int64) for p, a in zip(parts, answer, strict=True)]
        if upto < 3:
            return table, parts, short(like), like
        pairs = [p.hashes(hit) for p, hit in zip(parts, like, strict=True)]
        one, two = (np.concatenate([np.empty(0, U), *x]) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
        return table, parts, Sent((two >> U(64 - bits)).astype(np.int64), one), like

    def send(turn: int):
        @given_back
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                got = [x.column(2 + k).to_pylist() for k in range(turn)]
                for i, batch in enumerate(x.column(0).to_pylist()):
                    if not turn or got[2 if turn == 3 else 0][i]:  # texts may share words and no pair
                        yield taken(x.column(1)[i].as_buffer(), [g[i] for g in got], turn)[2].rows(batch)

        return run

    @given_back
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [x.column(2 + k).to_pylist() for k in range(4)]
            for i in range(x.num_rows):
                table, parts, sent, chosen = taken(x.column(1)[i].as_buffer(), [g[i] for g in got], 3)
                kept, n_words, n_removed = [], [], []
                for p, hit, again in zip(parts, chosen, parted(sent, got[3][i], chosen), strict=True):
                    a, b, c = _kept(p, hit[again])
                    kept += a
                    n_words.append(b)
                    n_removed.append(c)
                none = np.empty(0, np.int64)
                cols = [_column(table, k) for k in range(len(names))]
                out = [pa.array(kept, pa.string()), *(pa.array(np.concatenate(v) if v else none, pa.int64()) for v in (n_words, n_removed))]
                for k in range(0, table.num_rows, 500):
                    yield pa.RecordBatch.from_arrays([*(c.slice(k, 500) for c in cols), *(c.slice(k, 500) for c in out)], [*names, "kept", "n_words", "n_removed"])
                table = parts = p = sent = chosen = kept = cols = out = None  # before the next batch is made

    asked = blobs
    for turn, width in enumerate((4, 4, 4, 8)):
        got = answers(asked.mapInArrow(send(turn), _SENT), width, f"got{turn}")
        asked = asked.join(cut(got) if turn < 3 else got, "batch", "left")
    schema = StructType([*(df.schema[c] for c in names), StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return asked.mapInArrow(finish, schema)


def _kept(p: Filed, hit: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    words = p.words
    n = len(p.h)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, p.starts[hit], 1)
    np.add.at(edge, p.starts[hit] + p.window, -1)
    gone = np.cumsum(edge)[:n] > 0
    upto = np.concatenate([[0], np.cumsum(gone)])
    removed = upto[words.first[1:]] - upto[words.first[:-1]]
    texts: list = [None] * len(removed)
    touched = np.flatnonzero(removed)
    if len(touched):
        joined, at = words.join(), np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
        data = np.frombuffer(joined, np.uint8)
        for d in touched.tolist():
            a, z = int(words.first[d]), int(words.first[d + 1])
            stay = np.repeat(~gone[a:z], np.diff(at[a : z + 1]))
            texts[d] = data[at[a] : at[z]][stay].tobytes()[:-1].decode()
    return texts, np.diff(words.first), removed


def joined_words(text):
    """The words of a text column joined by one space, as SQL functions."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    found = repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", joined_words(F.col("text"))), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM s),
again AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + o) AS hit FROM x JOIN again USING (k), range(35) r(o) GROUP BY doc_id),
kept AS (SELECT d.doc_id, w, list_filter(range(1, len(w) + 1), lambda p: (NOT coalesce(list_contains(hit, p), false))) AS stay FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(w) - len(stay) AS n_removed, sha256(coalesce(array_to_string(list_transform(stay, lambda p: w[p]), ' '), '')) AS kept_sha256 FROM kept
"""

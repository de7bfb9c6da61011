"""SentencePiece encoding and decoding over a relational lattice.

Text gets a leading space, spaces become ``▁``, and the likeliest sequence of pieces
wins (unigram segmentation; ties to the longer last piece). Scores of the public piece
list come from a rule, Zipf's law by rank, as the list itself is one of merges.

A text is cut into words where no piece of the table crosses: before runs of ``▁``,
around line feeds, between a word character and some punctuation; which, is read off
the table. Each distinct word's lattice is relational: substrings up to the longest
piece are exploded, joined to the piece table (a fixed vocabulary, so broadcast), and
grouped by word; a higher-order aggregate folds Viterbi over the edges in order of
their ends, and another walks back. A character that no piece covers costs a fixed
penalty and becomes byte pieces. Spark copies an array at each step of a fold, so words
of over ``LONG`` bytes would cost the square of their length; the task that reads them
folds the same edges by the same rule in place instead, at a cost of their length.

Words of texts are encoded by the dictionary of distinct words. Of a bounded sample of
texts (``SAMPLE`` rows by hash of their text), at most ``FREQUENT`` words that recur are
encoded first and go to the tasks with the code, found there by their 64-bit hashes; the
others are sent once a chunk of texts, joined with their pieces, and come back as the
chunk's own dictionary, with which its texts, kept as codes of words, are put together.
The result is the same for any sample. Words are found and hashed over whole chunks of
bytes, in numpy. Decoding looks the pieces' bytes up by id.

Null texts are empty and have no words; rows may repeat. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import cut, partitions, read, small_batches
from .words import CHUNK, U, Words, mix

SPACE = "▁"
SAMPLE, FREQUENT = 40_000, 600_000
#: Distinct words that a task groups edges of in memory before it sorts.
GROUPED = 100_000
#: Words of more bytes are not folded by Spark.
LONG = 200
PENALTY = 10.0
#: Added to a rank before the logarithm.
FLATTEN = 10


class Table:
    """Pieces with ids and scores, and where words may be cut."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_id: int):
        self.pieces, self.byte_id = pieces, byte_id
        names = [p for p, _, _ in pieces]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names):
            raise ValueError("pieces with a space inside can't be cut into words")
        self.longest = max(map(len, names), default=1)
        if self.longest > 62 or not all(0 < i < 1 << 15 for _, i, _ in pieces):
            raise ValueError("pieces of more than 62 characters or ids past 32767 don't fit an edge")
        self.unknown = round(min((s for _, _, s in pieces), default=0.0) - PENALTY, 6)
        wordish = lambda c: c == "_" or c.isascii() and c.isalnum() or not c.isascii() and c != SPACE
        follow = {b for p in names for a, b in zip(p, p[1:], strict=False) if wordish(a)}
        self.kind = np.zeros(256, np.uint8)  # of bytes: 1 a word's, 2 punctuation that no piece has after one
        self.kind[[ord(c) for c in "_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = 1
        self.kind[0x80:] = 1
        self.kind[SPACE.encode()[-1]] = 0
        self.kind[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~" if c not in follow]] = 2
        self.feeds = not any("\n" in p for p in names)

    def words(self, texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
        """(first row, row after the last, words), as bytes with their leading spaces, for runs of whole texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size + 2)
        i = 0
        while i < len(texts):
            base = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            data = np.frombuffer("".join(f" {t}\n" for t in texts.slice(i, j - i).to_pylist()).encode(), np.uint8)
            begin = np.concatenate([[0], ends[i:j] - base])
            kind, space, start = self.kind[data], data == 32, np.zeros(len(data) + 1, bool)
            start[1:-1] = (space[1:] & ~space[:-1]) | ((kind[1:] == 2) & (kind[:-1] == 1))
            if self.feeds:
                feed = data == 10
                start[:-1] |= feed
                start[1:] |= feed
            start[begin] = True
            start[begin[1:] - 1] = True
            at = np.flatnonzero(start)
            stop = at[1:]
            at = at[:-1]
            real = np.ones(len(at), bool)
            real[np.searchsorted(at, begin[1:] - 1)] = False  # the feed after each text
            empty = np.flatnonzero(size[i:j] == 0)
            real[np.searchsorted(at, begin[empty])] = False
            at, stop = at[real], stop[real]
            yield i, j, Words(data, at, stop, np.searchsorted(at, begin))
            i = j

    def cut(self, text: str | None) -> list[str]:
        return [w for _, _, x in self.words(pa.array([text], pa.string())) for w in _strings(x, np.arange(len(x.starts))).to_pylist()]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.table({"piece": [p for p, _, _ in self.pieces], "id": pa.array([i for _, i, _ in self.pieces], pa.int32()), "score": [s for _, _, s in self.pieces]}))

    def fold(self, word: str) -> list[int]:
        """Ids of one word, of any length."""
        word = word.replace(" ", SPACE)
        known = {p: (i, round(-s * 1_000_000)) for p, i, s in self.pieces}
        sizes = sorted({len(p) for p in known}, reverse=True)
        unknown, n = round(-self.unknown * 1_000_000), len(word)
        cost, size, piece = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            least = None
            for k in sizes:
                if k <= end and (hit := known.get(word[end - k : end])):
                    c = cost[end - k] + hit[1]
                    if least is None or c < least:
                        least, size[end], piece[end] = c, k, hit[0]
            if word[end - 1] not in known and (least is None or cost[end - 1] + unknown < least):
                least, size[end], piece[end] = cost[end - 1] + unknown, 1, 0
            cost[end] = least
        out: list[int] = []
        while n:
            out += [piece[n]] if piece[n] else [self.byte_id + b for b in reversed(word[n - 1].encode())]
            n -= size[n]
        return out[::-1]


def _strings(words: Words, which: np.ndarray) -> pa.Array:
    """The words at these places, gathered as one buffer."""
    a, z = words.starts[which], words.ends[which]
    size = z - a
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = words.data[np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def zipf(names: list[str]) -> list[float]:
    raw = [-log(k + FLATTEN) for k in range(len(names))]
    total = log(sum(exp(r) for r in raw))
    return [round(r - total, 6) for r in raw]


def public_table(path: str | None = None) -> Table:
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
    names = [m.id_to_piece(i) for i in ids]
    return Table(list(zip(names, ids, zipf(names), strict=True)), m.piece_to_id("<0x00>"))


# --- the lattice


def lattice(words: DataFrame, table: Table) -> DataFrame:
    """(word, ids) of distinct words (column word, spaces as such, of at most ``LONG`` bytes). An edge is packed into a long, in
    order of its end, then of its start: end, length (counted down), id (0: a character of no piece) and cost in millionths.
    So is the best way to a place: cost, then length and id of its last edge; the least of two is the better one."""
    words.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPED))
    n, i, size = F.length("word"), F.col("i"), F.col("size")
    whole = words.select("word", F.replace(F.col("word"), F.lit(" "), F.lit(SPACE)).alias("w"))
    starts = whole.select("word", "w", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    spans = starts.select("word", "w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), n - i + 1))).alias("size"))
    spans = spans.select("word", "i", "size", F.substring("w", i, size).alias("piece"))
    edges = spans.join(F.broadcast(table.frame(words.sparkSession)), "piece", "left").where("id is not null or size = 1")
    cost = F.round(-F.coalesce("score", F.lit(table.unknown)) * 1_000_000).cast("long")
    packed = F.shiftleft((i + size - 1).cast("long"), 46) + F.shiftleft((63 - F.least(size, F.lit(63))).cast("long"), 40) + F.shiftleft(F.coalesce("id", F.lit(0)).cast("long"), 25) + cost
    grouped = edges.select("word", packed.alias("e")).groupBy("word").agg(F.sort_array(F.collect_list("e")).alias("es"))
    low = lambda n: F.lit((1 << n) - 1)

    def step(best, e):
        end = F.shiftright(e, 46).cast("int")
        before = F.get(best, end - 63 + F.shiftright(e, 40).bitwiseAND(F.lit(63)).cast("int"))
        made = F.shiftleft(F.shiftright(before, 21) + e.bitwiseAND(low(25)), 21).bitwiseOR(F.shiftright(e, 25).bitwiseAND(low(21)))
        return F.when(end == F.size(best), F.array_append(best, made)).otherwise(F.array_append(F.slice(best, 1, end), F.least(F.get(best, end), made)))

    found = grouped.select("word", F.aggregate("es", F.array(F.lit(0).cast("long")), step).alias("best"))
    walk = F.struct((F.size("best") - 1).alias("at"), F.array().cast("array<int>").alias("out"))

    def octets(at):
        """Byte pieces of the character before a place of the word."""
        c = F.replace(F.substring(F.col("word"), at, F.lit(1)), F.lit(" "), F.lit(SPACE)).cast("binary")
        return F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.conv(F.hex(F.substring(c, k, F.lit(1))), 16, 10).cast("int") + table.byte_id)

    def back(acc, _):
        e = F.get(F.col("best"), acc["at"])
        piece, length = e.bitwiseAND(low(15)).cast("int"), 63 - F.shiftright(e, 15).bitwiseAND(F.lit(63)).cast("int")
        ids = F.when(piece > 0, F.array(piece)).otherwise(octets(acc["at"]))
        return F.when(acc["at"] > 0, F.struct((acc["at"] - length).alias("at"), F.concat(ids, acc["out"]).alias("out"))).otherwise(acc)

    return found.select("word", F.aggregate("best", walk, back)["out"].alias("ids"))


# --- words of texts


@dataclass
class Known:
    """Words that tasks know: sorted hashes of their bytes, and the code of each; by code (commonest first): how many
    pieces it has, where its ids begin, and the ids of all."""

    hashes: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Codes of these hashes, -1 for unknown words."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.codes[at], -1)


NOTHING = Known(np.empty(0, U), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint16))


def frequent(texts: DataFrame, table: Table, sample: int = SAMPLE, keep: int = FREQUENT) -> Known:
    """At most ``keep`` words that recur in a sample of about ``sample`` rows of (text)."""
    total = texts.count()
    if not total or not sample:
        return NOTHING
    chosen = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / total) * (1 << 30))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for _, _, w in table.words(x.column(0)):
                _, at, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                short = (w.ends - w.starts)[at] <= LONG
                yield pa.RecordBatch.from_arrays([_strings(w, at[short]), pa.array(n[short].astype(np.int64))], ["word", "n"])

    top = cut(chosen.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(keep))
    got = lattice(top.select("word").repartition(partitions(texts.sparkSession), "word"), table).join(top, "word").select("word", "ids", "n").toArrow()
    if not got.num_rows:
        return NOTHING
    names, lists, n = (pa.concat_arrays(got.column(c).chunks) for c in ("word", "ids", "n"))
    h = _hashes(names)
    by = np.lexsort((h, -n.to_numpy()))
    lists = lists.take(pa.array(by))
    size = lists.value_lengths().to_numpy()
    order = np.argsort(h[by])
    return Known(h[by][order], order.astype(np.int32), size.astype(np.int32), (np.cumsum(size) - size).astype(np.int32), lists.flatten().to_numpy().astype(np.uint16))


def _hashes(names: pa.Array) -> np.ndarray:
    data = np.frombuffer("".join(names.to_pylist()).encode(), np.uint8)
    ends = np.cumsum(pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64))
    return Words(data, np.concatenate([[0], ends[:-1]]), ends, np.array([0, len(ends)])).hashes()


def _prepared(docs: DataFrame, text: str, id_: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


#: Pieces of texts that are put together at once, but for a longer text.
_RUN = 500_000


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[f : f + n] for each f and n, one after the other."""
    return data[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)]


def _cut_at(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, i = np.cumsum(counts), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _RUN, "right")))
        yield i, j
        i = j


_DATA = pa.schema([("doc_id", pa.list_(pa.int64())), ("hash", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("codes", pa.list_(pa.binary())), ("own", pa.list_(pa.list_(pa.int32())))])


#: Codes below are bytes of their own.
_SHORT = 191


def _packed(codes: np.ndarray, fresh: np.ndarray) -> list[bytes]:
    """Codes as streams of bytes that compress well: a byte each, which for frequent words is all; 14 more bits for most
    others; four bytes for the rest. Fresh codes follow from those before and have the byte ``_SHORT``."""
    rest = codes - _SHORT
    top = np.minimum(rest >> 14, 63)
    some = ~fresh & (rest >= 0)
    first = np.where(fresh, _SHORT, np.where(rest < 0, codes, _SHORT + 1 + top)).astype(np.uint8)
    low = (rest[some & (top < 63)] & 0x3FFF).astype("<u2").view(np.uint8).reshape(-1, 2)
    return [first.tobytes(), low[:, 0].tobytes(), low[:, 1].tobytes(), rest[some & (top == 63)].astype("<u4").tobytes()]


def _unpacked(streams: list[bytes], base: int) -> np.ndarray:
    """The codes; fresh ones count on from ``base``."""
    first, low, high, far = (np.frombuffer(s, np.uint8) for s in streams)
    codes = first.astype(np.int64)
    fresh, some = codes == _SHORT, codes > _SHORT
    wide = codes == _SHORT + 64
    codes[fresh] = base + np.arange(np.count_nonzero(fresh))
    near = some & ~wide
    codes[near] = (codes[near] - _SHORT - 1 << 14) + (low | high.astype(np.int64) << 8) + _SHORT
    codes[wide] = far.view("<u4").astype(np.int64) + _SHORT
    return codes


class Chunk:
    """Some whole texts as codes of words: known ones first, then the words the chunk asks for in order, then its long ones."""

    def __init__(self, words: Words, known: Known, table: Table):
        h = words.hashes()
        self.codes = known.find(h)
        size = words.ends - words.starts
        far, own = np.flatnonzero((self.codes < 0) & (size <= LONG)), np.flatnonzero(size > LONG)
        self.hashes, at, place = np.unique(h[far], return_index=True, return_inverse=True)
        order = np.argsort(at)
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        self.codes[far] = len(known.sizes) + rank[place]
        self.asked, self.words, self.table = far[at[order]], words, table
        _, at, place = np.unique(h[own], return_index=True, return_inverse=True)
        self.long = own[at]
        self.codes[own] = len(known.sizes) + len(self.asked) + place

    def name(self, at: int) -> int:
        """Of the chunk's place and of what it asks for, so that texts read in another order the second time find no answer."""
        return int(mix(np.array([at], U) ^ mix(np.bitwise_xor.reduce(self.hashes, initial=U(0)) + U(len(self.hashes)))[None])[0].view(np.int64))

    def data(self, ids: pa.Array, hashes: pa.Array) -> bytes:
        fresh = np.zeros(len(self.codes), bool)
        fresh[self.asked] = True
        own = [self.table.fold(w) for w in _strings(self.words, self.long).to_pylist()]
        row = {"doc_id": ids.to_pylist(), "hash": hashes.to_pylist(), "n": np.diff(self.words.first), "codes": _packed(self.codes, fresh), "own": own}
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DATA, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
            w.write_batch(pa.RecordBatch.from_pylist([row], _DATA))
        return sink.getvalue().to_pybytes()


def encoded(docs: DataFrame, table: Table, text: str = "text", id_: str = "doc_id", sample: int = SAMPLE, keep: int = FREQUENT, decoded: bool = False) -> DataFrame:
    """(doc_id, n_words, hash, ids) of each row: hash is that of the text; with ``decoded`` also ``text``, made from the ids.
    ``docs`` is read twice and must give its rows in the same order, as files do; a chunk that gets no answer is an error."""
    docs = _prepared(docs, text, id_)
    known = frequent(docs, table, sample, keep)
    n = partitions(docs.sparkSession)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at = TaskContext.get().partitionId() << 32
        for x in batches:
            for i, j, w in table.words(x.column(1)):
                yield x.slice(i, j - i), at, Chunk(w, known, table)
                at += 1

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, at, c in chunked(batches):
            yield pa.RecordBatch.from_arrays([pa.array([c.name(at)], pa.int64()), pa.array([len(c.asked)], pa.int32()), pa.array([c.data(x.column(0), x.column(2))], pa.binary())], ["chunk", "n", "data"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, c in chunked(batches):
            m = len(c.asked)
            yield pa.RecordBatch.from_arrays([_strings(c.words, c.asked), pa.array(np.full(m, c.name(at), np.int64)), pa.array(np.arange(m, dtype=np.int32))], ["word", "chunk", "k"])

    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rare = hashed.mapInArrow(far, "word string, chunk long, k int").where("word is not null and chunk is not null").repartition(n, "word")
    # distinct words, by counts that need all columns, as the filter above names what joins would add: so both readers of
    # the shuffle are the same, and it is made once
    distinct = rare.groupBy("word").agg(F.count("chunk").alias("chunks"), F.max("k").alias("last")).where("chunks > 0 and last >= 0").select("word")
    dictionary = lattice(distinct, table)
    answers = rare.join(dictionary, "word").groupBy("chunk").agg(F.collect_list(F.struct("k", F.col("ids").cast("array<smallint>").alias("ids"))).alias("got"))
    parts = hashed.mapInArrow(near, "chunk long, n int, data binary").join(answers, "chunk", "left").select("n", "data", "got")
    octets = Octets(table) if decoded else None
    names = ["doc_id", "n_words", "hash", "ids", *(["text"] if decoded else [])]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                data = pa.ipc.open_stream(x.column(1)[i].as_buffer()).read_all()
                for made in _put_together(data, x.column(0)[i].as_py(), x.column(2)[i].values, known):
                    columns = [*made, pa.array(octets.texts(made[3]), pa.string())] if decoded else made
                    yield pa.RecordBatch.from_arrays(columns, names)

    return parts.mapInArrow(whole, "doc_id long, n_words long, hash long, ids array<int>" + ", text string" * decoded)


def _put_together(data: pa.Table, asked: int, got: pa.StructArray | None, known: Known) -> Iterator[list[pa.Array]]:
    doc_id, hashes, n, streams, own = (data.column(c)[0].values for c in ("doc_id", "hash", "n", "codes", "own"))
    codes = _unpacked(streams.to_pylist(), len(known.sizes))
    if (len(got) if got is not None else 0) != asked:
        raise RuntimeError("the texts were read in another order the second time")
    lists = []
    if asked:
        lists.append(got.field(1).take(pa.array(np.argsort(got.field(0).to_numpy()))).cast(pa.list_(pa.int32())))
    lists.append(own)
    size = np.concatenate([known.sizes, *(v.value_lengths().to_numpy() for v in lists)]).astype(np.int64)
    ids = np.concatenate([known.ids.astype(np.int32), *(v.flatten().to_numpy() for v in lists)])
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    ends = np.concatenate([[0], np.cumsum(n.to_numpy())])
    upto = np.concatenate([[0], np.cumsum(size[codes])])[ends]
    for i, j in _cut_at(np.diff(upto)):
        own_codes = codes[ends[i] : ends[j]]
        made = pa.ListArray.from_arrays(pa.array((upto[i : j + 1] - upto[i]).astype(np.int32)), pa.array(_gathered(ids, first[own_codes], size[own_codes])))
        yield [doc_id.slice(i, j - i), n.slice(i, j - i).cast(pa.int64()), hashes.slice(i, j - i), made]


def encode(docs: DataFrame, table: Table, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of each text."""
    return encoded(docs, table, text, id_).select("doc_id", "ids")


class Octets:
    """Bytes of pieces by id; ids of no piece give nothing."""

    def __init__(self, table: Table):
        octets = {i: p.encode() for p, i, _ in table.pieces} | {table.byte_id + b: bytes([b]) for b in range(256)}
        raw = [octets.get(i, b"") for i in range(1 << 15)]
        self.data, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def texts(self, lists: pa.ListArray) -> list[str]:
        """Texts of lists of ids, the leading space taken off; null lists are empty."""
        count, out = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), []
        for i, j in _cut_at(count):
            v = lists.slice(i, j - i).flatten().to_numpy(zero_copy_only=False)
            made = _gathered(self.data, self.first[v], self.size[v]).tobytes()
            at = np.concatenate([[0], np.cumsum(self.size[v])])[np.concatenate([[0], np.cumsum(count[i:j])])].tolist()
            out += [made[a:z].decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ") for a, z in zip(at, at[1:], strict=False)]
        return out


def decode(encoded: DataFrame, table: Table, ids: str = "ids") -> DataFrame:
    """encoded with ``text``: bytes of pieces by id, put in order, the leading space taken off. Ids of no piece give nothing."""
    small_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "text"]
    octets = Octets(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = octets.texts(x.column(x.schema.get_field_index(ids)))
            yield pa.RecordBatch.from_arrays([*(x.column(x.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return encoded.mapInArrow(run, StructType([*(encoded.schema[c] for c in kept), StructField("text", StringType())]))


def summed(docs: DataFrame, table: Table, text: str = "text", id_: str = "doc_id", sample: int = SAMPLE, keep: int = FREQUENT) -> DataFrame:
    """(doc_id, n_words, n_pieces, digest, round_trip) of each row: digest is of all its ids, round_trip whether they
    decode to the text (not if it holds a ``▁`` of its own)."""
    back = encoded(docs, table, text, id_, sample, keep, decoded=True)
    return back.select("doc_id", "n_words", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("digest"), (F.xxhash64("text") == F.col("hash")).alias("round_trip"))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return summed(read(spark, sf_dir, "documents"), public_table())

"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. Writing: a task streams its rows to files
under a name of its own, rolls them at ``ROLL`` bytes and reports them; the reports
are checkpointed, and only files of a reported attempt are ever read, so a task may
be run again or twice. Reading: a split is a byte range of a file. Its task looks for
the gzip magic in the range, takes a candidate as a member only if it decodes to the
first bytes of a WARC record, and owns the records that start inside the range; the
last of them may end in the next one. A split that begins inside a member thus passes
over it, and magic bytes inside compressed data are passed over or fail to decode.

Files are reached through pyarrow's file systems, by any URI those know. Null html
is an empty payload, a null url an empty one. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, graded_join, partitions, read, shared_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
LEAST = 1000
BROADCAST = 100_000
ROLL, SPLIT, STEP = 256 << 20, 4 << 20, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records


def _urn(id_: int | None) -> str:
    return f"<urn:x-page:{'' if id_ is None else id_}>"


def encode(id_: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit has the payload's length and digest, and the response's id, but not its bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(id_)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def decode(record: bytes) -> dict:
    """Fields of a decompressed record; the payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    if len(block) != int(h["content-length"]):
        raise ValueError(f"record {h.get('warc-record-id')} is shorter than its Content-Length")
    http, _, body = block.partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
    if not revisit and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"record {h.get('warc-record-id')} doesn't match its digest")
    number = lambda urn: int(m[1]) if urn and (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", urn)) else None
    return {
        "page_id": number(h.get("warc-record-id")),
        "url": h.get("warc-target-uri"),
        "record_type": h["warc-type"],
        "refers_to": number(h.get("warc-refers-to")) if revisit else None,
        "payload": None if revisit else body,
        "payload_bytes": int(_headers(http)["content-length"]) if revisit else len(body),
        "payload_digest": digest,
    }


# --- writing


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of ``least`` bytes or more, all but those with the
    largest page_id refer to it. Groups are counted from digests alone. The ``BROADCAST`` digests that recur most are
    broadcast, so that payloads stay where they were read; only if there are more, the other rows are joined by shuffle."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1")
    joined = graded_join(rows, again, ["digest"], F.col("n"), BROADCAST)
    return joined.select("page_id", "url", "payload", F.when(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"))


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes rows of `classify` as records under the folder; returns (path, bytes, records) of the files, checkpointed."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, path, size, count = None, "", 0, 0

        def report() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "bytes", "records"])

        for x in batches:
            for id_, url, payload, to in zip(*(x.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, size, count = fs.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0
                made = encode(id_, url, payload, to, to is not None, date)
                out.write(made)
                size, count = size + len(made), count + 1
                if size >= ROLL:
                    yield report()
                    out = None
        if out is not None:
            yield report()

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return cut(rows.mapInArrow(run, "path string, bytes long, records long"))


# --- reading


class _Source:
    """Bytes of a file from an offset on, in steps, kept only as far as needed."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.base, self.data = file, size, start, b""
        file.seek(start)

    def have(self, upto: int) -> bool:
        """Reads on until the byte before ``upto`` is there; false at the end of the file."""
        while self.base + len(self.data) < upto:
            got = self.file.read(STEP)
            if not got:
                return False
            self.data += got
        return True

    def forget(self, before: int) -> None:
        self.data, self.base = self.data[before - self.base :], before


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The record that a member at this offset holds and where the member ends, or None if there is no such member."""
    d, parts, seen, pos = zlib.decompressobj(31), [], 0, at
    while not d.eof:
        if not source.have(pos + 1):
            if seen >= len(HEAD):
                raise ValueError("the file ends inside a record")
            return None
        raw = source.data[pos - source.base :][: STEP if seen else 4096]
        try:
            got = d.decompress(raw)
        except zlib.error as e:
            if seen >= len(HEAD):
                raise ValueError(f"damaged record at byte {at}") from e
            return None
        parts.append(got)
        pos += len(raw)
        if seen < len(HEAD):
            seen += len(got)
            if seen >= len(HEAD) or d.eof:
                if not b"".join(parts).startswith(HEAD):
                    return None
                seen = max(seen, len(HEAD))
    return b"".join(parts), pos - len(d.unused_data)


def records(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decompressed records whose members start at start <= byte < end."""
    source, pos = _Source(file, size, start), start
    while pos < end:
        source.have(pos + len(MAGIC))
        hit = source.data.find(MAGIC, pos - source.base)
        if hit < 0:
            upto = source.base + len(source.data)
            if upto >= end + len(MAGIC) - 1 or not source.have(upto + 1):
                return
            pos = max(pos, upto - len(MAGIC) + 1)
            source.forget(pos)
            continue
        pos = source.base + hit
        if pos >= end:
            return
        source.forget(pos)
        found = _member(source, pos)
        if found:
            yield found[0]
        pos = found[1] if found else pos + 1


RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def read_archives(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of the files (path, bytes), each byte range of ``split`` bytes read by itself."""
    ranges = files.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split}L)")).alias("at")).where("bytes > 0")
    ranges = ranges.repartition(partitions(files.sparkSession))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for x in batches:
            for path, size, at in zip(*(x.column(i).to_pylist() for i in range(3)), strict=True):
                fs, place = pafs.FileSystem.from_uri(path)
                held, weight = [], 0
                with fs.open_input_file(place) as file:
                    for raw in records(file, size, at, min(size, at + split)):
                        held.append(decode(raw))
                        weight += len(raw)
                        if weight >= 4 << 20:
                            yield made(held)
                            held, weight = [], 0
                if held:
                    yield made(held)

    return ranges.mapInArrow(run, RECORD)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write(classify(read(spark, sf_dir, "pages")), folder)
    found = cut(read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.delete_dir(base)  # the query's archives are its own; `write` leaves a caller's where they are
    return found


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (SELECT payload_digest, max(page_id) AS winner FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM d LEFT JOIN w USING (payload_digest)
"""

import gzip
import hashlib
import io
import random
import zlib

import pytest

from loomgraph.llm import warc


def made(n, seed=0):
    rng = random.Random(seed)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) + warc.MAGIC * rng.randrange(3) for _ in range(n)]
    return bodies, [warc.encode(i, f"http://h/é {i}", b, None, False, "d") for i, b in enumerate(bodies)]


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 5000, 10**6])
def test_every_split_reads_each_record_once(split):
    bodies, members = made(25)
    raw = b"".join(members)
    got = [warc.decode(r) for at in range(0, len(raw), split) for r in warc.records(io.BytesIO(raw), len(raw), at, min(len(raw), at + split))]
    assert [(g["page_id"], g["payload"]) for g in got] == list(enumerate(bodies))


def test_stored_members_with_magic_inside():
    inner = warc.encode(9, "u", b"inner", None, False, "d")
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = c.compress(head + block + b"\r\n\r\n") + c.flush()
    assert inner in raw
    assert len(list(warc.records(io.BytesIO(raw), len(raw), 0, len(raw)))) == 1
    assert gzip.decompress(raw).startswith(b"WARC/1.1")


def test_damage_is_an_error():
    _, members = made(3)
    raw = b"".join(members)[:-20]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw), len(raw), 0, len(raw)))


def test_round_trip_and_revisits(spark, tmp_path):
    big, long = "é" * 600, "z" * 3_000_000
    rows = [(1, "http://a/\r\nx", big), (5, None, big), (3, "u", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", long), (None, "u", big), (9, "u", "n" * 1000), (9, "u", "n" * 1000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    files = warc.write(warc.classify(df), f"file://{tmp_path}/w")
    got = warc.read_archives(files, split=500).collect()
    assert len(got) == len(rows) and files.agg({"records": "sum"}).first()[0] == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = by[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if html == big and i != 5 else ("response", None))
        assert r.payload == (None if r.refers_to else raw)
    assert warc.read_archives(warc.write(warc.classify(df.limit(0)), f"file://{tmp_path}/e")).count() == 0

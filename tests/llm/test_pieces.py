import time

import numpy as np
import pytest

from loomgraph.llm import pieces as pc

sentencepiece = pytest.importorskip("sentencepiece")


def field(number, kind, value):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    if kind == 0:
        return varint(number << 3) + varint(value)
    return varint(number << 3 | kind) + (value if kind == 5 else varint(len(value)) + value)


def unigram(table):
    """A SentencePiece model file of the same pieces and scores, for the public library."""
    rows = {0: ("<unk>", 0.0, 2), 1: ("<s>", 0.0, 3), 2: ("</s>", 0.0, 3)}
    rows |= {table.byte_id + b: (f"<0x{b:02X}>", 0.0, 6) for b in range(256)}
    rows |= {i: (p, s, 1) for p, i, s in table.pieces}
    out = b""
    for i in range(max(rows) + 1):
        p, s, t = rows[i]
        out += field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, t))
    out += field(2, 2, field(3, 0, 1) + field(35, 0, 1))
    out += field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    return sentencepiece.SentencePieceProcessor(model_proto=out)


@pytest.fixture(scope="module")
def table():
    return pc.public_table()


@pytest.fixture(scope="module")
def library(table):
    return unigram(table)


TEXTS = [None, "", " ", "a", "  two  spaces ", "line\nfeed\n\nagain", "Ünïcödé 日本語 🙂 mixed", "don't stop, (now)! a.b|c;d:e", "thanedble anea. Eriner thanea.", "x" * 600, "tab\tand\rmore", "1,234.5% #tag $$$ &&& ***"]


def test_words_join_to_the_text(table):
    for t in TEXTS:
        assert "".join(table.cut(t)) == (" " + t if t else "")


def test_encoding_matches_the_library_and_decodes(spark, table, library):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(30).collect()]
    texts = TEXTS + docs
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    made = pc.encode(df, table).cache()
    got = {r.doc_id: r.ids for r in made.collect()}
    score = dict((i, s) for _, i, s in table.pieces)
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        own = got.get(i, [])
        if own != want:  # equal scores to float precision may part differently
            assert abs(sum(score.get(x, 0) for x in own) - sum(score.get(x, 0) for x in want)) < 1e-3
    same = sum(got.get(i, []) == library.encode(t or "") for i, t in enumerate(texts))
    assert same >= 0.9 * len(texts)
    back = {r.doc_id: r.text for r in pc.decode(made, table).collect()}
    assert all(back.get(i, "") == (t or "") for i, t in enumerate(texts))


def test_query_parts_do_not_depend_on_the_sample(spark, table):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "dup dup"), (None, "dup dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for sample, keep in ((0, 10), (100, 5), (100, 10_000)):
        out = pc.summed(df, table, sample=sample, keep=keep).collect()
        results.append(sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_pieces, r.digest) for r in out))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    ids = {r.doc_id: len(r.ids) for r in pc.encode(df, table).collect() if r.doc_id is not None}
    assert all(n == ids.get(i, 0) for i, _, n, _ in results[0] if i >= 0)


def test_long_words_are_folded_alike(spark, table, library, monkeypatch):
    texts = ["éa" * 30 + " b " + "x" * 25, "thanedbleaneaerinerthanea" * 9, "日本語🙂" * 20, "▁▁", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = {r.doc_id: r.ids for r in pc.encode(df, table).collect()}
    monkeypatch.setattr(pc, "LONG", 10)  # for chunks made in this process; workers keep their own
    for i, t in enumerate(texts):
        folded = [x for w in table.cut(t) for x in table.fold(w)]
        assert folded == short[i]
        assert folded == library.encode(t or "") or len(folded) == len(library.encode(t))


def test_a_word_of_a_megabyte(spark, table):
    rng = np.random.default_rng(1)
    word = "".join(rng.choice(list("abcdefghij 日é")).replace(" ", "x") for _ in range(1000)) * 900
    assert len(word.encode()) > 1_000_000
    df = spark.createDataFrame([(1, word), (2, "a " + word[:300] + " b")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pc.summed(df, table).collect()}
    assert got[1].round_trip and got[2].round_trip and got[1].n_words == 1 and time.time() - began < 60


def test_empty_table(spark, table):
    assert pc.summed(spark.createDataFrame([], "doc_id long, text string"), table).count() == 0


def test_the_query_sums_the_ids_and_decodes_them(spark, table):
    long = " ".join(f"word{i % 977} né{i}" for i in range(30_000))
    texts = [*TEXTS, long, "x ▁ y", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = pc.encode(df, table)
    digest = {r.doc_id: (r.n, r.d) for r in made.selectExpr("doc_id", "size(ids) n", "xxhash64(ids) d").collect()}
    back = {r.doc_id: r.text for r in pc.decode(made, table).collect()}
    for sample in (0, 100):
        got = {r.doc_id: r for r in pc.summed(df, table, sample=sample).collect()}
        assert {i: (r.n_pieces, r.digest) for i, r in got.items()} == digest and len(got) == len(texts)
        assert all(got[i].round_trip == (back[i] == (t or "")) for i, t in enumerate(texts))
        assert [i for i, r in got.items() if not r.round_trip] == [texts.index("x ▁ y")]


def test_codes_survive_packing():
    rng = np.random.default_rng(2)
    base = 600_000
    known = rng.integers(0, base, 3000)
    known[:500] = rng.integers(0, 300, 500)
    fresh = rng.random(3000) < 0.2
    codes = known.copy()
    codes[fresh] = base + np.arange(fresh.sum())
    again = np.flatnonzero(~fresh)[1000:1100]
    codes[again] = base + rng.integers(0, 50, 100)
    codes[np.flatnonzero(~fresh)[-5:]] = [190, 191, 191 + (63 << 14) - 1, 191 + (63 << 14), 50_000_000]
    assert (pc._unpacked(pc._packed(codes, fresh), base) == codes).all()
    none = np.empty(0, np.int64)
    assert len(pc._unpacked(pc._packed(none, none.astype(bool)), 5)) == 0

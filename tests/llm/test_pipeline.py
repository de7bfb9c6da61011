import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from loomgraph.llm import pii
from loomgraph.llm.tokens import public

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and reread."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, folder = [], tmp_path_factory.mktemp("stages")
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        made = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, made))
        docs = made
    return {name: (a.toPandas(), b.toPandas()) for name, a, b in out}


def test_columns(stages):
    for name, (_, made) in stages.items():
        if name != "packing":
            assert list(made.columns) == cp.COLUMNS


def test_language_keeps_clean_documents(stages):
    before, after = stages["language"]
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert all(not re.search(r"[^\W\d_]", t or "") for t in gone.text) or len(gone) <= 0.01 * len(before)
    same = after.merge(before, on="doc_id")
    assert (same.text_x == same.text_y).all() and (same.lang_x == same.lang_y).mean() > 0.97


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies(stages):
    before, after = stages["near_copies"]
    assert after.text.is_unique and set(before.text.str.lower()) >= set(after.text.str.lower())
    sets = [shingles(t.lower()) for t in after.text]
    left = [(a, b) for i, a in enumerate(sets) for b in sets[:i] if len(a & b) >= 0.85 * len(a | b)]
    assert not left
    kept = {t: shingles(t.lower()) for t in after.text}
    for t in before[~before.doc_id.isin(after.doc_id)].text:  # what went is like something that stays
        own = shingles(t.lower())
        assert max(len(own & k) / len(own | k) for k in kept.values()) >= 0.4


def test_repeats(stages):
    before, after = stages["repeats"]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in zip(before.doc_id, before.text)}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    texts = dict(zip(after.doc_id, after.text))
    assert texts.keys() == words.keys()
    for i, w in words.items():
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert texts[i].split() == kept and (gone or texts[i] == before[before.doc_id == i].text.iloc[0])
    assert (after.n_chars == after.text.str.len()).all()


def test_personal_data(stages):
    before, after = stages["personal_data"]
    both = before.merge(after, on="doc_id")
    for old, new in zip(both.text_x, both.text_y):
        spans = pii.find(old)
        assert new == (pii.redact(old, spans) if spans else old)
        assert not [s for s in pii.find(new) if s.kind in pii.BASE]


def test_packing(stages):
    from tokenizers import Tokenizer

    docs, made = stages["packing"]
    t = Tokenizer.from_file(public("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in zip(docs.doc_id, docs.text)}
    assert made.groupby("doc_id").length.sum().to_dict() == want
    assert made.groupby("sequence_id").length.sum().max() <= 1024
    assert made.sequence_id.nunique() <= -(-sum(want.values()) // 1024) * 1.02 + 1


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, None, "en", "s", 0, "e"), (2, "", None, None, None, "e"), (None, "the and of to in that is was for on with as his they be", "en", "s", 55, "e"), (3, "12 %%", "en", "s", 5, "e")]
    for n, data in enumerate((rows, [])):
        at = str(tmp_path / f"t{n}")
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{at}/documents.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, at)
        assert docs.count() == (1 if data else 0)


def test_run_is_the_stages_in_order(spark, stages):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in cp.run(spark, SF).collect()}
    made = stages["packing"][1]
    assert got == set(zip(made.doc_id, made.piece, made.ids_crc32))


def test_repeated_ids_ties_and_a_very_long_text(spark, tmp_path):
    """Rows with one id are told apart by their texts; of equal rows one stays; a long text goes through whole."""
    import random

    rng = random.Random(4)
    common_words = "the and of to in that is was for on with as his they be at this from have not by".split()
    prose = lambda n: " ".join(rng.choice(common_words) + rng.choice(["", "ing", "ed", "er"]) for _ in range(n))
    a, b, long = prose(120), prose(120), prose(150_000)
    rows = [(1, a, "en", "s", len(a), "x"), (1, b, "en", "s", len(b), "y"), (1, a, "en", "s", len(a), "z"), (2, long, "en", "s", len(long), "x"), (3, a.upper(), "en", "t", len(a), "x"), (3, b, None, "t", len(b), "x")]
    at = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    docs, made = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = made[name] = spark.read.parquet(f"{at}/{name}")
    assert sorted((r.doc_id, len(r.text)) for r in made["language"].collect()) == sorted((r[0], len(r[1])) for r in rows)
    assert sorted((r.doc_id, r.text) for r in made["near_copies"].collect()) == sorted([(1, a), (1, b), (2, long)])
    assert made["repeats"].where("doc_id = 2").first().n_chars == made["repeats"].where("doc_id = 2").selectExpr("length(text) n").first().n
    pieces = made["packing"].where("doc_id = 2").orderBy("piece").collect()
    assert [p.start for p in pieces] == [0, *[sum(q.length for q in pieces[: i + 1]) for i in range(len(pieces) - 1)]] and len(pieces) > 100
    assert {(r.doc_id, r.piece) for r in cp.run(spark, at).collect()} == {(r.doc_id, r.piece) for r in made["packing"].collect()}

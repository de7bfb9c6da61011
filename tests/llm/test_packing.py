import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import packing as pk
from loomgraph.llm.tokens import Encoder, public

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(public("byte_bpe_50k.json"))
    return Encoder(public("byte_bpe_50k.tiktoken")), t


def test_ids_match_the_library(both):
    enc, t = both

    @settings(max_examples=1500, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(list("ab Z's.,\n\t\r12é ñ  \x1c\x85日本🙂")), st.characters(blacklist_categories=["Cs"])), max_size=40))
    def check(text):
        assert [np.frombuffer(r, "<u4").tolist() for r in enc.raw([text, "a " + text])] == [t.encode(x, add_special_tokens=False).ids for x in (text, "a " + text)]

    check()


def test_added_tokens_match_the_library(both):
    enc, t = both
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"a{end}b", f"{end}{end}", f"a  {end}  b\n{end}\n", f"x y {end[:-1]} {end.upper()} {end}'s", f"don{end}'t 12{end}3", f" {end} "]
    assert [np.frombuffer(r, "<u4").tolist() for r in enc.raw(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]

    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.sampled_from([end, " ", "\n", "a", "b's", "  ", "\u65e5", ".", "7"]), max_size=12))
    def check(parts):
        text = "".join(parts)
        assert np.frombuffer(enc.raw([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids

    check()


def size(packing):
    return Counter({s: sum(m * p.count(s) for p, m in packing.items()) for s in {s for p in packing for s in p}})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 99), st.integers(1, 40), max_size=30), st.integers(0, 99))
def test_operators_keep_all_pieces(counts, seed):
    rng = random.Random(seed)
    a, b = pk.greedy(counts, 100, rng), pk.greedy(counts, 100, rng)
    for made in (a, b, *([pk.cross(a, b, counts, 100, rng), pk.mutate(a, 100, rng)] if counts else [])):
        assert size(made) == Counter(counts)
        assert all(sum(p) <= 100 for p in made)
        assert pk.bins(made) >= pk.bound(counts, 100)


def test_near_the_bound():
    rng = random.Random(3)
    counts = Counter(min(1023, int(rng.expovariate(1 / 350)) + 1) for _ in range(20000))
    best = pk.evolve(counts, [], 1)[0]
    assert pk.bins(best) <= pk.bound(counts, 1024) * 1.004 + 1


def test_pieces_and_places(spark, both):
    enc, t = both
    rng = np.random.default_rng(8)
    texts = [None, "", "a", "word " * 1022 + "word", "word " * 1023 + "word", " ".join(["x y\nz"] * 2000)] + ["tok " * int(n) for n in rng.integers(1, 1500, 60)]
    rows = [(i, x, 5) for i, x in enumerate(texts)] + [(None, "dup", 1), (None, "dup", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = pk.packed(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, x, _ in rows[:-2]:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert sum(r.length for r in parts) == len(ids) and all(r.length == 1024 for r in parts[1:])
        for r in parts:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert len(by[None]) == 2
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in sequences.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    assert pk.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import numpy as np
import pyarrow as pa

from loomgraph.llm import near
from loomgraph.llm import simhash as sh



def edited(words, share, rng):
    """words with so many of the last ones new that the shingles are alike in about ``share``."""
    n = len(words)
    new = round((n - 4) * (1 - share) / (1 + share))
    return words[: n - new] + [f"new{rng.integers(1 << 40)}" for _ in range(new)]


def likeness(a, b):
    def own(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    return len(own(a) & own(b)) / len(own(a) | own(b))


def pairs(share, n, words, seed):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        w = [f"w{rng.integers(1 << 40)}" for _ in range(words)]
        yield " ".join(w), " ".join(edited(w, share, rng))


def test_pairs_of_just_over_the_likeness_go(spark):
    found = [p for words, share in ((300, 0.805), (300, 0.83), (60, 0.82)) for p in pairs(share, 150, words, round(1000 * share) + words)]
    assert all(0.8 <= likeness(a, b) <= 0.85 for a, b in found)
    rows = [(2 * i + k, t) for i, p in enumerate(found) for k, t in enumerate(p)]
    kept = {r.doc_id for r in sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(len(found))} <= kept
    assert len(kept) - len(found) <= 0.01 * len(found)


def test_lists_cut_again_find_the_same(monkeypatch):
    made = [t for p in pairs(0.82, 40, 80, 3) for t in p]
    e, at = next(near.shingle_sets(pa.array(made)))
    want = {(2 * i, 2 * i + 1) for i in range(40)}
    assert {tuple(sorted(p)) for p in near.alike(e, at)} == want
    monkeypatch.setattr(near, "SPLIT", 10)
    assert {tuple(sorted(p)) for p in near.alike(e, at)} == want


def test_large_groups_of_copies_are_one(spark):
    """A third of all rows in one group of near copies, another in one of exact copies, by way of the least node or of lists."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        own[int(rng.integers(0, 120))] = f"other{i}"
        rows.append(" ".join(own))
    rows += ["one text of many exact copies and nothing else"] * 1200
    rows += [" ".join(f"x{i}y{k}" for k in range(60)) for i in range(100)]
    got = near.groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    low = {r.doc_id: r.low for r in got}
    assert {low[i] for i in range(300, 1500)} == {300} and all(low[i] == i for i in range(1500, 1600))
    first = {low[i] for i in range(300)}
    assert len(first) < 9  # two edits may part two texts, hardly a chain of 300


def test_lists_whose_least_node_joins_nothing(spark):
    """Sets that share bands with one that none of them is alike to are still compared with each other."""
    rng = np.random.default_rng(13)
    rows = []
    for i in range(60):
        w = [f"g{i}w{k}" for k in range(100)]
        far = [f"n{rng.integers(1 << 40)}" for _ in range(22)]
        rows += [" ".join(w[:78] + far), " ".join(w), " ".join(w[:95] + [f"m{rng.integers(1 << 40)}" for _ in range(5)])]
    got = {r.doc_id: r.low for r in near.groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[3 * i + 2] == 3 * i + 1 for i in range(60) if likeness(rows[3 * i], rows[3 * i + 1]) < 0.8 > likeness(rows[3 * i], rows[3 * i + 2]))


def test_texts_less_alike_stay(spark):
    found = [p for words, share in ((300, 0.78), (300, 0.7), (60, 0.6), (9, 0.6), (8, 0.6)) for p in pairs(share, 60, words, round(1000 * share) + words)]
    found += [(f"a{i} b c d e f", f"a{i} b c d e g") for i in range(20)]  # one shingle of three
    assert all(0.3 < likeness(a, b) < 0.8 for a, b in found)
    rows = [(2 * i + k, t) for i, p in enumerate(found) for k, t in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sh.keep_one(df).count() == len(rows)


def test_groups_are_components_of_the_exact_links(spark):
    docs = [t for t in (r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()) if t and t.split()]
    got = {}
    for r in near.groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect():
        got.setdefault(r.group, set()).add(r.doc_id)
    want = [{i} for i in range(len(docs))]
    for i, a in enumerate(docs):
        for j in range(i):
            if likeness(a, docs[j]) >= 0.8 and want[i] is not want[j]:
                want[i] |= want[j]
                for k in want[i]:
                    want[k] = want[i]
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want}


def test_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(50)) for k in "abcd")
    rows = [
        (1, a, "en"),
        (1, a, "en"),  # a repeated row
        (5, a, "en"),  # a copy, and its id occurs with another text
        (5, b, "en"),
        (7, b, "en"),
        (8, c + " y", "en"),  # one id, two texts alike: the least stays
        (8, c + " x", "en"),
        (8, c + " x", "de"),
        (None, a, "en"),
        (None, d, "en"),
        (None, d, "en"),
        (None, None, None),
        (None, "", "en"),
    ]
    got = [tuple(r) for r in sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, a, "en"), (5, b, "en"), (8, c + " x", "de"), (None, d, "en"), (None, None, None)], key=repr)


def test_texts_meet_by_simhash(spark, monkeypatch):
    """Without any band, texts whose fingerprints are linked still meet and go through the exact comparison."""
    own = lambda e, at, again=False: np.add.reduceat(e.astype(np.uint64), at[:-1])[:, None] * np.uint64(16) + np.arange(16, dtype=np.uint64)
    monkeypatch.setattr(near, "bands", own)  # no two sets share one
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words)
    texts = [base, base + " tail", " ".join(f"v{i}" for i in range(400)), None, "", base.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [int(v) for v in sh.simhash(pa.array(texts))]
    assert (prints[0] ^ prints[1]).bit_count() <= sh.DISTANCE
    assert {r.doc_id: r.low for r in near.groups(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 0}

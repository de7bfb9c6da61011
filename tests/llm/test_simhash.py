import re

import numpy as np
import pyarrow as pa
import xxhash

from loomgraph.llm import simhash as sh


def brute_fp(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(ids, fps):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if bin(x ^ y).count("1") <= 3:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_fingerprints_match_brute_force():
    texts = [None, "", " \n ", "One", "Two words", "A b\tC  d\né É ñ", "x " * 500, "Größe \x0b ist A B C a b c"]
    assert sh.simhash(pa.array(texts)).tolist() == [brute_fp(t) for t in texts]
    assert xxhash.xxh64_intdigest(b"", 42) == 0x98B1582B0977E704


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = []
    for b in base:
        x = int(b)
        for _ in range(rng.integers(1, 8)):
            fps.append(x)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
    ids = list(range(len(fps), 0, -1))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, f0 long")
    got = {r.doc_id: r.component_id for r in sh.components(df).collect()}
    assert got == roots(ids, fps)


def test_large_block_lists_lose_nothing(spark):
    """Lists over the split are dealt again, whether they end in a batch or run over many."""
    rng = np.random.default_rng(4)
    fps = [int(x) << 40 for x in np.unique(rng.integers(0, 1 << 13, 2000))] + [int(x) for x in rng.integers(0, 1 << 62, 200)]
    ids = list(range(1, len(fps) + 1))
    df = spark.createDataFrame(list(zip(ids, fps)), "doc_id long, f0 long")
    whole = {r.doc_id: r.component_id for r in sh.components(df, split=1 << 30).collect()}
    for split in (20, 1500):
        assert {r.doc_id: r.component_id for r in sh.components(df, split=split).collect()} == whole
    some = rng.choice(len(fps), 300, replace=False)
    for i in some:
        for j in some:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                assert whole[ids[i]] == whole[ids[j]]


def test_hot_fingerprints_and_hubs(spark):
    """One fingerprint on most rows, one component of most fingerprints: more rows than any task's share."""
    near = [1 << b | 1 << c for b in range(56) for c in range(b)]
    fps = [0] * 2500 + [f - (1 << 64) if f >> 63 else f for f in near]
    df = spark.createDataFrame([(len(fps) - i, f) for i, f in enumerate(fps)], "doc_id long, f0 long")
    got = sh.components(df)
    assert got.count() == len(fps) and [r.component_id for r in got.select("component_id").distinct().collect()] == [1]


def test_very_long_text():
    text = "Ab cd ef gh " * 60_000
    assert sh.simhash(pa.array([text, "x"])).tolist() == [brute_fp(text), brute_fp("x")]


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string, fp string"
    assert sh.components(sh.fingerprints(spark.createDataFrame([], schema))).count() == 0
    rows = [(3, None, "x"), (3, None, "x"), (5, "", "y"), (None, "a b c d", "z")]
    got = sh.components(sh.fingerprints(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(3, 3), (3, 3), (5, 3)]


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(9)
    vocab = [f"word{i}" for i in range(5000)]
    rows, near = [], set()
    for i in range(120):
        words = list(rng.choice(vocab, 300))
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 3):
            other = list(words)
            for at in rng.choice(300, 4, replace=False):
                other[at] = "changed"
            rows.append((10 * i + k, " ".join(other)))
            near.add(10 * i + k)
    rows += [(9000, None), (9001, ""), (9002, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, f0 int")
    kept = {r.doc_id for r in sh.keep_one(df).collect()}
    assert kept.isdisjoint({9001, 9002}) and {10 * i for i in range(120)} | {9000} <= kept
    assert len(kept & near) <= 0.02 * len(near)

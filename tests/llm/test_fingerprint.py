import hashlib

import numpy as np

from loomgraph.llm import fingerprint as fp


def shingle_set(text, k=5):
    w = text.replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (-r[0], r[1]))
    out = {}
    for n, (i, t) in enumerate(rows):
        f = rows[(n + 1) % len(rows)][1]
        m = len(t) // 2
        new = t[: len(t) - m] + f[:m]

        def like(a, b):
            return len(a & b) / len(a | b) if a | b else 1.0

        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), like(shingle_set(t), shingle_set(new)), like(shingle_set(t), shingle_set(f)))
    return out


def test_edited_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = ["ab", "é", "x1", "word", "ñandú", "z", "日本"]
    rows = [(int(i), " ".join(rng.choice(vocab, rng.integers(0, 60)))) for i in rng.permutation(80)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "a b\nc\td"), (104, "long " * 30000)]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, fingerprint string, n_chars int")
    got = {r.doc_id: r for r in fp.edited(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (n, sha, near, nxt) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - near) < 1e-9 or len(shingle_set(dict(rows)[i] or "")) > fp.K // 2
        assert abs(r.near_next - nxt) < 0.2
    assert got[100].fingerprint == got[101].fingerprint == ""


def test_one_row_and_no_rows(spark):
    schema = "doc_id long, text string"
    one = fp.edited(spark.createDataFrame([(None, "a b c")], schema)).first()
    assert one.doc_id is None and one.edited_sha256 == hashlib.sha256(b"a ba ").hexdigest()
    assert fp.edited(spark.createDataFrame([], schema)).count() == 0


def test_sketch_estimates_and_merge():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 48, 20000, dtype=np.uint64)
    b = np.concatenate([a[:10000], rng.integers(0, 1 << 48, 10000, dtype=np.uint64)])
    sa, sb = fp.bottom_k(a, 512), fp.bottom_k(b, 512)
    assert abs(fp.distinct(sa, 512) / 20000 - 1) < 0.2
    assert abs(fp.resemblance(sa, sb, 512) - 1 / 3) < 0.08
    assert abs(fp.containment(sa, sb, 512) - 1 / 2) < 0.12
    assert (fp.merge(fp.bottom_k(a[:5000], 512), fp.bottom_k(a[5000:], 512), 512) == sa).all()
    assert (fp.from_text(fp.to_text(sa)) == sa).all()


def test_merge_by_equals_sketch_of_union(spark):
    df = spark.createDataFrame([("g", " ".join(f"w{i}" for i in range(a, a + 400))) for a in (0, 200, 300)] + [("h", "")], "g string, text string")
    made = fp.fingerprints(df, k=64)
    got = {r.g: r.fingerprint for r in fp.merge_by(made, ["g"], k=64).collect()}
    parts = [fp.from_text(r.fingerprint) for r in made.where("g = 'g'").collect()]
    want = parts[0]
    for p in parts[1:]:
        want = fp.merge(want, p, 64)
    assert got["g"] == fp.to_text(want)


def test_words_of_equal_rolling_hash_differ():
    """A Thue-Morse word and its complement agree in any polynomial hash modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = fp.sketches(fp.pa.array(["".join("ab"[x ^ flip] for x in bits) + " and four more words" for flip in (0, 1)]))
    assert fp.resemblance(a, b) == 0
    a, b = fp.sketches(fp.pa.array([" ".join("ab"[x ^ flip] for x in bits) for flip in (0, 1)]), words=1024)
    assert fp.resemblance(a, b) < 1

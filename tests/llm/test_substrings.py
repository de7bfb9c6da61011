import hashlib
import re
from collections import Counter

import numpy as np

from loomgraph.llm import substrings as ss


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - 34):
            if seen[tuple(w[s : s + 35])] > 1:
                gone.update(range(s, s + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(spark, rows):
    df = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    got = ss.repeats(df)
    return sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", ss.F.sha2(ss.F.coalesce("kept", ss.joined_words(ss.F.col("text"))), 256)).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    for vocab in (["a"], ["a", "b"], ["a", "b", "ç", "d e", "f\n"], [f"w{i}" for i in range(400)]):
        passages = [" ".join(rng.choice(vocab, n)) for n in (34, 35, 36, 50, 80)]
        rows = [(0, None), (1, ""), (2, " \t"), (3, "x " * 100), (4, "x " * 35), (5, "x " * 36)]
        for i in range(6, 60):
            text = " ".join(rng.choice(vocab, rng.integers(0, 70)))
            for p in rng.choice(len(passages), rng.integers(0, 3)):
                text += " " + passages[p] + " " + " ".join(rng.choice(vocab, rng.integers(0, 20)))
            rows.append((i, text))
        rows.append(rows[-1])
        assert result(spark, rows) == brute(rows)


def test_long_text_and_empty_table(spark):
    rng = np.random.default_rng(6)
    long = " ".join(rng.choice([f"v{i}" for i in range(3000)], 400_000))
    cut = " ".join(long.split(" ")[200_000:200_040])
    rows = [(1, long), (2, "start here " + cut + " and end"), (3, "y" * 700_000 + " z")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


class Text(ss.Words):
    """Words given by their hashes."""

    def __init__(self, h):
        super().__init__(np.empty(0, np.uint8), np.empty(0, int), np.empty(0, int), np.array([0, len(h)]))
        self.h = h

    def hashes(self, seed=0):
        return self.h


def test_interior_symbols_do_not_depend_on_context():
    rng = np.random.default_rng(7)
    for _ in range(300):
        h = ss.mix(rng.integers(0, 3, 35).astype(np.uint64))
        rounds = [[], []]
        for _ in range(4):
            left, right = (ss.mix(rng.integers(0, 3, rng.integers(0, 9)).astype(np.uint64)) for _ in range(2))
            own = ss.Filed(Text(np.concatenate([left, h, right])))
            for turn in range(2):
                if turn:
                    own.named(own.name % 5 != 0)
                length = np.diff(own.at, append=len(own.h))
                inside = (own.at - len(left) >= ss.MARGINS[turn]) & (own.at - len(left) + length <= 35 - ss.MARGINS[turn])
                rounds[turn].append(list(zip((own.at - len(left))[inside].tolist(), own.name[inside].tolist())))
        assert all(found == own[0] for own in rounds for found in own)


def test_words_of_equal_rolling_hash(spark):
    """A Thue-Morse word and its complement agree in any polynomial hash modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    shared = " ".join(f"s{i}" for i in range(34))
    rows = [(1, f"{one} {shared}"), (2, f"{two} {shared}"), (3, f"{shared} {one}"), (4, f"{shared} {one}")]
    assert result(spark, rows) == brute(rows)
    assert [r[2] for r in result(spark, rows)] == [0, 0, 35, 35]


def test_names_are_global(spark):
    """Symbols of a passage that two texts share are kept by every round; those of unique words are not."""
    rng = np.random.default_rng(8)
    shared = " ".join(f"s{i}" for i in rng.integers(0, 50, 60))
    texts = [f"{' '.join(f'u{k}x{i}' for i in range(60))} {shared}" for k in range(2)]
    own = [ss.Filed(w) for t in texts for _, _, w in ss.chunks(ss.pa.array([t]))]
    common = np.intersect1d(own[0].name, own[1].name)
    for p in own:
        p.named(np.isin(p.name, common))
        assert p.starts.min() >= 60 - ss.MARGINS[0] and len(p.starts) >= 26

import numpy as np

from loomgraph.llm import vectors as vx

SCHEMA = "vec_id long, embedding array<float>, label int, links int"


def brute(rows):
    ok = {}
    for k, (_, e, label) in enumerate(rows):
        if label is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            v = np.array(np.array(e, np.float32), float)
            ok[k] = v / np.linalg.norm(v)
    up = {k: k for k in range(len(rows))}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    n = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.98:
                n[a] += 1
                n[b] += 1
                up[find(a)] = find(b)
    low = {}
    for k, (i, *_) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, n[k], low[find(k)], i == low[find(k)]) for k, (i, *_) in enumerate(rows))


def result(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in vx.dedup(df, **kw).collect())


def clusters(rng, n, dim, groups, noise):
    base = rng.standard_normal((groups, dim))
    x = base[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, dim))
    return [[float(v) for v in r.astype(np.float32)] for r in x]


def test_against_brute_force_in_deep_trees(spark):
    rng = np.random.default_rng(11)
    x = clusters(rng, 700, 24, 250, 0.12)
    rows = [(int(i), v, int(rng.integers(0, 2))) for i, v in zip(rng.permutation(700), x)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)]
    assert result(spark, rows, leaf=40, block=30) == brute(rows)


def test_recall_three_subtrees_deep(spark, monkeypatch):
    """Cells are cut over and over (subtrees of depth 2, so that 1,500 vectors need several): nearly all links are found."""
    monkeypatch.setattr(vx, "DEPTH", 2)
    rng = np.random.default_rng(14)
    x = clusters(rng, 1500, 32, 700, 0.1)
    rows = [(i, v, 0) for i, v in enumerate(x)]
    rounds = []
    grow = vx.cut
    monkeypatch.setattr(vx, "cut", lambda df: (rounds.append(df.columns), grow(df))[1])
    got = {r[0]: r[1] for r in result(spark, rows, leaf=12, block=64)}
    assert sum(c == ["node", "cell", "tree", "was"] for c in rounds) >= 4  # the roots, and three rounds or more of cuts
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.97 * sum(want.values()) > 0


def test_doubles_and_hot_vectors(spark):
    """Double components are compared as such; one vector on most rows is one class."""
    rows = [(i, [1.0, 0.0, 0.0], 1) for i in range(6000)] + [(9000, [1.0, 1e-9, 0.0], 1), (9001, [0.98, 0.19899748742132398, 0.0], 1), (9002, [0.97, 0.24, 0.0], 1)]
    got = {r.vec_id: r for r in vx.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows) and got[0].n_links in (6000, 6001) and got[0].kept and got[9000].component_id == 0
    assert got[9002].component_id in (0, 9002) and sum(r.kept for r in got.values()) <= 3


def test_one_dense_group_in_blocks(spark):
    rng = np.random.default_rng(12)
    x = clusters(rng, 300, 16, 1, 0.03)
    rows = [(i, v, 1) for i, v in enumerate(x)]
    assert result(spark, rows, leaf=20, block=64) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, nan], 1), (4, [1.0, inf], 1), (5, [1.0, None], 1), (6, [1.0, 1.0], None), (7, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (9, [2.0, 2.0], 1), (10, [1.0, 1.0, 0.0], 1), (11, [], 1), (12, [1.0, 1.0], 2)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_recall_of_the_cuts():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal(x.shape) * 0.2 / 8
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    tau = vx.margin(64)
    lost = np.ones(len(x), bool)
    for cell in range(vx.TREES):
        cuts = np.array(vx.fit_cuts(cell, x, 6, tau))
        places = [{} for _ in range(2)]
        for side, m in enumerate((x, y)):
            for r, e in zip(*vx.route(cell, m, cuts, tau)):
                places[side].setdefault(r, set()).add(e)
        lost &= [not places[0][r] & places[1][r] for r in range(len(x))]
    assert lost.mean() < 0.001

import numpy as np
import pytest

from loomgraph.llm import components


def plain(links):
    root = {n: n for e in links for n in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("few", [0, 160, None])
def test_rounds_and_one_task_agree(spark, few, monkeypatch):
    """By rounds alone, by rounds until few links are left, and by one task."""
    rng = np.random.default_rng(3)
    links = [*map(tuple, rng.integers(-40, 40, (200, 2)).tolist()), *((100 + i, 101 + i) for i in range(25)), *((200, 201 + i) for i in range(20))]
    links = [(a, b) for a, b in links if a != b]
    cuts, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda rows: cuts.append(1) or cut(rows))
    df = spark.createDataFrame([*links, *links, (None, 1), (1, None), (500, 500)], "a long, b long")
    got = components.connected_components(df, few=few)
    assert {r.node: r.root for r in got.collect()} == plain(links) and got.count() == len(plain(links))
    assert few is not None or len(cuts) == 2
    assert few != 160 or 3 <= len(cuts) < 6


def test_no_links(spark):
    assert components.connected_components(spark.range(0).selectExpr("id a", "id b")).count() == 0
    assert components.connected_components(spark.range(3).selectExpr("id a", "id b"), few=0).count() == 0

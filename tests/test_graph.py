import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.operators import graph


def walk(edges, seeds):
    hops, front, h = {s: 0 for s in seeds}, set(seeds), 0
    while front:
        h += 1
        front = {d for s, d in edges if s in front} - hops.keys()
        hops |= {n: h for n in front}
    return hops


def components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: walk(edges, {n}).keys() for n in nodes}
    out = {}
    for n in nodes:
        own = {m for m in reach[n] if n in reach[m]}
        if len(own) > 1 or (n, n) in edges:
            out[n] = (min(own), len(own))
    return out


PAIRS = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=40)


@settings(max_examples=200, deadline=None)
@given(PAIRS)
def test_tarjan(pairs):
    edges = set(pairs)
    src = np.array([a for a, _ in edges], np.int64)
    dst = np.array([b for _, b in edges], np.int64)
    comp = graph.tarjan(src, dst, 13)
    want = components(edges)
    for n in range(13):
        assert comp[n] == want.get(n, (n, 1))[0]


@pytest.mark.parametrize("local", [True, False])
def test_both_ways_agree_with_plain_walks(spark, local, monkeypatch):
    if not local:
        monkeypatch.setattr(graph, "LOCAL", 0)
    rng = np.random.default_rng(7)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 30, (45, 2))}
    df = spark.createDataFrame([*edges, *edges, (None, 3), (3, None)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (2,), (None,), (99,)], "s long")
    assert {r.node: r.hops for r in graph.reachable(df, seeds).collect()} == walk(edges, {1, 2, 99})
    assert {r.node: (r.component, r.size) for r in graph.cycles(df).collect()} == components(edges)
    none = df.where("src > 100")
    assert graph.cycles(none).count() == 0 and {r.node for r in graph.reachable(none, seeds).collect()} == {1, 2, 99}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PAIRS)
def test_string_nodes(spark, pairs):
    edges = {(f"f{a}", f"f{b}") for a, b in pairs}
    df = spark.createDataFrame(list(edges), "src string, dst string")
    assert {r.node: (r.component, r.size) for r in graph.cycles(df).collect()} == components(edges)


def test_barrels_of_any_depth(spark):
    """A symbol behind more re-exports than any fixed number of rounds would follow."""
    n = 55
    rows = [(f"b{i}", "*", f"./b{i + 1}", "*") for i in range(n)] + [(f"b{n}", "x", None, "x")]
    exports = spark.createDataFrame(rows, "file_path string, name string, source_specifier string, original_name string")
    targets = spark.createDataFrame([(f"b{i}", f"./b{i + 1}", f"b{i + 1}") for i in range(n)], "file_path string, source_specifier string, target string")
    wanted = spark.createDataFrame([("b0", "x")], "file_path string, name string")
    r = graph.resolve_symbols(wanted, exports, targets).first()
    assert (r.origin_file, r.origin_name, r.hop) == (f"b{n}", "x", n)


def test_many_seeds_take_rounds(spark):
    """Seeds are counted like edges: many of them are not gathered into one task."""
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    got = graph.reachable(edges, spark.range(50).toDF("s"), local=10)
    assert {(r.node, r.hops) for r in got.collect()} == {(i, 0) for i in range(50)}
    assert "MapInArrow" not in got._jdf.queryExecution().toString()


def test_symbol_precedence_and_cycles(spark):
    schema = "file_path string, name string, source_specifier string, original_name string"
    exports = spark.createDataFrame([
        ("i", "a", "./x", "b"), ("i", "*", "./y", "*"), ("x", "b", None, "b"), ("y", "a", None, "a"), ("y", "c", None, "c"), ("y", "*", "./i", "*"), ("i", "n", "./x", "*"),
    ], schema)
    targets = spark.createDataFrame([("i", "./x", "x"), ("i", "./y", "y"), ("y", "./i", "i")], "file_path string, source_specifier string, target string")
    wanted = spark.createDataFrame([("i", "a"), ("i", "c"), ("i", "n"), ("i", "zzz"), ("y", "a")], "file_path string, name string")
    got = {(r.file_path, r.name): (r.origin_file, r.origin_name) for r in graph.resolve_symbols(wanted, exports, targets).collect()}
    assert got == {("i", "a"): ("x", "b"), ("i", "c"): ("y", "c"), ("i", "n"): ("x", "*"), ("i", "zzz"): ("i", "zzz"), ("y", "a"): ("y", "a")}


def test_components_of_large_graphs(spark, monkeypatch):
    """Colours are dealt to tasks where they are small and go on in rounds where they aren't; a long cycle takes few rounds."""
    rng = np.random.default_rng(5)
    edges = {(200 * k + int(a), 200 * k + int(b)) for k in range(2) for a, b in rng.integers(0, 20, (32, 2))}
    edges |= {(1000 + i, 1000 + (i + 1) % 40) for i in range(40)} | {(1039, 1000), (2000, 1000), (2001, 2000), (2000, 2001)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long").repartition(3)
    monkeypatch.setattr(graph, "_HELD", 10)
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda rows: cuts.append(1) or cut(rows))
    got = {r.node: (r.component, r.size) for r in graph.cycles(df, local=0).collect()}
    assert got == components(edges) and len(cuts) < 25
    assert {r.node: (r.component, r.size) for r in graph.cycles(df, local=0, dealt=20).collect()} == got


def test_a_round_shuffles_marks_alone(spark, monkeypatch):
    """Edges are dealt once, not at each step; settings are as before afterwards."""
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or cut(rows))
    keys = ["spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"]
    was = [spark.conf.get(k) for k in keys]
    edges = spark.createDataFrame([(i, (i + 1) % 60) for i in range(60)] + [(70, 3), (5, 71), (71, 71)], "src long, dst long").repartition(3)
    got = {r.n: r.c for r in graph._least(edges).collect()}
    assert got == {i: 0 for i in (*range(60), 71)} | {70: 70}
    assert [spark.conf.get(k) for k in keys] == was
    rounds = [p for p in plans if p.count("Join") > graph.STEPS]
    assert rounds and all(p.count("Exchange") - p.count("ReusedExchange") <= graph.STEPS + 3 and "Broadcast" not in p for p in rounds)


def test_text_of_cycles_found_by_rounds(spark):
    edges = spark.createDataFrame([(3, 10), (10, 2), (2, 3), (7, 7), (2, 7), (8, 2), (7, 9)], "src long, dst long")
    got = {(r.component, r.size, r.path) for r in graph.cycle_text(graph.cycles(edges, local=0)).collect()}
    assert got == {(2, 3, "2 -> 3 -> 10 -> 2"), (7, 1, "7 -> 7")}


def test_colours_stay_whole_where_plans_adapt(spark):
    """A join that turns into a broadcast while it runs does not part a colour's edges among tasks."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in keys}
    edges = [(100 * k + i, 100 * k + (i + 1) % 9) for k in range(30) for i in range(9)]
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {(r.component, r.size) for r in graph.cycles(spark.createDataFrame(edges, "src long, dst long").repartition(8), local=0).collect()}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {(100 * k, 9) for k in range(30)}

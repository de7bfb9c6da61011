import json

from loomgraph.llm import chat as ch

SCHEMA = "conv_id long, turn long, role string, text string, call_id string"
TOOLS = {"add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "op": {"type": "string", "enum": ["x", "y"]}}, "required": ["a"]}}


def call(id_, name, args):
    return {"id": id_, "name": name, "arguments": args if isinstance(args, str) else json.dumps(args)}


def asked(conv, turn, *calls):
    return (conv, turn, "assistant", json.dumps({"tool_calls": list(calls)}), "z")


def told(conv, turn, id_, content):
    return (conv, turn, "tool", json.dumps({"tool_call_id": id_, "content": content}), "z")


def result(spark, rows):
    return ch.chat(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()


def test_linking_order_and_canonical_json(spark):
    rows = [
        (1, 0, "user", 'say "é"\n', "z"),
        asked(1, 1, call("p", "add", {"b": 1.5, "a": 2}), call("q", "add", {"a": 3, "op": "$ref:p"})),
        told(1, 2, "p", '{"z": 1, "a": [2, {"d": 1, "c": 2}]}'),
        told(1, 3, "q", "plain"),
        told(1, 4, "nobody", "lost"),
        asked(2, 0, call("p", "add", {"a": 1})),
        asked(2, 1, call("p", "add", {"a": 1})),
        (None, None, None, None, None),
    ]
    got = {(r.conv_id, r.kind, r.call_id): r for r in result(spark, rows)}
    assert got[1, "call", "p"].json == '{"arguments":{"a":2,"b":1.5},"id":"p","name":"add"}'
    assert got[1, "result", "p"].json == '{"content":{"a":[2,{"c":2,"d":1}],"z":1},"tool_call_id":"p"}'
    assert got[1, "message", None].json == '{"content":"say \\"é\\"\\n","role":"user"}'
    assert [got[1, k, i].level for k, i in (("call", "p"), ("result", "p"), ("call", "q"), ("result", "q"))] == [0, 1, 2, 3]
    assert not got[1, "result", "nobody"].linked and got[1, "result", "p"].linked
    assert got[2, "call", "p"].duplicates == 1 and not got[2, "call", "p"].linked
    assert got[1, "call", "q"].n_faults == 1 and got[1, "call", "p"].n_faults == 0
    assert got[None, "message", None].json == '{"content":"","role":""}'


def test_cycles_have_no_level(spark):
    rows = [asked(1, 0, call("p", "add", {"a": 1, "op": "$ref:q"}), call("q", "add", {"a": 1, "op": "$ref:p"})), told(1, 1, "p", ""), told(1, 2, "q", "")]
    assert {r.level for r in result(spark, rows)} == {None}


def test_long_chains_and_joins(spark):
    """Levels of a chain of 1,200 links, of diamonds, of a cycle and what is behind it."""
    edges = [(1, f"n{i}", f"n{i + 1}") for i in range(1200)]
    edges += [(2, "a", "b"), (2, "a", "c"), (2, "b", "d"), (2, "c", "x"), (2, "x", "d"), (2, "d", "e"), (2, "a", "e")]
    edges += [(3, "p", "q"), (3, "q", "p"), (3, "q", "r"), (3, "s", "r"), (3, "s", "t")]
    nodes = sorted({(c, n) for c, a, b in edges for n in (a, b)}) + [(4, "alone")]
    got = {(r.conv_id, r.node): r.level for r in ch.levels(spark.createDataFrame(edges, "conv_id long, before string, after string"), spark.createDataFrame(nodes, "conv_id long, node string")).collect()}
    assert all(got[1, f"n{i}"] == i for i in range(1201))
    assert [got[2, n] for n in "abcxde"] == [0, 1, 1, 2, 3, 4]
    assert [got[3, n] for n in "pqrst"] == [None, None, None, 0, 1] and got[4, "alone"] == 0


def test_random_orders_match_a_plain_walk(spark):
    import random

    rng = random.Random(2)
    edges = sorted({(c, f"n{a}", f"n{b}") for c in range(8) for a, b in (sorted(rng.sample(range(8), 2)) for _ in range(rng.randrange(4, 14)))})
    want = {}
    for c, a, b in sorted(edges, key=lambda e: (e[0], int(e[1][1:]))):
        want.setdefault((c, a), 0)
        want[c, b] = max(want.get((c, b), 0), want[c, a] + 1)
    nodes = spark.createDataFrame(sorted(want), "conv_id long, node string")
    got = {(r.conv_id, r.node): r.level for r in ch.levels(spark.createDataFrame(edges, "conv_id long, before string, after string"), nodes).collect()}
    assert got == want


def test_references_elsewhere_change_nothing(spark):
    """Levels of rows without an identifier or a conversation are the same with and without references in the table."""
    rows = [told(9, 0, None, "x"), told(None, 1, "p", "y"), asked(None, 0, call("p", "add", {"a": 1})), asked(9, 2, call("k", "add", {"a": 1})), told(9, 3, "k", "z")]
    more = [asked(2, 0, call("p", "add", {"a": 1})), told(2, 1, "p", "1"), asked(2, 2, call("q", "add", {"a": 1, "op": "$ref:p"}))]
    own = lambda got: sorted((repr(r.conv_id), r.turn, r.kind, repr(r.call_id), r.level) for r in got if r.conv_id != 2)
    assert own(result(spark, rows)) == own(result(spark, rows + more))


def test_nulls_and_very_long_texts(spark):
    rows = [(1, None, "user", "a", "z"), (1, 0, None, "b", "z"), (None, 1, "user", "c", "z"), (1, 1, "user", None, "z"), (1, 2, "assistant", "x" * 1_000_000, "z")]
    got = result(spark, rows)
    assert len(got) == len(rows) and max(len(r.json) for r in got) > 1_000_000


def test_validation(spark):
    args = [{"a": 1}, {}, {"a": -1}, {"a": "1"}, {"a": 1, "op": "q"}, {"a": 1, "b": "x", "n": 0}, "not json", "[1]", {"a": 1.5}]
    rows = [asked(1, i, call(str(i), "add", a)) for i, a in enumerate(args)] + [asked(1, 99, call("99", "other", {}))]
    got = {r.call_id: r.n_faults for r in result(spark, rows)}
    assert [got[str(i)] for i in range(len(args))] == [0, 1, 1, 1, 1, 2, 1, 1, 1] and got["99"] == 1


def test_hot_identifier_and_empty_table(spark):
    rows = [asked(1, 0, call("p", "add", {"a": 1}))] * 300 + [told(1, 5, "p", "r")] * 300
    got = result(spark, rows)
    assert len(got) == 301 and sum(r.linked for r in got) == 301
    assert result(spark, []) == []


def test_query_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = ch.op4_chat(spark, sf)
    want = duckdb.sql(ch.ORACLE).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_query_with_nulls_and_repeats_matches_sql(spark, tmp_path):
    import duckdb

    rows = [(c, t, r, x) for c in (1, 2, None) for t in (0, 1, -1, None) for r in ("user", "assistant", "system", None) for x in ("a", None, 'q"\\\n')]
    rows += rows[:20] + [(7, 0, "user", "x" * 200_000), (7, 1, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = ch.op4_chat(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(ch.ORACLE).fetchall()))

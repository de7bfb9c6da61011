"""Chat formatting: tool calls linked to results, ordered, validated and serialised, in DataFrame functions only.

Messages are (conv_id, turn, role, text). Calls and results come from JSON texts
(`parsed`) or from plain turns (`from_turns`). Calls are made unique by conversation
and identifier before the hash join (the one of the lowest turn stays, ties by text;
the others are told as duplicates), so a result meets one call at most and a hot
identifier cannot multiply. Order is topological: a result comes after its call, a call
after the results it names in ``$ref`` strings of its arguments. Levels are found by
rounds over the remaining edges, until nothing changes, so no conversation is gathered in
one place; calls on a cycle get no level and are told. Arguments are checked against schemas known to the
plan. JSON is canonical: keys in order, no white space, through the variant type.

Nulls: a call or result without conversation or identifier is linked with nothing and has
level 0; a message without conversation, turn, role or text is passed on as such; a null
text serialises as an empty content. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read

#: Tools of plain conversations: what a user says is a call, what the assistant says next its result.
REPLY = {"reply": {"properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"]}}

_CALL = "array<struct<id:string,name:string,arguments:string>>"


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text, null where it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def text_json(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("a")))
    return whole.substr(F.lit(6), F.length(whole) - 6)


# --- calls and results


def parsed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, name, arguments) of assistant texts {"tool_calls": [{"id", "name", "arguments"}]}
    and results (conv_id, turn, call_id, content) of tool texts {"tool_call_id", "content"}."""
    calls = messages.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", f"tool_calls {_CALL}")["tool_calls"]).alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    told = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("r"))
    return calls, told.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))


def from_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns: a user's is a call of `reply`, the assistant's right after it the result."""
    id_ = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    arguments = F.concat(F.lit('{"text":'), text_json(F.col("text")), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit("}"))
    known = messages.where("conv_id is not null and turn is not null")
    calls = known.where("role = 'user'").select("conv_id", "turn", id_(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = known.where("role = 'assistant'").select("conv_id", "turn", id_(F.col("turn") - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def unique_calls(calls: DataFrame) -> DataFrame:
    """One call for each conversation and identifier, and how many there were."""
    first = F.struct("turn", "name", "arguments")
    one = calls.groupBy("conv_id", "call_id").agg(F.min(first).alias("c"), F.count("*").alias("times"))
    return one.select("conv_id", "call_id", "c.*", "times")


# --- validation


def _faults(arguments: Column, schema: dict) -> Column:
    """Names of what is wrong with a call's arguments."""
    v = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    tests: list[Column] = [F.when(v.isNull() | keys.isNull(), F.lit("not an object"))]
    said = lambda bad, what: F.when(v.isNotNull() & keys.isNotNull() & bad, F.lit(what))
    for name in schema.get("required", []):
        tests.append(said(~F.array_contains(keys, name), f"{name}: missing"))
    for name, rule in schema.get("properties", {}).items():
        got = F.try_variant_get(v, f"$.{name}", "variant")
        there, kind = F.array_contains(keys, name), F.coalesce(F.schema_of_variant(got), F.lit("VOID"))
        kinds = {"string": kind == "STRING", "integer": kind == "BIGINT", "number": kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "boolean": kind == "BOOLEAN", "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY")}
        if "type" in rule:
            tests.append(said(there & ~kinds[rule["type"]], f"{name}: not {rule['type']}"))
        text, number = F.try_variant_get(v, f"$.{name}", "string"), F.try_variant_get(v, f"$.{name}", "double")
        for key, bad in (("minLength", lambda r, text=text: F.length(text) < r), ("maxLength", lambda r, text=text: F.length(text) > r), ("minimum", lambda r, number=number: number < r), ("maximum", lambda r, number=number: number > r), ("enum", lambda r, text=text: ~text.isin(*r))):
            if key in rule:
                tests.append(said(there & F.coalesce(bad(rule[key]), F.lit(False)), f"{name}: {key}"))
    tests.append(said(F.size(F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {})))) if schema.get("properties") else keys) > 0, "unknown arguments"))
    return F.array_compact(F.array(*tests))


def validated(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls with ``faults``; a call of a tool without a schema has one fault."""
    faults = F.array(F.lit("unknown tool"))
    for name, schema in schemas.items():
        faults = F.when(F.col("name") == name, _faults(F.col("arguments"), schema)).otherwise(faults)
    return calls.withColumn("faults", faults)


# --- order


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, node, level): the longest path to the node; nodes on or behind a cycle have a null level.
    edges: (conv_id, before, after). A round first jumps along chains (`_shortened`), then settles all nodes whose
    predecessors are settled, until none is; so rounds follow how often paths join, not how long they are."""
    key = ["conv_id", "node"]
    left = cut(nodes.select(*key).distinct().withColumn("least", F.lit(0)))
    edges = cut(edges.select("conv_id", "before", "after").distinct().withColumn("w", F.lit(1)))
    if not edges.take(1):
        return left.select(*key, F.col("least").alias("level"))
    done = stuck = None
    while True:
        edges, left, stuck = _shortened(edges, left, stuck)
        waits = edges.select("conv_id", F.col("after").alias("node")).distinct()
        now = cut(left.join(waits, key, "left_anti").select(*key, F.col("least").alias("level")))
        if not now.take(1):
            break
        done = now if done is None else done.union(now)
        settled = now.select("conv_id", F.col("node").alias("before"), "level")
        told = edges.join(settled, ["conv_id", "before"]).groupBy("conv_id", F.col("after").alias("node")).agg(F.max(F.col("level") + F.col("w")).alias("told"))
        left = cut(left.join(waits, key, "left_semi").join(told, key, "left").select(*key, F.greatest("least", F.coalesce("told", F.lit(0))).alias("least")))
        edges = cut(edges.join(settled, ["conv_id", "before"], "left_anti"))
    never = left.select(*key, F.lit(None).cast("int").alias("level"))
    return never if done is None else done.union(never)


def _shortened(edges: DataFrame, left: DataFrame, stuck: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The same levels by other edges: a node with one predecessor has the level max(least, level of that + w), and such
    functions are composed by pointer jumping, so that it hangs off the first node before it with none or several.
    Nodes found to jump in circles are ``stuck``: they keep their edges and are not tried again."""
    one = edges.groupBy("conv_id", F.col("after").alias("node")).agg(F.count("*").alias("n"), F.min("before").alias("anchor"), F.min("w").alias("w")).where("n = 1").drop("n")
    one = one if stuck is None else one.join(stuck, ["conv_id", "node"], "left_anti")
    jumps = cut(one.join(left, ["conv_id", "node"]))
    n = jumps.count()
    circling = False
    for turn in range(n.bit_length() + 1):
        on = jumps.select("conv_id", F.col("node").alias("anchor"), F.col("anchor").alias("to"), F.col("w").alias("more"), F.col("least").alias("low"))
        moved = F.col("to").isNotNull()
        jumps = cut(
            jumps.join(on, ["conv_id", "anchor"], "left").select(
                "conv_id", "node", F.coalesce("to", "anchor").alias("anchor"),
                F.when(moved, F.col("w") + F.col("more")).otherwise(F.col("w")).alias("w"),
                F.when(moved, F.greatest("least", F.col("low") + F.col("w"))).otherwise(F.col("least")).alias("least"), moved.alias("moved"),
            )
        )
        circling = bool(jumps.where("moved").take(1))
        if not circling:
            break
        if turn < n.bit_length():
            jumps = jumps.drop("moved")
    if circling:  # what still moves after that many doublings is on or behind a cycle
        more = jumps.where("moved").select("conv_id", "node")
        stuck = cut(more if stuck is None else stuck.union(more))
        jumps = jumps.where("not moved")
    if not n:
        return edges, left, stuck
    jumps = jumps.select("conv_id", "node", "anchor", "w", "least")
    several = edges.join(jumps.select("conv_id", F.col("node").alias("after")), ["conv_id", "after"], "left_anti")
    over = jumps.select("conv_id", F.col("node").alias("before"), F.col("anchor").alias("to"), F.col("w").alias("more"), F.col("least").alias("low"))
    several = several.join(over, ["conv_id", "before"], "left").select("conv_id", F.coalesce("to", "before").alias("before"), "after", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("low") + F.col("w")).alias("low"))
    several = cut(several)
    lows = several.where("low is not null").groupBy("conv_id", F.col("after").alias("node")).agg(F.max("low").alias("low")).union(jumps.select("conv_id", "node", F.col("least").alias("low")))
    left = left.join(lows, ["conv_id", "node"], "left").select("conv_id", "node", F.greatest("least", F.coalesce("low", F.lit(0))).alias("least"))
    rest = several.select("conv_id", "before", "after", "w").union(jumps.select("conv_id", F.col("anchor").alias("before"), F.col("node").alias("after"), "w"))
    return cut(rest.groupBy("conv_id", "before", "after").agg(F.max("w").alias("w"))), cut(left), stuck


# --- the whole


def formatted(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row a unique call, a result or another message: conv_id, turn, kind (call, result or message), call_id,
    linked, level (topological; messages have 0), n_faults, duplicates, json."""
    one = validated(unique_calls(calls), schemas)
    known = one.select("conv_id", "call_id", F.lit(True).alias("has_call"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("has_result", F.lit(True))
    refs = one.select("conv_id", "call_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref:([^"]+)"'), 1))).alias("ref"))
    waits = refs.join(answered.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"]).select("conv_id", F.concat(F.lit("r:"), "ref").alias("before"), F.concat(F.lit("c:"), "call_id").alias("after"))
    if waits.take(1):
        follows = answered.join(known, ["conv_id", "call_id"]).select("conv_id", F.concat(F.lit("c:"), "call_id").alias("before"), F.concat(F.lit("r:"), "call_id").alias("after"))
        nodes = known.select("conv_id", F.concat(F.lit("c:"), "call_id").alias("node")).union(answered.select("conv_id", F.concat(F.lit("r:"), "call_id")))
        order = cut(levels(follows.union(waits), nodes))
        known_key = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()  # what has none meets nothing and has level 0
        level_of = lambda df, mark: df.withColumn("node", F.concat(F.lit(mark), "call_id")).join(order, ["conv_id", "node"], "left").withColumn("level", F.when(known_key, F.col("level")).otherwise(0))
    else:  # no call names a result: calls are sources, and what answers one comes after it
        level_of = lambda df, mark: df.withColumn("level", F.when(F.lit(mark == "r:") & F.col("linked"), 1).otherwise(0))
    asked = level_of(one.join(answered, ["conv_id", "call_id"], "left").withColumn("linked", F.coalesce("has_result", F.lit(False))), "c:")
    told = level_of(results.join(known, ["conv_id", "call_id"], "left").withColumn("linked", F.coalesce("has_call", F.lit(False))), "r:")
    quote = text_json
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), quote(F.col("arguments"))), F.lit(',"id":'), quote(F.col("call_id")), F.lit(',"name":'), quote(F.col("name")), F.lit("}"))
    result_json = F.concat(F.lit('{"content":'), F.coalesce(F.when(F.ltrim("content").rlike(r"^[\[{]"), canonical(F.col("content"))), quote(F.col("content"))), F.lit(',"tool_call_id":'), quote(F.col("call_id")), F.lit("}"))
    other_json = F.concat(F.lit('{"content":'), quote(F.col("text")), F.lit(',"role":'), quote(F.col("role")), F.lit("}"))
    cols = ["conv_id", "turn", "kind", "call_id", "linked", "level", "n_faults", "duplicates", "json"]
    asked = asked.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "linked", "level", F.size("faults").alias("n_faults"), (F.col("times") - 1).alias("duplicates"), call_json.alias("json"))
    told = told.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", "linked", "level", F.lit(0).alias("n_faults"), F.lit(0).cast("long").alias("duplicates"), result_json.alias("json"))
    rest = messages.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), F.lit(0).alias("level"), F.lit(0).alias("n_faults"), F.lit(0).cast("long").alias("duplicates"), other_json.alias("json"))
    return asked.union(told).union(rest).select(*cols)


def chat(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Messages whose tool traffic is JSON, formatted."""
    calls, results = parsed(messages)
    used = F.coalesce((F.col("role") == "tool") | ((F.col("role") == "assistant") & F.from_json("text", f"tool_calls {_CALL}")["tool_calls"].isNotNull()), F.lit(False))
    return formatted(messages.where(~used), calls, results, schemas)


def op4_chat(spark, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "conversations")
    calls, results = from_turns(messages)
    plain = F.coalesce(F.col("role").isin("user", "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.lit(False))
    found = formatted(messages.where(~plain), calls, results, REPLY)
    return found.select("conv_id", "turn", "kind", "call_id", "linked", "level", "n_faults", "duplicates", F.sha2("json", 256).alias("json_sha256"))


ORACLE = """
WITH m AS (SELECT conv_id, turn, role, text, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS own,
                  CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) AS prior FROM conversations),
c AS (SELECT conv_id, own AS call_id, turn, count(*) AS times, min(coalesce(text, '')) AS text
      FROM m WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT conv_id, turn, prior AS call_id, coalesce(text, '') AS text
      FROM m WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT * FROM m WHERE NOT coalesce(role IN ('user', 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL, false))
SELECT conv_id, turn, 'call' AS kind, call_id, EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) AS linked, 0 AS level,
       CASE WHEN text = '' THEN 1 ELSE 0 END + CASE WHEN turn < 0 THEN 1 ELSE 0 END AS n_faults, times - 1 AS duplicates,
       sha256('{"arguments":{"text":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(call_id) || ',"name":"reply"}') AS json_sha256
FROM c
UNION ALL
SELECT conv_id, turn, 'result', call_id, EXISTS (SELECT 1 FROM c WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id),
       CASE WHEN EXISTS (SELECT 1 FROM c WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) THEN 1 ELSE 0 END, 0, 0,
       sha256('{"content":' || to_json(text) || ',"tool_call_id":' || to_json(call_id) || '}')
FROM r
UNION ALL
SELECT conv_id, turn, 'message', NULL, false, 0, 0, 0, sha256('{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(coalesce(role, '')) || '}')
FROM o
"""

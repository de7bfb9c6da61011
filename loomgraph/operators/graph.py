"""Iterative graph operators over narrow edge tables (src, dst).

Graphs of at most ``LOCAL`` edges and seeds, which are written once and counted first, are
walked in one task over integer arrays; larger ones by rounds of joins, each checkpointed
(`cycles`: until their parts are as small). Both give the same rows (``local`` sets the bound of a call). Null ends are ignored, repeated edges count once, empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from loomgraph.plans.lineage import cut, fixed

LOCAL = 500_000


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def small(rows: DataFrame, local: int | None = None) -> bool:
    local = LOCAL if local is None else local
    return rows.limit(local + 1).count() <= local


# --- reachability


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None, local: int | None = None) -> DataFrame:
    """(node, hops): every node that some seed reaches and the fewest steps; seeds (one column) reach themselves in 0."""
    e = cut(clean(edges))
    s = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct())
    if small(e, local) and small(s, local):
        kind = e.schema["src"].dataType
        tagged = e.select(F.lit(0).alias("t"), "src", "dst").union(s.select(F.lit(1), F.col("node").cast(kind), F.lit(None).cast(kind)))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = pa.Table.from_batches(list(batches), None) if (batches := list(batches)) else None
            if got is None:
                return
            t = got.column(0).to_numpy()
            names, ids = _numbered(got.column(1), got.column(2))
            src, dst = ids[: len(t)][t == 0], ids[len(t) :][t == 0]
            hops = bfs(src, dst, ids[: len(t)][t == 1], len(names), depth)
            hit = np.flatnonzero(hops >= 0)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(hit)), pa.array(hops[hit].astype(np.int32))], ["node", "hops"])

        return tagged.coalesce(1).mapInArrow(walk, StructType([StructField("node", kind), StructField("hops", IntegerType())]))
    front = seen = s.select("node", F.lit(0).alias("hops"))
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        front = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(front.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops")))
        if not front.take(1):
            return seen
        seen = cut(seen.union(front))
    return seen


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values of the columns, sorted, and each entry's place among them (nulls: the first)."""
    import pyarrow.compute as pc

    whole = pa.concat_arrays([c.combine_chunks() if not isinstance(c, pa.Array) else c for c in columns])
    names = pc.unique(whole.drop_null())
    names = names.take(pc.sort_indices(names))
    return names, pc.fill_null(pc.index_in(whole, names), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def adjacency(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order]


def _next(at: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    size = at[nodes + 1] - at[nodes]
    ends = np.cumsum(size)
    return to[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[nodes] - ends + size, size)]


def bfs(src: np.ndarray, dst: np.ndarray, seeds: np.ndarray, n: int, depth: int | None = None) -> np.ndarray:
    hops = np.full(n, -1)
    front = np.unique(seeds)
    if not n:
        return hops
    at, to = adjacency(src, dst, n)
    hop = 0
    hops[front] = 0
    while len(front) and (depth is None or hop < depth):
        hop += 1
        front = np.unique(_next(at, to, front))
        front = front[hops[front] < 0]
        hops[front] = hop
    return hops


def unreachable(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes (one column) that no seed reaches."""
    name = nodes.columns[0]
    return nodes.join(reachable(edges, seeds).select(F.col("node").alias(name)), name, "left_anti")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blast_radius(edges: DataFrame, changed: DataFrame, depth: int | None = None) -> DataFrame:
    """Who depends on a change, directly or not: (node, hops, risk). Thresholds are ours: direct users are
    DANGEROUS, users of users RISKY, the rest SAFE; the changed nodes have hops 0 and no risk."""
    risk = F.when(F.col("hops") == 1, "DANGEROUS").when(F.col("hops") == 2, "RISKY").when(F.col("hops") > 2, "SAFE")
    return reachable(transpose(edges), changed, depth).withColumn("risk", risk)


# --- strongly connected components


def tarjan(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Component of each node, named by its least node; iterative."""
    at, to = adjacency(src, dst, n)
    at, to = at.tolist(), to.tolist()
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    clock = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, at[root])]
        index[root] = low[root] = clock
        clock += 1
        stack.append(root)
        while work:
            v, i = work[-1]
            if i < at[v + 1]:
                work[-1] = (v, i + 1)
                w = to[i]
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    work.append((w, at[w]))
                elif comp[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                own = []
                while True:
                    w = stack.pop()
                    own.append(w)
                    comp[w] = v
                    if w == v:
                        break
                least = min(own)
                for w in own:
                    comp[w] = least
    return np.array(comp, np.int64)


def cycles(edges: DataFrame, local: int | None = None, dealt: int | None = None) -> DataFrame:
    """(node, component, size): strongly connected components of two nodes or more and self-loops; a component is
    named by its least node. Graphs of over ``local`` edges: nodes are coloured by the least node that reaches them, and
    only edges inside a colour go on. Colours of at most ``dealt`` edges (``LOCAL`` unless given) are dealt to tasks whole
    and walked there; in larger ones nodes take the least node that they reach inside the colour: those that reach the
    colour's own node are its component, and the rest goes on where both marks are equal."""
    dealt = LOCAL if dealt is None else dealt
    e = cut(clean(edges))
    loops = e.where("src = dst").select(F.col("src").alias("node"))
    kind = e.schema["src"].dataType
    if small(e, local):
        return _walked(e.withColumn("c", F.lit(0)).coalesce(1), kind)
    live = _trimmed(e.where("src <> dst"))
    found = None
    while not live.isEmpty():
        inside = cut(_marked(live, _least(live)).where("p = q").select("src", "dst", F.col("p").alias("c")))
        parts = []
        if dealt:
            few = cut(inside.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") <= dealt))
            own = inside.join(few.select("c"), "c", "left_semi").select("src", "dst", "c")
            n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            with fixed(e.sparkSession, n):  # an adapted plan may leave out the dealing that the join did already, then read that join's rows in other cuts
                parts.append(cut(_walked(own.repartition(n, "c").sortWithinPartitions("c"), kind).select("node", "component")))
            inside = cut(inside.join(few.select("c"), "c", "left_anti").select("src", "dst", "c"))
        if not dealt or not inside.isEmpty():
            both = cut(_marked(inside, _least(transpose(inside))).where("p = q"))
            parts.append(cut(both.where("p = c").select(F.col("src").alias("node"), F.col("c").alias("component")).distinct()))
            live = _trimmed(both.where("p <> c").select("src", "dst"))
        else:
            live = inside
        for part in parts:
            found = part if found is None else found.union(part)
    if found is None:
        return loops.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    big = cut(found.join(sizes, "component").where("size > 1").select("node", "component", "size"))
    alone = loops.join(big, "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    return big.union(alone)


#: Edges of whole colours that a task walks at once.
_HELD = 200_000


def _walked(edges: DataFrame, kind: DataType) -> DataFrame:
    """(node, component, size) of edges (src, dst, c); equal ``c`` lie together, and no edge leads from one to another."""

    import pyarrow.compute as pc

    def found(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held)
        names, ids = _numbered(table.column(0), table.column(1))
        src, dst = ids[: table.num_rows], ids[table.num_rows :]
        comp = tarjan(src, dst, len(names))
        size = np.bincount(comp, minlength=len(names))[comp]
        self_loop = np.zeros(len(names), bool)
        self_loop[src[src == dst]] = True
        hit = pa.array(np.flatnonzero((size > 1) | self_loop))
        return pa.RecordBatch.from_arrays([names.take(hit), names.take(pa.array(comp)).take(hit), pa.array(size).take(hit)], ["node", "component", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for x in batches:
            if not x.num_rows:
                continue
            at = -1  # where a colour ends, once enough is held
            if sum(t.num_rows for t in held) >= _HELD:
                own = x.column(2)
                at = 0 if own[0].as_py() != held[-1].column(2)[-1].as_py() else pc.index(pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)), True).as_py() + 1 or -1
            if at >= 0:
                if at:
                    held.append(pa.Table.from_batches([x.slice(0, at)]))
                yield found(held)
                held, x = [], x.slice(at)
            held.append(pa.Table.from_batches([x]))
        if held:
            yield found(held)

    return edges.mapInArrow(run, StructType([StructField("node", kind), StructField("component", kind), StructField("size", LongType())]))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) between nodes that have both a way in and a way out."""
    ends = edges.select(F.col("src").alias("n")).intersect(edges.select(F.col("dst").alias("n")))
    return cut(edges.join(ends.withColumnRenamed("n", "src"), "src", "left_semi").join(ends.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"))


#: Steps that a round takes before it is written.
STEPS = 8
#: Edges that a task of a round has at least, on average, unless there are fewer.
_DEALT = 50_000


def _least(edges: DataFrame) -> DataFrame:
    """(n, c): for each node of the edges (src, dst) the least one that reaches it. A round takes some steps along the
    edges, then a jump: what reaches the mark of a node reaches the node. The edges are dealt and sorted once; a step
    shuffles marks alone."""
    spark = edges.sparkSession
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), edges.count() // _DEALT + 2)
    with fixed(spark, tasks):
        marks = cut(nodes.select("n", F.col("n").alias("c")))
        ways = cut(edges.select("src", "dst").union(marks.select("n", "n")).repartition(tasks, "src").sortWithinPartitions("src")).hint("merge")
        while True:
            step = marks.withColumn("old", F.col("c"))
            for _ in range(STEPS):
                own = F.when(F.col("src") == F.col("dst"), F.col("old"))
                step = ways.join(step.withColumnRenamed("n", "src"), "src").groupBy(F.col("dst").alias("n")).agg(F.min("c").alias("c"), F.min(own).alias("old"))
            onward = marks.select(F.col("n").alias("c"), F.col("c").alias("further")).hint("merge")
            new = cut(step.join(onward, "c").select("n", F.least("c", "further").alias("c"), (F.least("c", "further") < F.col("old")).alias("moved")))
            marks = new.select("n", "c")
            if new.where("moved").isEmpty():
                return marks


def _marked(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """The edges with the marks of both ends, p and q."""
    return edges.join(marks.toDF("src", "p"), "src").join(marks.toDF("dst", "q"), "dst")


def cycle_text(found: DataFrame) -> DataFrame:
    """(component, size, path): members in order, the first repeated at the end."""
    members = F.array_sort(F.collect_list("node")).alias("m")
    return found.groupBy("component", "size").agg(members).select("component", "size", F.array_join(F.concat("m", F.slice("m", 1, 1)).cast("array<string>"), " -> ").alias("path"))


# --- degrees and neighbours


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of each node with an edge."""
    e = clean(edges)
    one = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0)))
    return one.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(node, role) of the direct dependents and dependencies of one node."""
    e = clean(edges)
    return e.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("dependent").alias("role")).union(e.where(F.col("src") == node).select("dst", F.lit("dependency")))


def reclassified(files: DataFrame, edges: DataFrame, public: DataFrame) -> DataFrame:
    """(file_path, is_entry): after linking, a file is an entry if it is public (package or framework entry) or
    nothing imports it although it imports something."""
    d = degrees(edges).withColumnRenamed("node", "file_path")
    p = public.select("file_path").distinct().withColumn("public", F.lit(True))
    joined = files.select("file_path").join(d, "file_path", "left").join(p, "file_path", "left")
    return joined.select("file_path", (F.coalesce("public", F.lit(False)) | ((F.coalesce("n_in", F.lit(0)) == 0) & (F.coalesce("n_out", F.lit(0)) > 0))).alias("is_entry"))


# --- symbols through barrels


def through_stars(edges: DataFrame, barrels: DataFrame) -> DataFrame:
    """(src, dst, kind): the edges, and for each that ends at a barrel (one column) those to what the barrel leads to."""
    e = clean(edges)
    b = barrels.select(F.col(barrels.columns[0]).alias("mid")).distinct()
    far = e.select("src", F.col("dst").alias("mid")).join(b, "mid").join(e.select(F.col("src").alias("mid"), "dst"), "mid")
    return e.withColumn("kind", F.lit("import")).union(far.select("src", "dst", F.lit("reexport"))).distinct()


def resolve_symbols(wanted: DataFrame, exports: DataFrame, targets: DataFrame) -> DataFrame:
    """(file_path, name, origin_file, origin_name, hop) of wanted (file_path, name) symbols.

    exports: (file_path, name, source_specifier, original_name), name ``*`` for a star, source null for a local
    declaration; targets: (file_path, source_specifier, target). Each hop takes, for a symbol, a local declaration
    before a named re-export, that before a namespace, that before stars; stars all are followed. A (file, symbol)
    that was visited for the same start is not followed again, so cycles end; of the origins the nearest wins, then
    the least file. A symbol that no file declares resolves to the file it was asked of. Rounds go on until nothing
    is left to follow.
    """
    via = exports.join(targets, ["file_path", "source_specifier"], "left").select("file_path", F.col("name").alias("e"), "source_specifier", F.coalesce("original_name", "name").alias("o"), "target")
    via = cut(via)
    keys = ["file_path", "name"]
    start = wanted.select(*keys).distinct()
    front = cut(start.select(*keys, F.col("file_path").alias("f"), F.col("name").alias("s")))
    seen, found, hop = front, None, -1
    while True:
        hop += 1
        exact = front.join(via.withColumnRenamed("file_path", "vf"), (F.col("f") == F.col("vf")) & ((F.col("s") == F.col("e")) | ((F.col("e") == "*") & (F.col("s") != "default"))))
        rank = F.when(F.col("e") == "*", 3).when(F.col("source_specifier").isNull(), 0).when(F.col("o") == "*", 2).otherwise(1)
        ranked = exact.withColumn("rank", rank)
        best = ranked.groupBy(*keys, "f", "s").agg(F.min("rank").alias("best"))
        step = cut(ranked.join(best, [*keys, "f", "s"]).where("rank = best"))
        here = step.where("rank in (0, 2)").select(*keys, F.when(F.col("rank") == 2, F.coalesce("target", "f")).otherwise(F.col("f")).alias("origin_file"), F.when(F.col("rank") == 2, "*").otherwise(F.col("o")).alias("origin_name"), F.lit(hop).alias("hop"))
        found = here if found is None else found.union(here)
        onward = step.where("rank in (1, 3) and target is not null").select(*keys, F.col("target").alias("f"), F.when(F.col("rank") == 3, F.col("s")).otherwise(F.col("o")).alias("s")).distinct()
        front = cut(onward.join(seen, [*keys, "f", "s"], "left_anti"))
        if not front.take(1):
            break
        seen = cut(seen.union(front))
    best = found.groupBy(*keys).agg(F.min(F.struct("hop", "origin_file", "origin_name")).alias("b"))
    return start.join(best, keys, "left").select(*keys, F.coalesce("b.origin_file", "file_path").alias("origin_file"), F.coalesce("b.origin_name", "name").alias("origin_name"), F.col("b.hop").alias("hop"))

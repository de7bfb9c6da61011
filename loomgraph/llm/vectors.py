"""Embedding near-dedup by a forest of random-projection trees with spill.

Equal vectors of a label are one class with a weight from the start. Each tree cuts
the classes of a label by random directions at sampled medians; a vector within the
spill margin of a cut goes to both sides. Trees grow in rounds: every cell of more
than ``LEAF`` classes is cut by a subtree fitted on a bounded sample of it (about
``FIT`` vectors, whatever its size), until no cell is larger or cutting it further
would send most of it to both sides. So depth follows the data. Only the places of
vectors (their cells) are kept between rounds; the vectors lie in the shared folder by
node, in the type they came in, and move once, to the leaves. They are compared only
within leaves; a leaf that
stays large is compared in blocks of ``BLOCK``, each pair of blocks a task of its own.

A pair that meets in several leaves is counted in the least of them: each vector
carries its leaves, so that is known without collecting pairs. What leaves a task is
the number of links of each class, weighted by copies, and one link a class that
joins them; never the pairs.

Vectors that are null, zero or hold null or non-finite components, and those whose
label is null, link with nothing. Vectors of different lengths are not compared.
Rows may repeat; each is returned. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import checked, cut, placed, read, spread_join
from .components import connected_components, local_roots

COSINE, TREES = 0.98, 3
LEAF, BLOCK, FIT, DEPTH = 1024, 2048, 4096, 6
SPILL = 1.0  # margin, in standard deviations of a projected difference at the cosine
BOTH = 0.6  # a cut that sends more than this share to both sides isn't made


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors, in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@functools.lru_cache(maxsize=256)
def directions(cell: int, depth: int, dim: int) -> np.ndarray:
    """A unit direction for each inner node of a cell's subtree, in heap order."""
    r = np.random.default_rng([cell & (1 << 64) - 1, dim]).standard_normal((2**depth - 1, dim))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def margin(dim: int, cosine: float = COSINE) -> float:
    return SPILL * float(np.sqrt(2 - 2 * cosine) / np.sqrt(dim))


def fit_cuts(cell: int, x: np.ndarray, depth: int, tau: float) -> list[float]:
    """Medians of the subtree's nodes on a sample; nan where a cut would not part the sample."""
    proj, cuts = x @ directions(cell, depth, x.shape[1]).T, [float("nan")] * (2**depth - 1)
    at = {0: np.arange(len(x))}
    for node in range(2**depth - 1):
        own = at.pop(node, np.empty(0, int))
        p = proj[own, node]
        if len(own) >= 8:
            mid = float(np.median(p))
            left, right = p <= mid + tau, p >= mid - tau
            if (left & right).mean() <= BOTH:
                cuts[node] = mid
                at[2 * node + 1], at[2 * node + 2] = own[left], own[right]
    return cuts


def route(cell: int, x: np.ndarray, cuts: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, end node) for each place that a row comes to in the subtree."""
    depth = (len(cuts) + 1).bit_length() - 1
    proj = x @ directions(cell, depth, x.shape[1]).T
    rows, nodes, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
    for _ in range(depth):
        c = cuts[nodes]
        still = np.isnan(c)
        out.append((rows[still], nodes[still]))
        rows, nodes, c = rows[~still], nodes[~still], c[~still]
        p = proj[rows, nodes]
        left, right = p <= c + tau, p >= c - tau
        rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
    out.append((rows, nodes))
    return np.concatenate([r for r, _ in out]), np.concatenate([n for _, n in out])


_PLACED = "node long, cell long, tree int, was long"
#: Cells whose cuts are broadcast in a round; the cuts of more are joined by shuffle.
CELLS = 20_000


def grow(vecs: DataFrame, places: DataFrame, kind: str, cosine: float = COSINE, leaf: int = LEAF, rounds: int = 40) -> DataFrame:
    """(node, cell): the leaves of each node. vecs: (node, vec), placed by node; places: (node, cell, tree, was), the roots.
    A cell is cut again as long as that makes it smaller; ``rounds`` only bounds a fault."""
    ends = []
    for turn in range(rounds):
        places = cut(places)
        sizes = cut(places.groupBy("cell").agg(F.count("*").alias("n"), F.max("was").alias("was"), F.max("tree").alias("tree")))
        done = (F.col("n") <= leaf) | (F.col("n") > 0.8 * F.col("was"))
        closed = sizes.where(done & (F.col("tree") == 0)) if turn == 0 else sizes.where(done)  # a label that one leaf holds needs one tree
        ends.append(places.join(checked(closed.select("cell")), "cell", "left_semi").select("node", "cell"))
        big = sizes.where(~done).select("cell", F.col("n").alias("size"), F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("n") / (0.6 * leaf)))).cast("int").alias("depth"))
        big = cut(big)
        if not big.take(1):
            return functools.reduce(DataFrame.union, ends)
        chance = F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 20)) < F.lit(FIT * (1 << 20)) / F.col("size")
        sample = spread(places, big).where(chance).select("node", "cell", "depth").join(vecs, "node")

        def fitted(table: pa.Table) -> pa.Table:
            x, cell = _matrix(table.column("vec"), kind), table.column("cell")[0].as_py()
            cuts = fit_cuts(cell, x, table.column("depth")[0].as_py(), margin(x.shape[1], cosine))
            return pa.table({"cell": pa.array([cell], pa.int64()), "cuts": pa.array([cuts], pa.list_(pa.float64()))})

        cuts = sample.select("cell", "depth", "vec").groupBy("cell").applyInArrow(fitted, "cell long, cuts array<double>")
        marked = spread(places, cut(big.join(cuts, "cell").select("cell", "cuts", "size"))).select("node", "cell", "tree", "cuts", "size")

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                cells = x.column(1).to_numpy()
                for cell in np.unique(cells):
                    own = x.take(pa.array(np.flatnonzero(cells == cell)))
                    v = _matrix(own.column(5), kind)
                    rows, leaves = route(int(cell), v, np.array(own.column(3)[0].as_py()), margin(v.shape[1], cosine))
                    with np.errstate(over="ignore"):
                        new = (np.int64(cell) * np.int64(6364136223846793005) + (leaves + 1) * np.int64(1442695040888963407)) ^ (np.int64(cell) >> np.int64(29))
                    yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(rows)), pa.array(new), own.column(2).take(pa.array(rows)), own.column(4).take(pa.array(rows))], ["node", "cell", "tree", "was"])

        places = marked.join(vecs, "node").sortWithinPartitions("cell").select("node", "cell", "tree", "cuts", "size", "vec").mapInArrow(routed, _PLACED)
    raise RuntimeError(f"cells still fall apart after {rounds} rounds")


def spread(places: DataFrame, cells: DataFrame) -> DataFrame:
    """places with what is known of their cells, by broadcast of at most ``CELLS`` of these, else by shuffle, hot cells told apart."""
    return places.join(F.broadcast(cells), "cell") if cells.count() <= CELLS else spread_join(places, cells, "cell")


def compare(i: int, j: int, block: np.ndarray, node: np.ndarray, weight: np.ndarray, x: np.ndarray, lesser: list, cosine: float = COSINE):
    """Links within a leaf (or between blocks i and j of it) that no lesser leaf of theirs has: (nodes, weighted link counts, links u, v)."""
    early: dict[int, int] = {}
    flags = [[early.setdefault(q, len(early)) for q in own] for own in lesser]
    met = np.zeros((len(node), max(1, len(early))), np.float32)
    for r, own in enumerate(flags):
        met[r, own] = 1
    count = np.zeros(len(node), np.int64)
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    for a in range(0, len(node), 512):
        rows = np.arange(a, min(a + 512, len(node)))
        near = x[rows] @ x.T >= cosine
        near &= met[rows] @ met.T == 0
        if i != j:
            near &= block[rows][:, None] != block[None, :]
        near[rows - a, rows] = False
        count[rows] = near @ weight
        p, q = np.nonzero(near)
        keep = rows[p] < q
        if keep.any():
            s, t = local_roots(node[rows[p[keep]]], node[q[keep]])
            u.append(s[s != t])
            v.append(t[s != t])
    none = np.empty(0, np.int64)
    return node, count, np.concatenate(u) if u else none, np.concatenate(v) if v else none


def dedup(df: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    inner = df.schema["embedding"].dataType
    kind = "<f4" if isinstance(inner, ArrayType) and isinstance(inner.elementType, FloatType) else "<f8"
    e = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), "label")
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("e", lambda v: v != 0)
    df = df.withColumn("ok", F.coalesce(F.col("e").isNotNull() & F.col("label").isNotNull() & ~bad, F.lit(False)))
    rows = df.where("ok")
    same = [F.xxhash64("label", "e").alias("k1"), F.xxhash64("e", "label").alias("k2")]  # 128 bits that name a class
    classes = rows.groupBy("label", "e").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    classes = classes.withColumn("node", F.monotonically_increasing_id()).select("node", "weight", "low", F.xxhash64("label", F.size("e")).alias("root_cell"), *same, "e")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for x in batches:
            lists = x.column(6)
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()) * width
            vec = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(lists.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([*x.columns[:6], vec], [*x.schema.names[:6], "vec"])

    classes = placed(classes.mapInArrow(raw, "node long, weight long, low long, root_cell long, k1 long, k2 long, vec binary"), "node")
    vecs, about = classes.select("node", "vec"), classes.drop("vec")
    tree = F.explode(F.array(*(F.lit(t) for t in range(trees)))).alias("tree")
    roots_of = about.select("node", "root_cell", tree).select("node", F.xxhash64("root_cell", "tree").alias("cell"), "tree", F.lit(1 << 62).alias("was"))
    leaves = cut(grow(vecs, roots_of, kind, cosine, leaf))
    blocks = checked(leaves.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    of = leaves.join(blocks, "cell").groupBy("node").agg(F.collect_list(F.struct("cell", "blocks")).alias("leaves"))
    met = classes.select("node", "weight", "vec").join(of, "node").select("node", "weight", "vec", "leaves", F.explode("leaves").alias("own"))
    met = met.select(F.col("own.cell").alias("cell"), F.pmod(F.xxhash64("node"), F.col("own.blocks")).cast("int").alias("b"), "node", "weight", "vec", F.transform(F.filter("leaves", lambda q: q["cell"] < F.col("own.cell")), lambda q: q["cell"]).alias("early"), F.explode(F.sequence(F.lit(0), F.col("own.blocks") - 1)).alias("o"))
    met = met.select("cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "weight", "vec", "early")

    def compared(table: pa.Table) -> pa.Table:
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        node, count, u, v = compare(i, j, table.column("b").to_numpy(), table.column("node").to_numpy(), table.column("weight").to_numpy(), _matrix(table.column("vec").combine_chunks(), kind), table.column("early").to_pylist(), cosine)
        some = count > 0
        return pa.table({"node": np.concatenate([node[some], u]), "links": np.concatenate([count[some], np.zeros(len(u), np.int64)]), "other": pa.array([None] * int(some.sum()) + v.tolist(), pa.int64())})

    found = cut(met.groupBy("cell", "i", "j").applyInArrow(compared, "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other is not null").select("node", "other"))
    known = cut(about.join(links, "node", "left").join(roots, "node", "left").select("k1", "k2", "low", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = spread_join(known, least, "root").select("k1", "k2", "n_links", "component_id")
    met_again = spread_join(rows.select("vec_id", *same), known.withColumnRenamed("k2", "_k2"), "k1").where("k2 = _k2")
    linked = met_again.select("vec_id", "n_links", "component_id")
    alone = df.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.other)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT node AS vec_id, min(other) AS c FROM r GROUP BY node) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a) USING (vec_id)
"""

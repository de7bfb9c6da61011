"""Connected components of a link table, by alternating large and small stars until the links left are few enough for a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, given_back, spread_join

#: Links, counted first, that one task joins.
FEW = 500_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node each of them reaches."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        x, y = x[apart], y[apart]


def _joined(links: DataFrame) -> DataFrame:
    """(node, root) of few links (u, v; made of files), found by one task and written, so that a caller's stage has no Python of this one."""

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if got:
            nodes, roots = local_roots(*map(np.concatenate, zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return cut(links.coalesce(1).mapInArrow(run, "node long, root long"))


def connected_components(links: DataFrame, rounds: int = 60, few: int | None = None) -> DataFrame:
    """(node, root) for each node of ``links`` (two long columns): root is the
    smallest node reachable. Nulls and self-links are ignored, repeated links count
    once; a table without links gives no rows. Callers contract what they find in a
    task by `local_roots`, so the rounds only join what tasks share; every round is
    checkpointed, and a hub of many links is not joined in one task. At most ``few`` links (``FEW`` unless given), at first or after
    a round, are joined by one task: a round keeps all nodes and what joins them. The rounds run no Python: it would sit in one stage with the
    caller's, and each executor would keep twice the workers.
    """
    few = FEW if few is None else few
    a, b = links.columns[:2]
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(e.distinct())
    if e.count() <= few:
        return _joined(e)
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return e.toDF("node", "root").union(roots)
        if now[0] <= few:
            return _joined(e)
        seen = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")

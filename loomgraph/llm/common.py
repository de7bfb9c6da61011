"""What the operators of this subpackage share: input, sizes, cut lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: with texts of some kilobytes, a few MB.
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and the master is local."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: what follows reads the files, however often tasks are run again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by key and written once; joins by this key deal only their other side. (A plan that adapts
    doesn't tell how its rows lie, so this one doesn't.) Rows that come out of a shuffle are written before they are
    dealt: in another order, as after a lost executor, they could get other numbers."""
    spark = df.sparkSession
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = cut(df)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(partitions(spark), key))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def given_back(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run (for mapInArrow), whose freed memory goes back to the system when its task ends. Workers stay for later tasks
    and stages: what their allocators keep of the largest task adds to what the JVM beside them takes."""

    @wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return held


def runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Rows that agree in their first ``keys`` columns, as tables, from batches sorted by these; only one such run is held."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        if not x.num_rows:
            continue
        differs = np.zeros(x.num_rows, bool)
        for k in range(keys):
            c = x.column(k).to_numpy(zero_copy_only=False)
            differs[1:] |= c[1:] != c[:-1]
            if held:
                differs[0] |= held[-1].column(k)[-1].as_py() != c[0]
        edges = np.flatnonzero(differs).tolist()
        start = 0
        for e in edges:
            if e > start:
                held.append(x.slice(start, e - start))
            yield pa.Table.from_batches(held)
            held, start = [], e
        held.append(x.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right, which has one row a key. Keys that hold more rows of left than a task's fair share
    are told apart first: they are fewer than 4 a partition, so their rows of right are broadcast, and a hot
    key is never dealt to one task. left should be made of files."""
    sizes = left.groupBy(key).count()
    most, n = sizes.agg(F.max("count"), F.sum("count")).first()
    share = max(1000, (n or 0) // (4 * partitions(left.sparkSession)))
    if (most or 0) <= share:
        return left.join(right, key)
    few = F.broadcast(cut(sizes.where(F.col("count") > share).select(key)))
    return left.join(F.broadcast(right.join(few, key, "left_semi")), key).unionByName(left.join(few, key, "left_anti").join(right, key))


def checked(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, written once, and broadcast where it is joined if it has no more than ``most`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def graded_join(left: DataFrame, right: DataFrame, keys: list[str], weight: Column, most: int) -> DataFrame:
    """left with the columns of right, which has one row a key, or nulls. The ``most`` rows of right of greatest weight
    (rows of left they meet) are broadcast, all of them if there are no more; else what they don't meet is joined by shuffle."""
    right = cut(right)
    if right.count() <= most:
        return left.join(F.broadcast(right), keys, "left")
    top = cut(right.orderBy(weight.desc(), *keys).limit(most))
    rest = right.join(F.broadcast(top.select(*keys)), keys, "left_anti")
    cold = left.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(rest, keys, "left")
    return left.join(F.broadcast(top), keys).unionByName(cold)

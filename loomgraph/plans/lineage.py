"""Cutting lineage: results of a round go to files that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


@contextmanager
def fixed(spark: SparkSession, tasks: int) -> Iterator[None]:
    """What is planned in here shuffles to this many tasks and does not adapt: such a plan tells how its rows lie, so
    what is dealt by a key and written is not dealt again where it is joined by that key."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(tasks)}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def checked(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, written once, and broadcast where it is joined if it has no more than ``most`` rows; else the planner decides."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df

"""Incremental analysis: what changed between snapshots, facts reused, and a watched folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import graph


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, change, old_sha256, new_sha256): added, changed or deleted files of two snapshots (file_path, sha256)."""
    o, n = old.select("file_path", F.col("sha256").alias("old_sha256"), F.lit(True).alias("o")), new.select("file_path", F.col("sha256").alias("new_sha256"), F.lit(True).alias("n"))
    j = o.join(n, "file_path", "full").where("o is null or n is null or not (old_sha256 <=> new_sha256)")
    return j.select("file_path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("changed").alias("change"), "old_sha256", "new_sha256")


def refreshed(stored: DataFrame, files: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored facts of files that are as they were, and parsed ones of the rest. Facts carry file_path and sha256."""
    keys = ["file_path", "sha256"]
    kept = stored.join(files.select(*keys), keys, "left_semi")
    misses = files.join(stored.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(parse(misses))


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, hops): changed files and all that depend on them."""
    return graph.reachable(graph.transpose(edges), changed.select("file_path"))


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("file_path", S.sha256(F.col("content")).alias("sha256"))


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, schema: str = "file_path string, sha256 string") -> DataFrame:
    """The stored snapshot, empty before the first run."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(conf).exists(at) else spark.createDataFrame([], schema)


def _epochs(spark: SparkSession, state: str) -> list[int]:
    """Epochs whose snapshot is whole, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(state)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{state}/{n}/snapshot/_SUCCESS")))


def current(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """The snapshot of the last whole epoch (before one, if given), empty if there is none."""
    done = [e for e in _epochs(spark, state) if before is None or e < before]
    return load(spark, f"{state}/{done[-1] if done else 'none'}/snapshot")


def watch(spark: SparkSession, folder: str, state: str, on_change: Callable[..., None], checkpoint: str, edges: Callable[[], DataFrame] | None = None):
    """A streaming query over a folder of fact files (Parquet: file_path, content; null content: the file is gone).
    Every batch is compared with the snapshot before it. The new snapshot goes to a folder of its epoch, which counts
    once it is whole, so a failure at any point leaves the old one; then the changes are handed on, from files, with
    the files they affect by ``edges`` (src, dst), if given. A batch that is run again does the same once more: changes
    are handed on once, but for a failure after which nobody can tell whether they were."""
    stream = spark.readStream.schema("file_path string, content string").option("maxFilesPerTrigger", 1000).parquet(folder)

    def batch(df: DataFrame, epoch: int) -> None:
        session = df.sparkSession
        told = df.groupBy("file_path").agg(F.max("content").alias("content"))
        gone, new = told.where("content is null").select("file_path"), snapshot(told.where("content is not null"))
        old = current(session, state, epoch)
        met = old.join(told.select("file_path"), "file_path", "left_semi")
        changes(met, new).write.mode("overwrite").parquet(f"{state}/{epoch}/moved")
        old.join(told.select("file_path"), "file_path", "left_anti").unionByName(new).join(gone, "file_path", "left_anti").write.mode("overwrite").parquet(f"{state}/{epoch}/snapshot")
        moved = session.read.parquet(f"{state}/{epoch}/moved")
        if moved.take(1):
            on_change(moved, affected(moved, edges())) if edges else on_change(moved)
        _forget(session, state, epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, state: str, epoch: int, keep: int = 2) -> None:
    """Epochs before the last few go."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for old in [e for e in _epochs(spark, state) if e < epoch][:-keep]:
        at = jvm.org.apache.hadoop.fs.Path(f"{state}/{old}")
        at.getFileSystem(conf).delete(at, True)

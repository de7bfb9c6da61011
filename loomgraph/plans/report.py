"""Reports: findings of one shape, and the graph page's node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut

FINDING = ["kind", "severity", "file_path", "symbol", "package", "manifest_path", "line", "message"]


def surrogate_ids(nodes: DataFrame, name: str) -> DataFrame:
    """(name, id): ids from 1 in order of distinct nodes. Ranges are ranked by themselves and shifted by the counts of the
    ranges before, so no single task sorts everything."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(nodes.select(name).repartitionByRange(n, name).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("c"))
    base = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    own = parts.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(name)))
    return own.join(F.broadcast(base.select("part", "base")), "part").select(name, (F.col("base") + F.col("nth")).alias("id"))


def finding(df: DataFrame, kind: str, severity: str, message, **columns) -> DataFrame:
    """df as findings; columns give the named fields, the others are null."""
    kinds = {"line": "int"}
    fields = {f: columns.get(f, F.lit(None)) for f in FINDING if f not in ("kind", "severity", "message")}
    return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), *(c.cast(kinds.get(f, "string")).alias(f) for f, c in fields.items()), message.cast("string").alias("message")).select(*FINDING)


def graph_json(edges: DataFrame) -> DataFrame:
    """One JSON text a node: {"id", "name", "targets"}, for a page that draws the graph."""
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    ids = cut(surrogate_ids(names, "name"))
    out = edges.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").groupBy("s").agg(F.array_sort(F.collect_set("d")).alias("targets"))
    joined = ids.join(out, F.col("id") == F.col("s"), "left")
    return joined.select("id", F.to_json(F.struct("id", "name", F.coalesce("targets", F.array().cast("array<long>")).alias("targets"))).alias("json"))


def edit_plan(dead: DataFrame) -> DataFrame:
    """(file_path, start, end, replacement, name): the text of each dead symbol, last first, so that edits don't move those
    that follow; nothing is written."""
    return dead.where("start is not null").select("file_path", "start", "end", F.lit("").alias("replacement"), "name").orderBy("file_path", F.desc("start"))


def summary(seconds: float, scanned: int, hits: int) -> list[str]:
    """Lines that sum a run up: how long it took, what it read, how much of it came from the store."""
    share = f"{100 * hits / scanned:.1f}%" if scanned else "0.0%"
    return [f"duration: {seconds:.2f} s", f"files scanned: {scanned}", f"taken from the store: {share}"]

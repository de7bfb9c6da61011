"""A session over one tree: analysis with progress, impact of a change, safety of a cut, planned edits.

Events are told by name to those who listen, in order: ``initialize``, then ``<stage>:start``
and ``<stage>:complete`` (with the number of rows) of each stage of `STAGES`, then
``analysis:complete``; ``error`` with the stage that failed. Nothing of the tree is written.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph, rules
from loomgraph.plans import report
from loomgraph.plans.analysis import Analysis
from loomgraph.plans.lineage import cut
from loomgraph.streaming import incremental

#: Parts of an analysis in the order they are made.
STAGES = ["files", "facts", "packages", "active_plugins", "resolved", "edges", "entry_points", "reached"]


class Session:
    def __init__(self, spark: SparkSession, root: str, state: str | None = None, **options):
        """``state`` is a folder of snapshots: what it holds tells which files are as they were."""
        self.spark, self.root, self.state, self.options = spark, root, state, options
        self.listeners: dict[str, list[Callable]] = {}
        self.analysis: Analysis | None = None
        self.findings: DataFrame | None = None
        self.processing, self.seconds = False, 0.0

    def on(self, event: str, listener: Callable) -> None:
        """``*`` listens to all; a listener gets the event's name and its fields."""
        self.listeners.setdefault(event, []).append(listener)

    def _tell(self, event: str, **fields) -> None:
        for listener in (*self.listeners.get(event, ()), *self.listeners.get("*", ())):
            listener(event, fields)

    def analyze(self) -> DataFrame:
        """All findings, written once."""
        began, stage = time.time(), "initialize"
        self.processing = True
        try:
            self.analysis = Analysis(self.spark, self.root, **self.options)
            self._tell("initialize", root=self.root)
            for done, stage in enumerate(STAGES):
                self._tell(f"{stage}:start", percentage=round(100 * done / len(STAGES)))
                rows = getattr(self.analysis, stage).count()
                self._tell(f"{stage}:complete", rows=rows, percentage=round(100 * (done + 1) / len(STAGES)))
            stage = "findings"
            self.findings = cut(self.analysis.findings())
            self.seconds = time.time() - began
            self._tell("analysis:complete", findings=self.findings.count(), seconds=self.seconds)
            return self.findings
        except Exception as e:
            self._tell("error", stage=stage, error=e)
            raise
        finally:
            self.processing = False

    def _done(self) -> Analysis:
        if self.analysis is None:
            raise RuntimeError("nothing is analysed yet: call analyze() first")
        return self.analysis

    # --- what a change would do

    def impact(self, file_path: str, symbol: str | None = None) -> DataFrame:
        """(kind, name, hops, note) for one file: its dependents and dependencies, all that depends on it with the risk,
        its exports (or the symbol), the packages it uses, and for a symbol what blocks a cut (none: safe)."""
        a = self._done()
        if not a.source_files.where(F.col("file_path") == file_path).take(1):
            raise ValueError(f"no source file {file_path}")
        none, zero = F.lit(None).cast("string"), F.lit(None).cast("int")
        out = graph.neighbours(a.edges, file_path).select(F.col("role").alias("kind"), F.col("node").alias("name"), zero.alias("hops"), none.alias("note"))
        changed = self.spark.createDataFrame([(file_path,)], "file_path string")
        out = out.union(graph.blast_radius(a.edges, changed).where("hops > 0").select(F.lit("affected"), "node", "hops", "risk"))
        own = a.exports.where(F.col("file_path") == file_path)
        own = own if symbol is None else own.where(F.col("name") == symbol)
        out = out.union(own.select(F.lit("export"), "name", zero, "export_type"))
        out = out.union(a.package_usage.where(F.col("file_path") == file_path).select(F.lit("package"), "package", zero, none))
        if symbol is not None:
            blocked = self.safety(own.select("file_path", "name")).select(F.when(F.col("reason").isNull(), "safe").otherwise("blocked"), "name", zero, "reason")
            out = out.union(blocked)
        return out

    def safety(self, symbols: DataFrame) -> DataFrame:
        """(file_path, name, reason) of symbols: used by a file, or named where code can't be followed; a null reason is safe."""
        a = self._done()
        s = symbols.select("file_path", "name").distinct()
        used = s.join(a.uses, ["file_path", "name"], "left_semi").withColumn("reason", F.lit("used by another file"))
        named = rules.prune_blockers(s, a.view("string_ref"), a.view("chain"), a.metadata, ["default", "main", "module", "exports"])
        why = used.withColumn("p", F.lit(0)).unionByName(named.withColumn("p", F.lit(1))).groupBy("file_path", "name").agg(F.min_by("reason", "p").alias("reason"))
        return s.join(why, ["file_path", "name"], "left")

    def plan(self, files: bool = True, exports: bool = True, dependencies: bool = True) -> DataFrame:
        """(action, file_path, start, end, name): files, exports and dependencies that would go. Exports that something blocks stay."""
        a = self._done()
        none, nothing = F.lit(None).cast("int"), F.lit(None).cast("string")
        parts = []
        if files:
            parts.append(a.orphan_files.select(F.lit("delete-file").alias("action"), "file_path", none.alias("start"), none.alias("end"), nothing.alias("name")))
        if exports:
            parts.append(a.edit_plan.select(F.lit("remove-export").alias("action"), "file_path", "start", "end", "name"))
        if dependencies:
            parts.append(a.unused_dependencies.select(F.lit("remove-dependency").alias("action"), F.col("manifest_path").alias("file_path"), none.alias("start"), none.alias("end"), F.col("package").alias("name")))
        if not parts:
            return self.spark.createDataFrame([], "action string, file_path string, start int, end int, name string")
        return rules.united(*parts)

    # --- about the run

    def metrics(self) -> dict[str, int]:
        """Files scanned, those that the stored snapshot has as they are, and the rest."""
        now = self._done().files.select("file_path", "sha256")
        old = incremental.current(self.spark, self.state) if self.state else now.limit(0)
        hit = old.select("file_path", "sha256", F.lit(True).alias("hit"))
        return rules.metrics(now.join(hit, ["file_path", "sha256"], "left"), F.col("hit")).first().asDict()

    def summary(self) -> list[str]:
        m = self.metrics()
        return report.summary(self.seconds, m["scanned"], m["hits"])

    def plugins(self) -> list[str]:
        return self._done().rules.names()

    def results(self) -> DataFrame | None:
        return self.findings

    def is_processing(self) -> bool:
        return self.processing

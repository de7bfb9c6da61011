"""Source trees as tables: files, and the facts extracted from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.plans.lineage import cut
from loomgraph.sources import extract

SOURCE = r"\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|vue|svelte)$"
SKIPPED = r"(^|/)(node_modules|\.git|\.cache|dist|coverage)/"
# fixed values: hidden folders and files that tools use
HIDDEN = [".github/workflows", ".vitepress", ".storybook", ".*rc.{js,cjs,mjs,json,yml,yaml}"]
GLOB = "*.{ts,tsx,js,jsx,mjs,cjs,mts,cts,vue,svelte,json,json5,html,yaml,yml}"

#: Facts that go on together.
BATCH = 5000

_MEMBER = "array<struct<name:string,type:string,is_public:boolean,start:int,end:int>>"
#: Fields of each kind of fact.
SCHEMAS = {
    "import": "specifier string, kind string",
    "import_symbol": "specifier string, imported_name string, local_name string",
    "export": f"name string, export_type string, source_specifier string, original_name string, start int, end int, line int, column int, members {_MEMBER}",
    "identifier": "name string",
    "chain": "chain string, parts array<string>",
    "string_ref": "value string",
    "token": "token_kind string, name string",
    "dynamic_import": "specifier string, pattern string, dir_prefix string, is_literal boolean",
    "suppression": "rule string, symbol string",
    "node": "node_type string, pre int, post int, attrs map<string,string>",
    "source": "n_statements int, has_side_effects boolean",
    "template": "template_kind string, name string, value string",
    "shape": "callee_object string, callee string, shape string, pre int",
    "write": "name string, type string, pre int",
    "access": "name string, kind string, pre int",
    "body": "name string, shape string, n_tokens int, pre int",
    "failed": "error string",
}


def files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, sha256, content) of the texts below root. File names are filtered while listing; folders that are
    skipped are filtered after, so what they hold under those names is read, but goes no further than the scan. Spark
    lists no hidden names, so the hidden folders and files that tools use are looked for by name, three levels deep."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load([root, *_hidden(spark, root)])
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    strip = F.regexp_replace(S.normal_path(F.regexp_replace("path", "^file:/+", "file:/")), "^" + base.rstrip("/").replace("file:///", "file:/").replace(".", r"\.") + "/", "")
    named = found.where(~F.col("path").rlike(SKIPPED)).select(strip.alias("file_path"), "content")  # a listing names a path once
    return named.select("file_path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))


def _hidden(spark: SparkSession, root: str) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for up in ("", "*/", "*/*/"):
        for name in HIDDEN:
            at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{up}{name}")
            out += [s.getPath().toString() for s in at.getFileSystem(conf).globStatus(at) or []]
    return [p for p in out if "node_modules/" not in p]


def sources(found: DataFrame) -> DataFrame:
    return found.where(F.col("file_path").rlike(SOURCE))


def facts(found: DataFrame, *kinds: str) -> DataFrame:
    """(file_path, kind, fact) of source files, parsed once; ``kinds``: those to keep, else all. Parsing takes so much longer
    than reading that files are dealt out first: few bytes of input are few tasks, however many files they make."""
    wanted = frozenset(kinds) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, str]] = []
        for x in batches:
            for path, code in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                rows += [(path, k, v) for k, v in extract.rows(path, code, wanted)]
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(sources(found).select("file_path", "content").repartition(n, "file_path").mapInArrow(run, "file_path string, kind string, fact string"))


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["file_path", "kind", "fact"])


def view(all_facts: DataFrame, kind: str) -> DataFrame:
    """The facts of one kind, with its fields as columns."""
    return all_facts.where(F.col("kind") == kind).select("file_path", F.from_json("fact", SCHEMAS[kind]).alias("f")).select("file_path", "f.*")


def metadata(found: DataFrame) -> DataFrame:
    return found.where(F.col("file_path").rlike(r"\.(json5?|html|ya?ml)$"))


def workflows(found: DataFrame) -> DataFrame:
    """(file_path, script) of the run lines of CI workflows."""
    w = found.where(F.col("file_path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    return w.select("file_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*-?\s*run:\s*(?:\|\s*\n)?\s*([^\n]+)"), 1)).alias("script"))

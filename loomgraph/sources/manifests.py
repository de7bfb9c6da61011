"""Manifests, workspace patterns and configuration files as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.plans.lineage import checked, cut

SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
_MAPS = ", ".join(f"{s} map<string,string>" for s in SECTIONS)


def dependencies(manifests: DataFrame) -> DataFrame:
    """(manifest_path, package, version, dep_kind) of each section's entries; malformed manifests give none."""
    parsed = manifests.select("manifest_path", F.from_json("content", _MAPS).alias("m"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("dep_kind"), F.col(f"m.{s}").alias("d")) for s in SECTIONS))).alias("s")
    return parsed.select("manifest_path", each).select("manifest_path", "s.dep_kind", F.explode("s.d").alias("package", "version")).select("manifest_path", "package", "version", "dep_kind")


def leaves(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """(keys, path, value) of the string and number leaves of JSON texts of any nesting, by exploding variants until only
    leaves are left; each level is written once and explodes the one before."""
    live = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    out, cols = None, ", ".join(f"t.{k}" for k in keys)
    while True:
        live = cut(live.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^(OBJECT|ARRAY|VOID)", 1)))
        leaf = live.where("kind = ''").select(*keys, "path", F.variant_get("v", "$", "string").alias("value"))
        out = leaf if out is None else out.union(leaf)
        inner = live.where("kind in ('OBJECT', 'ARRAY')")
        if not inner.take(1):
            return out
        live = df.sparkSession.sql(f"SELECT {cols}, concat(t.path, coalesce(concat('.', x.key), concat('[', x.pos, ']'))) AS path, x.value AS v FROM {{level}} t, LATERAL variant_explode(t.v) AS x", level=inner)


def packages(manifests: DataFrame) -> DataFrame:
    """(root_dir, manifest_path, name, version, scripts, entry_points, workspaces) of manifests (manifest_path, content)."""
    fields = "name string, version string, main string, module string, source string, types string, typings string, scripts map<string,string>, workspaces string, bin string, exports string"
    p = manifests.select("manifest_path", S.dirname(F.col("manifest_path")).alias("root_dir"), F.from_json("content", fields).alias("m"), "content")
    plain = p.select("manifest_path", F.explode(F.array_compact(F.array("m.main", "m.module", "m.source", "m.types", "m.typings"))).alias("e"))
    deep = leaves(p.select("manifest_path", F.to_json(F.struct(F.get_json_object("content", "$.exports").alias("e"))).alias("j")).select("manifest_path", F.get_json_object("j", "$.e").alias("j")), "j", ["manifest_path"]).select("manifest_path", F.col("value").alias("e"))
    text = p.select("manifest_path", F.explode(F.array_compact(F.array("m.exports", "m.bin"))).alias("e")).where("not startswith(e, '{') and not startswith(e, '[')")
    bins = p.select("manifest_path", F.explode(F.map_values(F.from_json("m.bin", "map<string,string>"))).alias("e"))
    every = plain.union(deep).union(text).union(bins).where("e is not null and not startswith(e, '{')").select("manifest_path", F.regexp_replace("e", r"^\./", "").alias("e")).distinct()
    grouped = every.groupBy("manifest_path").agg(F.array_sort(F.collect_set("e")).alias("entry_points"))
    # fixed values: entry files of packages that name none
    fallback = F.array(*map(F.lit, ["index.ts", "src/index.ts", "index.js", "src/index.js", "src/main.ts"]))
    return p.join(grouped, "manifest_path", "left").select("root_dir", "manifest_path", "m.name", "m.version", "m.scripts", F.coalesce("entry_points", fallback).alias("entry_points"), "m.workspaces")


def workspace_yaml(files: DataFrame) -> DataFrame:
    """(path, pattern) of ``packages:`` in workspace YAML files, as a block of items or an inline list."""
    body = F.regexp_extract("content", r"(?ms)^packages:[ \t]*((?:\[[^\]]*\])|(?:\n(?:[ \t]*-[^\n]*|[ \t]*#[^\n]*|[ \t]*)(?=\n|\z))+)", 1)
    item = F.explode(F.regexp_extract_all(body, F.lit(r"""(?m)(?:^[ \t]*-[ \t]*|[\[,]\s*)["']?([^"'\s,\[\]#]+)["']?"""), 1))
    return files.select("path", item.alias("pattern"))


def workspace_patterns(files: DataFrame) -> DataFrame:
    """(pattern, origin, priority) of all sources of workspace patterns among files (path, content)."""
    yaml = files.where("path in ('pnpm-workspace.yaml', 'workspace.yaml')")
    of_yaml = workspace_yaml(yaml).select("pattern", F.col("path").alias("origin"), F.when(F.col("path") == "pnpm-workspace.yaml", 0).otherwise(3).alias("priority"))
    lists = files.where("path in ('package.json', 'lerna.json')")
    listed = F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("content", "$.workspaces.packages"), "array<string>"), F.from_json(F.get_json_object("content", "$.packages"), "array<string>"))
    of_json = lists.select(F.explode(listed).alias("pattern"), F.col("path").alias("origin"), F.when(F.col("path") == "package.json", 1).otherwise(2).alias("priority"))
    return of_yaml.union(of_json)


def by_precedence(df: DataFrame, keys: list[str], priority: str = "priority") -> DataFrame:
    """Rows of the first source of each key that has any."""
    least = df.groupBy(*keys).agg(F.min(priority).alias("_least")) if keys else df.agg(F.min(priority).alias("_least"))
    joined = df.join(least, keys) if keys else df.crossJoin(F.broadcast(least))  # one row
    return joined.where(F.col(priority) == F.col("_least")).drop("_least")


def expand_globs(patterns: DataFrame, dirs: DataFrame) -> DataFrame:
    """(pattern, dir): directories that a pattern names. A star stands for one level, hidden directories for none. Patterns are few."""
    p = checked(patterns.select("pattern", S.glob_regex(F.regexp_replace("pattern", r"/\*\*$", "/*")).alias("regex")))
    return dirs.where(~F.col("dir").rlike(r"(^|/)\.")).join(p, F.expr("dir rlike regex")).select("pattern", "dir")


def tsconfig_aliases(files: DataFrame) -> DataFrame:
    """(scope_dir, pattern, target, kind, pos) of ``paths`` in tsconfig files (path, content), below their ``baseUrl``."""
    c = S.strip_comments(F.col("content"))
    parsed = files.where("path rlike '(^|/)tsconfig[^/]*\\\\.json$'").select(S.dirname(F.col("path")).alias("scope_dir"), F.from_json(c, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>").alias("o"))
    each = parsed.select("scope_dir", F.coalesce("o.compilerOptions.baseUrl", F.lit(".")).alias("base"), F.posexplode("o.compilerOptions.paths").alias("p", "pattern", "targets"))
    t = each.select("scope_dir", "base", "p", "pattern", F.posexplode("targets").alias("q", "t"))
    return t.select("scope_dir", "pattern", S.join_path(F.col("base"), F.col("t")).alias("target"), F.lit("paths").alias("kind"), (F.col("p") * 100 + F.col("q")).alias("pos"))


def extends_chain(files: DataFrame, depth: int = 10) -> DataFrame:
    """(path, base, hop): what a tsconfig extends, directly and on, ten hops at most."""
    c = S.strip_comments(F.col("content"))
    one = files.select("path", F.get_json_object(c, "$.extends").alias("e")).where("startswith(e, '.')")
    one = one.select("path", S.join_path(S.dirname(F.col("path")), F.when(F.col("e").endswith(".json"), F.col("e")).otherwise(F.concat("e", F.lit(".json")))).alias("base"))
    one = cut(one)
    step = out = one.withColumn("hop", F.lit(1))
    for hop in range(2, depth + 1):
        step = cut(step.select("path", F.col("base").alias("mid")).join(one.select(F.col("path").alias("mid"), "base"), "mid").select("path", "base", F.lit(hop).alias("hop")))
        if not step.take(1):
            break
        out = out.union(step)
    return out


def include_exclude(files: DataFrame) -> DataFrame:
    """(path, scope_dir, kind, pattern) of ``include`` and ``exclude`` in tsconfig files (path, content)."""
    c = S.strip_comments(F.col("content"))
    lists = F.from_json(c, "include array<string>, exclude array<string>")
    none = F.array().cast("array<string>")

    def marked(kind: str) -> Column:
        return F.transform(F.coalesce(F.col("lists")[kind], none), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))

    parsed = files.select("path", S.dirname(F.col("path")).alias("scope_dir"), lists.alias("lists"))
    return parsed.select("path", "scope_dir", F.explode(F.concat(marked("include"), marked("exclude"))).alias("e")).select("path", "scope_dir", "e.kind", "e.pattern")


def project_files(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, file_path): files below a tsconfig that its patterns (`include_exclude`) take in and none of them keeps out;
    without includes everything below. Files meet patterns by ancestor directory."""
    regex = S.glob_regex(F.regexp_replace(F.regexp_replace("pattern", r"^\./", ""), r"(^|/)([^/*.]+)$", "$1$2/**"))
    rules = patterns.select("path", "scope_dir", "kind", regex.alias("regex"))
    below = files.select("file_path", F.explode(S.ancestors(F.col("file_path"))).alias("scope_dir"))
    own = below.join(patterns.select("path", "scope_dir").distinct(), "scope_dir").withColumn("rest", S.relative_to(F.col("file_path"), F.col("scope_dir")))
    hit = own.join(rules, ["path", "scope_dir"]).where(F.expr("rest rlike regex")).select("path", "file_path", "kind").distinct()
    open_ = patterns.groupBy("path").agg(F.max(F.col("kind") == "include").alias("listed")).where("not listed").select("path")
    taken = hit.where("kind = 'include'").select("path", "file_path").union(own.join(open_, "path", "left_semi").select("path", "file_path")).distinct()
    return taken.join(hit.where("kind = 'exclude'").select("path", "file_path"), ["path", "file_path"], "left_anti")


def framework_configs(files: DataFrame) -> DataFrame:
    """(path, content) of framework configuration files, among files (file_path, content)."""
    return files.where(r"file_path rlike '\\.config\\.(ts|js|mjs|cjs)$'").select(F.col("file_path").alias("path"), "content")


def package_directories(files: DataFrame) -> DataFrame:
    """(root_dir, kind, file_path): the manifest, tsconfig files and configuration files that lie in a package's directory itself."""
    base, root = S.basename(F.col("file_path")), S.dirname(F.col("file_path"))
    kind = F.when(base == "package.json", "manifest").when(base.rlike(r"^(tsconfig|jsconfig)[^/]*\.json$"), "tsconfig").when(base.rlike(r"\.config\.(ts|js|mjs|cjs|json)$"), "config")
    found = files.select(root.alias("root_dir"), kind.alias("kind"), "file_path").where("kind is not null")
    return found.join(found.where("kind = 'manifest'").select("root_dir").distinct(), "root_dir", "left_semi")


def monorepo_configs(files: DataFrame) -> DataFrame:
    """(file_name, path, value): leaves of the task runners' configuration in the root, files (file_path, content)."""
    # fixed values: names of these files
    top = files.where(F.col("file_path").isin("turbo.json", "nx.json")).select(F.col("file_path").alias("file_name"), S.strip_comments(F.col("content")).alias("json"))
    return leaves(top, "json", ["file_name"])


def project_references(files: DataFrame) -> DataFrame:
    """(path, reference) of ``references`` in tsconfig files."""
    refs = F.from_json(F.get_json_object(S.strip_comments(F.col("content")), "$.references"), "array<struct<path:string>>")
    return files.select("path", F.explode(refs).alias("r")).select("path", S.join_path(S.dirname(F.col("path")), F.col("r.path")).alias("reference"))


def config_facts(files: DataFrame) -> DataFrame:
    """(path, kind, name, value) of framework configuration: aliases (object and array form) and entries, by pattern."""
    body = F.regexp_extract("content", r"(?s)\balias\s*:\s*(\{.*?\}|\[.*?\])", 1)
    pair = r"""["']?([@\w$/.*~-]+)["']?\s*:\s*(?:path\.resolve\([^)]*?["']([^"']+)["']\s*\)|["']([^"']+)["'])"""
    found = r"""find\s*:\s*["']([^"']+)["']\s*,\s*replacement\s*:\s*["']([^"']+)["']"""
    value = lambda g: F.regexp_extract_all(body, F.lit(pair), g)
    both = F.arrays_zip(value(1).alias("n"), value(2).alias("a"), value(3).alias("b"))
    objects = files.where(body.startswith("{")).select("path", F.explode(both).alias("z")).select("path", F.lit("alias").alias("kind"), F.col("z.n").alias("name"), F.when(F.col("z.a") != "", F.col("z.a")).otherwise(F.col("z.b")).alias("value"))
    arrays = files.where(body.startswith("[")).select("path", F.explode(F.arrays_zip(F.regexp_extract_all(body, F.lit(found), 1).alias("n"), F.regexp_extract_all(body, F.lit(found), 2).alias("v"))).alias("z")).select("path", F.lit("alias").alias("kind"), F.col("z.n").alias("name"), F.col("z.v").alias("value"))
    entry = F.regexp_extract("content", r"""(?s)\b(?:entry|input)\s*:\s*(\{.*?\}|\[.*?\]|["'][^"']+["'])""", 1)
    entries = files.select("path", F.explode(F.regexp_extract_all(entry, F.lit(r"""["'](\.{0,2}/?[\w./-]+\.[\w]+)["']"""), 1)).alias("value")).select("path", F.lit("entry").alias("kind"), F.lit(None).cast("string").alias("name"), "value")
    return objects.union(arrays).union(entries)


def config_templates(active: DataFrame, config_files: DataFrame, files: DataFrame, templates: DataFrame) -> DataFrame:
    """(plugin, file_name, template) of active plugins of which no configuration exists."""
    there = config_files.join(files.select(F.explode(S.tail_names(F.col("file_path"))).alias("file_name")).distinct(), "file_name", "left_semi").select("plugin").distinct()
    return active.join(there, "plugin", "left_anti").join(templates, "plugin").select("plugin", "file_name", "template")


def manifest_text(deps: DataFrame) -> DataFrame:
    """(manifest_path, json): a manifest's sections with their packages in order."""
    per = deps.groupBy("manifest_path", "dep_kind").agg(F.array_sort(F.collect_set(F.struct("package", "version"))).alias("e"))
    section = per.select("manifest_path", F.struct("dep_kind", F.to_json(F.map_from_entries("e")).alias("j")).alias("s"))
    one = section.groupBy("manifest_path").agg(F.array_sort(F.collect_list("s")).alias("ss"))
    return one.select("manifest_path", F.concat(F.lit("{"), F.array_join(F.transform("ss", lambda s: F.concat(F.lit('"'), s["dep_kind"], F.lit('":'), s["j"])), ","), F.lit("}")).alias("json"))


def layered_config(files: DataFrame, name: str, overrides: dict | None = None, defaults: dict | None = None) -> dict:
    """Configuration of a tool ``name`` from a tree's files (file_path, content): defaults, ``name``/config.json, the
    manifest's key ``name``, the workspace, what is given. Configuration that is code is never run. Files that are
    missing or malformed say nothing; at most two are read to the driver."""
    bare = F.when(F.col("file_path") == "package.json", F.col("content")).otherwise(S.strip_comments(F.col("content")))
    text = {r.file_path: r.json for r in files.where(F.col("file_path").isin(f"{name}/config.json", "package.json")).select("file_path", bare.alias("json")).collect()}

    def read(path: str) -> dict:
        try:
            got = json.loads(text.get(path) or "{}")
        except ValueError:
            return {}
        return got if isinstance(got, dict) else {}

    own = read("package.json").get(name)
    workspace = {"workspace": True} if read("package.json").get("workspaces") else {}
    return merged_config(defaults or {}, read(f"{name}/config.json"), own if isinstance(own, dict) else {}, workspace, overrides or {})


def merged_config(*layers: dict) -> dict:
    """Later layers replace earlier keys; ``options`` is merged key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = {**out.get(k, {}), **v} if k == "options" and isinstance(v, dict) else v
    return out

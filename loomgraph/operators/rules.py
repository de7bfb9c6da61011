"""Findings over fact tables: anti-joins, aggregations and ordered per-key logic.

Anti-join semantics throughout: a null key on the left is never matched and is
dropped first, as such a fact says nothing; repeated facts count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import graph, resolve
from loomgraph.plans.lineage import checked

PROTECTED = r"(?i)(\.(test|spec|e2e)\.|(^|/)(__tests__|tests?)/|\.config\.[cm]?[jt]s$|(^|/)\.[\w-]+rc(\.[cm]?js)?$)"


# --- predicates


def protected(path: Column) -> Column:
    """Tests and configuration: never reported."""
    return path.rlike(PROTECTED)


# fixed values: names that tools look for, anywhere in a path
TOOL_FILES = [
    "jest.config.", "vitest.config.", "vitest.workspace.", "playwright.config.", "cypress.config.", "webpack.config.", "vite.config.", "rollup.config.", "esbuild.config.", "parcel.config.",
    "tsup.config.", "unbuild.config.", "pkgroll.config.", "tailwind.config.", "postcss.config.", ".postcssrc.", ".eslintrc.", "eslint.config.", "prettier.config.", ".prettierrc.", ".stylelintrc.",
    "stylelint.config.", "biome.json", ".oxlintrc.", ".babelrc.", "babel.config.", ".commitlintrc.", "commitlint.config.", ".lintstagedrc.", "lint-staged.config.", "typedoc.config.", "typedoc.json",
    "turbo.json", "nx.json", "lerna.json", "syncpack.config.",
]
# fixed values: paths that start programs and packages by convention
ENTRY_ENDINGS = [
    "/bin/cli.js", "/bin/cli.ts", "/bin/cli.mjs", "/bin/index.js", "/bin/index.ts", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/index.mjs", "/index.cjs",
    "/src/main.ts", "/src/main.js", "/src/app.ts", "/src/app.js", "/main.ts", "/main.js", "/app.ts", "/app.js",
]
# fixed values: paths that frameworks load by convention, and tests and stories
CONVENTIONS = [
    r"(?i)\.(test|spec|e2e|cy)\.(js|ts|tsx|jsx)$",
    r"(?i)\.stories\.(js|ts|tsx|jsx)$",
    r"/app/(page|layout|loading|error|not-found|template|default|route|middleware)\.(js|ts|tsx|jsx)$",
    r"/pages/.*\.(js|ts|tsx|jsx|vue)$",
    r"/middleware\.(js|ts)$",
    r"/next\.config\.(js|ts|mjs|cjs)$",
    r"/app/routes/.*\.(js|ts|tsx|jsx)$",
    r"/app/root\.(js|ts|tsx|jsx)$",
    r"/app/entry\.(client|server)\.(js|ts|tsx|jsx)$",
    r"/\+(page|layout)(\.(server|client))?\.(svelte|js|ts)$",
    r"/\+error\.(svelte|js|ts)$",
    r"/\+server\.(js|ts)$",
    r"/(svelte|astro|nuxt|vite)\.config\.(js|ts|mjs)$",
    r"/src/(pages|layouts)/.*\.astro$",
    r"/layouts/.*\.vue$",
    r"/server/api/.*\.(js|ts)$",
    r"/app\.module\.(ts|js)$",
    r"/angular\.json$",
    r"/app/(_layout|index)\.(js|ts|tsx|jsx)$",
]
# fixed values: members that every object has, whose names say nothing about use
GLOBAL_NAMES = ["toLowerCase", "toUpperCase", "toString", "valueOf", "hasOwnProperty", "constructor"]


def core_tooling(path: Column) -> Column:
    """Files that a tool or framework loads by its conventions: by a piece of the name, an ending, or a pattern."""
    whole = F.concat(F.lit("/"), path)
    named = F.exists(F.array(*map(F.lit, TOOL_FILES)), lambda f: F.contains(path, f))
    ends = F.exists(F.array(*map(F.lit, ENTRY_ENDINGS)), lambda e: F.endswith(whole, e))
    return named | ends | whole.rlike("|".join(f"(?:{c})" for c in CONVENTIONS))


def unsuppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings (rule, file_path, symbol) that no comment of their file silences: ``*``, the rule, or rule and symbol."""
    s = suppressions.select("file_path", F.col("rule").alias("r"), F.col("symbol").alias("s")).distinct()
    all_ = s.where("r = '*'").select("file_path").distinct()
    rule = s.where("r <> '*' and s is null").select("file_path", F.col("r").alias("rule")).distinct()
    one = s.where("s is not null").select("file_path", F.col("r").alias("rule"), F.col("s").alias("symbol"))
    return findings.join(all_, "file_path", "left_anti").join(rule, ["file_path", "rule"], "left_anti").join(one, ["file_path", "rule", "symbol"], "left_anti").select(*findings.columns)


def reportable_exports(exports: DataFrame) -> DataFrame:
    return exports.where("name is not null and name not in ('*', 'default')")


def countable_dependency(package: Column, own: Column, has_ts: Column) -> Column:
    """Type packages, a package's own name, and the compiler where there is TypeScript say nothing about use."""
    return ~package.startswith("@types/") & (package != own) & ~((package == "typescript") & has_ts)


def matched_routes(files: DataFrame, rules: DataFrame, active: DataFrame) -> DataFrame:
    """(file_path, plugin) of files that a route of an active plugin matches; rules are a small dimension."""
    r = checked(rules.join(active, "plugin", "left_semi").select("plugin", "regex"))
    return files.select("file_path").join(r, F.expr("file_path rlike regex")).select("file_path", "plugin").distinct()


def active_plugins(config_files: DataFrame, packages: DataFrame, activation: DataFrame, files: DataFrame, deps: DataFrame) -> DataFrame:
    """Plugins of which a config file exists or a package is declared, as their activation asks."""
    by_file = config_files.join(files.select(F.explode(S.tail_names(F.col("file_path"))).alias("file_name")).distinct(), "file_name", "left_semi").select("plugin")
    by_dep = packages.join(deps.select("package").distinct(), "package", "left_semi").select("plugin")
    a = activation.select("plugin", "activation")
    return a.where("activation like '%file%' or activation = 'base'").join(by_file, "plugin", "left_semi").union(a.where("activation like '%dep%'").join(by_dep, "plugin", "left_semi")).select("plugin").distinct()


# --- dependencies


def package_usage(imports: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(file_path, package) of imports of packages that are neither built in nor workspace members."""
    p = S.package_name(F.col("specifier"))
    found = imports.where(S.is_package(F.col("specifier"))).select("file_path", p.alias("package")).where(~S.is_builtin(F.col("package"))).distinct()
    return found if packages is None else found.join(packages.select(F.col("name").alias("package")), "package", "left_anti").select("file_path", "package")


def unlisted(usage: DataFrame, scope: DataFrame, deps: DataFrame) -> DataFrame:
    """(file_path, package): imported, but no manifest in scope declares it."""
    listed = usage.join(scope, "file_path").join(deps.select("manifest_path", "package").distinct(), ["manifest_path", "package"], "left_semi").select("file_path", "package")
    known = scope.select("file_path").distinct()
    return usage.join(known, "file_path", "left_semi").join(listed, ["file_path", "package"], "left_anti").select("file_path", "package").distinct()


def unused(deps: DataFrame, used: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Declared and not used: rows of deps whose ``by`` columns (package) no used row has."""
    by = by or ["package"]
    return deps.join(used.select(*by).distinct(), by, "left_anti")


def root_only_in_workspaces(root_deps: DataFrame, root_usage: DataFrame, ws_usage: DataFrame) -> DataFrame:
    return root_deps.join(ws_usage.select("package"), "package", "left_semi").join(root_usage.select("package"), "package", "left_anti")


def undeclared_workspace(usage: DataFrame, owner: DataFrame, packages: DataFrame, deps: DataFrame) -> DataFrame:
    """(manifest_path, package): a workspace package imported by a file whose own package doesn't declare it."""
    names = packages.select(F.col("name").alias("package"))
    at = packages.select("root_dir", "manifest_path", F.col("name").alias("own"))
    found = usage.join(names, "package", "left_semi").join(owner, "file_path").join(at, "root_dir").where("package <> own")
    return found.select("manifest_path", "package").distinct().join(deps.select("manifest_path", "package"), ["manifest_path", "package"], "left_anti")


def unprotocolled(root_deps: DataFrame, packages: DataFrame) -> DataFrame:
    """Workspace packages that the root names without the workspace protocol."""
    return root_deps.join(packages.select(F.col("name").alias("package")), "package", "left_semi").where(~F.col("version").startswith("workspace:"))


def version_mismatches(deps: DataFrame) -> DataFrame:
    """(package, versions, manifests) of packages declared at several versions; collected after duplicates are gone."""
    d = deps.where("version is not null and not startswith(version, 'workspace:')").select("package", "version", "manifest_path").distinct()
    return d.groupBy("package").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.collect_set("manifest_path")).alias("manifests")).where(F.size("versions") > 1)


def typosquats(deps: DataFrame, popular: DataFrame, trusted: DataFrame) -> DataFrame:
    """(package, popular, distance) one or two edits apart. Popular names are a short list; lengths part most pairs first."""
    asked = deps.select("package").distinct().join(trusted.select("package"), "package", "left_anti")
    p = checked(popular.select(F.col("package").alias("popular")).distinct())
    near = asked.join(p, F.abs(F.length("package") - F.length("popular")) <= 2)
    return near.withColumn("distance", F.levenshtein("package", "popular")).where("distance between 1 and 2")


def plugin_requirements(required: DataFrame, deps: DataFrame) -> DataFrame:
    """(plugin, package, problem): missing, or in the wrong section. required: (plugin, package, is_dev, is_optional)."""
    d = deps.select("package", "dep_kind").distinct().groupBy("package").agg(F.max(F.col("dep_kind") == "devDependencies").alias("dev"), F.max(F.col("dep_kind") != "devDependencies").alias("prod"))
    j = required.join(d, "package", "left")
    problem = F.when(F.col("dev").isNull(), F.when(~F.col("is_optional"), "missing")).when(F.col("is_dev") & ~F.col("dev"), "should be a devDependency").when(~F.col("is_dev") & ~F.col("prod"), "should be a dependency")
    return j.withColumn("problem", problem).where("problem is not null").select("plugin", "package", "problem")


def orphaned_configs(config_files: DataFrame, files: DataFrame, required: DataFrame, deps: DataFrame) -> DataFrame:
    """(plugin, file_name): the config exists, none of the plugin's packages is declared."""
    there = config_files.join(files.select(F.explode(S.tail_names(F.col("file_path"))).alias("file_name")).distinct(), "file_name", "left_semi")
    backed = required.join(deps.select("package"), "package", "left_semi").select("plugin").distinct()
    return there.join(required.select("plugin").distinct(), "plugin", "left_semi").join(backed, "plugin", "left_anti").select("plugin", "file_name")


def script_commands(scripts: DataFrame) -> DataFrame:
    """(manifest_path, command): words of scripts that name a program; behind a runner, the word after it."""
    parts = scripts.select("manifest_path", F.posexplode(F.split(F.col("script"), r"\s*(?:&&|\|\||[;|&])\s*")).alias("part", "p"))
    words = parts.select("manifest_path", F.filter(F.split(F.regexp_replace(F.trim("p"), r"[\"']", ""), r"\s+"), lambda w: ~w.rlike(r"^\w+=|^-")).alias("w"))
    first = F.element_at("w", 1)
    return words.where(F.size("w") > 0).select("manifest_path", F.when(first.isin("npx", "pnpx", "bunx", "cross-env"), F.try_element_at("w", F.lit(2))).otherwise(first).alias("command")).where("command is not null and command <> ''").distinct()


def program_packages(commands: DataFrame, programs: DataFrame) -> DataFrame:
    """(manifest_path, package): programs looked up in the dimension (bin, package), else taken for packages themselves."""
    j = commands.join(programs.select(F.col("bin").alias("command"), "package"), "command", "left")
    return j.select("manifest_path", F.coalesce("package", "command").alias("package")).distinct()


def peers(used: DataFrame, peer_deps: DataFrame) -> DataFrame:
    """Peers of used packages that count as used too; optional ones and types don't."""
    return peer_deps.join(used.select("package").distinct(), "package", "left_semi").where("not is_optional and not startswith(peer, '@types/')").select("package", "peer").distinct()


def dependency_sets(imports: DataFrame) -> DataFrame:
    """(is_dev, packages): what development paths and what others import, in order."""
    u = package_usage(imports).withColumn("is_dev", S.is_dev_path(F.col("file_path")))
    return u.groupBy("is_dev").agg(F.array_sort(F.collect_set("package")).alias("packages"))


# --- exports and members


def references(import_symbols: DataFrame, resolved: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(file_path, name) of every use by resolved key: named imports, and members read off namespaces. One equi-join a rule."""
    linked = import_symbols.join(resolved, ["file_path", "specifier"])
    named = linked.where("imported_name <> '*'").select(F.col("target").alias("file_path"), F.col("imported_name").alias("name"))
    if chains is None:
        return named.distinct()
    spaces = linked.where("imported_name = '*'").select("file_path", "local_name", "target")
    read = chains.select("file_path", F.col("parts")[0].alias("local_name"), F.col("parts")[1].alias("name")).where("name is not null")
    return named.union(spaces.join(read, ["file_path", "local_name"]).select("target", "name")).distinct()


def dead_exports(exports: DataFrame, used: DataFrame, reached: DataFrame, public: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """Exports of reached files that nobody uses by (file, name). Files in ``public`` are entries whose exports are
    their interface. ``fuzzy`` (file_path, name) adds the rule that any other file's identifier of that name is a use,
    but for names that every object has."""
    e = reportable_exports(exports).join(reached.select(F.col("node").alias("file_path")), "file_path", "left_semi").join(public.select("file_path"), "file_path", "left_anti")
    dead = e.join(used, ["file_path", "name"], "left_anti")
    if fuzzy is not None:
        where = fuzzy.where(~F.col("name").isin(*GLOBAL_NAMES)).select("name", "file_path").distinct().groupBy("name").agg(F.count("*").alias("files"), F.min("file_path").alias("one"))
        dead = dead.join(where, "name", "left").where("files is null or (files = 1 and one = file_path)").drop("files", "one")
    return dead


def dead_members(exports: DataFrame, chains: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(file_path, name, member) of public members that no chain names after another part, in any file."""
    m = exports.select("file_path", "name", F.explode("members").alias("m")).where("m.is_public").select("file_path", "name", F.col("m.name").alias("member"))
    read = chains.select(F.explode(F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1)))).alias("member")).union(identifiers.select(F.col("name").alias("member"))).distinct()
    return m.join(read, "member", "left_anti").select("file_path", "name", "member")


def unused_bindings(import_symbols: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(file_path, local_name, specifier) of imported names that the file never mentions."""
    return import_symbols.where("local_name is not null").join(identifiers.select("file_path", F.col("name").alias("local_name")).distinct(), ["file_path", "local_name"], "left_anti").select("file_path", "local_name", "specifier")


def contract_uses(routes: DataFrame, contracts: DataFrame, exports: DataFrame) -> DataFrame:
    """(file_path, name): exports that a framework calls by name in the files it owns."""
    owned = routes.join(contracts, "plugin").select("file_path", F.col("contract").alias("name"))
    return exports.select("file_path", "name").join(owned, ["file_path", "name"], "left_semi").distinct()


def barrel_share(exports: DataFrame, statements: DataFrame, least: float = 0.8) -> DataFrame:
    """(file_path, share, is_barrel): re-exports among the statements that aren't imports."""
    r = exports.groupBy("file_path").agg(F.count_distinct(F.when(F.col("source_specifier").isNotNull(), F.struct("source_specifier", "name"))).alias("r"))
    j = statements.join(r, "file_path", "left")
    share = F.coalesce("r", F.lit(0)) / F.greatest(F.lit(1), F.col("n_statements"))
    return j.select("file_path", share.alias("share"), (share > least).alias("is_barrel"))


def prune_blockers(symbols: DataFrame, strings: DataFrame, chains: DataFrame, metadata: DataFrame, reserved: list[str]) -> DataFrame:
    """(file_path, name, reason): why a symbol may not be cut, the first reason that holds."""
    s = symbols.select("file_path", "name").distinct()
    short = s.where(F.col("name").isin(*reserved) | (F.length("name") <= 2)).select("file_path", "name", F.lit(1).alias("p"), F.lit("reserved or short name").alias("reason"))
    text = strings.select(F.col("value").alias("name")).union(chains.select(F.explode("parts"))).distinct()
    named = s.join(text, "name", "left_semi").select("file_path", "name", F.lit(2), F.lit("named in a string or chain"))
    told = metadata.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][\w$]*)"), 1))).alias("name")).distinct()
    meta = s.join(told, "name", "left_semi").select("file_path", "name", F.lit(3), F.lit("named in metadata"))
    return short.union(named).union(meta).groupBy("file_path", "name").agg(F.min_by("reason", "p").alias("reason"))


# --- boundaries

#: The rule that holds where no others are given: a core must not reach into the network layer.
SANDBOX = [(1, "**/src/core/**", "**/src/network/**", False, "src/core must not reach into src/network")]


def boundary_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst, rule_order, message): the first rule that an edge matches, where it forbids. rules: (rule_order,
    from_glob, to_glob, allow, message), a short list."""
    r = checked(rules.select("rule_order", S.glob_regex(F.col("from_glob")).alias("f"), S.glob_regex(F.col("to_glob")).alias("t"), "allow", "message"))
    hit = edges.select("src", "dst").distinct().join(r, F.expr("src rlike f and dst rlike t"))
    first = hit.groupBy("src", "dst").agg(F.min_by(F.struct("rule_order", "allow", "message"), "rule_order").alias("r"))
    return first.where("not r.allow").select("src", "dst", "r.rule_order", "r.message")


# --- syntax trees


def endless_loops(nodes: DataFrame) -> DataFrame:
    """(file_path, node_id) of loops on a constant condition without a way out below them. Nodes carry pre and post
    numbers; below means a larger pre and a smaller post. A file's nodes are gone through once, in order of pre: the
    least post of the exits that come later tells whether one is below."""
    n = nodes.withColumn("_loop", F.expr("node_type in ('WhileStatement', 'DoWhileStatement', 'ForStatement') and attrs['constant'] = 'true'"))
    n = n.withColumn("_exit", F.expr("node_type in ('BreakStatement', 'ReturnStatement', 'ThrowStatement')")).where("_loop or _exit")
    later = Window.partitionBy("file_path").orderBy(F.col("pre").cast("long")).rangeBetween(1, Window.unboundedFollowing)
    first = n.withColumn("_least", F.min(F.when(F.col("_exit"), F.col("post"))).over(later))
    return first.where("_loop and (_least is null or _least >= post)").select("file_path", "node_id")


def leaking_listeners(ops: DataFrame, order: list[str]) -> DataFrame:
    """(file_path, event) whose last operation adds a listener. ops: (file_path, event, op)."""
    last = ops.groupBy("file_path", "event").agg(F.max_by("op", F.struct(*order)).alias("op"))
    return last.where("op = 'add'").select("file_path", "event")


def unguarded_uses(uses: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of uses (kind 'use') that no 'guard' of the same key precedes."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.when(F.col("kind") == "guard", 1).otherwise(0)).over(w), F.lit(0))
    return uses.withColumn("guarded", seen).where("kind = 'use' and guarded = 0").drop("guarded")


def named_calls(shapes: DataFrame) -> DataFrame:
    """shapes (callee_object, callee, ...) with the whole name of what is called in ``callee``."""
    object_, name = F.col("callee_object"), F.col("callee")
    return shapes.withColumn("callee", F.when(object_.isNull(), S.callee_name(name, F.lit(None).cast("string"))).otherwise(S.callee_name(object_, name))).drop("callee_object")


def polymorphic(shapes: DataFrame, least: int = 2) -> DataFrame:
    """(callee, n_shapes) of callees that get objects of several shapes."""
    return shapes.groupBy("callee").agg(F.count_distinct("shape").alias("n_shapes")).where(F.col("n_shapes") >= least)


def clones(shapes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of their shape within ``by``: file and shape, or shape alone for clones across files."""
    return shapes.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("nth > 1")


def type_changes(writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Writes whose type isn't that of the key's first write."""
    first = F.first("type").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return writes.withColumn("first_type", first).where("type <> first_type")


# --- sets


def united(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, each once; columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def difference(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``by`` of left that right lacks; nulls are never equal, so rows with one stay."""
    return left.select(*by).distinct().join(right.select(*by).distinct(), by, "left_anti")


def intersection(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.select(*by).distinct().join(right.select(*by).distinct(), by, "left_semi")


def merged_sets(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row a key with the ordered set of each column's values, nulls left out; partial sets of tasks are merged."""
    return rows.groupBy(*by).agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


# --- workspace


def without_entries(packages: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """Packages of which no entry point is known. entries: (by, entry)."""
    return packages.join(entries.where("entry is not null").select(by).distinct(), by, "left_anti")


def export_registry(exports: DataFrame) -> DataFrame:
    """(file_path, names): what each file exports, in order."""
    return exports.where("name is not null").groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("names"))


def consumed_by_side(usage: DataFrame, is_root: Column) -> DataFrame:
    """(is_root, packages): packages that files of the root, and of workspaces, import."""
    return usage.groupBy(is_root.alias("is_root")).agg(F.array_sort(F.collect_set("package")).alias("packages"))


def workspace_summary(packages: DataFrame, links: DataFrame, package: str) -> DataFrame:
    """One row: n_packages, n_links, n_names (distinct packages that links name)."""
    return links.agg(F.count("*").alias("n_links"), F.count_distinct(package).alias("n_names")).crossJoin(packages.agg(F.count("*").alias("n_packages")))  # a row each


def zombie_exports(exports: DataFrame, used_names: DataFrame) -> DataFrame:
    """Exports whose bare name no file uses, whatever file it is imported from. used_names: (name)."""
    return reportable_exports(exports).join(used_names.select("name").distinct(), "name", "left_anti").select(*exports.columns)


def export_layout(exports: DataFrame, entries: DataFrame) -> DataFrame:
    """How a file's exports are made: stars (specifiers), namespaces and forwarded (name from specifier), local names;
    a file that passes others' exports on is a barrel unless it is an entry. exports: (file_path, name, export_type, source_specifier, original_name)."""
    src, name = F.col("source_specifier"), F.col("name")
    star = src.isNotNull() & (name == "*")
    space = src.isNotNull() & (name != "*") & (F.col("original_name") == "*")
    sent = src.isNotNull() & (name != "*") & ~F.coalesce(F.col("original_name") == "*", F.lit(False))
    bag = lambda when, what, as_: F.array_sort(F.collect_set(F.when(when, what))).alias(as_)
    made = exports.groupBy("file_path").agg(
        bag(star, src, "stars"),
        bag(space, F.concat_ws(" from ", name, src), "namespaces"),
        bag(sent, F.concat(F.coalesce("original_name", name), F.lit(" as "), name, F.lit(" from "), src), "forwarded"),
        bag(src.isNull(), name, "local"),
    )
    known = entries.select("file_path").distinct().withColumn("_entry", F.lit(True))
    passes = F.size("stars") + F.size("namespaces") + F.size("forwarded") > 0
    return made.join(known, "file_path", "left").select("file_path", "stars", "namespaces", "forwarded", "local", F.coalesce("_entry", F.lit(False)).alias("is_entry"), (passes & F.col("_entry").isNull()).alias("is_barrel"))


def migrations(active: DataFrame, table: DataFrame) -> DataFrame:
    """(legacy, modern, message) for each older tool in use. active: (name); table: (legacy, modern, reason)."""
    j = table.join(active.select(F.col("name").alias("legacy")).distinct(), "legacy", "left_semi")
    return j.select("legacy", "modern", F.concat(F.lit("consider "), "modern", F.lit(" instead of "), "legacy", F.lit(": "), "reason").alias("message"))


def without_lockfile(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Manifests (manifest_path, root_dir) in whose directory or above no lockfile lies."""
    # fixed values: files that pin what is installed
    names = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock"]
    there = files.where(S.basename(F.col("file_path")).isin(*names)).select(S.dirname(F.col("file_path")).alias("dir")).distinct()
    up = manifests.select("manifest_path", F.explode(S.ancestors(F.concat_ws("/", F.when(F.col("root_dir") != "", F.col("root_dir")), F.lit("x")))).alias("dir"))
    return manifests.join(up.join(there, "dir").select("manifest_path").distinct(), "manifest_path", "left_anti")


def discovered(files: DataFrame, folders: DataFrame, deps: DataFrame) -> DataFrame:
    """(plugin, file_path, package, listed): files in a folder that a tool owns are entries; ``listed`` tells whether its
    package is declared. folders: (plugin, folder, package), a short list; folder is one path segment."""
    each = files.select("file_path", F.explode(F.array_distinct(F.split(S.dirname(F.col("file_path")), "/"))).alias("folder"))
    known = deps.select("package").distinct().withColumn("listed", F.lit(True))
    return each.join(folders, "folder").join(known, "package", "left").select("plugin", "file_path", "package", F.coalesce("listed", F.lit(False)).alias("listed"))


# --- reports


def ordered(findings: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """findings with their ``place`` within ``by``: errors first, then as ``order`` says."""
    w = Window.partitionBy(*by).orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), *order)
    return findings.withColumn("place", F.row_number().over(w))


def metrics(files: DataFrame, hit: Column) -> DataFrame:
    """One row: files scanned, taken from the store (``hit``) and parsed anew."""
    return files.agg(F.count("*").alias("scanned"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.count_if(~F.coalesce(hit, F.lit(False))).alias("misses"))


def by_file(findings: DataFrame) -> DataFrame:
    """(file_path, n, messages): each file's diagnostics, errors first, then by rule."""
    item = F.struct(F.when(F.col("severity") == "error", 0).otherwise(1).alias("o"), "rule", "message")
    return findings.groupBy("file_path").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(item)), lambda m: m["message"]).alias("messages"))


def totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def first_of(findings: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One finding for each key, the first in order: of equal messages the first plugin's, of equal places the first rule's."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def overriding(registered: DataFrame) -> DataFrame:
    """The last registration of each name: (name, seq, ...)."""
    return registered.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")


def orphans(files: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that no entry reaches; protected ones are left out."""
    return graph.unreachable(files.select("file_path"), edges, entries.select("file_path")).where(~protected(F.col("file_path")))


def install_commands(missing: DataFrame, lockfiles: DataFrame) -> DataFrame:
    """(root_dir, command): one line a root, by its lockfile; the first of several lockfiles by the usual precedence."""
    # fixed values: lockfiles in order of precedence and the command of each
    table = [("pnpm-lock.yaml", 1, "pnpm add"), ("yarn.lock", 2, "yarn add"), ("bun.lockb", 3, "bun add"), ("package-lock.json", 4, "npm install")]
    spark = missing.sparkSession
    known = lockfiles.join(spark.createDataFrame(table, "file_name string, p int, c string"), "file_name")
    chosen = resolve.first_by(known, ["root_dir"], "c", "p")
    names = missing.groupBy("root_dir").agg(F.array_join(F.array_sort(F.collect_set("package")), " ").alias("names"))
    return names.join(chosen, "root_dir", "left").select("root_dir", F.concat_ws(" ", F.coalesce("c", F.lit("npm install")), "names").alias("command"))


def needle_hits(files: DataFrame, needles: DataFrame, active: DataFrame) -> DataFrame:
    """(file_path, plugin) of files whose content holds a text that an active plugin looks for; needles are a small dimension."""
    n = checked(needles.join(active, "plugin", "left_semi").select("plugin", "needle"))
    return files.select("file_path", "content").join(n, F.expr("contains(content, needle)")).select("file_path", "plugin").distinct()

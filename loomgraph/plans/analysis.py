"""The whole analysis of a source tree, from files to findings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import graph, resolve, rules, secrets
from loomgraph.plans import plugins, report
from loomgraph.plans.lineage import cut
from loomgraph.sources import manifests, scan


@dataclass
class Analysis:
    """Facts and findings of the tree below ``root``, each computed once when first asked for.

    ``fuzzy`` adds name-based use to the exact rule; ``entries`` are further entry files;
    ``conventions`` makes entries of all files that tools load by their names (`rules.core_tooling`,
    which takes in every index file), whether the tool is in use or not; ``boundaries`` are rows
    (rule_order, from_glob, to_glob, allow, message), by default `rules.SANDBOX`; ``extra`` are
    plugins made by `plugins.define`.
    """

    spark: SparkSession
    root: str
    fuzzy: bool = False
    entries: list[str] = field(default_factory=list)
    boundaries: list[tuple] = field(default_factory=lambda: list(rules.SANDBOX))
    conventions: bool = False
    extra: list[dict] = field(default_factory=list)

    @cached_property
    def rules(self) -> plugins.Rules:
        return plugins.Rules(self.spark, self.extra)

    # --- facts

    @cached_property
    def files(self) -> DataFrame:
        return cut(scan.files(self.spark, self.root))

    @cached_property
    def source_files(self) -> DataFrame:
        return scan.sources(self.files).select("file_path", "sha256")

    @cached_property
    def facts(self) -> DataFrame:
        return scan.facts(self.files)

    def view(self, kind: str) -> DataFrame:
        return scan.view(self.facts, kind)

    @cached_property
    def manifest_files(self) -> DataFrame:
        return self.files.where("file_path rlike '(^|/)package\\\\.json$'").select(F.col("file_path").alias("manifest_path"), "content")

    @cached_property
    def packages(self) -> DataFrame:
        return cut(manifests.packages(self.manifest_files))

    @cached_property
    def deps(self) -> DataFrame:
        return cut(manifests.dependencies(self.manifest_files))

    @cached_property
    def aliases(self) -> DataFrame:
        configs = self.files.where("file_path rlike 'tsconfig|jsconfig'").select(F.col("file_path").alias("path"), "content")
        of_ts = manifests.tsconfig_aliases(configs)
        of_tools = self.config_facts.where("kind = 'alias'").select(S.dirname(F.col("path")).alias("scope_dir"), F.col("name").alias("pattern"), F.regexp_replace("value", r"^\./|^/", "").alias("target"), F.lit("tool").alias("kind"), F.lit(500).alias("pos"))
        return of_ts.unionByName(of_tools)

    @cached_property
    def config_facts(self) -> DataFrame:
        return cut(manifests.config_facts(manifests.framework_configs(self.files)))

    @cached_property
    def manifest_entries(self) -> DataFrame:
        """(root_dir, file_path): the files that a package's manifest, or the usual names, make its entries."""
        asked = self.packages.select("root_dir", F.explode("entry_points").alias("e")).select("root_dir", S.join_path(F.col("root_dir"), F.col("e")).alias("p"))
        built = asked.select("root_dir", F.explode(F.array("p", F.regexp_replace("p", r"(^|/)(dist|build|lib)/", "$1src/"))).alias("p")).distinct()
        bare = S.drop_extension(F.col("p"))
        spread = built.select("root_dir", "p", F.posexplode(F.concat(resolve.candidates(F.col("p")), resolve.candidates(bare))).alias("pos", "file_path"))
        found = spread.join(self.source_files.select("file_path"), "file_path", "left_semi")
        return cut(found.groupBy("root_dir", "p").agg(F.min_by("file_path", "pos").alias("file_path")).select("root_dir", "file_path").distinct())

    @cached_property
    def imports(self) -> DataFrame:
        return cut(self.view("import"))

    @cached_property
    def exports(self) -> DataFrame:
        return cut(self.view("export"))

    @cached_property
    def resolved(self) -> DataFrame:
        return cut(resolve.resolve(self.imports, self.source_files, self.packages, self.aliases))

    @cached_property
    def edges(self) -> DataFrame:
        linked = resolve.edges(self.imports, self.resolved)
        return cut(linked.unionByName(resolve.glob_edges(self.view("dynamic_import"), self.source_files)))

    @cached_property
    def entry_points(self) -> DataFrame:
        """(file_path, reason): manifest entries, framework routes, configuration, tests, what plugins look for, those given."""
        known = self.source_files.select("file_path")
        out = self.manifest_entries.select("file_path", F.lit("manifest").alias("reason"))
        out = out.union(known.where(rules.protected(F.col("file_path"))).select("file_path", F.lit("tooling")))
        out = out.union(rules.matched_routes(known, self.rules.routes, self.active_plugins).select("file_path", F.lit("route")))
        out = out.union(rules.needle_hits(scan.sources(self.files), self.rules.needles, self.active_plugins).select("file_path", F.lit("needle")))
        named = self.config_facts.where("kind = 'entry'").select(S.join_path(S.dirname(F.col("path")), F.col("value")).alias("file_path"))
        out = out.union(named.join(known, "file_path", "left_semi").select("file_path", F.lit("config")))
        out = out.union(self.discovered.where("listed").join(known, "file_path", "left_semi").select("file_path", F.lit("tooling")))
        if self.conventions:
            out = out.union(known.where(rules.core_tooling(F.col("file_path"))).select("file_path", F.lit("convention")))
        if self.entries:
            out = out.union(self.spark.createDataFrame([(e, "given") for e in self.entries], "file_path string, reason string"))
        return cut(out.distinct())

    @cached_property
    def active_plugins(self) -> DataFrame:
        return cut(rules.active_plugins(self.rules.config_files, self.rules.packages, self.rules.activations, self.files, self.deps))

    @cached_property
    def discovered(self) -> DataFrame:
        """Files of folders that a tool loads by itself: (plugin, file_path, package, listed)."""
        return cut(rules.discovered(self.files, plugins.folders(self.spark), self.deps))

    @cached_property
    def reached(self) -> DataFrame:
        return cut(graph.reachable(self.edges, self.entry_points.select("file_path")))

    @cached_property
    def uses(self) -> DataFrame:
        """(file_path, name) of each used export, by the file that declares it: barrels are resolved, stars and namespaces included."""
        direct = rules.references(self.view("import_symbol"), self.resolved, self.view("chain"))
        targets = self.resolved.select("file_path", F.col("specifier").alias("source_specifier"), "target")
        origin = graph.resolve_symbols(direct, self.exports.select("file_path", "name", "source_specifier", "original_name"), targets)
        routes = rules.matched_routes(self.source_files, self.rules.routes, self.active_plugins)
        contract = rules.contract_uses(routes, self.rules.contracts, self.exports)
        # what a public file re-exports is its interface too, however many barrels it comes through
        public = self.exports.join(self.public, "file_path", "left_semi").where("source_specifier is not null and name <> '*'").select("file_path", "name")
        stars = self.star_public
        shown = graph.resolve_symbols(public, self.exports.select("file_path", "name", "source_specifier", "original_name"), targets)
        return cut(direct.union(origin.select("origin_file", "origin_name")).union(contract).union(shown.select("origin_file", "origin_name")).union(stars).distinct())

    @cached_property
    def star_public(self) -> DataFrame:
        """Exports of files that public files star-export, through any number of stars."""
        star = self.exports.where("name = '*'").join(self.resolved, (self.exports.file_path == self.resolved.file_path) & (self.exports.source_specifier == self.resolved.specifier)).select(self.exports.file_path.alias("src"), F.col("target").alias("dst"))
        seen = graph.reachable(star, self.public).where("hops > 0").select(F.col("node").alias("file_path"))
        return self.exports.join(seen, "file_path", "left_semi").select("file_path", "name")

    @cached_property
    def public(self) -> DataFrame:
        return self.entry_points.where("reason not in ('route', 'needle', 'convention')").select("file_path").distinct()

    # --- findings

    @cached_property
    def orphan_files(self) -> DataFrame:
        return rules.orphans(self.source_files, self.edges, self.entry_points)

    @cached_property
    def dead_exports(self) -> DataFrame:
        fuzzy = self.view("identifier").union(self.view("string_ref").select("file_path", F.col("value").alias("name"))) if self.fuzzy else None
        dead = rules.dead_exports(self.exports, self.uses, self.reached, self.public, fuzzy)
        silent = dead.withColumn("rule", F.lit("unused-export")).withColumn("symbol", F.col("name"))
        return rules.unsuppressed(silent, self.view("suppression")).drop("rule", "symbol")

    @cached_property
    def dead_members(self) -> DataFrame:
        dead = self.dead_exports.select("file_path", "name")
        live = self.exports.join(dead, ["file_path", "name"], "left_anti").join(self.reached.select(F.col("node").alias("file_path")), "file_path", "left_semi").where("export_type <> 'interface'")
        pattern = self.view("import_symbol").select(F.col("imported_name").alias("name"))
        return plugins.protect_members(self.rules.protected)(rules.dead_members(live, self.view("chain"), pattern))

    @cached_property
    def package_usage(self) -> DataFrame:
        """Imports that no file of the tree answers."""
        outside = self.imports.join(self.resolved, ["file_path", "specifier"], "left_anti")
        return rules.package_usage(outside, self.packages.where("name is not null"))

    @cached_property
    def scope(self) -> DataFrame:
        return resolve.in_scope(self.source_files, self.packages)

    @cached_property
    def unused_dependencies(self) -> DataFrame:
        """(manifest_path, package): used neither by a file in scope that an entry reaches nor by a script, of the
        manifest or of a CI workflow, nor as the peer of a package that is."""
        reached = self.package_usage.join(self.reached.select(F.col("node").alias("file_path")), "file_path", "left_semi")
        by_file = reached.join(self.scope, "file_path").select("manifest_path", "package")
        by_script = rules.program_packages(self.commands, plugins.programs(self.spark))
        used = by_file.union(by_script.select("manifest_path", "package"))
        peer = self.deps.where("dep_kind = 'peerDependencies'").join(self.packages.select("manifest_path", F.col("name").alias("own")), "manifest_path")
        peer = peer.select(F.col("own").alias("package"), F.col("package").alias("peer"), F.lit(False).alias("is_optional"))
        imported = self.imports.where(S.is_package(F.col("specifier"))).select(S.package_name(F.col("specifier")).alias("package"))
        everywhere = rules.peers(imported, peer).select(F.col("peer").alias("package")).union(rules.program_packages(self.ci_commands, plugins.programs(self.spark)).select("package")).distinct()
        names = self.packages.select("manifest_path", F.coalesce("name", F.lit("")).alias("own"))
        has_ts = bool(self.source_files.where(r"file_path rlike '\\.tsx?$'").take(1))
        declared = self.deps.where("dep_kind in ('dependencies', 'devDependencies')").join(names, "manifest_path")
        declared = declared.where(rules.countable_dependency(F.col("package"), F.col("own"), F.lit(has_ts)))
        declared = declared.join(everywhere, "package", "left_anti")
        tools = self.rules.packages.join(self.active_plugins, "plugin", "left_semi").where("is_dev").select("package")
        declared = declared.join(self.packages.where("name is not null").select(F.col("name").alias("package")), "package", "left_anti").join(tools, "package", "left_anti")
        return rules.unused(declared, used, ["manifest_path", "package"]).select("manifest_path", "package")

    @cached_property
    def commands(self) -> DataFrame:
        """(manifest_path, command) of manifests' scripts."""
        return cut(rules.script_commands(self.packages.select("manifest_path", F.explode("scripts").alias("script_name", "script"))))

    @cached_property
    def ci_commands(self) -> DataFrame:
        """(manifest_path, command) of CI workflows; manifest_path is the workflow's."""
        return cut(rules.script_commands(scan.workflows(self.files).withColumnRenamed("file_path", "manifest_path")))

    @cached_property
    def unlisted_dependencies(self) -> DataFrame:
        found = rules.unlisted(self.package_usage, self.scope, self.deps)
        folders = self.discovered.where("not listed").groupBy("package").agg(F.min("file_path").alias("file_path")).select("file_path", "package")
        return found.unionByName(folders)

    @cached_property
    def unused_binaries(self) -> DataFrame:
        """(package, command): declared packages that come with a program which no script runs."""
        ran = self.commands.select("command").union(self.ci_commands.select("command")).distinct()
        programs = plugins.programs(self.spark).select(F.col("bin").alias("command"), "package").join(self.deps.select("package").distinct(), "package", "left_semi")
        return rules.unused(programs, ran, ["command"]).select("package", "command")

    @cached_property
    def root_only(self) -> DataFrame:
        """Packages that the root declares and workspaces alone use."""
        owner = resolve.owning_package(self.source_files, self.packages)
        usage = self.package_usage.join(owner, "file_path")
        root_deps = self.deps.where("manifest_path = 'package.json' and dep_kind in ('dependencies', 'devDependencies')").select("package").distinct()
        return rules.root_only_in_workspaces(root_deps, usage.where("root_dir = ''"), usage.where("root_dir <> ''"))

    @cached_property
    def unprotocolled(self) -> DataFrame:
        return rules.unprotocolled(self.deps.where("manifest_path = 'package.json'"), self.packages.where("name is not null and root_dir <> ''"))

    @cached_property
    def without_entries(self) -> DataFrame:
        return rules.without_entries(self.packages.where("root_dir <> ''").select("root_dir", "manifest_path", "name"), self.manifest_entries.select("root_dir", F.col("file_path").alias("entry")), "root_dir")

    @cached_property
    def zombie_exports(self) -> DataFrame:
        """Exports of reached files whose name occurs nowhere in another's imports, identifiers or chains."""
        names = self.view("import_symbol").select(F.col("imported_name").alias("name")).union(self.view("identifier").select("name")).union(self.view("chain").select(F.explode("parts")))
        inside = self.exports.join(self.reached.select(F.col("node").alias("file_path")), "file_path", "left_semi").join(self.public, "file_path", "left_anti")
        return rules.zombie_exports(inside.where("source_specifier is null"), names)

    @cached_property
    def unused_bindings(self) -> DataFrame:
        return rules.unused_bindings(self.view("import_symbol"), self.view("identifier"))

    @cached_property
    def typosquats(self) -> DataFrame:
        known = plugins.popular(self.spark)
        return rules.typosquats(self.deps, known, known)

    @cached_property
    def plugin_problems(self) -> DataFrame:
        """(plugin, package, problem) of active plugins, and (plugin, file_name, problem) of configuration without its package."""
        needed = rules.plugin_requirements(self.rules.packages.join(self.active_plugins, "plugin", "left_semi"), self.deps)
        alone = rules.orphaned_configs(self.rules.config_files, self.files, self.rules.packages, self.deps)
        return needed.union(alone.select("plugin", "file_name", F.lit("configuration without its package"))).distinct()

    @cached_property
    def missing_configs(self) -> DataFrame:
        return manifests.config_templates(self.active_plugins, self.rules.config_files, self.files, plugins.templates(self.spark))

    @cached_property
    def install_commands(self) -> DataFrame:
        """One line that would install what imports lack, by the root's lockfile."""
        missing = self.unlisted_dependencies.select(F.lit("").alias("root_dir"), "package").distinct()
        locks = self.files.select(S.dirname(F.col("file_path")).alias("root_dir"), S.basename(F.col("file_path")).alias("file_name"))
        return rules.install_commands(missing, locks)

    @cached_property
    def migrations(self) -> DataFrame:
        active = self.active_plugins.select(F.col("plugin").alias("name")).union(self.deps.select("package"))
        return rules.migrations(active, plugins.migrations(self.spark))

    @cached_property
    def without_lockfile(self) -> DataFrame:
        return rules.without_lockfile(self.packages.where("root_dir = ''").select("manifest_path", "root_dir"), self.files)

    @cached_property
    def reclassified(self) -> DataFrame:
        return graph.reclassified(self.source_files, self.edges, self.entry_points)

    @cached_property
    def layouts(self) -> DataFrame:
        return rules.export_layout(self.exports, self.entry_points)

    @cached_property
    def prune_blockers(self) -> DataFrame:
        """(file_path, name, reason) of dead exports that may be named from outside the code."""
        strings, chains = self.view("string_ref"), self.view("chain")
        return cut(rules.prune_blockers(self.dead_exports, strings, chains, scan.metadata(self.files), ["default", "main", "module", "exports"]))

    @cached_property
    def edit_plan(self) -> DataFrame:
        """Edits that would take dead exports away which nothing blocks."""
        return report.edit_plan(self.dead_exports.join(self.prune_blockers.select("file_path", "name"), ["file_path", "name"], "left_anti"))

    @cached_property
    def graph_json(self) -> DataFrame:
        return report.graph_json(self.edges)

    @cached_property
    def metadata(self) -> DataFrame:
        return scan.metadata(self.files)

    @cached_property
    def failures(self) -> DataFrame:
        """Sources that could not be read: what they import and export is not known."""
        return self.view("failed")

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.cycle_text(graph.cycles(self.edges))

    @cached_property
    def version_mismatches(self) -> DataFrame:
        return rules.version_mismatches(self.deps)

    @cached_property
    def undeclared_workspace(self) -> DataFrame:
        usage = self.imports.where(S.is_package(F.col("specifier"))).select("file_path", S.package_name(F.col("specifier")).alias("package")).distinct()
        return rules.undeclared_workspace(usage, resolve.owning_package(self.source_files, self.packages), self.packages.where("name is not null"), self.deps)

    @cached_property
    def boundary_violations(self) -> DataFrame:
        return rules.boundary_violations(self.edges, self.spark.createDataFrame(self.boundaries, "rule_order int, from_glob string, to_glob string, allow boolean, message string"))

    @cached_property
    def smells(self) -> DataFrame:
        """(file_path, pre, rule) of syntax that rules look at."""
        n = self.view("node").withColumn("node_id", F.xxhash64("file_path", "pre"))
        a = F.col("attrs")
        rule = F.when(F.col("node_type") == "LooseEquality", "loose-equality").when((F.col("node_type") == "RegExpLiteral") & S.evil_regex(a["pattern"]), "slow-regex").when(F.col("node_type") == "IgnoreComment", "ignore-comment")
        rule = rule.when((F.col("node_type") == "WorkerPost") & S.non_serialisable(a["argument"]), "worker-payload").when(F.col("node_type") == "ComputedAssign", "computed-assignment").when(F.col("node_type") == "EnvRead", "config-read").when(F.col("node_type") == "NativeBinding", "native-binding")
        plain = n.withColumn("rule", rule).where("rule is not null").select("file_path", "pre", "rule")
        loops = n.join(rules.endless_loops(n), ["file_path", "node_id"], "left_semi").select("file_path", "pre", F.lit("endless-loop"))
        calls = n.where("node_type = 'ListenerCall'").select("file_path", a["event"].alias("event"), a["op"].alias("op"), "pre")
        leaks = rules.leaking_listeners(calls, ["pre"]).select("file_path", F.lit(None).cast("int"), F.lit("leaking-listener"))
        shapes = rules.named_calls(self.view("shape")).select("callee", "shape", "file_path", "pre")
        many = rules.clones(shapes.join(rules.polymorphic(shapes), "callee", "left_semi").dropDuplicates(["callee", "shape"]), ["callee"], ["file_path", "pre"])
        copies = rules.clones(self.view("body"), ["shape"], ["file_path", "pre"])
        turned = rules.type_changes(self.view("write"), ["file_path", "name"], ["pre"])
        null = rules.unguarded_uses(self.view("access"), ["file_path", "name"], ["pre"])
        named = lambda df, what: df.select("file_path", "pre", F.lit(what))
        return plain.union(loops).union(leaks).union(named(many, "polymorphic-call")).union(named(copies, "cloned-body")).union(named(turned, "type-change")).union(named(null, "null-access"))

    @cached_property
    def secrets(self) -> DataFrame:
        return secrets.scan(scan.sources(self.files))

    def findings(self) -> DataFrame:
        """All findings in one shape, suppressed files left out."""
        c = F.col
        f = report.finding
        out = f(self.orphan_files, "unused-file", "warning", F.lit("no entry reaches this file"), file_path=c("file_path"))
        out = out.union(f(self.dead_exports, "unused-export", "warning", F.concat(c("name"), F.lit(" is not used")), file_path=c("file_path"), symbol=c("name"), line=c("line")))
        out = out.union(f(self.dead_members, "unused-member", "warning", F.concat_ws(".", "name", "member"), file_path=c("file_path"), symbol=F.concat_ws(".", "name", "member")))
        out = out.union(f(self.unused_dependencies, "unused-dependency", "warning", c("package"), package=c("package"), manifest_path=c("manifest_path")))
        out = out.union(f(self.unlisted_dependencies, "unlisted-dependency", "error", c("package"), file_path=c("file_path"), package=c("package")))
        out = out.union(f(self.cycles, "cycle", "warning", c("path")))
        out = out.union(f(self.version_mismatches, "version-mismatch", "warning", F.array_join("versions", ", "), package=c("package")))
        out = out.union(f(self.undeclared_workspace, "undeclared-workspace", "error", c("package"), package=c("package"), manifest_path=c("manifest_path")))
        out = out.union(f(self.secrets, "secret", "error", c("label"), file_path=c("file_path"), symbol=c("type"), line=c("line")))
        out = out.union(f(self.smells, "smell", "warning", c("rule"), file_path=c("file_path"), symbol=c("rule")))
        out = out.union(f(self.root_only, "root-only-dependency", "warning", c("package"), package=c("package"), manifest_path=F.lit("package.json")))
        out = out.union(f(self.unprotocolled, "workspace-protocol", "warning", F.concat_ws(" ", "package", "version"), package=c("package"), manifest_path=c("manifest_path")))
        out = out.union(f(self.without_entries, "no-entry", "warning", F.lit("no entry of this package exists"), package=c("name"), manifest_path=c("manifest_path")))
        out = out.union(f(self.unused_binaries, "unused-binary", "warning", c("command"), package=c("package"), symbol=c("command")))
        out = out.union(f(self.zombie_exports, "zombie-export", "warning", F.concat(c("name"), F.lit(" is named nowhere")), file_path=c("file_path"), symbol=c("name"), line=c("line")))
        out = out.union(f(self.unused_bindings, "unused-binding", "warning", F.concat_ws(" from ", "local_name", "specifier"), file_path=c("file_path"), symbol=c("local_name")))
        out = out.union(f(self.typosquats, "typosquat", "error", F.concat_ws(" looks like ", "package", "popular"), package=c("package")))
        out = out.union(f(self.plugin_problems, "plugin", "warning", F.concat_ws(": ", "plugin", "problem"), package=c("package"), symbol=c("plugin")))
        out = out.union(f(self.migrations, "migration", "info", c("message"), package=c("legacy")))
        out = out.union(f(self.without_lockfile, "no-lockfile", "warning", F.lit("nothing pins what is installed"), manifest_path=c("manifest_path")))
        out = out.union(f(self.failures, "unreadable", "error", c("error"), file_path=c("file_path")))
        if self.boundaries:
            out = out.union(f(self.boundary_violations, "boundary", "error", c("message"), file_path=c("src"), symbol=c("dst")))
        silent = self.view("suppression").where("symbol is null").select("file_path", F.when(c("rule") == "*", F.lit(None)).otherwise(c("rule")).alias("r")).distinct()
        hushed = out.join(silent.where("r is null").select("file_path"), "file_path", "left_anti")
        return hushed.join(silent.where("r is not null").select("file_path", F.col("r").alias("kind")), ["file_path", "kind"], "left_anti").select(*report.FINDING)

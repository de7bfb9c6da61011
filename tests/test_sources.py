import time

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import resolve, rules
from loomgraph.plans import plugins, report
from loomgraph.sources import manifests as M
from loomgraph.streaming import incremental as inc


def test_workspace_sources_and_precedence(spark):
    files = spark.createDataFrame([
        ("pnpm-workspace.yaml", "packages:\n  - 'apps/*'\n  # note\n  - \"libs/**\"\nother:\n  - no\n"),
        ("package.json", '{"workspaces": {"packages": ["x/*"]}}'),
        ("lerna.json", '{"packages": ["y/*"]}'),
        ("workspace.yaml", "packages: ['z/*', w]\n"),
    ], "path string, content string")
    got = {(r.pattern, r.priority) for r in M.workspace_patterns(files).collect()}
    assert got == {("apps/*", 0), ("libs/**", 0), ("x/*", 1), ("y/*", 2), ("z/*", 3), ("w", 3)}
    assert {r.pattern for r in M.by_precedence(M.workspace_patterns(files), []).collect()} == {"apps/*", "libs/**"}
    dirs = spark.createDataFrame([("apps/a",), ("apps/.h",), ("apps/a/b",), ("libs/c",)], "dir string")
    assert {r.dir for r in M.expand_globs(M.workspace_patterns(files).where("priority = 0"), dirs).collect()} == {"apps/a", "libs/c"}


def test_packages_and_leaves(spark):
    content = '{"name":"n","version":"1","main":"./m.js","bin":{"b":"b.js"},"exports":{".":{"import":"./i.mjs","types":{"default":"./t.d.ts"}},"./s":"./s.js"},"scripts":{"t":"x"}}'
    df = spark.createDataFrame([("p/package.json", content), ("q/package.json", "{}"), ("r/package.json", "broken {"), ("s/package.json", '{"bin":"cli.js","exports":"./e.js"}')], "manifest_path string, content string")
    got = {r.root_dir: r.entry_points for r in M.packages(df).collect()}
    assert got["p"] == ["b.js", "i.mjs", "m.js", "s.js", "t.d.ts"]
    assert got["s"] == ["cli.js", "e.js"]
    assert got["q"][0] == got["r"][0] == "index.ts"


def test_configs(spark):
    files = spark.createDataFrame([
        ("tsconfig.json", '{"extends": "./base", /* c */ "compilerOptions": {"paths": {"@/*": ["src/*", "gen/*"]}}, "references": [{"path": "./pkg"}]}'),
        ("base.json", '{"extends": "./root.json"}'),
        ("root.json", "{}"),
    ], "path string, content string")
    assert {(r.pattern, r.target) for r in M.tsconfig_aliases(files).collect()} == {("@/*", "src/*"), ("@/*", "gen/*")}
    assert {(r.base, r.hop) for r in M.extends_chain(files).where("path = 'tsconfig.json'").collect()} == {("base.json", 1), ("root.json", 2)}
    assert {r.reference for r in M.project_references(files.where("path = 'tsconfig.json'")).collect()} == {"pkg"}
    tools = spark.createDataFrame([
        ("vite.config.ts", "export default { resolve: { alias: { '@': path.resolve(__dirname, './src'), lib: './lib' } }, build: { rollupOptions: { input: ['a.html', 'src/b.ts'] } } }"),
        ("w.config.js", "module.exports = { entry: './src/w.js', resolve: { alias: [{ find: 'x', replacement: './y' }] } }"),
    ], "path string, content string")
    got = {(r.kind, r.name, r.value) for r in M.config_facts(tools).collect()}
    assert got == {("alias", "@", "./src"), ("alias", "lib", "./lib"), ("alias", "x", "./y"), ("entry", None, "a.html"), ("entry", None, "src/b.ts"), ("entry", None, "./src/w.js")}
    assert M.merged_config({"a": 1, "options": {"x": 1}}, {"options": {"y": 2}}, {"a": 3}) == {"a": 3, "options": {"x": 1, "y": 2}}


def test_project_files_and_monorepo_configs(spark):
    config = spark.createDataFrame([
        ("a/tsconfig.json", '{"include": ["src", "*.ts"], "exclude": ["src/**/*.spec.ts"]} // end'),
        ("b/tsconfig.json", '{"exclude": ["gen"]}'),
        ("c/tsconfig.json", "broken"),
    ], "path string, content string")
    paths = ["a/src/x.ts", "a/src/d/y.spec.ts", "a/z.ts", "a/other/w.ts", "b/gen/g.ts", "b/h.ts", "c/i.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "file_path string")
    got = {(r.path, r.file_path) for r in M.project_files(files, M.include_exclude(config)).collect()}
    assert got == {("a/tsconfig.json", "a/src/x.ts"), ("a/tsconfig.json", "a/z.ts"), ("b/tsconfig.json", "b/h.ts")}
    top = spark.createDataFrame([("turbo.json", '{"tasks": {"build": {"dependsOn": ["^build"]}}}'), ("x/nx.json", "{}")], "file_path string, content string")
    assert [tuple(r) for r in M.monorepo_configs(top).collect()] == [("turbo.json", ".tasks.build.dependsOn[0]", "^build")]


def test_layered_config(spark):
    files = spark.createDataFrame([
        ("own/config.json", '{"a": 1, "b": 1, "options": {"x": 1}} // last'),
        ("package.json", '{"workspaces": ["p/*"], "own": {"b": 2, "options": {"y": 2}}}'),
        ("own.config.js", "module.exports = { b: 9 }"),
    ], "file_path string, content string")
    assert M.layered_config(files, "own", {"c": 3}, {"a": 0, "d": 4}) == {"a": 1, "b": 2, "c": 3, "d": 4, "options": {"x": 1, "y": 2}, "workspace": True}
    assert M.layered_config(files.where("file_path = 'x'"), "own") == {}


def test_alias_scopes_before_places(spark):
    """However many patterns an inner scope has, it goes before an outer one."""
    from loomgraph.operators import resolve

    aliases = spark.createDataFrame([("", "@/*", "outer/*", 0), ("a", "@/*", "inner/*", 5000)], "scope_dir string, pattern string, target string, pos int")
    imports = spark.createDataFrame([("a/x.ts", "@/f")], "file_path string, specifier string")
    files = spark.createDataFrame([("outer/f.ts",), ("a/inner/f.ts",)], "file_path string")
    assert resolve.resolve(imports, files, aliases=aliases).first().target == "a/inner/f.ts"


def test_manifest_text_round_trip(spark):
    deps = spark.createDataFrame([("m", "b", "1", "dependencies"), ("m", "a", "2", "dependencies"), ("m", "c", "3", "devDependencies")], "manifest_path string, package string, version string, dep_kind string")
    out = M.manifest_text(deps)
    assert out.first().json == '{"dependencies":{"a":"2","b":"1"},"devDependencies":{"c":"3"}}'
    assert M.dependencies(out.withColumnRenamed("json", "content")).count() == 3


def test_scripts_plugins_and_installs(spark):
    scripts = spark.createDataFrame([("m", 'NODE_ENV=x tsc -p . && npx "vitest" run; node a.js | jest')], "manifest_path string, script string")
    commands = rules.script_commands(scripts)
    assert {r.command for r in commands.collect()} == {"tsc", "vitest", "node", "jest"}
    assert {r.package for r in rules.program_packages(commands, plugins.programs(spark)).collect()} == {"typescript", "vitest", "node", "jest"}
    assert plugins.activations(spark).count() == 104
    files = spark.createDataFrame([("a/vite.config.ts",), ("b/x.ts",)], "file_path string")
    deps = spark.createDataFrame([("m", "zod", "1", "dependencies"), ("m", "vite", "1", "dependencies")], "manifest_path string, package string, version string, dep_kind string")
    active = rules.active_plugins(plugins.config_files(spark), plugins.packages(spark), plugins.activations(spark), files, deps)
    assert {r.plugin for r in active.collect()} == {"vite", "zod"}
    wrong = rules.plugin_requirements(plugins.packages(spark).join(active, "plugin", "left_semi"), deps)
    assert [tuple(r) for r in wrong.collect()] == [("vite", "vite", "should be a devDependency")]
    missing = spark.createDataFrame([("", "b"), ("", "a"), ("p", "c")], "root_dir string, package string")
    locks = spark.createDataFrame([("", "package-lock.json"), ("", "yarn.lock")], "root_dir string, file_name string")
    assert {tuple(r) for r in rules.install_commands(missing, locks).collect()} == {("", "yarn add a b"), ("p", "npm install c")}


def test_scalars(spark):
    one = spark.range(1)

    def v(c):
        return one.select(c.alias("v")).first().v

    assert [v(S.package_name(F.lit(x))) for x in ("@a/b/c", "x/y", "z")] == ["@a/b", "x", "z"]
    assert v(S.join_path(F.lit("a/b"), F.lit("../c/./d"))) == "a/c/d" and v(S.join_path(F.lit(""), F.lit("./x"))) == "x"
    assert v(S.normal_path(F.lit("c:\\a\\.\\b//c"))) == "C:/a/b/c"
    assert v(S.strip_comments(F.lit('{"a": "x // y", /* z */ "b": [1, 2,], }'))).replace(" ", "") == '{"a":"x//y","b":[1,2]}'
    assert v(S.ancestors(F.lit("a/b/c.ts"))) == ["", "a", "a/b"]
    match = lambda g, p: v(F.regexp(F.lit(p), S.glob_regex(F.lit(g))))
    assert match("src/**", "src/a/b.ts") and match("src/*.ts", "src/a.ts") and not match("src/*.ts", "src/a/b.ts") and match("**/*.ts", "x.ts") and match("*", "a/b")
    assert v(S.line_number(F.lit("a\nb\nc"), F.lit(4))) == 3


def test_snapshots_and_watch(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    schema = "file_path string, content string"
    seen = []

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        inc.watch(spark, str(folder), str(state), lambda df: seen.append(sorted((r.file_path, r.change) for r in df.collect())), str(tmp_path / "cp")).awaitTermination(120)

    put([("a", "1"), ("b", "1")])
    run()
    time.sleep(0.1)
    put([("a", "1"), ("b", "2"), ("c", "1")])
    run()
    time.sleep(0.1)
    put([("a", None), ("c", "1")])
    run()
    assert seen == [[("a", "added"), ("b", "added")], [("b", "changed"), ("c", "added")], [("a", "deleted")]]
    assert {r.file_path for r in inc.current(spark, str(state)).collect()} == {"b", "c"}
    put([("d", "1")])
    broken = inc.watch(spark, str(folder), str(state), lambda df: 1 / 0, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="division"):
        broken.awaitTermination(120)
    assert {r.file_path for r in inc.current(spark, str(state), 3).collect()} == {"b", "c"}
    run()  # the batch is run again, with the snapshot it had
    assert seen[-1] == [("d", "added")]
    edges = spark.createDataFrame([("x", "b"), ("y", "x"), ("z", "q")], "src string, dst string")
    assert {(r.node, r.hops) for r in inc.affected(spark.createDataFrame([("b",)], "file_path string"), edges).collect()} == {("b", 0), ("x", 1), ("y", 2)}


def test_graph_report(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert sorted(r.json for r in report.graph_json(edges).collect()) == ['{"id":1,"name":"a","targets":[2,3]}', '{"id":2,"name":"b","targets":[3]}', '{"id":3,"name":"c","targets":[]}']


def test_files_of_one_partition_are_dealt_out(spark):
    """Few bytes of input are one task of a scan; parsing them takes many. Kinds that aren't asked for aren't written."""
    from loomgraph.sources import scan

    made = spark.createDataFrame([(f"p{i}.ts", f"draw({{ x: {i} }});") for i in range(60)], "file_path string, content string").coalesce(1)
    got = scan.facts(made, "shape")
    assert sum(n > 0 for n in got.rdd.glom().map(len).collect()) > 1
    assert {r.kind for r in got.collect()} == {"shape"} and got.count() == 60
    assert scan.view(scan.facts(made), "shape").exceptAll(scan.view(got, "shape")).isEmpty()


def test_edges_of_computed_imports_are_whole_and_small(spark, tmp_path, monkeypatch):
    """Every edge is a row, as often as before; they are dealt by their number and stored in far less than a byte each."""
    monkeypatch.setattr(resolve, "_EDGES", 20_000, raising=False)
    below = [f"a/d/{i * 7919}.ts" for i in range(2000)]
    above = [f"a/f{i}.ts" for i in range(60)]
    files = spark.createDataFrame([(f,) for f in [*below, *above, "a/d/0.ts", None]], "file_path string")
    asked = [(f, False, "./d") for f in [*above, above[0]]] + [("a/d/0.ts", False, "."), ("a/x.ts", True, "./d"), ("a/y.ts", False, None), ("a/z.ts", False, "./none")]
    edges = resolve.glob_edges(spark.createDataFrame(asked, "file_path string, is_literal boolean, dir_prefix string"), files)
    edges.write.parquet(str(tmp_path / "edges"))
    parts = list((tmp_path / "edges").glob("*.parquet"))
    got = sorted((r.src, r.dst, r.kind) for r in edges.collect())
    assert got == sorted((s, d, "glob") for s, ds in [*((a, [*below, "a/d/0.ts"]) for a in above), ("a/d/0.ts", below[1:])] for d in ds)
    assert len(parts) > 2 and sum(p.stat().st_size for p in parts) < len(got) // 2


def test_computed_imports_of_nothing(spark):
    none = spark.createDataFrame([], "file_path string, is_literal boolean, dir_prefix string")
    assert resolve.glob_edges(none, spark.createDataFrame([("a.ts",)], "file_path string")).collect() == []

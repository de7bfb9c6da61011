"""Small trees with the shapes that matter, and what must be found in them."""

import json

import pytest

from loomgraph.plans.analysis import Analysis


def tree(tmp_path, files):
    for name, text in files.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text if isinstance(text, str) else json.dumps(text))
    return f"file://{tmp_path}"


def exports(a):
    return {(r.file_path, r.name) for r in a.dead_exports.collect()}


def orphans(a):
    return {r.file_path for r in a.orphan_files.collect()}


def deps(a):
    return {r.package for r in a.unused_dependencies.collect()}


def test_basic(spark, tmp_path):
    root = tree(tmp_path, {
        "package.json": {"name": "a", "main": "src/index.ts", "dependencies": {"left": "1", "right": "1"}, "devDependencies": {"typescript": "5", "@types/node": "1"}, "scripts": {"b": "tsc && npx right-cli"}},
        "src/index.ts": "import { one } from './math.js';\nimport left from 'left';\nconsole.log(one(2), left);\n",
        "src/math.ts": "export function one(x: number) { return x }\nexport function two() { return 2 }\n",
        "src/alone.ts": "export const x = 1;\n",
        "node_modules/left/index.js": "module.exports = 1",
    })
    a = Analysis(spark, root)
    assert exports(a) == {("src/math.ts", "two")}
    assert orphans(a) == {"src/alone.ts"}
    assert deps(a) == {"right"}
    assert a.unlisted_dependencies.count() == 0


def test_named_reexport_and_barrels(spark, tmp_path):
    root = tree(tmp_path, {
        "package.json": {"main": "src/index.ts"},
        "src/index.ts": "import { used, Renamed } from './lib';\nimport * as ns from './space';\nused(); new Renamed(); ns.deep(); const k = 'folded'; ns[k];\n",
        "src/lib/index.ts": "export * from './a';\nexport { inner as Renamed, spare } from './b';\nexport * from './index';\n",
        "src/lib/a.ts": "export const used = () => 1;\nexport const unused = 2;\nexport interface Shape { a: string }\n",
        "src/lib/b.ts": "class inner {}\nexport { inner, inner as spare };\nexport default 3;\n",
        "src/space.ts": "export const deep = 1, other = 2;\nexport const folded = 3;\nexport function never() {}\n",
    })
    a = Analysis(spark, root)
    assert exports(a) == {("src/lib/a.ts", "unused"), ("src/lib/a.ts", "Shape"), ("src/lib/index.ts", "spare"), ("src/lib/b.ts", "spare"), ("src/space.ts", "never"), ("src/space.ts", "other")}
    assert orphans(a) == set()


def test_members_side_effects_and_orphan_directory(spark, tmp_path):
    root = tree(tmp_path, {
        "package.json": {"main": "src/index.ts"},
        "src/index.ts": "import './setup';\nimport { Service, table } from './service';\nnew Service().run();\nconsole.log(table.left);\n",
        "src/setup.ts": "globalThis.flag = true;\nexport const effect = 1;\n",
        "src/service.ts": "export class Service {\n  private secret = 1;\n  run() { return this.help() }\n  help() { return 1 }\n  idle(): void {}\n}\nexport const table = { left: 1, right: 2 };\n",
        "src/dead/a.ts": "import './b';\n",
        "src/dead/b.ts": "import { x } from './a';\n",
    })
    a = Analysis(spark, root)
    assert orphans(a) == {"src/dead/a.ts", "src/dead/b.ts"}
    assert {(r.name, r.member) for r in a.dead_members.collect()} == {("Service", "idle"), ("table", "right")}
    assert exports(a) == {("src/setup.ts", "effect")}


def test_cycles_dynamic_imports_and_suppressions(spark, tmp_path):
    root = tree(tmp_path, {
        "package.json": {"main": "src/index.ts"},
        "src/index.ts": "import './c1'; import './p'; import './self';\nconst load = (n: string) => import(`./plugins/${n}.js`);\nload('x');\n",
        "src/c1.ts": "import './c2'",
        "src/c2.ts": "import './c3'",
        "src/c3.ts": "import './c1'",
        "src/p.ts": "const q = require('./q');",
        "src/q.ts": "require('./p');",
        "src/self.ts": "import './self';",
        "src/plugins/x.ts": "export default 1;\n",
        "src/quiet.ts": "// loomgraph-ignore unused-file\nexport const a = 1;\n",
        "src/loud.ts": "/* loomgraph-ignore * */ export const a = 1;\n",
        "src/plain.ts": "export const a = 1;\n",
    })
    a = Analysis(spark, root)
    assert {r.path for r in a.cycles.collect()} == {"src/c1.ts -> src/c2.ts -> src/c3.ts -> src/c1.ts", "src/p.ts -> src/q.ts -> src/p.ts", "src/self.ts -> src/self.ts"}
    found = {(r.kind, r.file_path) for r in a.findings().collect()}
    assert {p for k, p in found if k == "unused-file"} == {"src/plain.ts"}


def test_monorepo(spark, tmp_path):
    root = tree(tmp_path, {
        "package.json": {"private": True, "workspaces": ["packages/*"]},
        "tsconfig.json": '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["packages/lib/src/*"],}, }, }',
        "packages/app/package.json": {"name": "@x/app", "main": "src/main.ts", "dependencies": {"zed": "^1.0.0"}},
        "packages/app/src/main.ts": "import { a } from '@x/ui';\nimport { b } from '@lib/deep/b';\nimport zed from 'zed';\nimport miss from 'missing/sub';\nimport fs from 'fs';\nconsole.log(a, b, zed, miss, fs);\n",
        "packages/ui/package.json": {"name": "@x/ui", "exports": {".": {"import": "./src/index.ts"}}, "dependencies": {"zed": "^2.0.0"}},
        "packages/ui/src/index.ts": "export * from './a';\n",
        "packages/ui/src/a.ts": "export const a = 1;\nexport const shown = 2;\n",
        "packages/lib/package.json": {"name": "@x/lib"},
        "packages/lib/src/deep/b.ts": "export const b = 1;\nexport const c = 2;\n",
    })
    a = Analysis(spark, root, boundaries=[(1, "packages/app/**", "packages/lib/**", False, "app must not reach into lib")])
    assert [(r.package, r.versions) for r in a.version_mismatches.collect()] == [("zed", ["^1.0.0", "^2.0.0"])]
    assert {(r.manifest_path, r.package) for r in a.undeclared_workspace.collect()} == {("packages/app/package.json", "@x/ui")}
    assert {(r.file_path, r.package) for r in a.unlisted_dependencies.collect()} == {("packages/app/src/main.ts", "missing")}
    assert {(r.src, r.dst) for r in a.boundary_violations.collect()} == {("packages/app/src/main.ts", "packages/lib/src/deep/b.ts")}
    assert exports(a) == {("packages/lib/src/deep/b.ts", "c")}
    assert deps(a) == {"zed"} and {r.manifest_path for r in a.unused_dependencies.collect()} == {"packages/ui/package.json"}


def test_fuzzy_mode(spark, tmp_path):
    files = {
        "package.json": {"main": "src/main.ts"},
        "src/main.ts": "import * as all from './mod';\nconst name = 'byString';\nall[pick()];\nfunction pick() { return name }\n",
        "src/mod.ts": "export const byString = 1;\nexport const never = 2;\n",
    }
    root = tree(tmp_path, files)
    assert exports(Analysis(spark, root)) == {("src/mod.ts", "byString"), ("src/mod.ts", "never")}
    assert exports(Analysis(spark, root, fuzzy=True)) == {("src/mod.ts", "never")}


def test_smells_and_secrets(spark, tmp_path):
    root = tree(tmp_path, {
        "package.json": {"main": "a.js"},
        "a.js": "while (true) { work() }\nfor (;;) { if (x) break }\nif (a == b) {}\nconst r = /(a+)+$/;\n// eslint-disable-next-line\nel.addEventListener('x', f); el.addEventListener('y', f); el.removeEventListener('y', f);\nw.postMessage(() => 1);\no[key] = 1;\nconst t = 'a == b'; const token = '%s';\nprocess.env.HOME;\n" % ("ab" * 20),
    })
    a = Analysis(spark, root)
    assert sorted(r.rule for r in a.smells.collect()) == sorted(["endless-loop", "loose-equality", "slow-regex", "ignore-comment", "leaking-listener", "worker-payload", "computed-assignment", "config-read"])
    assert [(r.type, r.line) for r in a.secrets.collect()] == [("assigned-token", 9)]


def kinds(a, *names):
    if not hasattr(a, "_rows"):
        a._rows = a.findings().collect()
    return sorted((r.kind, r.file_path or r.manifest_path, r.symbol or r.package) for r in a._rows if r.kind in names)


def test_findings_of_manifests_and_tools(spark, tmp_path):
    root = tree(tmp_path, {
        "package.json": {"private": True, "workspaces": ["packages/*"], "dependencies": {"lodahs": "1", "moment": "2", "@x/ui": "1.0.0", "shared": "1", "leftpadding": "1"}, "devDependencies": {"next": "1", "typescript": "5"}, "scripts": {"lint": "eslint ."}},
        ".github/workflows/ci.yml": "jobs:\n  a:\n    steps:\n      - run: npx leftpadding --check\n",
        "vite.config.ts": "export default {}\n",
        "packages/app/package.json": {"name": "@x/app", "main": "src/main.ts", "dependencies": {"@x/ui": "workspace:*"}},
        "packages/app/src/main.ts": "import shared from 'shared';\nimport { a, spare } from '@x/ui';\nconsole.log(shared, a);\n",
        "packages/ui/package.json": {"name": "@x/ui", "exports": "./src/index.ts"},
        "packages/ui/src/index.ts": "export const a = 1, spare = 2;\n",
        "packages/bare/package.json": {"name": "@x/bare"},
        "packages/bare/other.txt": "",
    })
    a = Analysis(spark, root)
    assert "leftpadding" not in deps(a) and {"lodahs", "moment"} <= deps(a)
    assert kinds(a, "root-only-dependency") == [("root-only-dependency", "package.json", "shared")]
    assert kinds(a, "workspace-protocol") == [("workspace-protocol", "package.json", "@x/ui")]
    assert kinds(a, "no-entry") == [("no-entry", "packages/bare/package.json", "@x/bare")]
    assert kinds(a, "unused-binding") == [("unused-binding", "packages/app/src/main.ts", "spare")]
    assert kinds(a, "typosquat") == [("typosquat", None, "lodahs")]
    assert ("plugin", None, "vite") in kinds(a, "plugin") and ("migration", None, "moment") in kinds(a, "migration")
    assert kinds(a, "no-lockfile") == [("no-lockfile", "package.json", None)]
    assert ("unused-binary", None, "tsc") in kinds(a, "unused-binary")


def test_shapes_types_and_copies(spark, tmp_path):
    body = "const r = p + q; if (r > 10) { return r * 2 } return p.call(q, r, 1)"
    root = tree(tmp_path, {
        "package.json": {"main": "a.ts"},
        "a.ts": f"import './b'; let t = 1; t = 'x'; let n = null; n.f; draw({{ x: 1 }}); draw({{ x: 1, y: 2 }});\nfunction one(p, q) {{ {body} }}\none(1, 2);\n",
        "b.ts": f"function two(s, q) {{ {body.replace('p', 's')} }}\ntwo(1, 2);\n",
    })
    found = {(r.file_path, r.rule) for r in Analysis(spark, root).smells.collect()}
    assert {("a.ts", "type-change"), ("a.ts", "null-access"), ("a.ts", "polymorphic-call"), ("b.ts", "cloned-body")} <= found


def test_components_keep_their_lines_and_broken_sources_are_told(spark, tmp_path, monkeypatch):
    root = tree(tmp_path, {
        "package.json": {"main": "main.ts"},
        "main.ts": "import './view.vue';\n",
        "view.vue": "<template>\n  <b>{{ x }}</b>\n</template>\n\n<script lang='ts'>\nexport const x = 1;\n</script>\n",
    })
    a = Analysis(spark, root)
    assert [(r.name, r.line, r.column) for r in a.exports.collect()] == [("x", 6, 13)]
    assert [(r.template_kind, r.value.strip()) for r in a.view("template").collect()] == [("markup", "<b>{{ x }}</b>")]
    a.facts = a.facts.unionByName(spark.createDataFrame([("main.ts", "failed", '{"error": "why"}')], "file_path string, kind string, fact string"))
    assert ("unreadable", "main.ts", None) in kinds(a, "unreadable")


def test_registered_plugins_conventions_and_hidden_folders(spark, tmp_path):
    from loomgraph.plans import plugins

    files = {
        "package.json": {"main": "main.ts", "dependencies": {"own-tool": "1"}},
        "main.ts": "import { Made } from './made';\nnew Made();\n",
        "made.ts": "export class Made { onInit() {} idle() {} }\n",
        "deep/hooked/h.ts": "export const start = 1;\nexport const spare = 2;\n",
        "deep/start.ts": "ownTool();\n",
        "deep/index.ts": "export const x = 1;\n",
    }
    own = plugins.define("own", packages=("own-tool",), routes=(r"(^|/)hooked/",), contracts=("start",), needles=("ownTool(",), protected_members=("onInit",))
    a = Analysis(spark, tree(tmp_path, files), extra=[own])
    assert orphans(a) == {"deep/index.ts"} and exports(a) == {("deep/hooked/h.ts", "spare")}
    assert {r.member for r in a.dead_members.collect()} == {"idle"}
    assert orphans(Analysis(spark, a.root, extra=[own], conventions=True)) == set()
    assert {(r.plugin, r.reason) for r in a.entry_points.where("reason = 'needle'").selectExpr("file_path as plugin", "reason").collect()} == {("deep/start.ts", "needle")}


def test_large_tree_with_known_counts(spark, tmp_path):
    """Three packages; a chain of files is used in each, the rest is not; half of the exports of used files are."""
    files = {"package.json": {"private": True, "workspaces": ["packages/*"]}}
    used = {"core": 6, "bridge": 6, "app": 5}
    total = {"core": 40, "bridge": 30, "app": 20}
    after = {"core": None, "bridge": "core", "app": "bridge"}
    for p, n in total.items():
        files[f"packages/{p}/package.json"] = {"name": f"@n/{p}", "main": "src/f0.ts", "dependencies": {f"@n/{after[p]}": "workspace:*"} if after[p] else {}}
        for i in range(n):
            onward = f"import {{ live{i + 1} }} from './f{i + 1}';\nlive{i + 1}();\n" if i + 1 < used[p] or i >= used[p] and i + 1 < n else ""
            across = f"import {{ live0 as other }} from '@n/{after[p]}';\nother();\n" if i == 0 and after[p] else ""
            files[f"packages/{p}/src/f{i}.ts"] = f"{onward}{across}export function live{i}() {{}}\nexport function dead{i}() {{}}\n"
    a = Analysis(spark, tree(tmp_path, files))
    assert len(orphans(a)) == sum(total.values()) - sum(used.values())
    dead = exports(a)
    assert len(dead) == sum(u - 1 for u in used.values()) and all(n.startswith("dead") for _, n in dead)
    assert deps(a) == set()


def test_session(spark, tmp_path):
    from loomgraph.plans.session import STAGES, Session
    from loomgraph.streaming import incremental

    files = {
        "package.json": {"main": "a.ts", "dependencies": {"left": "1"}},
        "a.ts": "import { b } from './b';\nimport left from 'left';\nb(left);\n",
        "b.ts": "import { c } from './c';\nexport const b = () => c;\nexport const named = 1;\nexport const idle = 2;\n",
        "c.ts": "export const c = 'named';\n",
        "lone.ts": "export const l = 1;\n",
    }
    root, state, heard = tree(tmp_path / "t", files), str(tmp_path / "state"), []
    s = Session(spark, root, state)
    s.on("*", lambda event, fields: heard.append((event, fields)))
    with pytest.raises(RuntimeError):
        s.impact("a.ts")
    found = s.analyze()
    assert s.results() is found and not s.is_processing()
    assert [e for e, _ in heard] == ["initialize", *(f"{x}:{y}" for x in STAGES for y in ("start", "complete")), "analysis:complete"]
    assert heard[-2][1]["percentage"] == 100 and {"unused-file", "unused-export"} <= {r.kind for r in found.collect()}
    got = {(r.kind, r.name, r.hops, r.note) for r in s.impact("c.ts").collect()}
    assert got == {("dependent", "b.ts", None, None), ("affected", "b.ts", 1, "DANGEROUS"), ("affected", "a.ts", 2, "RISKY"), ("export", "c", None, "variable")}
    assert ("blocked", "named", None, "named in a string or chain") in {tuple(r) for r in s.impact("b.ts", "named").collect()}
    assert ("safe", "idle", None, None) in {tuple(r) for r in s.impact("b.ts", "idle").collect()}
    assert ("blocked", "b", None, "used by another file") in {tuple(r) for r in s.impact("b.ts", "b").collect()}
    plan = {(r.action, r.file_path, r.name) for r in s.plan().collect()}
    assert {("delete-file", "lone.ts", None), ("remove-export", "b.ts", "idle")} <= plan and ("remove-export", "b.ts", "named") not in plan
    edit = s.plan(files=False, dependencies=False).where("name = 'idle'").first()
    assert files["b.ts"][edit.start : edit.end] == "idle"
    assert s.metrics() == {"scanned": 5, "hits": 0, "misses": 5} and "next" in s.plugins()
    incremental.save(s.analysis.files.select("file_path", "sha256").where("file_path <> 'c.ts'"), f"{state}/0/snapshot")
    assert s.metrics()["hits"] == 4 and s.summary()[1:] == ["files scanned: 5", "taken from the store: 80.0%"]
    with pytest.raises(ValueError):
        s.impact("nobody.ts")


def test_sources_that_cannot_be_read_keep_their_imports(monkeypatch):
    from loomgraph.sources import extract

    def fail(*_):
        raise ValueError("no")

    code = "import { a } from './a';\nconst b = require(\"b\");\nawait import('./c');\n"
    whole = {json.loads(v)["specifier"] for k, v in extract.rows("x.ts", code) if k == "import"}
    monkeypatch.setattr(extract, "_outline", fail)
    found = [(k, json.loads(v)) for k, v in extract.rows("x.ts", code)]
    assert whole == {"./a", "b", "./c"} == {v["specifier"] for k, v in found if k == "import"}
    assert [k for k, _ in found if k == "failed"] == ["failed"]


def test_extraction_takes_linear_time():
    import time

    from loomgraph.sources.extract import facts

    line = "export const v{0} = call{0}(a{0}.b, `t${{c{0}}}`), w{0} = {{ k: [1, 2], m: 'x' }};\nimport('./m{0}'); if (v{0}) {{ while (true) {{ break }} }}\n"
    took = []
    for n in (1000, 8000):
        code = "".join(line.format(i) for i in range(n))
        began = time.time()
        found = list(facts("a.ts", code))
        took.append(time.time() - began)
        assert sum(k == "export" for k, _ in found) == 2 * n
    assert len(code) > 1_000_000 and took[1] < 8 * took[0] * 2.5 + 1


@pytest.mark.parametrize(
    ("code", "names"),
    [
        ("export const a = 1, b: Map<string, number> = f(x, y), c = [1, 2]\nfoo, d", ["a", "b", "c"]),
        ("export let a,\n  b = g(),\n  c;\nd = 1, e", ["a", "b", "c"]),
        ("export const a = x\n  ? y : z, b = (p, q) => p, c", ["a", "b", "c"]),
    ],
)
def test_all_declarators_are_exported(code, names):
    from loomgraph.sources.extract import facts

    assert [f["name"] for k, f in facts("a.ts", code) if k == "export"] == names


@pytest.mark.parametrize("code", ["", "`${`a${1}`}` + /[/]/.test('x')", "import {", "export {", "a = b / c / d; // '", "'unterminated\nexport const x = 1", "{{{{", "}}}}"])
def test_scanner_survives(code):
    from loomgraph.sources.extract import mask, rows

    assert len(mask(code)[0]) == len(code)
    assert all(k != "failed" for k, _ in rows("a.ts", code))

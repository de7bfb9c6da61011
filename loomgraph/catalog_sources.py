"""Queries of sources, extraction, entries and rules over inputs written from the driver tables, with their SQL twins.

Each input takes several shapes by a number column, so that a rule meets what it must
take and what it must leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.catalog import EDGES, PATHS, Tables, _paths, _pick, query
from loomgraph.functions import scalars as S
from loomgraph.operators import resolve, rules, secrets
from loomgraph.plans import plugins, report
from loomgraph.sources import manifests, scan

# --- files and configuration


@query(
    "s6_package_directories",
    """WITH f AS (SELECT DISTINCT 'pk' || p_size AS root_dir, CASE p_partkey % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'tsconfig.build.json' WHEN 2 THEN 'vite.config.ts' WHEN 3 THEN 'x.ts' ELSE 'deep/tsconfig.json' END AS name FROM part)
  SELECT root_dir, CASE name WHEN 'package.json' THEN 'manifest' WHEN 'tsconfig.build.json' THEN 'tsconfig' ELSE 'config' END AS kind, root_dir || '/' || name AS file_path FROM f
  WHERE name IN ('package.json', 'tsconfig.build.json', 'vite.config.ts') AND root_dir IN (SELECT root_dir FROM f WHERE name = 'package.json')""",
)
def _(t: Tables) -> DataFrame:
    name = _pick("p_partkey", "package.json", "tsconfig.build.json", "vite.config.ts", "x.ts", "deep/tsconfig.json")
    return manifests.package_directories(t.part.select(F.concat(F.lit("pk"), F.col("p_size").cast("string"), F.lit("/"), name).alias("file_path")).distinct())


@query("s9_project_files", f"WITH {PATHS} SELECT DISTINCT 'tsconfig.json' AS path, p AS file_path FROM paths WHERE regexp_matches(p, '[.]html$') AND NOT regexp_matches(p, '^[^/]*/de/')")
def _(t):
    files = _paths(t).select(F.col("p").alias("file_path")).distinct()
    config = t.spark.createDataFrame([("tsconfig.json", '{ "include": ["**/*.html"], /* no */ "exclude": ["*/de"], }')], "path string, content string")
    return manifests.project_files(files, manifests.include_exclude(config))


@query("s10_monorepo_configs", "SELECT CASE event_id % 3 WHEN 0 THEN 'turbo.json' ELSE 'nx.json' END AS file_name, '.k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE event_id % 3 < 2 AND json_extract(props, '$.k') IS NOT NULL")
def _(t):
    files = t.events.select(_pick("event_id", "turbo.json", "nx.json", "lerna.json").alias("file_path"), F.concat(F.lit("// note\n"), "props").alias("content"))
    return manifests.monorepo_configs(files).where("path = '.k'")


@query("s11_framework_configs", "SELECT p_partkey || '/a.config.' || CASE p_partkey % 3 WHEN 0 THEN 'ts' ELSE 'mjs' END AS path FROM part WHERE p_partkey % 3 < 2")
def _(t):
    files = t.part.select(F.concat(F.col("p_partkey").cast("string"), F.lit("/a.config."), _pick("p_partkey", "ts", "mjs", "json")).alias("file_path"), F.lit("").alias("content"))
    return manifests.framework_configs(files).select("path")


@query("s13_workflow_scripts", "SELECT '.github/workflows/' || event_id || '.yml' AS file_path, unnest(['npm ' || event_type, event_type || ' --x']) AS script FROM events WHERE event_id % 2 = 0")
def _(t):
    folder = _pick("event_id", ".github/workflows/", "docs/workflows/")
    content = F.concat(F.lit("jobs:\n  a:\n    steps:\n      - run: npm "), "event_type", F.lit("\n      - name: run\n        run: |\n          "), "event_type", F.lit(" --x\n"))
    return scan.workflows(t.events.select(F.concat(folder, F.col("event_id").cast("string"), F.lit(".yml")).alias("file_path"), content.alias("content")))


@query("s12_metadata", "SELECT event_id FROM events WHERE event_id % 5 IN (0, 2, 3)")
def _(t):
    files = t.events.select("event_id", F.concat(F.lit("a"), _pick("event_id", ".json5", ".jsonl", ".html", ".yml", ".ts")).alias("file_path"))
    return scan.metadata(files).select("event_id")


@query("x21_deep_leaves", "SELECT n_nationkey, repeat('.a', 20) AS path, n_name AS value FROM nation UNION ALL SELECT n_nationkey, repeat('.a', 19) || '.l[0]', CAST(n_regionkey AS VARCHAR) FROM nation")
def _(t):
    text = F.concat(F.repeat(F.lit('{"a":'), F.lit(19)), F.lit('{"a":"'), "n_name", F.lit('","l":['), F.col("n_regionkey").cast("string"), F.lit("]}"), F.repeat(F.lit("}"), F.lit(19)))
    return manifests.leaves(t.nation.select("n_nationkey", text.alias("json")), "json", ["n_nationkey"])


@query("k8_config_templates", "SELECT plugin, plugin || '.config.js' AS file_name, 'use ' || plugin AS template FROM (SELECT DISTINCT p_brand AS plugin FROM part) WHERE plugin NOT IN (SELECT p_brand FROM part WHERE p_size = 7)")
def _(t):
    brands = t.part.select(F.col("p_brand").alias("plugin")).distinct()
    name = F.concat("plugin", F.lit(".config.js"))
    files = t.part.where("p_size = 7").select(F.concat(F.lit("x/"), "p_brand", F.lit(".config.js")).alias("file_path"))
    return manifests.config_templates(brands, brands.select("plugin", name.alias("file_name")), files, brands.select("plugin", name.alias("file_name"), F.concat(F.lit("use "), "plugin").alias("template")))


@query("k5_edit_plan", "SELECT p_partkey AS file_path, CAST(p_size AS BIGINT) AS first, CAST(p_size + 3 AS BIGINT) AS last, '' AS replacement, p_brand AS name FROM part WHERE p_size % 2 = 0")
def _(t):
    dead = t.part.select(F.col("p_partkey").alias("file_path"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("start"), (F.col("p_size") + 3).alias("end"), F.col("p_brand").alias("name"))
    return report.edit_plan(dead).select("file_path", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"), "replacement", "name")


# --- entries, links, rules


@query("p2_core_tooling", "SELECT page_id, page_id % 14 < 9 AS hit FROM pages")
def _(t):
    yes = ["src/a.cy.ts", "lib/B.stories.tsx", "x/jest.config.ts", "packages/a/index.ts", "src/main.js", "web/app/page.tsx", "src/pages/deep/x.vue", "src/routes/+layout.server.ts", "app/_layout.tsx"]
    no = ["src/cy.ts", "src/indexes.ts", "src/domain.ts", "src/page.tsx", "app/pages.ts"]
    return t.pages.select("page_id", rules.core_tooling(_pick("page_id", *yes, *no)).alias("hit"))


@query("p8_orphans", f"WITH RECURSIVE {EDGES}, r AS (SELECT p_partkey AS node FROM part WHERE p_size = 1 UNION SELECT dst FROM r JOIN edges ON src = node) SELECT CAST(p_partkey AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '.spec.ts' ELSE '.ts' END AS file_path FROM part WHERE p_partkey NOT IN (SELECT node FROM r) AND p_partkey % 3 <> 0")
def _(t):
    name = lambda c: F.concat(F.col(c).cast("string"), F.when(F.col(c) % 3 == 0, ".spec.ts").otherwise(".ts"))
    edges = t.edges().select(name("src").alias("src"), name("dst").alias("dst"))
    return rules.orphans(t.part.select(name("p_partkey").alias("file_path")), edges, t.entries().select(name("node").alias("file_path")))


@query(
    "p11_global_names",
    """WITH e AS (SELECT p_partkey AS file_path, CASE WHEN p_size % 5 = 0 THEN 'toString' ELSE p_brand END AS name, p_size FROM part),
  w AS (SELECT name, count(DISTINCT file_path) AS files, min(file_path) AS one FROM e WHERE p_size <= 10 AND name <> 'toString' GROUP BY name)
  SELECT file_path, e.name FROM e LEFT JOIN w ON w.name = e.name WHERE NOT (p_size = 1) AND (files IS NULL OR (files = 1 AND one = file_path))""",
)
def _(t):
    e = t.part.select(F.col("p_partkey").alias("file_path"), F.when(F.col("p_size") % 5 == 0, "toString").otherwise(F.col("p_brand")).alias("name"), "p_size")
    used = e.where("p_size = 1").select("file_path", "name")
    everything = e.select(F.col("file_path").alias("node"))
    return rules.dead_exports(e.select("file_path", "name"), used, everything, e.where("false").select("file_path"), e.where("p_size <= 10").select("file_path", "name"))


@query("j14_sandbox", f"WITH {EDGES} SELECT 'a/src/core/' || src AS src, 'b/src/network/' || dst AS dst, CAST(1 AS BIGINT) AS rule_order, 'src/core must not reach into src/network' AS message FROM edges WHERE src % 2 = 0 AND dst % 3 = 0")
def _(t):
    at = lambda c, n, yes, no: F.concat(F.when(F.col(c) % n == 0, yes).otherwise(no), F.col(c).cast("string")).alias(c)
    edges = t.edges().select(at("src", 2, "a/src/core/", "a/src/ui/"), at("dst", 3, "b/src/network/", "b/src/core/"))
    table = t.spark.createDataFrame(rules.SANDBOX, "rule_order long, from_glob string, to_glob string, allow boolean, message string")
    return rules.boundary_violations(edges, table)


@query("r13_without_lockfile", "SELECT 'p' || s_suppkey || '/q/package.json' AS manifest_path, 'p' || s_suppkey || '/q' AS root_dir FROM supplier WHERE s_suppkey % 4 = 3 OR s_suppkey % 4 = 2")
def _(t):
    key = F.col("s_suppkey").cast("string")
    there = t.supplier.select(F.concat(F.lit("p"), key, _pick("s_suppkey", "/q/yarn.lock", "/package-lock.json", "/q/r/yarn.lock", "/q/yarn.lock.bak")).alias("file_path"))
    own = t.supplier.select(F.concat(F.lit("p"), key, F.lit("/q/package.json")).alias("manifest_path"), F.concat(F.lit("p"), key, F.lit("/q")).alias("root_dir"))
    return rules.without_lockfile(own, there)


@query("u9_discovered", "SELECT 'vitepress' AS plugin, p_partkey || '/.vitepress/' || p_size || '.ts' AS file_path, 'vitepress' AS package, true AS listed FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'other', p_partkey || '/own/x/' || p_size || '.ts', 'none', false FROM part WHERE p_partkey % 3 = 1")
def _(t):
    path = F.concat(F.col("p_partkey").cast("string"), _pick("p_partkey", "/.vitepress/", "/own/x/", "/vitepress/"), F.col("p_size").cast("string"), F.lit(".ts"))
    folders = t.spark.createDataFrame([("vitepress", ".vitepress", "vitepress"), ("other", "own", "none")], "plugin string, folder string, package string")
    return rules.discovered(t.part.select(path.alias("file_path")), folders, t.spark.createDataFrame([("vitepress",)], "package string"))


@query(
    "x18_export_layout",
    """WITH e AS (SELECT p_size AS f, p_partkey % 4 AS k, 'n' || p_partkey AS n FROM part)
  SELECT CAST(f AS VARCHAR) AS file_path, coalesce(string_agg(DISTINCT './' || n, ',' ORDER BY './' || n) FILTER (k = 0), '') AS stars, coalesce(string_agg(DISTINCT n || ' from ./m', ',' ORDER BY n || ' from ./m') FILTER (k = 1), '') AS namespaces,
    coalesce(string_agg(DISTINCT 'o as ' || n || ' from ./m', ',' ORDER BY 'o as ' || n || ' from ./m') FILTER (k = 2), '') AS forwarded, coalesce(string_agg(DISTINCT n, ',' ORDER BY n) FILTER (k = 3), '') AS local,
    f % 5 = 0 AS is_entry, bool_or(k < 3) AND f % 5 <> 0 AS is_barrel FROM e GROUP BY f""",
)
def _(t):
    k, n = F.col("p_partkey") % 4, F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    exports = t.part.select(
        F.col("p_size").cast("string").alias("file_path"),
        F.when(k == 0, "*").otherwise(n).alias("name"),
        F.when(k == 0, F.concat(F.lit("./"), n)).when(k < 3, "./m").alias("source_specifier"),
        F.when(k < 2, "*").when(k == 2, "o").otherwise(n).alias("original_name"),
    )
    found = rules.export_layout(exports, t.part.where("p_size % 5 = 0").select(F.col("p_size").cast("string").alias("file_path")))
    return found.select("file_path", *(F.array_join(c, ",").alias(c) for c in ("stars", "namespaces", "forwarded", "local")), "is_entry", "is_barrel")


@query("f9_callee_name", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'o.' || event_type WHEN 2 THEN 'anonymous.' || event_type WHEN 3 THEN 'o.anonymous' ELSE 'anonymous' END AS callee FROM events")
def _(t):
    k, kind = F.col("event_id") % 5, F.col("event_type")
    object_ = F.when(k == 0, kind).when((k == 1) | (k == 3), "o").when(k == 2, F.lit(None).cast("string"))
    property_ = F.when((k == 1) | (k == 2), kind).when(k == 3, "")
    return t.events.select("event_id", S.callee_name(object_, property_).alias("callee"))


@query("j1_linked_imports", "SELECT 'd/f' || p.p_partkey || '.ts' AS src, 'd/f' || q.p_partkey || CASE WHEN q.p_size % 3 = 0 THEN '/index.ts' ELSE '.ts' END AS dst, 'static' AS kind FROM part p JOIN part q ON q.p_partkey = p.p_partkey * 7 % 203 WHERE NOT (p.p_size % 2 = 0 AND q.p_size % 3 = 0)")
def _(t):
    """Specifiers without an ending, with that of compiled code, and of directories."""
    name = F.concat(F.lit("d/f"), F.col("p_partkey").cast("string"))
    files = t.part.select(F.concat(name, F.when(F.col("p_size") % 3 == 0, "/index.ts").otherwise(".ts")).alias("file_path"))
    imports = t.part.select(F.concat(name, F.lit(".ts")).alias("file_path"), F.concat(F.lit("./x/../f"), (F.col("p_partkey") * 7 % 203).cast("string"), F.when(F.col("p_size") % 2 == 0, ".js").otherwise("")).alias("specifier"), F.lit("static").alias("kind"))
    return resolve.edges(imports, resolve.resolve(imports, files))


@query("g3_glob_edges", "SELECT DISTINCT 'a/f' || p.p_partkey || '.ts' AS src, 'a/d' || q.p_size || '/' || q.p_partkey || '.ts' AS dst, 'glob' AS kind FROM part p JOIN part q ON q.p_size = p.p_size WHERE p.p_partkey % 2 = 0")
def _(t):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    files = t.part.select(F.concat(F.lit("a/d"), size, F.lit("/"), key, F.lit(".ts")).alias("file_path"))
    asked = t.part.select(F.concat(F.lit("a/f"), key, F.lit(".ts")).alias("file_path"), (F.col("p_partkey") % 2 == 1).alias("is_literal"), F.concat(F.lit("./d"), size).alias("dir_prefix"))
    return resolve.glob_edges(asked, files)


@query("u2_registry", "SELECT * FROM (VALUES ('next', 'own', true, false), ('mine', 'a', false, false), ('mine', 'b', false, true)) r(plugin, package, is_dev, is_optional)")
def _(t):
    """A plugin of a built-in name replaces it, another is added, the last registration counts."""
    made = [plugins.define("mine", packages=("old",)), plugins.define("next", packages=(("own", True, False),)), plugins.define("mine", packages=("a", ("b", False, True)))]
    return plugins.Rules(t.spark, made).packages.where("plugin in ('next', 'mine')")


@query(
    "r12_secrets_by_kind",
    """WITH d AS (SELECT doc_id, doc_id % 5 AS k, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) AS h FROM documents)
  SELECT doc_id AS file_path, CASE k WHEN 0 THEN 'assigned-token' WHEN 1 THEN 'cloud-key-id' WHEN 2 THEN 'private-key' WHEN 3 THEN 'signed-token' ELSE 'url-password' END AS type,
    CASE k WHEN 0 THEN h WHEN 1 THEN 'AKIA' || upper(substr(h, 1, 16)) WHEN 2 THEN '-----BEGIN EC PRIVATE KEY-----' WHEN 3 THEN 'eyJ' || substr(h, 1, 9) || '.eyJ' || substr(h, 1, 8) || '.' || substr(h, 1, 10) ELSE substr(h, 1, 8) END AS value, CAST(2 AS BIGINT) AS line FROM d""",
)
def _(t):
    h = F.substring(S.sha256(F.col("doc_id").cast("string")), 1, 32)
    part = lambda n: F.substring(h, 1, n)
    forms = [
        F.concat(F.lit("apiKey: '"), h, F.lit("', key = 'short'")),
        F.concat(F.lit("id=AKIA"), F.upper(part(16)), F.lit(" AKIAlower")),
        F.lit("-----BEGIN EC PRIVATE KEY-----\n-----BEGIN CERTIFICATE-----"),
        F.concat(F.lit("Bearer eyJ"), part(9), F.lit(".eyJ"), part(8), F.lit("."), part(10), F.lit(" eyJ.eyJ.x")),
        F.concat(F.lit("db://user:"), part(8), F.lit("@host db://host:80/ a:b@c")),
    ]
    k = F.col("doc_id") % 5
    content = F.concat(F.lit("first\n"), F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).when(k == 3, forms[3]).otherwise(forms[4]))
    return secrets.scan(t.documents.select(F.col("doc_id").alias("file_path"), content.alias("content"))).select("file_path", "type", "value", F.col("line").cast("long").alias("line"))


# --- extraction: three shapes of source, by part

_PASSED = r"""export { a as b{N} } from './m{S}';\nexport * from "./s{S}";\nexport * as ns{N} from './t';\nexport const v{N} = { k{S}: 1 }, w{N} = 2;\nexport default function main{N}() {}\n"""
_COMMON = r"""const dep = require('./d{S}');\nconst { x, y: z{N} } = require('e');\nmodule.exports = { f{N}, g: dep.h };\nexports.h{N} = 2; /* exports.no = 1 */\n"""
_ACTS = r"""import './side{S}';\nstart{N}();\nconst q = gql`query Q{N} { id }`;\nconst v = useThing{S}();\no[key] = 1;\nconst e = process.env.V{N};\nw.postMessage(() => 1);\n// eslint-disable-next-line\n@Deco{S}() class K {}\nconst view = <View{S} a="b" />;\nconst nat = require('./x{S}.node');\nnew Worker(new URL('./work{S}.js', import.meta.url));\n"""


def _source(t: Tables) -> DataFrame:
    def code(template: str):
        text = F.lit(template.replace("\\n", "\n"))
        return F.replace(F.replace(text, F.lit("{N}"), F.col("p_partkey").cast("string")), F.lit("{S}"), F.col("p_size").cast("string"))

    k = F.col("p_partkey") % 3
    return t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("file_path"), F.when(k == 0, code(_PASSED)).when(k == 1, code(_COMMON)).otherwise(code(_ACTS)).alias("content"))


def _view(t: Tables, kind: str) -> DataFrame:
    return scan.view(scan.facts(_source(t)), kind)


_AT = "'p' || p_partkey || '.ts' AS file_path"


@query(
    "x5_exports_of_all_kinds",
    f"""SELECT {_AT}, unnest(CASE p_partkey % 3 WHEN 0 THEN ['b' || p_partkey || ':reexport:./m' || p_size || ':a', '*:star:./s' || p_size || ':*', 'ns' || p_partkey || ':namespace:./t:*', 'v' || p_partkey || ':variable::v' || p_partkey, 'w' || p_partkey || ':variable::w' || p_partkey, 'default:function::main' || p_partkey]
    WHEN 1 THEN ['f' || p_partkey || ':commonjs::f' || p_partkey, 'g:commonjs::g', 'h' || p_partkey || ':commonjs::h' || p_partkey] ELSE [] END) AS made FROM part""",
)
def _(t):
    """X-5, X-7 and X-8."""
    return _view(t, "export").select("file_path", F.concat_ws(":", "name", "export_type", F.coalesce("source_specifier", F.lit("")), "original_name").alias("made"))


@query(
    "x9_imports_of_all_kinds",
    f"""SELECT {_AT}, unnest(CASE p_partkey % 3 WHEN 0 THEN ['./m' || p_size || ':reexport', './s' || p_size || ':reexport', './t:reexport'] WHEN 1 THEN ['./d' || p_size || ':require', 'e:require']
    ELSE ['./side' || p_size || ':side_effect', './x' || p_size || '.node:require', './work' || p_size || '.js:worker'] END) AS made FROM part""",
)
def _(t):
    return _view(t, "import").select("file_path", F.concat_ws(":", "specifier", "kind").alias("made"))


@query("x9_required_names", f"SELECT {_AT}, unnest(['*:dep', 'x:x', 'y:z' || p_partkey]) AS made FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT {_AT}, '*:nat' FROM part WHERE p_partkey % 3 = 2")
def _(t):
    return _view(t, "import_symbol").select("file_path", F.concat_ws(":", "imported_name", "local_name").alias("made"))


@query("x14_tokens", f"SELECT {_AT}, unnest(['jsx:View' || p_size, 'decorator:Deco' || p_size]) AS made FROM part WHERE p_partkey % 3 = 2")
def _(t):
    return _view(t, "token").select("file_path", F.concat_ws(":", "token_kind", "name").alias("made"))


@query("x15_side_effects", f"SELECT {_AT}, p_partkey % 3 = 2 AS acts FROM part")
def _(t):
    return _view(t, "source").select("file_path", F.col("has_side_effects").alias("acts"))


@query("x22_templates", f"SELECT {_AT}, unnest(['graphql:Q' || p_partkey, 'hook:useThing' || p_size]) AS made FROM part WHERE p_partkey % 3 = 2")
def _(t):
    return _view(t, "template").select("file_path", F.concat_ws(":", "template_kind", "name").alias("made"))


@query("r_syntax_nodes", f"SELECT {_AT}, unnest(['ComputedAssign', 'EnvRead:V' || p_partkey, 'IgnoreComment:eslint-disable', 'NativeBinding:./x' || p_size || '.node', 'WorkerPost:() => 1']) AS made FROM part WHERE p_partkey % 3 = 2")
def _(t):
    """R4, R5, R7, R8 and R10."""
    a = F.col("attrs")
    return _view(t, "node").select("file_path", F.concat_ws(":", "node_type", F.coalesce(a["name"], a["text"], a["argument"])).alias("made"))


_TYPED = r"""let a{N} = 1; a{N} = 'x{S}'; let b = 1; b = 2; let n = null; n.f{S}(); if (n) { n.g() }\ndraw({ x: 1, y{S}: 2 }); draw({ x: 1 });\nfunction one{N}(p, q) { const r = p + q; if (r > 10) { return r * 2 } return p.call(q, r, 1) }\nfunction two{N}(s, t) { const u = s + t; if (u > 20) { return u * 3 } return s.call(t, u, 4) }\n"""


def _typed(t: Tables, kind: str) -> DataFrame:
    text = F.lit(_TYPED.replace("\\n", "\n"))
    code = F.replace(F.replace(text, F.lit("{N}"), F.col("p_partkey").cast("string")), F.lit("{S}"), F.col("p_size").cast("string"))
    return scan.view(scan.facts(t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("file_path"), code.alias("content")), kind), kind)


@query("a7_shapes_from_sources", f"SELECT {_AT}, 'draw' AS callee, unnest(['x', 'x,y' || p_size]) AS shape FROM part")
def _(t):
    found = rules.named_calls(_typed(t, "shape")).select("file_path", "callee", "shape")
    return found.join(rules.polymorphic(found).select("callee"), "callee", "left_semi")


@query("a8_clones_from_sources", f"SELECT {_AT}, 'two' || p_partkey AS name FROM part")
def _(t):
    return rules.clones(_typed(t, "body"), ["file_path", "shape"], ["pre"]).select("file_path", "name")


@query("a9_types_from_sources", f"SELECT {_AT}, 'a' || p_partkey AS name, 'number' AS first_type, 'string' AS type FROM part")
def _(t):
    return rules.type_changes(_typed(t, "write"), ["file_path", "name"], ["pre"]).select("file_path", "name", "first_type", "type")


@query("j30_null_from_sources", f"SELECT {_AT}, 'n' AS name, count(*) AS uses FROM part GROUP BY p_partkey")
def _(t):
    return rules.unguarded_uses(_typed(t, "access"), ["file_path", "name"], ["pre"]).groupBy("file_path", "name").agg(F.count("*").alias("uses"))

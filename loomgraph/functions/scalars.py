"""Scalar functions over specifiers, paths, globs and source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names that are modules of the runtime itself
BUILTIN = [
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram",
    "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os",
    "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys",
    "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
]
# fixed values: words of paths that only development uses
DEV_WORDS = ["test", "spec", "mock", "fixture", "storybook", "stories", "e2e", "config", "scripts"]


def package_name(specifier: Column) -> Column:
    """The package of a specifier: two segments when scoped, else one."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def is_package(specifier: Column) -> Column:
    """Neither relative nor absolute, nor of a scheme such as node: or data:."""
    return ~specifier.rlike(r"^(\.|/|#|[a-z]+:)") & (specifier != "")


def is_builtin(package: Column) -> Column:
    return package.startswith("node:") | package.isin(*BUILTIN)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def glob_regex(glob: Column) -> Column:
    """``**`` crosses directories, ``*`` and ``?`` stay in one; all else is literal. A bare ``*`` is everything."""
    quoted = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    deep = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    flat = F.replace(F.replace(deep, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    body = F.replace(F.replace(flat, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
    return F.when(glob == "*", F.lit("^.*$")).otherwise(F.concat(F.lit("^"), body, F.lit("$")))


def evil_regex(pattern: Column) -> Column:
    """A repeated group that itself repeats: the classic shape of exponential matching."""
    return pattern.rlike(r"\([^()]*[+*][^()]*\)[+*{]")


def shape_key(types: Column) -> Column:
    """Node types in pre-order; types: array of structs (pre, node_type)."""
    return F.array_join(F.transform(F.array_sort(types), lambda t: t["node_type"]), "|")


def object_shape(keys: Column) -> Column:
    return F.array_join(F.array_sort(keys), ",")


def line_number(content: Column, offset: Column) -> Column:
    """1 for the first line; offset counts characters from 0."""
    before = F.substring(content, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def normal_path(path: Column) -> Column:
    """Slashes forward, none doubled, no ``./`` inside, drive letters upper-case."""
    p = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(\./)+", "/"), r"(?<!:)/{2,}", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when(p.rlike("^[a-z]:"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def tail_names(path: Column) -> Column:
    """A path's last segment, and its last two: what configuration files are known by."""
    return F.array_distinct(F.array(basename(path), F.array_join(F.slice(F.split(path, "/"), -2, 2), "/")))


def drop_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def relative_to(path: Column, root: Column) -> Column:
    """path below root, or path itself where it is not below."""
    return F.when(root == "", path).when(path.startswith(F.concat(root, F.lit("/"))), path.substr(F.length(root) + 2, F.length(path))).otherwise(path)


def join_path(base: Column, specifier: Column) -> Column:
    """base/specifier with ``.`` and ``..`` segments resolved; ``..`` above the root stays out."""
    whole = F.when(specifier.startswith("/"), specifier).when(base == "", specifier).otherwise(F.concat(base, F.lit("/"), specifier))
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """Directories above a path, the root ("") first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def alias_regex(pattern: Column) -> Column:
    """An alias with one ``*`` as a regex that captures what the star stands for; one without matches itself and what is below it."""
    quoted = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\/?])", r"\\$1")
    return F.when(pattern.contains("*"), F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit("(.*)")), F.lit("$"))).otherwise(F.concat(F.lit("^"), quoted, F.lit("(?:/(.*))?$")))


def strip_runner(command: Column) -> Column:
    return F.regexp_replace(F.trim(command), r"^(npx|pnpx|bunx|pnpm exec|pnpm dlx|yarn dlx|yarn|npm run|pnpm run|pnpm)\s+(-[-\w]+\s+)*", "")


def strip_comments(jsonc: Column) -> Column:
    """Comments and trailing commas out of JSON with comments; those inside strings stay."""
    bare = F.regexp_replace(jsonc, r'("(?:\\.|[^"\\])*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")
    return F.regexp_replace(bare, r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', "$1")


def is_dev_path(path: Column) -> Column:
    low = F.lower(path)
    return F.exists(F.array(*map(F.lit, DEV_WORDS)), lambda w: F.contains(low, w))


def non_serialisable(argument: Column) -> Column:
    """Arguments that a structured clone refuses: functions, symbols, weak collections."""
    return argument.rlike(r"^\s*(async\s+)?(function\b|\([^)]*\)\s*=>|\w+\s*=>)|\bSymbol\(|\bnew\s+(WeakMap|WeakSet|WeakRef|Promise)\b")


def callee_name(object_: Column, property_: Column) -> Column:
    """``obj.prop`` of a call, its bare name where there is no object, ``anonymous`` for what has no name. A call with
    neither is anonymous; an empty text is a part that is there but has no name."""
    named = lambda c: F.when(c == "", "anonymous").otherwise(c)
    return F.when(property_.isNull(), F.coalesce(named(object_), F.lit("anonymous"))).otherwise(F.concat_ws(".", F.coalesce(named(object_), F.lit("anonymous")), named(property_)))


def percentage(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * done / total + 0.5)).otherwise(100).cast("long")

"""Facts of one JavaScript or TypeScript source, by a scanner that knows strings, comments, templates and regular expressions.

`mask` blanks what is not code, keeping every offset, so the patterns that follow see
code only; of single-file components what is outside script blocks is blanked too. A
source costs time in proportion to its length. Known misses: names shadowed in inner scopes count as uses, object spreads
and re-assigned namespaces are not followed, and computed keys are folded only through
constants of the same file.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

TAG = "loomgraph-ignore"
#: Tokens of the shortest body that counts as a copy of another.
CLONE = 20
KEYWORDS = frozenset(
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let module namespace never new null number of override package private protected public readonly require return satisfies set static string super switch symbol this throw true try type typeof undefined unique unknown using var void while with yield".split()
)
_NAME = r"[A-Za-z_$][\w$]*"
_BEFORE_REGEX = re.compile(r"(?:^|[=(,;:!&|?{}\[+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await))\s*$")
_STOP = re.compile(r"[\"'`/{}]")
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


class Literal(NamedTuple):
    kind: str  # string, template, regex, comment
    start: int
    end: int
    value: str


def mask(code: str) -> tuple[str, list[Literal]]:
    """Code with literals' insides and comments blanked, and the literals."""
    out, found = list(code), []
    i, n = 0, len(code)
    stack: list[int] = []  # depth of braces at which each open template goes on
    depth = 0

    def blank(a: int, z: int) -> None:
        for k in range(a, z):
            if out[k] != "\n":
                out[k] = " "

    def template(start: int) -> int:
        k = start
        while k < n and code[k] != "`":
            if code[k] == "\\":
                k += 2
            elif code.startswith("${", k):
                blank(start, k + 1)
                found.append(Literal("template", start - 1, k, code[start:k]))
                stack.append(depth)
                return k + 2
            else:
                k += 1
        blank(start, min(k, n))
        found.append(Literal("template", start - 1, min(k + 1, n), code[start:k]))
        return k + 1

    while m := _STOP.search(code, i):
        i, c = m.start(), m[0]
        if code.startswith("//", i):
            z = code.find("\n", i)
            z = n if z < 0 else z
            found.append(Literal("comment", i, z, code[i + 2 : z]))
            blank(i, z)
            i = z
        elif code.startswith("/*", i):
            z = code.find("*/", i + 2)
            z = n if z < 0 else z + 2
            found.append(Literal("comment", i, z, code[i + 2 : z - 2]))
            blank(i, z)
            i = z
        elif c in "\"'":
            k = i + 1
            while k < n and code[k] not in (c, "\n"):
                k += 2 if code[k] == "\\" else 1
            k = min(k, n)
            found.append(Literal("string", i, k + 1, code[i + 1 : k]))
            blank(i + 1, k)
            i = k + 1
        elif c == "`":
            i = template(i + 1)
        elif c == "/" and _BEFORE_REGEX.search("".join(out[max(0, i - 16) : i])) and (m := _REGEX.match(code, i)):
            found.append(Literal("regex", i, m.end(), m[0][1 : m[0].rindex("/")]))
            blank(i + 1, m.end())
            i = m.end()
        else:
            if c == "{":
                depth += 1
            elif c == "}":
                if stack and stack[-1] == depth:
                    stack.pop()
                    i = template(i + 1)
                    continue
                depth -= 1
            i += 1
    return "".join(out), found


def closing(code: str, at: int) -> int:
    """Offset of the bracket that closes the one at ``at``, or the end."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for k in range(at, len(code)):
        if code[k] in pairs:
            depth += 1
        elif code[k] in ")]}":
            depth -= 1
            if not depth:
                return k
    return len(code)


def _parts(body: str) -> list[tuple[str, int]]:
    """Comma- or semicolon-separated parts of a body at its own depth, with their offsets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(body):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in ",;" and not depth:
            out.append((body[start:k], start))
            start = k + 1
    return [*out, (body[start:], start)]


def _declarators(text: str, at: int) -> Iterator[re.Match]:
    """Matches of the names after the first in a declaration whose first name ends at ``at``. Commas in brackets and in
    type arguments part nothing; a line ends the statement unless it ends, or the next begins, inside an expression."""
    depth, typed, fresh, last, k = 0, False, True, "", at
    while k < len(text):
        c = text[k]
        if c in "([{" or (typed and c == "<"):
            depth += 1
        elif c in ")]}" or (typed and c == ">" and last != "="):
            depth -= 1
            if depth < 0:
                return
        elif not depth:
            if c == ";":
                return
            if c == ":" and fresh:
                typed = True
            elif c == "=":
                typed = False
            elif c == ",":
                m = _NEXT_NAME.match(text, k + 1)
                if not m:
                    return
                yield m
                k, fresh, typed, last = m.end(), True, False, "a"
                continue
            elif c == "\n" and last not in _GOES_ON and text[k : k + 200].lstrip()[:1] not in _GOES_ON:
                return
        if not c.isspace():
            last, fresh = c, False
        k += 1


def bindings(clause: str) -> list[tuple[str, str]]:
    """(imported name, local name) of an import clause."""
    out = []
    clause = clause.strip()
    if m := re.search(r"\{([^}]*)\}", clause):
        for part in m[1].split(","):
            words = re.sub(r"^\s*type\s+(?=\S)", "", part).split()
            if words:
                out.append((words[0], words[-1]))
        clause = clause[: m.start()] + clause[m.end() :]
    if m := re.search(rf"\*\s*as\s+({_NAME})", clause):
        out.append(("*", m[1]))
        clause = clause[: m.start()]
    if m := re.match(rf"({_NAME})\s*,?\s*$", clause.strip()):
        out.append(("default", m[1]))
    return out


def members(code: str, brace: int, kind: str) -> list[dict]:
    """Members of the body that opens at ``brace``: name, type, is_public, start, end."""
    end = closing(code, brace)
    body, out = code[brace + 1 : end], []
    if kind in ("class", "interface"):
        depth, k = 0, 0
        pattern = re.compile(rf"(?:(private|protected|public)\s+)?(?:(?:static|readonly|async|override|abstract|get|set|declare)\s+)*\*?\s*(#?{_NAME})\s*([?!]?\s*[(:=;<]|$)", re.M)
        fresh = True
        while k < len(body):
            c = body[k]
            if not depth and fresh and (m := pattern.match(body, k)) and m[2] not in ("constructor",):
                out.append({"name": m[2], "type": "method" if "(" in m[3] or "<" in m[3] else "property", "is_public": m[1] not in ("private", "protected") and m[2][0] != "#", "start": brace + 1 + m.start(2), "end": brace + 1 + m.end(2)})
                k, fresh = m.end(2), False
                continue
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                fresh = fresh or (c == "}" and not depth)
            elif c in ";\n" and not depth:
                fresh = True
            elif not c.isspace():
                fresh = False
            k += 1
    else:
        for part, at in _parts(body):
            if m := re.match(rf"\s*(?:async\s+)?\*?\s*(?:(?:get|set)\s+(?=\w))?({_NAME})\s*(?:[:(=]|$)", part):
                out.append({"name": m[1], "type": "member", "is_public": True, "start": brace + 1 + at + m.start(1), "end": brace + 1 + at + m.end(1)})
    return out


_IMPORT = re.compile(r"(?<![\w$.])import\s+(?!\()(type\s+)?([^'\"();]*?)\s*from\s*(['\"])")
_BARE = re.compile(r"(?<![\w$.])import\s*(['\"])")
_CALL = re.compile(r"(?<![\w$.])(import|require)\s*\(\s*(?=(['\"`]))")
_FROM = re.compile(rf"(?<![\w$.])export\s+(?:type\s+)?(\*(?:\s*as\s+({_NAME}))?|\{{[^}}]*\}})\s*from\s*(['\"])")
_LIST = re.compile(r"(?<![\w$.])export\s+(?:type\s+)?\{([^}]*)\}(?!\s*from\b)")
_DECL = re.compile(rf"(?<![\w$.])export\s+(?:declare\s+)?(default\s+)?(?:(async\s+)?(function\s*\*?|(?:abstract\s+)?class|(?:const\s+)?enum|interface|type|namespace)\s+({_NAME})|(const|let|var)\s+(\{{[^}}]*\}}|\[[^\]]*\]|{_NAME})|(default\b))")
_COMMON = re.compile(rf"(?<![\w$.])(?:module\.)?exports(?:\.({_NAME}))?\s*=(?!=)\s*")
_CHAIN = re.compile(rf"(?<![\w$.]){_NAME}(?:\s*\??\.\s*#?{_NAME})+")
_AFTER = re.compile(rf"[)\]]\s*\??\.\s*({_NAME})")
_NEXT_NAME = re.compile(rf"\s*({_NAME})")
_GOES_ON = frozenset(",=.+-*/?:&|")
_SCRIPT = re.compile(r"(?is)<script\b[^>]*>(.*?)</script\s*>")
_TEMPLATE = re.compile(r"(?is)<template\b[^>]*>(.*)</template\s*>")
_NOT_LINE, _BREAK, _PLUS, _BRACE = re.compile(r"[^\n]"), re.compile("\n"), re.compile(r"\s*\+"), re.compile(r"\s*\{")
_OBJECT = re.compile(r"\s*(?::[^=;{]*)?=\s*(?:Object\.freeze\(\s*)?\{")
_WORKER = re.compile(r"(?<![\w$.])new\s+(?:Shared)?Worker\s*\(\s*(?:new\s+URL\s*\(\s*)?(?=['\"`])")
_TEST = re.compile(r"\s*while\s*\(([^)]*)\)")
_COMPUTED = re.compile(rf"(?<![\w$.])({_NAME})\s*(?:\?\.)?\[\s*(?:(['\"])|({_NAME})\s*\])")


def facts(path: str, code: str) -> Iterator[tuple[str, dict]]:
    """(kind, fields) of a source."""
    code = code.removeprefix("\ufeff")
    whole_code = code
    if path.endswith((".vue", ".svelte")):
        parts, done = [], 0
        for m in _SCRIPT.finditer(code):
            parts += [_NOT_LINE.sub(" ", code[done : m.start(1)]), m[1]]
            done = m.end(1)
        code = "".join([*parts, _NOT_LINE.sub(" ", code[done:])])
    text, literals = mask(code)
    at = {s.start: s.value for s in literals if s.kind in ("string", "template")}
    breaks = [m.start() for m in _BREAK.finditer(code)]
    line = lambda k: bisect_left(breaks, k) + 1
    column = lambda k: k - (breaks[i - 1] + 1 if (i := bisect_left(breaks, k)) else 0)
    templates = [s.start for s in literals if s.kind == "template"]
    gone = bytearray(len(text))  # import statements and declared names aren't uses
    constants = {m[1]: at[m.end() - 1] for m in re.finditer(rf"(?<![\w$])const\s+({_NAME})\s*(?::\s*string\s*)?=\s*(?=(['\"]))['\"]", text) if m.end() - 1 in at}

    def cover(a: int, z: int) -> None:
        gone[a:z] = b"\x01" * (z - a)

    def export(name: str, kind: str, start: int, end: int, source: str | None = None, original: str | None = None, own: list | None = None) -> tuple[str, dict]:
        return "export", {"name": name, "export_type": kind, "source_specifier": source, "original_name": original, "start": start, "end": end, "line": line(start), "column": column(start), "members": own or []}

    for m in _IMPORT.finditer(text):
        spec = at.get(m.start(3), "")
        yield "import", {"specifier": spec, "kind": "static"}
        for name, local in bindings(m[2]):
            yield "import_symbol", {"specifier": spec, "imported_name": name, "local_name": local}
        cover(m.start(), m.end())
    for m in _BARE.finditer(text):
        yield "import", {"specifier": at.get(m.start(1), ""), "kind": "side_effect"}
    for m in _CALL.finditer(text):
        spec, quote = at.get(m.end(), ""), m[2]
        later = bisect_right(templates, m.end())
        whole = quote != "`" or later == len(templates) or templates[later] >= closing(text, text.index("(", m.start()))
        joined = _PLUS.match(text, m.end() + len(spec) + 2) is not None
        literal = whole and not joined
        if literal:
            kind = "require" if m[1] == "require" else "dynamic"
            yield "import", {"specifier": spec, "kind": kind}
            if kind == "require" and (b := re.search(rf"(?:const|let|var)\s+(\{{[^}}]*\}}|{_NAME})\s*=\s*$", text[max(0, m.start() - 300) : m.start()])):
                names = [(w[0], w[-1]) for part in b[1].strip("{}").split(",") if (w := [x.strip() for x in part.split(":")]) and w[0]] if b[1].startswith("{") else [("*", b[1])]
                for name, local in names:
                    yield "import_symbol", {"specifier": spec, "imported_name": name, "local_name": local}
            elif kind == "dynamic":
                yield "import_symbol", {"specifier": spec, "imported_name": "*", "local_name": None}
        prefix = spec.rpartition("/")[0] if not literal else None
        yield "dynamic_import", {"specifier": spec if literal else None, "pattern": spec if literal else spec + "*", "dir_prefix": prefix or None, "is_literal": literal}
    for m in _WORKER.finditer(text):
        yield "import", {"specifier": at.get(m.end(), ""), "kind": "worker"}
    for m in _FROM.finditer(text):
        spec = at.get(m.start(3), "")
        yield "import", {"specifier": spec, "kind": "reexport"}
        if m[1].startswith("*"):
            yield export(m[2] or "*", "namespace" if m[2] else "star", m.start(), m.end(), spec, "*")
        else:
            for original, name in bindings(m[1]):
                yield export(name, "reexport", m.start(), m.end(), spec, original)
        cover(m.start(), m.end())
    for m in _LIST.finditer(text):
        for local, name in bindings("{" + m[1] + "}"):
            yield export(name, "list", m.start(), m.end(), None, local)
    for m in _DECL.finditer(text):
        default, word, name, binding = m[1] or m[7], m[3], m[4], m[6]
        if word and name and not (default and name in KEYWORDS):
            kind = word.split()[-1].rstrip("*").strip()
            brace = text.find("{", m.end())
            own = members(text, brace, kind if kind in ("class", "interface") else "object") if brace >= 0 and kind in ("class", "interface", "enum") else []
            yield export("default" if default else name, kind, m.start(4), m.end(4), None, name, own)
            cover(m.start(4), m.end(4))
        elif binding:
            if binding[0] in "{[":
                for original, local in bindings("{" + binding.strip("{}[]").replace(":", " as ") + "}"):
                    yield export(local, "variable", m.start(6), m.end(6), None, original)
            else:
                own = []
                if b := _OBJECT.match(text, m.end()):
                    own = members(text, b.end() - 1, "object")
                yield export(binding, "variable", m.start(6), m.end(6), None, binding, own)
                for more in _declarators(text, m.end()):
                    b = _OBJECT.match(text, more.end())
                    yield export(more[1], "variable", more.start(1), more.end(1), None, more[1], members(text, b.end() - 1, "object") if b else [])
                    cover(more.start(1), more.end(1))
            cover(m.start(6), m.end(6))
        elif default:
            yield export("default", "expression", m.start(), m.end())
    for m in _COMMON.finditer(text):
        if m[1]:
            yield export(m[1], "commonjs", m.start(1), m.end(1), None, m[1])
        elif text.startswith("module", m.start()):
            if text[m.end() : m.end() + 1] == "{":
                for own in members(text, m.end(), "object") or []:
                    yield export(own["name"], "commonjs", own["start"], own["end"], None, own["name"])
                body = text[m.end() + 1 : closing(text, m.end())]
                for part, k in _parts(body):
                    if re.fullmatch(rf"\s*{_NAME}\s*", part) and not any(o["name"] == part.strip() for o in members(text, m.end(), "object")):
                        yield export(part.strip(), "commonjs", m.end() + 1 + k, m.end() + 1 + k + len(part), None, part.strip())
            else:
                yield export("default", "commonjs", m.start(), m.end())
    for m in re.finditer(rf"(?<![\w$.#])(?:function\s*\*?|class|interface|type|enum|namespace|const|let|var)\s+({_NAME})", text):
        cover(m.start(1), m.end(1))
    seen = set()
    for m in re.finditer(rf"(?<![\w$#]){_NAME}", text):
        if m[0] in seen or m[0] in KEYWORDS or gone[m.start()]:
            continue
        k = m.start() - 1
        while k >= 0 and text[k].isspace():
            k -= 1
        if k < 0 or text[k] != "." or text[max(0, k - 2) : k + 1] == "...":
            seen.add(m[0])
            yield "identifier", {"name": m[0]}
    for chain in {re.sub(r"[\s?#]", "", m[0]) for m in _CHAIN.finditer(text)}:
        yield "chain", {"chain": chain, "parts": chain.split(".")}
    for name in {m[1] for m in _AFTER.finditer(text)}:
        yield "chain", {"chain": f"().{name}", "parts": ["()", name]}
    for m in _COMPUTED.finditer(text):
        key = at.get(m.start(2)) if m[2] else constants.get(m[3])
        if key is not None:
            yield "chain", {"chain": f"{m[1]}.{key}", "parts": [m[1], *key.split(".")]}
    for value in {s.value for s in literals if s.kind in ("string", "template")}:
        yield "string_ref", {"value": value}
    for m in re.finditer(r"<([A-Z][\w$.]*)", text):
        yield "token", {"token_kind": "jsx", "name": m[1]}
    for m in re.finditer(rf"(?<![\w$])@({_NAME})", text):
        yield "token", {"token_kind": "decorator", "name": m[1]}
    for s in literals:
        if s.kind == "comment":
            for m in re.finditer(re.escape(TAG) + r"\s+([\w*-]+)(?::([\w$]+))?", s.value):
                yield "suppression", {"rule": m[1], "symbol": m[2]}
    yield from _templates(path, whole_code, text, literals)
    yield from _nodes(text, literals, at)
    yield from _shapes(text, at)
    yield "source", _outline(text, at)


def _templates(path: str, code: str, text: str, literals: list[Literal]) -> Iterator[tuple[str, dict]]:
    """Texts in other languages: tagged queries, the templates of components; and the hooks that code calls."""
    for s in literals:
        if s.kind == "template" and re.search(r"(?<![\w$])(?:gql|graphql)\s*$", text[max(0, s.start - 20) : s.start]):
            yield "template", {"template_kind": "graphql", "name": (re.search(rf"\b(?:query|mutation|subscription|fragment)\s+({_NAME})", s.value) or [None, None])[1], "value": s.value}
    for name in sorted({m[1] for m in re.finditer(r"(?<![\w$.])(use[A-Z]\w*)\s*[(<]", text)}):
        yield "template", {"template_kind": "hook", "name": name, "value": None}
    if path.endswith((".vue", ".svelte")):
        for m in _TEMPLATE.finditer(code):
            yield "template", {"template_kind": "markup", "name": None, "value": m[1]}


_KINDS = (("string", re.compile(r"\s*['\"`]")), ("number", re.compile(r"\s*[-+]?\d")), ("boolean", re.compile(r"\s*(?:true|false)\b")), ("null", re.compile(r"\s*(?:null|undefined)\b")), ("array", re.compile(r"\s*\[")), ("object", re.compile(r"\s*\{")), ("function", re.compile(r"\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|[\w$]+\s*=>)")))
_FUNCTION = re.compile(rf"(?<![\w$.])function\s*\*?\s*({_NAME})?\s*\([^()]*\)\s*(?::\s*[\w$<>\[\]|. ]+)?\s*\{{|(?<![\w$.])(?:const|let|var)\s+({_NAME})\s*=\s*(?:async\s+)?\([^()]*\)\s*=>\s*\{{")
_TOKEN = re.compile(r"(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<text>['\"`])|(?P<op>[^\s\w])")


def _kind(text: str, at: int) -> str | None:
    return next((k for k, p in _KINDS if p.match(text, at)), None)


def _shapes(text: str, at: dict) -> Iterator[tuple[str, dict]]:
    """What rules about shapes and types look at: objects handed to calls, types written to variables, uses and guards
    of variables that may be null, and functions by the kinds of their tokens."""
    for m in re.finditer(rf"(?<![\w$.])(?:({_NAME})\s*\.\s*)?({_NAME})\s*\(\s*(?=\{{)", text):
        if m[2] not in KEYWORDS:
            names = sorted({o["name"] for o in members(text, m.end(), "object")})
            yield "shape", {"callee_object": m[1], "callee": m[2], "shape": ",".join(names), "pre": m.start()}
    known = {m[1] for m in re.finditer(rf"(?<![\w$.])(?:let|var)\s+({_NAME})", text)}
    null = set()
    for m in re.finditer(rf"(?<![\w$.])(?:(?:let|var)\s+)?({_NAME})\s*=(?![=>])", text):
        if m[1] in known and (kind := _kind(text, m.end())):
            if kind == "null":
                null.add(m[1])
            else:
                yield "write", {"name": m[1], "type": kind, "pre": m.start()}
    if null:
        names = "|".join(map(re.escape, sorted(null)))
        for m in re.finditer(rf"(?<![\w$.])({names})(?=\s*(\?\.|\.|\[|&&|!==?|===?|\)|\?\?|=(?![=>])))", text):
            if m[2] == "=" and _kind(text, text.index("=", m.end()) + 1) == "null":
                continue
            tested = re.search(r"(?:if|while)\s*\(\s*!?\s*$", text[max(0, m.start() - 16) : m.start()]) is not None
            kind = "guard" if tested or m[2] in ("&&", "??", "=") or m[2][:2] in ("!=", "==") else "use" if m[2] in (".", "[") else None
            if kind:
                yield "access", {"name": m[1], "kind": kind, "pre": m.start()}
    for m in _FUNCTION.finditer(text):
        end = closing(text, m.end() - 1)
        kinds = [t.lastgroup if t.lastgroup != "name" or t[0] not in KEYWORDS else t[0] for t in _TOKEN.finditer(text, m.end(), end)]
        signs = [t[0] if t.lastgroup == "op" else k for t, k in zip(_TOKEN.finditer(text, m.end(), end), kinds, strict=True)]
        if len(signs) >= CLONE:
            yield "body", {"name": m[1] or m[2], "shape": hashlib.sha256(" ".join(signs).encode()).hexdigest(), "n_tokens": len(signs), "pre": m.start()}


def _outline(text: str, at: dict) -> dict:
    """Statements that aren't imports, and whether loading the file does something."""
    depth, start, heads = 0, True, []
    for k, c in enumerate(text):
        if c in "([{":
            if start and not depth:
                heads.append(k)
            start = False
            depth += 1
        elif c in ")]}":
            depth -= 1
            start = start or (c == "}" and not depth)
        elif c == ";" and not depth:
            start = True
        elif c == "\n" and not depth:
            start = start or bool(re.match(r"\s*(import|export|const|let|var|function|class|async|await|if|for|while|new|interface|type|enum)\b", text[k : k + 40]))
        elif not c.isspace() and start and not depth:
            heads.append(k)
            start = False
    own = [h for h in heads if not re.match(r"import\b(?!\s*\()", text[h : h + 12])]
    effect = any(re.match(rf"(?:await\b|\(|new\s|(?!(?:if|for|while|switch|function|class|export|import|const|let|var|type|interface|enum|declare|return)\b){_NAME}(?:\s*\.\s*{_NAME})*\s*\()|if\s*\(\s*require\.main", text[h : h + 200]) for h in own)
    return {"n_statements": len(own), "has_side_effects": effect}


def _nodes(text: str, literals: list[Literal], at: dict) -> Iterator[tuple[str, dict]]:
    """Syntax nodes that rules look at; start and end offsets serve as pre and post numbers."""
    node = lambda kind, a, z, **attrs: ("node", {"node_type": kind, "pre": a, "post": z, "attrs": attrs})
    for m in re.finditer(r"(?<![\w$.])(while|for|do)\b\s*(\(|\{)", text):
        head = closing(text, m.end() - 1)
        if m[1] == "do":
            end = head
            test = _TEST.match(text, head + 1)
            constant, kind = bool(test) and test[1].strip() in ("true", "1"), "DoWhileStatement"
        else:
            inside = text[m.end() : head].strip()
            constant = inside in ("true", "1") if m[1] == "while" else re.fullmatch(r"[^;]*;\s*(true)?\s*;[^;]*", inside) is not None
            body = _BRACE.match(text, head + 1)
            end = closing(text, body.end() - 1) if body else (text.find(";", head) + 1 or len(text))
            kind = "WhileStatement" if m[1] == "while" else "ForStatement"
        yield node(kind, m.start(), end, constant=str(constant).lower())
    for m in re.finditer(r"(?<![\w$.])(break|return|throw)\b", text):
        yield node({"break": "BreakStatement", "return": "ReturnStatement", "throw": "ThrowStatement"}[m[1]], m.start(), m.end())
    for m in re.finditer(r"(?<![=!<>])([=!]=)(?!=)", text):
        yield node("LooseEquality", m.start(), m.end(), operator=m[1])
    for s in literals:
        if s.kind == "regex":
            yield node("RegExpLiteral", s.start, s.end, pattern=s.value)
        elif s.kind == "comment" and (m := re.search(r"(eslint-disable|@ts-ignore|@ts-nocheck|@ts-expect-error)", s.value)):
            yield node("IgnoreComment", s.start, s.end, text=m[1])
    for m in re.finditer(r"new\s+RegExp\s*\(\s*(?=['\"])", text):
        yield node("RegExpLiteral", m.start(), m.end(), pattern=at.get(m.end(), ""))
    for m in re.finditer(r"\.(addEventListener|removeEventListener|on|off)\s*\(\s*(?=['\"])", text):
        yield node("ListenerCall", m.start(), m.end(), op="add" if m[1] in ("addEventListener", "on") else "remove", event=at.get(m.end(), ""))
    for m in re.finditer(r"\.postMessage\s*\(", text):
        yield node("WorkerPost", m.start(), m.end(), argument=text[m.end() : closing(text, m.end() - 1)])
    for m in re.finditer(rf"{_NAME}\s*\[\s*(?!['\"\d])[^\]\n]+\]\s*=(?!=)", text):
        yield node("ComputedAssign", m.start(), m.end())
    for m in re.finditer(rf"process\.env\.({_NAME})", text):
        yield node("EnvRead", m.start(), m.end(), name=m[1])
    for s in literals:
        if s.kind == "string" and s.value.endswith(".node"):
            yield node("NativeBinding", s.start, s.end, name=s.value)


_PLAIN = re.compile(r"""(?:\bfrom|\bimport|\brequire\s*\(|\bimport\s*\()\s*(['"])([^'"\n]+)\1""")
_SAYS = re.compile(r"^\s*(?:import|export)\b|\brequire\s*\(", re.M)


def plain_imports(code: str) -> list[tuple[str, dict]]:
    """Specifiers that stand behind a word that imports, wherever they are: what is known of a source that can't be read."""
    return [("import", {"specifier": s, "kind": "plain"}) for s in sorted({m[2] for m in _PLAIN.finditer(code)})]


def rows(path: str, code: str | None, kinds: frozenset[str] | None = None) -> list[tuple[str, str]]:
    """(kind, fields as JSON) of a source, of some kinds if they are given. One that cannot be read, or in which nothing is found although its code says
    that it imports or exports, falls back on its plain imports; the first has a ``failed`` fact as well."""
    code = code or ""
    try:
        found = list(facts(path, code))
    except (RecursionError, ValueError, IndexError) as e:
        found = [("failed", {"error": repr(e)}), *plain_imports(code)]
    else:
        if not any(k in ("import", "export") for k, _ in found) and _SAYS.search(mask(code)[0]):
            found += plain_imports(code)
    return [(k, json.dumps(v)) for k, v in found if kinds is None or k in kinds]

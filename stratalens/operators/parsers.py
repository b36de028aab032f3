"""Source files to imports, exports and components (X1-X16): an Arrow-fed function for each batch of files."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratalens.functions import text as texts
from stratalens.session import with_package

#: Files whose results a worker hands on together.
TOGETHER = 500

PARSED = (
    "parse_success boolean, parse_errors array<string>,"
    " imports array<struct<ord:int,source:string,import_type:string,is_type_only:boolean,is_dynamic:boolean,line:int,specifiers:array<struct<imported:string,local:string,is_type:boolean>>>>,"
    " exports array<struct<ord:int,export_type:string,name:string,source:string,line:int,specifiers:array<struct<local:string,exported:string,is_type:boolean>>>>,"
    " components array<struct<id:string,name:string,raw_type:string,start_line:int,end_line:int,visibility:string,is_exported:boolean,parent_id:string,parameters:array<string>,return_type:string>>"
)


def _component(kind: str, name: str, start: int, end: int, exported: bool, parent: str | None = None, parameters: list[str] | None = None) -> dict:
    return {
        "id": f"{kind}_{name}_{start}", "name": name, "raw_type": kind, "start_line": start, "end_line": end, "visibility": "public",
        "is_exported": exported, "parent_id": parent, "parameters": parameters or [], "return_type": None,
    }


def _result(error: str | None = None, imports=(), exports=(), components=()) -> dict:
    return {
        "parse_success": error is None, "parse_errors": [error] if error else [], "imports": [x | {"ord": i} for i, x in enumerate(imports)],
        "exports": [x | {"ord": i} for i, x in enumerate(exports)], "components": list(components),
    }


def parse_python(source: str) -> dict:
    """Functions and classes at any depth, all exported; async functions and bare relative imports aren't seen.

    The text is only parsed, never run.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return _result(f"{type(e).__name__}: {e}")
    imports, components = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            components.append(_component("function", node.name, node.lineno, node.end_lineno or node.lineno, True, parameters=[a.arg for a in node.args.args]))
        elif isinstance(node, ast.ClassDef):
            components.append(_component("class", node.name, node.lineno, node.end_lineno or node.lineno, True))
        elif isinstance(node, ast.Import):
            imports += [_import(a.name, "namespace" if a.asname else "default", node.lineno, [(a.name, a.asname or a.name)]) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.append(_import(node.module, "named", node.lineno, [(a.name, a.asname or a.name) for a in node.names]))
    return _result(imports=imports, components=components)


def _import(source: str, kind: str, line: int, names=(), type_only: bool = False, dynamic: bool = False) -> dict:
    return {"source": source, "import_type": kind, "is_type_only": type_only, "is_dynamic": dynamic, "line": line, "specifiers": [{"imported": a, "local": b, "is_type": type_only} for a, b in names]}


_NAME = r"[A-Za-z_$][\w$]*"
# What may stand before a key word is looked at behind it, so a search goes from word to word.
_IMPORT = re.compile(r"""import(?<![^;}\s]import)\s+(type\s+(?!from\b))?([\w$*{}\s,]*?)\s*(?:\bfrom\s*)?(["'])\x00(\d+)\x00\3""")
_DYNAMIC = re.compile(r"""import(?<!\wimport)\s*\(\s*(["'])\x00(\d+)\x00\1\s*\)""")
_EXPORT_FROM = re.compile(rf"""export(?<!\wexport)\s+(type\s+)?(\*(?:\s+as\s+{_NAME})?|\{{[^}}]*\}})(?:\s*from\s*(["'])\x00(\d+)\x00\3)?""")
_EXPORT_DEFAULT = re.compile(rf"export(?<!\wexport)\s+default\s+(?:(?:async\s+)?function\s*\*?\s*|(?:abstract\s+)?class\s+)?({_NAME})?")
_HEAD = re.compile(rf"(?=[acdefiltv])\b(export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:(?:async\s+)?(function)\b\s*\*?\s*({_NAME})|(class|interface|enum)\s+({_NAME})|(type)\s+({_NAME})\s*(?:<[^=]*>)?=(?!=)|(const|let|var)\b(?!\s+enum\b))")
_FUNCTION = re.compile(rf"\s*(?::[^=;\n]+)?=(?!=)\s*(?:async\s*)?(?:function\b|(?:<[^>(]*>\s*)?\([^()]*\)\s*(?::[^=;]+)?=>|{_NAME}\s*=>)")
_MODIFIERS = re.compile(r"(?:(?:public|private|protected|static|readonly|abstract|declare|override|accessor|async|get|set)\b(?!\s*[(=;:?!<])\s*)*\*?\s*")
_TOKEN = re.compile(r"""//[^\n]*|/\*|["']|`|[{}()\[\]/]|\$\{""")
_PLAIN = {q: re.compile(rf"(?:\\[\s\S]|[^{q}\\\n])*") for q in "\"'"}
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_PAIR = {")": "(", "]": "[", "}": "{"}


def _masked(source: str) -> tuple[str, list[str], str | None]:
    """The text with comments, templates and regular expressions blanked and strings numbered, the strings, and the first
    syntax error; line breaks stay, and so does code inside ${...} of a template."""
    source = source.replace("\0", " ")
    strings: list[str] = []
    out: list[str] = []
    open_: list[str] = []
    error, at = None, 0
    line = lambda i: source.count("\n", 0, i) + 1
    blank = lambda t: re.sub(r"[^\n]", " ", t)

    def template(begin: int) -> int:
        """Blank a template's text up to its end or the next ${."""
        nonlocal error
        end = _TEMPLATE.match(source, begin).end()
        out.append(blank(source[begin:end]))
        if source.startswith("${", end):
            open_.append("${")
            out.append(" {")
            return end + 2
        if end == len(source):
            error = error or f"SyntaxError: unterminated template ({line(begin)})"
        out.append(" " * (end < len(source)))
        return end + 1

    while m := _TOKEN.search(source, at):
        out.append(source[at : m.start()])
        t, at = m[0], m.end()
        if t[:2] == "//":
            out.append(" " * len(t))
        elif t == "/*":
            end = source.find("*/", at)
            error = error or (f"SyntaxError: unterminated comment ({line(m.start())})" if end < 0 else None)
            end = len(source) if end < 0 else end + 2
            out.append(blank(source[m.start() : end]))
            at = end
        elif t in "\"'":
            end = _PLAIN[t].match(source, at).end()
            if source[end : end + 1] == t:
                strings.append(source[at:end])
                out.append(f"{t}\0{len(strings) - 1}\0{t}")
                at = end + 1
            else:
                out.append(t)  # an apostrophe in the text of a tag
        elif t == "`":
            out.append(" ")
            at = template(at)
        elif t == "/":
            before = "".join(out[-3:]).rstrip()
            found = _REGEX.match(source, m.start()) if not before or before[-1] in "=(,:;!&|?{}[+-*%~^" or re.search(r"\b(?:return|typeof|case|in|of|yield|await)$", before) else None
            out.append(blank(found[0]) if found else t)
            at = found.end() if found else at
        elif t in "{([" or t == "${":
            open_.append(t[-1])
            out.append(t)
        else:
            last = open_.pop() if open_ else ""
            if last == "${":
                out.append("}")
                at = template(at)
                continue
            if last != _PAIR[t]:
                error = error or f"SyntaxError: unexpected {t} ({line(m.start())})"
            out.append(t)
    out.append(source[at:])
    if open_:
        error = error or f"SyntaxError: {open_[-1]} is never closed"
    return "".join(out), strings, error


def import_kind(names: list[tuple[str, str]]) -> str:
    """None is a side effect; else default, namespace, named, in this order."""
    kinds = {a for a, _ in names}
    return "side_effect" if not names else "default" if "default" in kinds else "namespace" if "*" in kinds else "named"


def _names(clause: str) -> list[tuple[str, str]]:
    out = []
    braces = re.search(r"\{([^}]*)\}", clause)
    for part in re.sub(r"\{[^}]*\}", "", clause).split(","):
        if star := re.match(rf"\s*\*\s*as\s+({_NAME})", part):
            out.append(("*", star[1]))
        elif one := re.match(rf"\s*({_NAME})\s*$", part):
            out.append(("default", one[1]))
    for part in braces[1].split(",") if braces else ():
        if m := re.match(rf"\s*(?:type\s+)?({_NAME})(?:\s+as\s+({_NAME}))?\s*$", part):
            out.append((m[1], m[2] or m[1]))
    return out


_DEPTH = re.compile(r"[{}()\[\],;\n]")
_GOES_ON = re.compile(r"\s*(?:[=+\-*/%&|^?:.,<>)\]}]|\b(?:in|of|as|instanceof|satisfies|extends)\b)")


def _end_of(code: str, at: int, stops: str = ";") -> int:
    """Where a statement that goes on at `at` ends: at one of `stops`, at a bracket that closes more than was opened, or at
    a line break that nothing goes on over, all outside of brackets."""
    depth = 0
    for m in _DEPTH.finditer(code, at):
        c = m[0]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return m.start()
        elif not depth and (c in stops or c == "\n" and (code[at : m.start()].rstrip()[-1:] or "=") not in tuple("=+-*/%&|^?:.,<(") and not _GOES_ON.match(code, m.end())):
            return m.start()
    return len(code)


def _block_end(code: str, at: int) -> int:
    """Where the braces that open after `at` are closed, or the statement ends."""
    depth = 0
    for m in _BRACES.finditer(code, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth < 0 or depth == 0 and m[0] in "};":
            return m.start()
    return max(at, len(code) - 1)


_BRACES = re.compile(r"[{};]")
_BRACKETS = re.compile(r"[{}()\[\]]")
_DECLARED = re.compile(rf"\s*({_NAME})")
_PART = re.compile(r"[{}()\[\]<>,]|$")
_BEFORE_TYPE = re.compile(r"[^:=]*")
_LAST_NAME = re.compile(rf"({_NAME})\s*\??\s*$")
_KEY = re.compile(rf"\s*(?:(#?{_NAME})|(\[|[\"'\d]))")
_DECORATOR = re.compile(rf"@\s*(?:{_NAME}\.?)*")
_QUOTED_KEY = re.compile(r"[\"']?[^\"'\n(=;:]*[\"']?")
_METHOD = re.compile(r"\s*[?!]?\s*(?:<[^>(]*>)?\s*\(")


def _closed(code: str, at: int) -> int:
    """One past the bracket that closes the one at `at`."""
    depth = 0
    for m in _BRACKETS.finditer(code, at):
        depth += 1 if m[0] in "{([" else -1
        if not depth:
            return m.end()
    return len(code)


def _declarators(code: str, at: int) -> Iterator[tuple[str, int, int, bool]]:
    """(name, begin, end, whether it is bound to a function) of each identifier that const, let or var declares."""
    while True:
        end = _end_of(code, at, ",;")
        if m := _DECLARED.match(code, at, end):
            yield m[1], m.start(1), end, bool(_FUNCTION.match(code, m.end(), end))
        if code[end : end + 1] != ",":
            return
        at = end + 1


def _parameters(code: str, at: int) -> list[str]:
    """The names of what stands in the parentheses from `at`; of a pattern or a default only the name before it."""
    inside, out, depth = code[at + 1 : _closed(code, at) - 1], [], 0
    begin = 0
    for m in _PART.finditer(inside):
        if m[0] and m[0] in "{([<":
            depth += 1
        elif m[0] and m[0] in "})]>":
            depth -= 1
        elif depth <= 0 or not m[0]:
            if name := _LAST_NAME.search(_BEFORE_TYPE.match(inside[begin : m.start()])[0]):
                out.append(name[1])
            begin = m.end()
    return out


def parse_javascript(source: str) -> dict:
    """Imports, dynamic imports, exports and declarations by a scanner that skips comments, strings and regular
    expressions; code inside ${...} of a template is seen.

    Syntax errors are brackets that don't match and comments or templates without an end; tags in a file of components
    are read as code.
    """
    code, strings, error = _masked(source)
    if error:
        return _result(error)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_left(breaks, at) + 1
    imports = [(m.start(), _import(strings[int(m[4])], import_kind(n := _names(m[2])), line(m.start()), n, bool(m[1]))) for m in _IMPORT.finditer(code)]
    imports += [(m.start(), _import(strings[int(m[2])], "default", line(m.start()), dynamic=True)) for m in _DYNAMIC.finditer(code)]
    exports = []
    for m in _EXPORT_FROM.finditer(code):
        source_of = strings[int(m[4])] if m[4] else None
        if m[2][0] == "*":
            exports.append((m.start(), {"export_type": "all", "name": "*", "source": source_of, "line": line(m.start()), "specifiers": []}))
        else:
            names = [{"local": a, "exported": b, "is_type": bool(m[1])} for a, b in _names(m[2])]
            exports.append((m.start(), {"export_type": "named", "name": None, "source": source_of, "line": line(m.start()), "specifiers": names}))
    exports += [(m.start(), {"export_type": "default", "name": m[1] or "default", "source": None, "line": line(m.start()), "specifiers": []}) for m in _EXPORT_DEFAULT.finditer(code)]
    components, shown = [], 0  # up to `shown` an export is around
    for m in _HEAD.finditer(code):
        kind, name = m[2] or m[4] or m[6] or m[8], m[3] or m[5] or m[7]
        if m[8]:
            found = [(n, a, b, "function" if f else "constant" if kind == "const" else "variable", []) for n, a, b, f in _declarators(code, m.end())]
        else:
            head = code.find("(", m.end()) if m[2] else -1
            found = [(name, m.start(), _block_end(code, m.end() if head < 0 else _closed(code, head)), kind, _parameters(code, head) if head >= 0 else [])]
        if m[1]:
            shown = max([shown, *(f[2] for f in found)])
        for n, begin, end, what, parameters in found:
            at = line(begin if m[8] else m.start())
            components.append(_component(what, n, at, line(end), begin < shown, parameters=parameters))
            if m[1] and "default" not in m[1]:
                exports.append((begin, {"export_type": "named", "name": n, "source": None, "line": at, "specifiers": [{"local": n, "exported": n, "is_type": what in ("type", "interface")}]}))
            if what == "class" and (body := code.find("{", m.end())) >= 0:
                components += _members(code, body, components[-1], line)
    order = lambda rows: [x for _, x in sorted(rows, key=lambda r: r[0])]
    return _result(imports=order(imports), exports=order(exports), components=components)


def _members(code: str, body: int, owner: dict, line) -> list[dict]:
    """X6, X7, corrected: the constructor, methods and properties of a class, whose braces open at `body`."""
    out, at, end = [], body + 1, _closed(code, body) - 1
    while at < end:
        if code[at] in " \t\r\n;,":
            at += 1
            continue
        if code[at] == "@":  # a decorator, with its arguments if it has some
            at = _DECORATOR.match(code, at).end()
            at = _closed(code, at) if code[at : at + 1] == "(" else at
            continue
        mods = _MODIFIERS.match(code, at, end)
        m = _KEY.match(code, mods.end(), end)
        if not m:
            stop = mods.end()  # a static block, or what isn't understood
            at = _closed(code, stop) if code[stop] in "{([" else max(stop, at + 1)
            continue
        name, begin, after = m[1] or "<anonymous>", m.start(1) if m[1] else m.start(2), m.end()
        after = _closed(code, begin) if m[2] == "[" else _QUOTED_KEY.match(code, begin).end() if m[2] else after
        head = _METHOD.match(code, after, end)
        seen = "private" if name[0] == "#" or "private" in mods[0] else "protected" if "protected" in mods[0] else "public"
        if head:
            close = _closed(code, head.end() - 1)
            stop = _block_end(code, close)
            kind = "constructor" if name == "constructor" else "method"
            made = _component(kind, name, line(begin), line(stop), False, owner["id"], _parameters(code, head.end() - 1))
            at = stop + 1
        else:
            stop = min(end, _end_of(code, after))
            made = _component("property", name, line(begin), line(max(begin, stop - 1)), False, owner["id"]) | {"id": f"prop_{name}_{line(begin)}"}
            at = stop + 1
        out.append(made | {"visibility": seen})
    return out


def parse(path: str, content: str) -> dict:
    """X16."""
    ext = path.rpartition(".")[2].lower()
    return parse_python(content) if ext in ("py", "pyw", "pyi") else parse_javascript(content)


def parsed(files: DataFrame) -> DataFrame:
    """(project_id, path, content): with the parse result of each file, and its line metrics.

    Files that are too short or hold NUL are left out; one that doesn't parse keeps its metrics, with empty lists.  Each is
    parsed once, by the tasks that hold it here, whatever is asked of the lists.
    """

    @F.arrow_udf(PARSED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, contents in batches:
            for at in range(0, len(names), TOGETHER):
                pairs = zip(names.slice(at, TOGETHER).to_pylist(), contents.slice(at, TOGETHER).to_pylist(), strict=True)
                yield pa.array([parse(p, c) for p, c in pairs], kind)

    kind = to_arrow_type(run.returnType)
    # as a deterministic function it would be copied into filters, and these moved to before a repartition
    run = run.asNondeterministic()
    with_package(files.sparkSession)
    rows = files.filter(texts.worth_parsing(F.col("content")))
    mark = F.when(F.col("path").rlike(r"(?i)\.py[wi]?$"), "#").otherwise("//")
    done = rows.withColumn("parsed", run("path", "content")).withColumn("metrics", texts.line_metrics(F.col("content"), mark))
    return done.select("project_id", "path", "parsed.*", "metrics.*", texts.byte_length(F.col("content")).alias("file_size"), F.lit(1).alias("complexity"))


def imports_of(files: DataFrame) -> DataFrame:
    return files.select("project_id", "path", F.inline("imports"))


def exports_of(files: DataFrame) -> DataFrame:
    return files.select("project_id", "path", F.inline("exports"))

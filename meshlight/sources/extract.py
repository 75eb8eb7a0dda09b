"""Definitions, imports and call sites of source files.

``extract(files)`` turns ``files(path, source)`` into definition rows.  Python is
read with ``ast``; Rust, TypeScript, Go, C and C++ with one scanner that blanks
comments and strings and matches braces.  A file that cannot be read gives one
row with ``parse_error`` and no definition.
"""

from __future__ import annotations

import ast
import bisect
import functools
import hashlib
import itertools
import operator
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexing import masked

SCHEMA = (
    "id string, name string, file string, kind string, lang string, start_line long, end_line long, start_byte long, end_byte long, "
    "parent_id string, content_hash string, source string, parse_error string"
)
LANGS = {
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript",
    "svelte": "typescript", "go": "go", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
}
_NAME = r"([A-Za-z_$][\w$]*)"
#: (kind, pattern) by language; the name is group 1 and a body is a brace block, or ends at ``;``.
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function_item", rf"\bfn\s+{_NAME}"), ("struct_item", rf"\bstruct\s+{_NAME}"), ("enum_item", rf"\benum\s+{_NAME}"), ("union_item", rf"\bunion\s+{_NAME}\s*\{{"),
        ("trait_item", rf"\btrait\s+{_NAME}"), ("impl_item", rf"\bimpl\b(?:\s*<[^{{;]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?{_NAME}"), ("mod_item", rf"\bmod\s+{_NAME}"),
        ("type_item", rf"\btype\s+{_NAME}\s*[=<]"), ("const_item", rf"\bconst\s+(?!fn\b){_NAME}\s*:"), ("static_item", rf"\bstatic\s+(?:mut\s+)?{_NAME}\s*:"),
    ],
    "typescript": [
        ("class_declaration", rf"\bclass\s+{_NAME}"), ("interface_declaration", rf"\binterface\s+{_NAME}"), ("function_declaration", rf"\bfunction\s*\*?\s*{_NAME}\s*[(<]"),
        ("arrow_function", rf"\b(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
        ("variable_declarator", rf"\b(?:const|let|var)\s+{_NAME}\s*(?::[^=;]+)?=(?![^;\n]*=>)"),
        ("method_definition", rf"(?m)^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_NAME}\s*\([^)]*\)\s*(?::[^{{;]+)?\{{"),
    ],
    "go": [("method_declaration", rf"\bfunc\s*\([^)]*\)\s*{_NAME}"), ("function_declaration", rf"\bfunc\s+{_NAME}"), ("type_spec", rf"\btype\s+{_NAME}\s")],
    "c": [
        ("struct_specifier", rf"\bstruct\s+{_NAME}\s*\{{"),
        ("function_definition", rf"(?m)^[A-Za-z_][\w\s\*]*?[\s\*]{_NAME}\s*\([^;{{}}]*\)\s*\{{"),
        ("function_declaration", rf"(?m)^[A-Za-z_][\w\s\*]*?[\s\*]{_NAME}\s*\([^;{{}}]*\)\s*;"),
    ],
}
RULES["cpp"] = [("class_specifier", rf"\bclass\s+(?:[A-Z_]+\s+)?{_NAME}\s*(?:final\s*)?(?::[^{{;]*)?\{{"), *RULES["c"]]
#: The same compiled, with a word that a text must hold for the rule to fit, if there is one.
_RULES = {lang: [(kind, re.compile(p), word[1] if (word := re.match(r"\\b(\w+)", p)) else "") for kind, p in rules] for lang, rules in RULES.items()}
_NOT_CALLS = frozenset("if for while switch return match fn func function catch sizeof def class and or not in is lambda print elif with assert except loop move".split())


_BLANK_LINES, _LINE_END = re.compile(r"\n{2,}"), re.compile("\n")


def digest(source: str) -> str:
    """Hash of the trimmed lines, runs of blank lines collapsed."""
    text = "\n".join([x.strip(" ") for x in source.split("\n")])
    if "\n\n" in text:
        text = _BLANK_LINES.sub("\n\n", text)
    return hashlib.md5(text.encode()).hexdigest()


def line_starts(source: str) -> list[int]:
    return [0, *[m.end() for m in _LINE_END.finditer(source)]]


class _Rows:
    """Definition rows of one file; places are looked up, not counted from the file's start each time."""

    def __init__(self, path: str, lang: str, source: str):
        self.path, self.lang, self.source, self.rows = path, lang, source, []
        self.lines = line_starts(source)
        #: Bytes before each code point, if any takes more than one.
        self.bytes = None if source.isascii() else [0, *itertools.accumulate(len(c.encode()) for c in source)]
        self.seen: dict[str, int] = {}

    def add(self, name: str, kind: str, start: int, end: int, parent: str | None) -> str:
        """The id: path, kind and content hash, and a number from the second equal definition of the file on."""
        body = self.source[start:end]
        h = digest(body)
        line = bisect.bisect_right(self.lines, start) - 1
        first = start if self.bytes is None else self.bytes[start]
        key = f"{self.path}:{kind}:{h[:8]}"
        n = self.seen[key] = self.seen.get(key, 0) + 1
        self.rows.append({
            "id": key if n == 1 else f"{key}:{n}", "name": name, "file": self.path, "kind": kind, "lang": self.lang, "start_line": line + 1,
            "end_line": line + 1 + body.count("\n"), "start_byte": first, "end_byte": first + (len(body) if self.bytes is None else len(body.encode())), "parent_id": parent,
            "content_hash": h, "source": body, "parse_error": None,
        })
        return self.rows[-1]["id"]


_DEFINITIONS = frozenset((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
#: Where statements stand in each other, in the order of the source; expressions hold none.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
_HOLDERS = (ast.mod, ast.stmt, ast.excepthandler, ast.match_case)
#: The same by type of node.
_BLOCKS_OF = {t: tuple(b for b in _BLOCKS if b in t._fields) for t in vars(ast).values() if isinstance(t, type) and issubclass(t, _HOLDERS)}


def parse_python(path: str, source: str, tree: ast.AST | None = None) -> list[dict]:
    """Functions (async too) and classes, nearest enclosing definition as parent; decorators are part of a definition."""
    lines = source.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    found = _Rows(path, "python", source)
    _visit(tree or ast.parse(source), None, lines, starts, found)
    return found.rows


def _visit(node: ast.AST, parent: str | None, lines: list[str], starts: list[int], found: _Rows) -> None:
    for block in _BLOCKS_OF[type(node)]:
        for kid in getattr(node, block):
            if type(kid) in _DEFINITIONS:
                kind = "class_definition" if isinstance(kid, ast.ClassDef) else "function_definition"
                line = min([kid.lineno, *[d.lineno for d in kid.decorator_list]])
                start = starts[line - 1] + (len(lines[line - 1]) - len(lines[line - 1].lstrip()))
                last = lines[kid.end_lineno - 1]
                end = starts[kid.end_lineno - 1] + (min(kid.end_col_offset, len(last)) if last.isascii() else len(last.encode()[: kid.end_col_offset].decode(errors="ignore")))
                _visit(kid, found.add(kid.name, kind, start, end, parent), lines, starts, found)
            elif _BLOCKS_OF[type(kid)]:
                _visit(kid, parent, lines, starts, found)


_BRACKET = re.compile(r"[{}()\[\];]")


class _Brackets:
    """Where items end: brackets are read once, and each open brace knows its close."""

    def __init__(self, text: str):
        self.at = [m.start() for m in _BRACKET.finditer(text)]
        self.text, self.close, self.stops = text, {}, []
        opened = []
        for i in self.at:
            c = text[i]
            if c in "{};":
                self.stops.append(i)
                if c == "{":
                    opened.append(i)
                elif c == "}" and opened:
                    self.close[opened.pop()] = i

    def begin(self, at: int) -> int:
        """Behind what ends before ``at`` in its line, or the line's start."""
        k = bisect.bisect_left(self.stops, at)
        return max(self.text.rfind("\n", self.stops[k - 1] + 1 if k else 0, at) + 1, self.stops[k - 1] + 1 if k else 0)

    def end(self, at: int) -> int:
        """Where the item that begins before ``at`` ends: its brace block, or the next ``;`` outside of brackets."""
        round_ = 0
        for k in range(bisect.bisect_left(self.at, at), len(self.at)):
            i = self.at[k]
            c = self.text[i]
            if c == "{":
                return self.close.get(i, len(self.text) - 1) + 1
            if c == "}":
                return i
            round_ += (c in "([") - (c in ")]")
            if c == ";" and round_ <= 0:
                return i + 1
        return len(self.text)


_INDENT = re.compile(r"\s*")


def parse_braced(path: str, source: str, lang: str, text: str | None = None) -> list[dict]:
    """Items by rule, at most one for a position, nested ones under the nearest that encloses them; ``text`` is the masked source if it is at hand."""
    text = masked(source, lang) if text is None else text
    found: dict[int, tuple[int, str, str]] = {}
    for kind, pattern, word in _RULES[lang]:
        for m in pattern.finditer(text) if word in text else ():
            if m[1] not in _NOT_CALLS:
                head = m.start() + len(m[0]) - len(m[0].lstrip())
                found.setdefault(m.start(1), (head, kind, m[1]))  # the first rule wins
    if not found:
        return []
    rows, stack, brackets = _Rows(path, lang, source), [], _Brackets(text)
    for at, (head, kind, name) in sorted(found.items(), key=lambda x: x[1][0]):
        start = min(head, _INDENT.match(text, brackets.begin(head)).end())  # with what stands before it in the line
        end = brackets.end(at)
        while stack and stack[-1][0] <= start:
            stack.pop()
        stack.append((end, rows.add(name, kind, start, end, stack[-1][1] if stack else None)))
    return rows.rows


def dialect(path: str, source: str) -> str:
    """C or C++ of a header by what it holds."""
    lang = LANGS.get(path.rsplit(".", 1)[-1].lower(), "")
    if path.endswith(".h") and re.search(r"\b(class|namespace|template|public:|private:)\b", masked(source, "cpp")):
        return "cpp"
    return lang


def parse_file(path: str, source: str) -> list[dict]:
    """Definition rows of one file; errors become a row."""
    lang = dialect(path, source)
    try:
        if not lang:
            raise ValueError("unknown extension")
        if lang == "python":
            return parse_python(path, source)
        if path.endswith(".svelte"):
            source = "\n".join(re.findall(r"<script[^>]*>(.*?)</script>", source, re.S))
        return parse_braced(path, source, lang)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [dict.fromkeys([x.split()[0] for x in SCHEMA.split(", ")]) | {"file": path, "lang": lang or None, "parse_error": str(e)[:200]}]


def _parser(lang: str):
    def parse(path: str, source: str) -> list[dict]:
        return parse_braced(path, source, lang)

    return parse


parse_rust, parse_typescript, parse_go, parse_c, parse_cpp = (_parser(x) for x in ("rust", "typescript", "go", "c", "cpp"))
parse_dispatch, dialect_sniff = parse_file, dialect


def c_prototypes(path: str, source: str) -> list[dict]:
    """Function prototypes alone."""
    return [r for r in parse_braced(path, source, "c") if r["kind"] == "function_declaration"]


def macro_recover(rows: list[dict]) -> list[dict]:
    """``class MACRO Name {`` that was read as a function is a type."""
    for r in rows:
        if r["kind"] == "function_definition" and re.match(r"\s*(class|struct)\s+[A-Z_]+\s+\w+", r["source"] or ""):
            r["kind"] = "class_specifier"
    return rows


def rust_export_name(attributes: str, name: str) -> str:
    """The name an export attribute gives, else the function's own."""
    m = re.search(r"name\s*=\s*\"([^\"]+)\"", attributes)
    return m[1] if m else name


def py_import_exports(source: str, exports: set[str]) -> set[str]:
    """Imported names that are exports."""
    return {o.rsplit(".", 1)[-1] for o in py_imports(source).values()} & exports


def go_import_match(directory: str, spec: str) -> bool:
    """The directory is a suffix of the import path, by whole components."""
    return ("/" + spec.strip("/")).endswith("/" + directory.strip("/"))


def go_pkg_resolve(candidates: list[tuple[str, str]], spec: str) -> str | None:
    """Of (id, file) the first whose directory matches the import, tests last."""
    fit = [(f.endswith("_test.go"), f, i) for i, f in candidates if "/" in f and go_import_match(f.rsplit("/", 1)[0], spec)]
    return min(fit)[2] if fit else None


def py_resolve(receiver: str | None, name: str, imports: dict[str, str], local: set[str]) -> str:
    """How a Python call resolves: local, import, or nothing for a receiver that no import binds."""
    if receiver is None:
        return "import" if name in imports else "local" if name in local else "none"
    if receiver in ("self", "cls"):
        return "local"
    return "import" if receiver in imports else "none"


def spread(files: DataFrame, by: str = "path") -> DataFrame:
    """Rows dealt out over all cores by ``by``: source text is small for the work that it gives, so that split by size it is a few tasks."""
    return files.repartition(max(12, 3 * files.sparkSession.sparkContext.defaultParallelism), by)


def of_langs(path: Column, *langs: str) -> Column:
    """Paths whose files may be read as one of ``langs``; a header is C or C++."""
    endings = [e for e, lang in LANGS.items() if lang in langs or (e == "h" and "cpp" in langs)]
    return F.lower(F.substring_index(path, ".", -1)).isin(endings)


_ARROW = {"string": pa.string(), "long": pa.int64()}


def per_file(files: DataFrame, rows: Callable[[str, str], list[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """What ``rows`` makes of each of ``files(path, source)``, in the order of ``schema``; ``dealt`` files lie on all cores already."""
    columns = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True) for r in rows(path, source or "")]
            for at in range(0, len(found), 10_000):
                values = zip(*found[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, columns, strict=True)], schema=columns)

    files = files.select("path", "source")
    return (files if dealt else spread(files)).mapInArrow(run, schema)


#: A file without any of these words defines no type.
_TYPE_WORDS = "class|struct|enum|union|trait|type|interface"


def may_define_types(source: Column) -> Column:
    return functools.reduce(operator.or_, [F.contains(source, F.lit(w)) for w in _TYPE_WORDS.split("|")])


def extract(files: DataFrame, dealt: bool = False, columns: Sequence[str] = (), sites: Sequence[str] = ()) -> DataFrame:
    """Definition rows of ``files(path, source)``, of all columns or of ``columns``; a null source is an empty file.

    With ``sites``, files of these languages, which are read once for both, also give
    rows without an id that hold a call site in the columns ``site_...``.  A column
    ``above``, if it is named, holds the lines, four at most, before a definition's first.
    """
    return _extracted(files, dealt, columns, sites)


def _extracted(files: DataFrame, dealt: bool, columns: Sequence[str], langs: Sequence[str]) -> DataFrame:
    shown = [c for c in SCHEMA.split(", ") if not columns or c.split()[0] in columns] + ["above string"] * ("above" in columns)
    names = [c.split()[0] for c in shown]
    calls = [f"site_{c}" for c in SITE_SCHEMA.split(", ") if langs]
    no_definition, no_site = (None,) * len(shown), (None,) * len(calls)

    def rows(path: str, source: str) -> list[tuple]:
        definitions, found = _all_of(path, source, langs)
        if "above" in columns:
            lines = source.split("\n")
            for r in definitions:
                r["above"] = "\n".join(lines[max(r["start_line"] - 5, 0) : r["start_line"] - 1]) if r["start_line"] else None
        return [(*[r[c] for c in names], *no_site) for r in definitions] + [no_definition + x for x in found]

    return per_file(files, rows, ", ".join(shown + calls), dealt)


# ---------------------------------------------------------------- calls and imports


def py_imports(source: str) -> dict[str, str]:
    """Local name -> dotted origin of every import statement."""
    return _tree_imports(ast.parse(source))


def _tree_imports(tree: ast.AST) -> dict[str, str]:
    out, todo = {}, [tree]
    for node in todo:  # which grows by the statements of each node
        for block in _BLOCKS:
            todo += getattr(node, block, ())
        if isinstance(node, ast.Import):
            for a in node.names:
                out[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                out[a.asname or a.name] = f"{node.module or ''}.{a.name}".lstrip(".")
    return out


def go_imports(source: str) -> dict[str, str]:
    """Package alias -> import path."""
    out = {}
    for block in re.findall(r"import\s*\((.*?)\)", source, re.S) + re.findall(r"import\s+([^\n(]+)", source):
        for alias, path in re.findall(r"(?:^|\n)\s*([\w.]+)?\s*\"([^\"]+)\"", "\n" + block):
            out[alias or path.rsplit("/", 1)[-1]] = path
    return out


def ts_imports(source: str) -> list[tuple[str, str, str]]:
    """(local name, exported name, specifier) of import statements."""
    out = []
    for names, spec in re.findall(r"import\s+(?:type\s+)?([^;'\"]+?)\s+from\s+['\"]([^'\"]+)['\"]", source):
        for group in re.findall(r"\{([^}]*)\}", names):
            for item in filter(None, (x.strip() for x in group.split(","))):
                a, _, b = item.removeprefix("type ").partition(" as ")
                out.append((b.strip() or a.strip(), a.strip(), spec))
        plain = re.sub(r"\{[^}]*\}", "", names).replace(",", " ").strip()
        if m := re.match(r"\*\s+as\s+([\w$]+)", plain):
            out.append((m[1], "*", spec))
        elif plain:
            out.append((plain.split()[0], "default", spec))
    return out


def ts_exports(source: str) -> list[tuple[str, str | None]]:
    """(name, specifier) of exports; ``*`` for a star export."""
    out = [(n, None) for n in re.findall(r"export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([\w$]+)", source)]
    for names, spec in re.findall(r"export\s+(?:type\s+)?\{([^}]*)\}(?:\s*from\s*['\"]([^'\"]+)['\"])?", source):
        out += [(x.partition(" as ")[2].strip() or x.strip(), spec or None) for x in names.split(",") if x.strip()]
    return out + [("*", spec) for spec in re.findall(r"export\s+\*\s+from\s*['\"]([^'\"]+)['\"]", source)]


_CALL = re.compile(r"(?<![A-Za-z_])(?:([A-Za-z_]\w*+)\s*+(?:\.|::)\s*+)?([A-Za-z_]\w*+)\s*+(?:::<[^>]*>)?\(")
_DEFINED = re.compile(r"\b(def|fn|func|function|class)\s+$")


def call_sites(source: str, lang: str = "c", text: str | None = None) -> list[tuple[int, str | None, str]]:
    """(line, receiver, name) of what looks like a call outside of comments and literals; ``text`` is the masked source if it is at hand."""
    if "def " in source:
        text = masked(re.sub(r"#[^\n]*", lambda m: " " * len(m[0]), source), lang)
    elif text is None:
        text = masked(source, lang)
    out, lines = [], line_starts(text)
    for m in _CALL.finditer(text):
        before = text[max(0, m.start() - 9) : m.start()]
        if m[2] not in _NOT_CALLS and not _DEFINED.search(before):
            out.append((bisect.bisect_right(lines, m.start(2)), m[1], m[2]))
    return out


def py_calls(source: str) -> list[tuple[int, str | None, str]]:
    """(line, receiver, name) of Python calls; a receiver that is no name is ``?``."""
    return _tree_calls(ast.parse(source))


def _tree_calls(tree: ast.AST) -> list[tuple[int, str | None, str]]:
    out, todo = [], [tree]
    for node in todo:  # which grows by the parts of each node
        for field in node._fields:
            part = getattr(node, field, None)
            if isinstance(part, list):
                todo += [x for x in part if isinstance(x, ast.AST)]
            elif isinstance(part, ast.AST) and not isinstance(part, ast.expr_context):
                todo.append(part)
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                out.append((node.lineno, None, node.func.id))
            elif isinstance(node.func, ast.Attribute):
                out.append((node.lineno, node.func.value.id if isinstance(node.func.value, ast.Name) else "?", node.func.attr))
    return out


SITE_SCHEMA = "file string, lang string, line long, receiver string, name string, origin string"


def file_sites(path: str, source: str) -> list[tuple]:
    """Call sites of one file, none if it cannot be read."""
    lang = dialect(path, source)
    try:
        if lang == "python":
            tree = ast.parse(source)
            return _bound(path, lang, _tree_calls(tree), _tree_imports(tree))
        return _braced_sites(path, source, lang)
    except SyntaxError:
        return []


def _braced_sites(path: str, source: str, lang: str, text: str | None = None) -> list[tuple]:
    bound = go_imports(source) if lang == "go" else {a: f"{s}#{b}" for a, b, s in ts_imports(source)} if lang == "typescript" else {}
    return _bound(path, lang, call_sites(source, lang, text), bound)


def _bound(path: str, lang: str, calls: list[tuple[int, str | None, str]], bound: dict[str, str]) -> list[tuple]:
    return [(path, lang, line, r, n, bound.get(r if r else n)) for line, r, n in calls]


def _all_of(path: str, source: str, langs: Sequence[str]) -> tuple[list[dict], list[tuple]]:
    """Definitions of one file and, if its language is one of ``langs``, call sites; by one tree or one masked text."""
    lang = dialect(path, source) if langs else ""
    if lang not in langs:
        return parse_file(path, source), []
    if lang == "python":
        try:
            tree = ast.parse(source)
            return parse_python(path, source, tree), _bound(path, lang, _tree_calls(tree), _tree_imports(tree))
        except (SyntaxError, ValueError, RecursionError):
            return parse_file(path, source), []
    if path.endswith(".svelte"):  # its definitions are those of its scripts
        return parse_file(path, source), _braced_sites(path, source, lang)
    text = masked(source, lang)
    return parse_braced(path, source, lang, text), _braced_sites(path, source, lang, text)


def python_sites_too(files: DataFrame, dealt: bool = False, columns: Sequence[str] = ()) -> DataFrame:
    """Rows of ``extract``, and rows without an id that hold a Python call site in the columns ``site_...`` of ``sites``."""
    return _extracted(files, dealt, columns, ("python",))


def sites(files: DataFrame, dealt: bool = False) -> DataFrame:
    """``(file, lang, line, receiver, name, origin)`` of call sites; origin is what an import binds the receiver or name to."""
    return per_file(files, file_sites, SITE_SCHEMA, dealt)


def call_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """``(src, dst)``: call sites joined to the block around them and to the target they resolve to.

    A bare name is the same file's definition, else the one its import names,
    else (not in Python) the only definition of the family.  An attribute call
    resolves through an imported module alone; Go methods never do.
    """
    from ..operators.names import enclosing_block

    callable_ = nodes.where(F.col("kind").rlike("function|method|arrow|class"))
    inside = enclosing_block(callable_, calls, "lang", "receiver", "name", "origin")
    at = inside.select(F.col("id").alias("src"), F.col("file").alias("f"), F.col("lang").alias("l"), "receiver", "name", "origin").distinct()
    leaf = F.when((F.col("l") == "typescript") & F.col("receiver").isNull() & F.col("origin").isNotNull() & ~F.endswith("origin", F.lit("#*")), F.element_at(F.split("origin", "#"), -1))
    leaf = F.coalesce(leaf, F.when((F.col("l") == "python") & F.col("receiver").isNull() & F.col("origin").isNotNull(), F.element_at(F.split("origin", r"\."), -1)), F.col("name"))
    at = at.withColumn("leaf", leaf).withColumn("family", _family(F.col("l")))
    defs = callable_.select(F.col("id").alias("dst"), F.col("file").alias("f"), _family(F.col("lang")).alias("family"), F.col("name").alias("leaf"))
    site = ["src", "name", "receiver"]
    own = at.where(F.col("origin").isNull() & (F.col("receiver").isNull() | F.col("receiver").isin("self", "cls", "this", "Self")))
    local = own.join(defs, ["f", "family", "leaf"]).select(*site, "dst", F.lit(3).alias("rank"))
    # An import and a definition meet by name and by the last part of module and file or folder, which agree if the paths do.
    module = F.when(F.col("l") == "python", F.when(F.col("receiver").isNull(), F.regexp_replace("origin", r"\.[^.]*$", "")).otherwise(F.col("origin"))).otherwise(F.element_at(F.split("origin", "#"), 1))
    wanted = F.regexp_replace(F.regexp_replace(module, r"^(\./|\.\./)+", ""), r"\.", "/")
    bound = at.where(F.col("origin").isNotNull()).withColumn("wanted", wanted).withColumn("part", F.element_at(F.split("wanted", "/"), -1)).drop("f")
    stem = F.regexp_replace(F.regexp_replace("f", r"\.[^./]+$", ""), r"/(__init__|index)$", "")
    folder = F.regexp_replace("f", r"/[^/]*$", "")
    homes = F.when(F.col("family") == "go", F.array_distinct(F.array(stem, folder))).otherwise(F.array(stem))
    places = defs.withColumn("home", F.explode(homes)).withColumn("part", F.element_at(F.split("home", "/"), -1)).drop("f")
    slash = F.lit("/")
    fits = F.endswith(F.concat(slash, "home"), F.concat(slash, "wanted")) | F.endswith(F.concat(slash, "wanted"), F.concat(slash, "home"))
    imported = bound.join(places, ["family", "leaf", "part"]).where(fits).select(*site, "dst", F.lit(2).alias("rank"))
    # One row for each name, whatever the number of its definitions.
    only = defs.groupBy("family", "leaf").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").drop("n")
    free = at.where(F.col("receiver").isNull() & F.col("origin").isNull() & F.col("l").isin("rust", "c", "cpp", "typescript", "go"))
    single = free.join(only, ["family", "leaf"]).select(*site, "dst", F.lit(1).alias("rank"))
    best = local.union(imported).union(single).where("src <> dst")
    best = best.withColumn("top", F.max("rank").over(_by(*site))).where("rank = top")
    return best.select("src", "dst").distinct()


def _family(lang):
    """C and C++ call each other; other languages resolve among themselves."""
    return F.when(lang == "cpp", "c").otherwise(lang)


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)

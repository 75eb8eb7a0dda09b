"""Extraction, resolution and bridges over a project for each document, each against the rows that its source means.

The tables of the fixtures hold no program text, so each document becomes a copy of
the project of ``sources/samples.py`` under names of its own; the SQL lists what a
reader of one expects and says it of all documents.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import bridges as B
from .operators import resolution as V
from .operators.storage import save
from .sources import extract as X
from .sources import samples
from .sources.views import load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


#: What a column of the expected rows holds: ``path:name``, a path, a name, or what is the same for every document.
_LABEL, _PATH, _NAME = "concat('d', doc_id, '/', split_part({c}, ':', 1), ':', split_part({c}, ':', 2), '_', w, '_', doc_id)", "concat('d', doc_id, '/', {c})", "concat({c}, '_', w, '_', doc_id)"
_HOLDS = {"src": _LABEL, "dst": _LABEL, "caller_file": _PATH, "callee_file": _PATH, "caller": _NAME, "callee": _NAME, "file": _PATH, "path": _PATH, "name": _NAME, "ancestor": _NAME, "export": _NAME}


def expect(columns: str, *rows: tuple, first: bool = False, **holds: str):
    """Registers a query whose rows are known for each document, or for the first one; ``holds`` says what a column has where its name does not."""

    def literal(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    def add(f):
        QUERIES[f.__name__] = f
        listed = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
        shown = ", ".join((holds.get(c) or _HOLDS.get(c, "{c}")).format(c=c) + f" AS {c}" for c in columns.split(", "))
        only = " WHERE doc_id = (SELECT min(doc_id) FROM documents)" if first else ""
        ORACLE_SQL[f.__name__] = f"SELECT {shown} FROM (VALUES {listed}) t({columns}), (SELECT doc_id, {samples.WORD} AS w FROM documents) d{only}"
        return f

    return add


_SAME = "{c}"


def sources(spark, sf_dir) -> DataFrame:
    """The files of all projects; they are made where they are read, from a table of each document's word."""
    return samples.tagged(save(load(spark, sf_dir, "documents").select("doc_id", F.expr(samples.WORD).alias("w")), "words"))


_PLACE = ("id", "name", "file", "kind", "lang", "start_line", "end_line", "parent_id")
_SITE = ("file", "lang", "line", "receiver", "name", "origin")


def parse(files: DataFrame, *more: str) -> DataFrame:
    """Definitions of ``files``: place, kind and name, and the columns ``more``."""
    return save(parsed(files, *more), "nodes")


def parsed(files: DataFrame, *more: str) -> DataFrame:
    """The same for a query that reads them once."""
    return X.extract(files, True, (*_PLACE, *more, "parse_error")).where("parse_error is null").select(*_PLACE, *more)


def _apart(both: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Definitions and call sites of ``both``."""
    both = save(both.where("parse_error is null").select(*_PLACE, *more, *(f"site_{c}" for c in _SITE)), "nodes")
    return both.where("id is not null").select(*_PLACE, *more), both.where("id is null").select(*(F.col(f"site_{c}").alias(c) for c in _SITE))


def of(files: DataFrame, *langs: str) -> DataFrame:
    """The files that a query over definitions and calls of ``langs`` alone has to parse."""
    return files.where(X.of_langs(F.col("path"), *langs))


def _calls(spark, sf_dir, *langs: str) -> tuple[DataFrame, DataFrame]:
    return _apart(X.extract(of(sources(spark, sf_dir), *langs), True, (*_PLACE, "parse_error"), langs))


def _first(spark, sf_dir) -> tuple[str, str]:
    """Folder and ending of the names of the first document."""
    docs = load(spark, sf_dir, "documents")
    least = docs.agg(F.min("doc_id")).first()[0]  # texts are not sorted with the ids
    r = docs.where(F.col("doc_id") == least).selectExpr("doc_id", f"{samples.WORD} as w").first()
    return f"d{r.doc_id}", f"_{r.w}_{r.doc_id}"


def _names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` as ``file:name``."""
    at = nodes.select("id", F.concat_ws(":", "file", "name").alias("label"))
    named = edges.withColumnsRenamed({"src": "_s", "dst": "_d"}).join(at.withColumnsRenamed({"id": "_s", "label": "src"}), "_s").join(at.withColumnsRenamed({"id": "_d", "label": "dst"}), "_d")
    return named.drop("_s", "_d")


def _defs(spark, sf_dir, parse, *suffixes: str) -> DataFrame:
    def rows(path: str, source: str) -> list[tuple]:
        return [(r["file"], r["name"], r["kind"], r["start_line"], r["end_line"]) for r in parse(path, source)]

    return _per_file(spark, sf_dir, rows, "file string, name string, kind string, start_line long, end_line long", *suffixes)


def _per_file(spark, sf_dir, rows: Callable[[str, str], list[tuple]], schema: str, *suffixes: str) -> DataFrame:
    """What ``rows`` makes of each file whose path ends in one of ``suffixes``."""
    fit = functools.reduce(operator.or_, [F.endswith("path", F.lit(x)) for x in suffixes])
    return X.per_file(sources(spark, sf_dir).where(fit), rows, schema, dealt=True)


_DEF = "file, name, kind, start_line, end_line"


@expect(
    _DEF, ("app/main.py", "run", "function_definition", 5, 7), ("app/main.py", "twice", "function_definition", 10, 11), ("app/utils.py", "clean", "function_definition", 1, 2),
    ("app/utils.py", "strip", "function_definition", 5, 6), ("app/models.py", "Model", "class_definition", 1, 3), ("app/models.py", "save", "function_definition", 2, 3),
    ("app/models.py", "check", "function_definition", 6, 7), ("app/models.py", "create", "function_definition", 10, 11), ("app/dyn.py", "go", "function_definition", 1, 3),
    ("app/dyn.py", "len_of", "function_definition", 6, 8), ("ffi/use.py", "main", "function_definition", 4, 6),
)
def parse_python(spark, sf_dir):
    return _defs(spark, sf_dir, X.parse_python, ".py")


@expect(
    _DEF, ("lib/src/core.rs", "dispatch", "function_item", 1, 4), ("lib/src/core.rs", "Job", "struct_item", 6, 6), ("lib/src/handler.rs", "handle", "function_item", 1, 4),
    ("ffi/src/lib.rs", "word_count", "function_item", 2, 4), ("ffi/src/lib.rs", "search", "function_item", 8, 10), ("ffi/src/lib.rs", "open_project", "function_item", 13, 13),
)
def parse_rust(spark, sf_dir):
    return _defs(spark, sf_dir, X.parse_rust, ".rs")


@expect(
    _DEF, ("web/api.ts", "fetchAll", "function_declaration", 1, 3), ("web/api.ts", "load", "arrow_function", 5, 5), ("web/page.ts", "Page", "class_declaration", 3, 7),
    ("web/page.ts", "show", "method_definition", 4, 6), ("web/ipc.ts", "openIt", "function_declaration", 1, 3),
)
def parse_typescript(spark, sf_dir):
    return _defs(spark, sf_dir, X.parse_typescript, ".ts")


@expect(
    _DEF, ("srv/main.go", "Serve", "function_declaration", 5, 8), ("srv/main.go", "help", "function_declaration", 10, 10), ("srv/db/db.go", "Open", "function_declaration", 3, 3),
    ("srv/db/db.go", "Conn", "type_spec", 5, 5), ("srv/db/db.go", "Close", "method_declaration", 7, 7), ("srv/db/other_test.go", "TestOpen", "function_declaration", 3, 5),
)
def parse_go(spark, sf_dir):
    return _defs(spark, sf_dir, X.parse_go, ".go")


@expect(_DEF, ("native/op.h", "add", "function_declaration", 1, 1), ("native/op.c", "add", "function_definition", 2, 4), ("native/op.c", "twice_of", "function_definition", 6, 8))
def parse_c(spark, sf_dir):
    return _defs(spark, sf_dir, X.parse_c, ".c", ".h")


@expect(_DEF, ("native/op.h", "add", "function_declaration", 1, 1))
def c_prototypes(spark, sf_dir):
    return _defs(spark, sf_dir, X.c_prototypes, ".c", ".h")


# ---------------------------------------------------------------- calls

_EDGE = "src, dst"


@expect(
    _EDGE, ("app/main.py:run", "app/utils.py:clean"), ("app/main.py:run", "app/models.py:create"), ("app/main.py:twice", "app/main.py:run"), ("app/utils.py:clean", "app/utils.py:strip"),
    ("app/models.py:save", "app/models.py:check"), ("app/models.py:create", "app/models.py:Model"),
)
def py_call_edges(spark, sf_dir):
    nodes, sites = _calls(spark, sf_dir, "python")
    return _names(V.py_call_edges(nodes, sites), nodes)


@expect(_EDGE, ("lib/src/core.rs:dispatch", "lib/src/handler.rs:handle"))
def rust_call_edges(spark, sf_dir):
    nodes, sites = _calls(spark, sf_dir, "rust")
    return _names(V.rust_call_edges(nodes, sites), nodes)


@expect(_EDGE, ("srv/main.go:Serve", "srv/db/db.go:Open"), ("srv/main.go:Serve", "srv/main.go:help"), ("srv/db/other_test.go:TestOpen", "srv/db/db.go:Open"))
def go_call_edges(spark, sf_dir):
    nodes, sites = _calls(spark, sf_dir, "go")
    return _names(V.go_call_edges(nodes, sites), nodes)


@expect(_EDGE, ("web/api.ts:fetchAll", "web/api.ts:load"), ("web/page.ts:show", "web/api.ts:fetchAll"))
def ts_call_edges(spark, sf_dir):
    nodes, sites = _calls(spark, sf_dir, "typescript")
    return _names(V.ts_call_edges(nodes, sites), nodes)


@expect(_EDGE, ("native/op.c:twice_of", "native/op.c:add"))
def c_call_edges(spark, sf_dir):
    nodes, sites = _calls(spark, sf_dir, "c")
    return _names(V.c_call_edges(nodes, sites), nodes)


@expect(_EDGE, ("native/op.c:twice_of", "native/op.c:add"), ("ffi/bind.cpp:compute_all", "native/op.c:add"))
def cpp_call_edges(spark, sf_dir):
    nodes, sites = _calls(spark, sf_dir, "cpp", "c")
    return _names(V.cpp_call_edges(nodes.where("kind <> 'function_declaration'"), sites), nodes)


@expect(_EDGE, ("app/models.py:create", "app/models.py:Model"), ("srv/db/db.go:Close", "srv/db/db.go:Conn"))
def usage_edges(spark, sf_dir):
    files = sources(spark, sf_dir)
    nodes = parse(files.where(X.may_define_types(F.col("source"))), "source")  # types are used in their own file
    return V.usages(nodes).select(F.concat_ws(":", "file", "name").alias("src"), F.concat_ws(":", "file", "word").alias("dst"))


@expect("file, name, origin", ("web/index.ts", "fetchAll", "web/api.ts"), ("web/index.ts", "Page", "web/page.ts"), ("web/api.ts", "fetchAll", "web/api.ts"), ("web/api.ts", "load", "web/api.ts"), ("web/page.ts", "Page", "web/page.ts"), ("web/ipc.ts", "openIt", "web/ipc.ts"), origin=_PATH)
def ts_reexport(spark, sf_dir):
    def rows(path: str, source: str) -> list[tuple]:
        home = path.rsplit("/", 1)[0]
        return [(path, name, spec and f"{home}/{spec.removeprefix('./')}.ts") for name, spec in X.ts_exports(source)]

    return V.ts_reexport(save(_per_file(spark, sf_dir, rows, "file string, name string, target string", ".ts"), "exports"))


@expect("file, line, name", ("app/models.py", 3, "save"), ("app/main.py", 6, "run"), ("web/page.ts", 5, "show"))
def enclosing_callable(spark, sf_dir):
    files = sources(spark, sf_dir)
    lines = F.expr("case when path like '%app/models.py' then array(3L) when path like '%app/main.py' then array(6L) when path like '%web/page.ts' then array(5L, 1L) end")
    at = files.select(F.col("path").alias("file"), F.explode(lines).alias("line"))
    nodes = parsed(files.where(lines.isNotNull()))  # what is around a line stands in its file
    return V.enclosing_callable(nodes, at, "name").select("file", "line", "name")


@expect("name, ancestor, depth", ("save", "Model", 1), ("show", "Page", 1))
def ast_ancestor(spark, sf_dir):
    nodes = parse(sources(spark, sf_dir))
    up = V.ast_ancestor(nodes, nodes.select("id"))
    return up.join(nodes.select("id", "name"), "id").join(nodes.select(F.col("id").alias("ancestor"), F.col("name").alias("a")), "ancestor").select("name", F.col("a").alias("ancestor"), "depth")


@expect("name", ("clean",), ("strip",))
def module_interior(spark, sf_dir):
    label = "app::utils"
    files = sources(spark, sf_dir).where(V.may_hold_module(F.col("path"), F.col("source"), label))
    return V.module_interior(parsed(files), label).select("name")


@expect("name, points", ("save", 200), first=True)
def qualify_evidence(spark, sf_dir):
    _, tag = _first(spark, sf_dir)
    nodes = parse(V.may_define(sources(spark, sf_dir), f"save{tag}"), "source")
    return V.qualify_evidence(nodes, f"Model{tag}", f"save{tag}").join(nodes.select("id", "name"), "id").select("name", "points")


@expect("name", ("save",), first=True)
def seed_qualified(spark, sf_dir):
    _, tag = _first(spark, sf_dir)
    nodes = parse(V.may_define(sources(spark, sf_dir), f"save{tag}"), "source")
    return V.seed_qualified(nodes, f"app::Model{tag}::save{tag}").join(nodes, "id").select("name")


@expect("path", ("app/main.py",), ("native/op.h",), first=True)
def detect_full_files(spark, sf_dir):
    home, _ = _first(spark, sf_dir)
    return V.detect_full_files(sources(spark, sf_dir), f"see {home}/app/main.py, then {home}/native/op.h").select("path")


# ---------------------------------------------------------------- imports and bridges


@expect("file, name, origin", ("app/main.py", "utils", "app.utils"), ("app/main.py", "m", "app.models"), ("ffi/use.py", "ffi_mod", "ffi_mod"), name=_SAME)
def py_imports(spark, sf_dir):
    def rows(path: str, source: str) -> list[tuple]:
        return [(path, a, b) for a, b in X.py_imports(source).items()]

    return _per_file(spark, sf_dir, rows, "file string, name string, origin string", ".py")


@expect("file, name, origin", ("srv/main.go", "db", "srv/db"), name=_SAME, origin=_PATH)
def go_imports(spark, sf_dir):
    def rows(path: str, source: str) -> list[tuple]:
        return [(path, a, b) for a, b in X.go_imports(source).items()]

    return _per_file(spark, sf_dir, rows, "file string, name string, origin string", ".go")


@expect("file, name, exported, spec", ("web/page.ts", "all", "fetchAll", "./api"), name=_SAME, exported=_NAME)
def ts_imports(spark, sf_dir):
    def rows(path: str, source: str) -> list[tuple]:
        return [(path, *r) for r in X.ts_imports(source)]

    return _per_file(spark, sf_dir, rows, "file string, name string, exported string, spec string", ".ts")


def exporting(files: DataFrame) -> DataFrame:
    """The files that native exports are found in, and those of C that they may name."""
    path = F.col("path")
    return files.where(X.of_langs(path, "c", "cpp") | (X.of_langs(path, "rust") & B.may_export(F.col("source"))))


def calling(files: DataFrame) -> DataFrame:
    """The files with calls and definitions of IPC commands."""
    path, source = F.col("path"), F.col("source")
    return files.where((X.of_langs(path, "typescript") & B.may_call_ipc(source)) | (X.of_langs(path, "rust") & B.may_define_ipc(source)))


@expect("name, export", ("word_count", "word_count"), ("search", "search_all"))
def rust_exports(spark, sf_dir):
    files = of(sources(spark, sf_dir), "rust").where(B.may_export(F.col("source")))
    return B.rust_exports(parsed(files, "above"), None, "name").select("name", "export")


@expect("name, export", ("compute_all", "compute_all"))
def pybind_exports(spark, sf_dir):
    files = of(sources(spark, sf_dir), "c", "cpp").where(B.may_be_bound(F.col("source")))
    return B.pybind_exports(parsed(files), files, "name").select("name", "export")


@expect("export, name", ("word_count", "word_count"), ("search_all", "search"), ("compute_all", "compute_all"))
def ffi_export_map(spark, sf_dir):
    files = exporting(sources(spark, sf_dir))
    nodes = parse(files.where(X.of_langs(F.col("path"), "rust") | B.may_be_bound(F.col("source"))), "above")
    return B.ffi_export_map(B.rust_exports(nodes, None, "name").union(B.pybind_exports(nodes, files, "name")), "name").select("export", "name")


def _with_python(nodes: DataFrame, files: DataFrame, exports: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with the definitions, and the call sites, of the Python files that may link to ``exports``."""
    found, sites = _apart(X.python_sites_too(B.naming(of(files, "python"), exports), columns=(*_PLACE, *more, "parse_error")), *more)
    return nodes.union(found), sites


@expect("src, dst, kind", ("ffi/use.py:main", "ffi/src/lib.rs:word_count", "export"), ("ffi/use.py:main", "ffi/bind.cpp:compute_all", "export"))
def py_link_exports(spark, sf_dir):
    files = sources(spark, sf_dir)
    native = exporting(files)
    nodes = parse(native)
    exports = save(B.native_exports(nodes, native), "exports")
    nodes, sites = _with_python(nodes, files, exports)
    return _names(B.py_link_exports(nodes, sites, exports), nodes)


@expect("src, dst, kind", ("web/ipc.ts:openIt", "ffi/src/lib.rs:open_project", "ipc"))
def ipc_edges(spark, sf_dir):
    files = calling(sources(spark, sf_dir))
    nodes = parse(files, "source")
    return _names(B.ipc_edges(nodes, of(files, "rust")), nodes)


@expect("src, dst, kind", ("ffi/use.py:main", "ffi/src/lib.rs:word_count", "export"), ("ffi/use.py:main", "ffi/bind.cpp:compute_all", "export"), ("web/ipc.ts:openIt", "ffi/src/lib.rs:open_project", "ipc"))
def interconnect_maps(spark, sf_dir):
    path, source = F.col("path"), F.col("source")
    rust = X.of_langs(path, "rust") & (B.may_export(source) | B.may_define_ipc(source))
    files = sources(spark, sf_dir)
    native = files.where(X.of_langs(path, "c", "cpp") | rust)
    nodes = parse(files.where(X.of_langs(path, "c", "cpp") | rust | (X.of_langs(path, "typescript") & B.may_call_ipc(source))), "source")
    exports = save(B.native_exports(nodes, native), "exports")
    nodes, sites = _with_python(nodes, files, exports, "source")
    return _names(B.interconnect_maps(nodes, native, sites, exports=exports), nodes)


@expect(
    "caller_file, caller, callee_file, callee", ("app/main.py", "run", "app/utils.py", "clean"), ("app/main.py", "run", "app/models.py", "create"), ("app/main.py", "twice", "app/main.py", "run"),
    ("app/utils.py", "clean", "app/utils.py", "strip"), ("app/models.py", "save", "app/models.py", "check"), ("app/models.py", "create", "app/models.py", "Model"),
)
def python_call_edges(spark, sf_dir):
    return samples.python_project(sources(spark, sf_dir), dealt=True)

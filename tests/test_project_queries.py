"""Queries over a project for each document parse the files that can give rows, once, and all of those."""

import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from meshlight import catalogue_code as C
from meshlight.functions.text import TYPE_KINDS
from meshlight.operators import bridges as B
from meshlight.operators import resolution as V
from meshlight.operators.names import enclosing_block
from meshlight.sources import extract as X
from meshlight.sources import lexing


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("two")
    spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize(("query", "files", "rows"), [
    ("ts_call_edges", 4, 2), ("go_call_edges", 3, 3), ("c_call_edges", 2, 1), ("cpp_call_edges", 3, 2), ("usage_edges", 5, 2), ("enclosing_callable", 3, 3),
    ("module_interior", 1, 2), ("rust_exports", 1, 2), ("pybind_exports", 3, 1), ("ffi_export_map", 4, 3), ("ipc_edges", 2, 1), ("interconnect_maps", 10, 3),
])
def test_files_that_cannot_give_rows_are_not_parsed(spark, two, monkeypatch, query, files, rows):
    parsed = []

    def seen(name):
        before = getattr(X, name)
        monkeypatch.setattr(X, name, lambda f, *a, **k: (parsed.append(f.count()), before(f, *a, **k))[1])

    for name in ("extract", "python_sites_too"):
        seen(name)
    assert C.QUERIES[query](spark, two).count() == 2 * rows
    assert parsed and sum(parsed) <= 2 * files  # 36 before


def test_python_definitions_stand_in_statements_of_all_kinds():
    source = (
        "try:\n    def a(): pass\nexcept E:\n    def b(): pass\nelse:\n    class c: pass\nfinally:\n    async def d(): pass\n"
        "match x:\n    case 1:\n        def e():\n            with f as g:\n                def h(): import i.j as k\n"
        "for l in m:\n    pass\nelse:\n    while n:\n        def o(): from p import q\nw = lambda: [r(s) for t in u(v)]\n"
    )
    found = [r["name"] for r in X.parse_python("a.py", source)]
    assert found == list("abcdeho")
    assert X.py_imports(source) == {"k": "i.j", "q": "p.q"}
    assert sorted(c[2] for c in X.py_calls(source)) == ["r", "u"]
    long = "def f():\n    return " + " + ".join(["g(1)"] * 900) + "\n"
    assert [r["name"] for r in X.parse_file("a.py", long)] == ["f"]  # was an error of recursion
    assert len(X.py_calls(long)) == 900 and ast.parse(long)


def test_each_rule_of_a_type_has_a_word_that_its_files_hold():
    for rules in X.RULES.values():
        for kind, pattern in rules:
            if any(x in kind for x in TYPE_KINDS):
                assert re.match(r"\\b(" + X._TYPE_WORDS + r")\\s", pattern), pattern


def test_python_calls_come_with_the_definitions(spark):
    files = spark.createDataFrame([("a.py", "import m\ndef f():\n    m.g(1)\n"), ("b.py", "def ("), ("c.rs", "fn h() { i() }"), ("d.py", None)], "path string, source string")
    both = X.python_sites_too(files)
    assert sorted(r.name for r in both.where("id is not null").collect()) == ["f", "h"]
    site = both.where("id is null and parse_error is null").select(*(f"site_{c.split()[0]}" for c in X.SITE_SCHEMA.split(", ")))
    assert [tuple(r) for r in site.collect()] == [("a.py", "python", 3, "m", "g", "m")]
    assert both.where("parse_error is not null").count() == 1


def test_usage_and_enclosing_blocks_keep_their_rows(spark):
    schema = "id string, file string, name string, kind string, source string, start_line long, end_line long"
    nodes = spark.createDataFrame([("t", "a", "Type", "class_x", "Type", 1, 2), ("f", "a", "f", "function", "Type Type Other", 1, 9), ("g", "b", "g", "function", "Type", 1, 9), ("h", "a", "h", "function", None, 1, 3)], schema)
    assert V.usage_edges(nodes).collect() == [("f", "t")]
    sites = spark.createDataFrame([("a", 2, "x", None), ("a", 2, "y", "r"), ("a", 2, "y", "r"), ("c", 1, "z", None)], "file string, line long, name string, receiver string")
    got = enclosing_block(nodes, sites, "name", "receiver").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 2, "x", None, "t"), ("a", 2, "y", "r", "t")]


def test_the_first_document_is_the_least_id_that_there_is(spark, tmp_path):
    spark.createDataFrame([(None, "zero"), (5, "five words"), (3, "Three words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert C._first(spark, str(tmp_path)) == ("d3", "_three_3")  # the row without an id came first


@pytest.mark.parametrize(("query", "files"), [("interconnect_maps", 6), ("py_link_exports", 5)])
def test_python_files_that_name_no_export_are_not_parsed(spark, two, monkeypatch, query, files):
    parsed = []
    for name in ("extract", "python_sites_too"):
        before = getattr(X, name)
        monkeypatch.setattr(X, name, lambda f, *a, before=before, **k: (parsed.append(f.count()), before(f, *a, **k))[1])
    C.QUERIES[query](spark, two).count()
    assert sum(parsed) == 2 * files  # the five Python files of a document before, now the one that calls an export


def test_files_that_name_an_export_are_kept_however_they_do(spark):
    exports = spark.createDataFrame([("r", "word_count"), ("s", "lookup"), ("t", "ﬁnd_all"), ("u", "main"), ("v", None)], "id string, export string")
    python = {
        "call.py": "m.word_count(1)", "paren.py": "(\n(lookup))(1)", "def.py": "def word_count(): pass", "format.py": "f'{lookup(1)}'", "other.py": "x = 'é'\nname(1)",
        "part.py": "word_counts(1); my_lookup(1)", "common.py": "def main(): return 1", "keyword.py": "import os", "empty.py": "", "null.py": None,
    }
    kept = B.naming(spark.createDataFrame([*python.items()], "path string, source string"), exports)
    assert sorted(r.path for r in kept.collect()) == ["call.py", "def.py", "format.py", "other.py", "paren.py"]


@pytest.mark.parametrize(("query", "files", "rows"), [("go_call_edges", 3, 3), ("c_call_edges", 2, 1), ("cpp_call_edges", 3, 2)])
def test_files_are_read_once_for_definitions_and_calls(spark, two, monkeypatch, query, files, rows):
    read, before = [], X.per_file
    monkeypatch.setattr(X, "per_file", lambda f, *a, **k: (read.append(f.count()), before(f, *a, **k))[1])
    assert C.QUERIES[query](spark, two).count() == 2 * rows
    assert sum(read) == 2 * files  # twice as many before


def test_definitions_and_call_sites_of_one_reading_are_those_of_two(spark):
    texts = {
        "a.py": "import m\ndef f():\n    m.g(1)\n", "b.py": "def (", "c.rs": "fn h() { i::j(k(1)) } // l(1)\n", "d.svelte": "<script>\nfunction n() { o(1) }\n</script>\n{p(1)}\n",
        "e.ts": "import { q as r } from './s';\nexport function t() { return r(`${u(1)}`) }\n", "f.go": "import \"v/w\"\nfunc x() { w.y() }\n", "g.h": "class A {};\nint z(int a) { return b<int>(a); }\n", "h.c": "# def c(1)\nint d() { return e (1); }\n", "i.txt": "f(1)", "j.c": None,
    }
    files = spark.createDataFrame([*texts.items()], "path string, source string")
    langs = ("python", "rust", "typescript", "go", "c", "cpp")
    both = X.extract(files, sites=langs)
    names, sites = [c.split()[0] for c in X.SCHEMA.split(", ")], [c.split()[0] for c in X.SITE_SCHEMA.split(", ")]
    site = both.where("id is null and parse_error is null")
    assert sorted(map(repr, both.where("id is not null or parse_error is not null").select(*names).collect())) == sorted(map(repr, X.extract(files).select(*names).collect()))
    found = {tuple(r) for r in site.select(*(f"site_{c}" for c in sites)).collect()}
    assert found == {tuple(r) for r in X.sites(files).select(*sites).collect() if r.lang}
    assert {(r[0], r[3], r[4]) for r in found} >= {("a.py", "m", "g"), ("c.rs", "i", "j"), ("c.rs", None, "k"), ("e.ts", None, "r"), ("f.go", "w", "y"), ("h.c", None, "e"), ("d.svelte", None, "p")}
    assert [r[:] for r in X.extract(files, columns=("id",)).where("id is null").collect()] == [(None,)] * 2


def test_receivers_and_names_of_calls_are_whole_words():
    assert X.call_sites("a.b (1); c::d::<E>(2); 9f(3); é_g(4); h . i(5); j.(6)") == [(1, "a", "b"), (1, "c", "d"), (1, None, "f"), (1, None, "_g"), (1, "h", "i")]


def counted(monkeypatch):
    parsed, before = [], X.extract
    monkeypatch.setattr(X, "extract", lambda f, *a, **k: (parsed.append(f.count()), before(f, *a, **k))[1])
    return parsed


def test_c_files_without_a_body_are_not_parsed_for_bindings(spark, two, monkeypatch):
    parsed = counted(monkeypatch)
    assert sorted(C.QUERIES["pybind_exports"](spark, two).collect()) == [("compute_all_some_1", "compute_all_some_1"), ("compute_all_x_2", "compute_all_x_2")]
    assert sum(parsed) == 2 * 2  # the header too before


def test_bindings_keep_columns_of_their_targets(spark):
    texts = {"a.cpp": 'm.def("e", &n::f); m.def("g", h);', "b.h": "int f(int);", "c.c": "int f(int x) { return x; }\nint h(int x) { return x; }", "d.c": '.def("i", f)'}
    files = spark.createDataFrame([*texts.items()], "path string, source string")
    assert sorted(B.pybind_exports(X.extract(files), files, "name", "file").select("export", "name", "file").collect()) == [("e", "f", "c.c"), ("g", "h", "c.c")]


@pytest.mark.parametrize("lang", ["rust", "go", "c", "cpp", "typescript"])
def test_comments_and_literals_are_those_of_a_search_at_each_letter(monkeypatch, lang):
    parts = ['r#"', '"#', 'br"', 'R"(', ')"', "'a'", "'a", '"', "'", "`", "${", "}", "{", "/*", "*/", "//", "/", "\\", "\n", "b", "r", "R", "x", "1", " ", "(", ")", "=", "#"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 24))) for _ in range(4000)]
    fast = [lexing.masked(t, lang) for t in texts]
    monkeypatch.setattr(lexing, "_opened", lambda opener, source, at: opener.search(source, at))
    assert fast == [lexing.masked(t, lang) for t in texts]


def test_rust_exports_need_no_second_reading_of_the_texts(spark, tmp_path, monkeypatch):
    # Two documents of one id: their files share paths, by which texts and definitions met.
    spark.createDataFrame([(1, "some words"), (1, "other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = C.QUERIES["rust_exports"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(f"{n}_{w}_1", f"{e}_{w}_1") for n, e in (("search", "search_all"), ("word_count", "word_count")) for w in ("other", "some")]
    assert "Join" not in found._jdf.queryExecution().toString()


def test_the_lines_above_are_those_of_the_text(spark):
    body = "fn a() {}\n"
    texts = {f"{n}.rs": "#[no_mangle]\n" + "// x\n" * n + body for n in range(6)} | {
        "n.rs": '#[pyfunction]\n#[pyo3(name = "b")]\n' + body, "o.rs": body + "#[napi]\n" + body, "p.rs": "#[napi]\n\n\n\n" + body, "q.rs": "#[napi]\n\n\n\n\n" + body, "r.py": "def f(): pass", "s.rs": None, "t.txt": "fn",
    }
    files = spark.createDataFrame([*texts.items()], "path string, source string")
    nodes = X.extract(files, columns=("id", "name", "file", "kind", "lang", "start_line", "above"))
    found = sorted(map(tuple, B.rust_exports(nodes, None, "file").select("file", "export").collect()))
    assert found == sorted(map(tuple, B.rust_exports(nodes.drop("above"), files, "file").select("file", "export").collect()))
    assert found == [("0.rs", "a"), ("n.rs", "b"), ("o.rs", "a"), ("p.rs", "a")]
    assert "above" not in X.extract(files).columns


def test_texts_are_made_once_for_conditions_and_rows(spark, two):
    files = C.sources(spark, two).where(X.may_define_types(F.col("source")) & F.endswith("path", F.lit(".rs")))
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 2  # of the names and of the home, again for each use of the text before
    assert plan.index("EndsWith") > plan.index("replace(")  # below it: texts of other paths are not made
    assert sorted(p.path for p in files.collect()) == ["d1/lib/src/core.rs", "d2/lib/src/core.rs"]


def test_usages_name_block_and_type_without_joins_by_id(spark, two):
    schema = "id string, file string, name string, kind string, source string"
    nodes = spark.createDataFrame([("t", "a", "Type", "class_x", "Type"), ("f", "a", "f", "function", "Type Type"), ("g", "a", "f", "function", "Type"), ("h", "b", "h", "function", "Type")], schema)
    assert sorted(map(tuple, V.usages(nodes).collect())) == [("f", "t", "a", "f", "Type"), ("g", "t", "a", "f", "Type")]
    plan = C.QUERIES["usage_edges"](spark, two)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # four before


@pytest.mark.parametrize("label", ["app::utils", "a.b+c", "x", ""])
def test_files_of_a_module_are_those_of_its_hints(spark, label):
    hints = V.module_hints(label)
    paths = [None, "", *(p + h + e for h in hints for p in ("", "/", "q/", "q") for e in ("", "x", "\n")), *(h.replace(".", "_") for h in hints), *(h.upper() for h in hints)]
    table = spark.createDataFrame([(p,) for p in paths], "file string")
    expected = sorted(p for p in paths if p is not None and any(p == h or p.endswith("/" + h) for h in hints))
    assert sorted(r.file for r in table.where(V.in_module(F.col("file"), label)).collect()) == expected
    assert table.select(V.in_module(F.col("file"), label).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("file#") <= 4  # 36 before


def test_definitions_that_are_read_once_are_not_written(spark, two, monkeypatch):
    written, before = [], C.save
    monkeypatch.setattr(C, "save", lambda df, name: (written.append(name), before(df, name))[1])
    for query in ("module_interior", "rust_exports", "pybind_exports"):
        C.QUERIES[query](spark, two)
    assert written == ["words"] * 3  # and nodes, before


def test_the_export_map_parses_no_header_and_joins_no_names(spark, two, monkeypatch):
    parsed = counted(monkeypatch)
    found = C.QUERIES["ffi_export_map"](spark, two)
    assert sum(parsed) == 2 * 3  # four of a document before
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # three before
    exports = spark.createDataFrame([("b", "x", "n"), ("a", "x", "m"), ("c", "y", None)], "id string, export string, name string")
    assert sorted(map(tuple, B.ffi_export_map(exports, "name").collect())) == [("x", "a", "m"), ("y", "c", None)]


def test_enclosing_blocks_bring_their_columns(spark, two):
    nodes = spark.createDataFrame([("c", "a", "C", "class_definition", 1, 9), ("f", "a", "f", "function_definition", 2, 5), ("g", "b", None, "function_definition", 1, 2)], "id string, file string, name string, kind string, start_line long, end_line long")
    sites = spark.createDataFrame([("a", 3), ("a", 8), ("b", 2), ("b", 3)], "file string, line long")
    expected = [("a", 3, "f", "f", 2), ("a", 8, "c", "C", 1), ("b", 2, "g", None, 1)]
    assert sorted(map(tuple, enclosing_block(nodes, sites, of=("name", "start_line")).collect())) == expected
    plan = C.QUERIES["enclosing_callable"](spark, two)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # two before


def test_ancestors_are_followed_to_the_top(spark, two, monkeypatch):
    chain = [(f"n{k}", f"name{k}", f"n{k - 1}" if k else None) for k in range(6)] + [("x", "x", "y"), ("y", "y", "x")]
    nodes = spark.createDataFrame(chain, "id string, name string, parent_id string")
    monkeypatch.setattr(C, "parse", lambda files: nodes)
    found = C.QUERIES["ast_ancestor"](spark, two).collect()
    want = {(f"name{k}", f"name{j}", k - j) for k in range(6) for j in range(k)}  # depths above 2 were left out
    assert {tuple(r) for r in found if r.name > "n" and r.name < "o"} == want
    assert max(r.depth for r in found if r.name in "xy") == 64

"""Scalar rules, extraction and graph operators on small literal cases."""

from pyspark.sql import functions as F

from meshlight.functions import paths as P
from meshlight.functions import text as T
from meshlight.operators import graph as G
from meshlight.operators import names as N
from meshlight.operators.components import connected_components
from meshlight.operators.storage import file_delta, load_graph, save, save_graph
from meshlight.sources import extract as X
from meshlight.sources import samples


def values(spark, column, rows, *names):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_tokens():
    assert T.code_shaped("cpuGnnForward") and T.code_shaped("a/b") and T.code_shaped("Group") and not T.code_shaped("word")
    assert T.strong_token("longword") and not T.strong_token("abc") and not T.strong_token("if")
    assert T.split_camel("initWindowSize") == ["init", "Window", "Size"]
    assert T.raw_tokens("find initWindow in src/app.rs")[0] == "src/app.rs"
    assert T.normalize_seed("`a::b::run()`") == "run"
    assert [T.recency_text(x) for x in (5, 120, 7200, 200000)] == ["just now", "2 mins ago", "2 hours ago", "2 days ago"]
    assert T.truncate_tokens("aaaa\nbbbb\ncc", 10) == "aaaa\nbbbb"


def test_name_scores(spark):
    rows = [("handle", "handle"), ("do_handle", "handle"), ("rehandle", "handle"), ("handler", "handle"), ("a_handle_b", "handle"), ("xhandley", "handle"), ("other", "handle")]
    assert values(spark, T.name_score(F.col("n"), F.col("t")), rows, "n", "t") == [100600.0, 848.0, 530.0, 474.0, 424.0, 162.0, 0.0]


def test_role_tiers(spark):
    rows = [("struct_item",), ("function_item",), ("impl_item",), ("const_item",), ("type_alias",), ("mod_item",), ("call",), ("if_expression",), ("unknown",), ("odd",)]
    assert values(spark, T.role_tier(F.col("k")), rows, "k") == [100, 90, 70, 50, 45, 30, 10, 0, 5, 20]


def test_name_hash(spark):
    rows = [("",), ("a",), ("ARGENTINA and a long name",), ("ü",)]
    assert values(spark, T.name_hash_column(F.col("n")), rows, "n") == [T.name_hash(r[0]) for r in rows]


def test_paths(spark):
    rows = [("tests/a.py",), ("test_repos/app/a.py",), ("src/a_test.go",), ("vendor/x/y.c",), ("src/a.rs",)]
    assert values(spark, P.noise_block(F.col("p")), rows, "p") == [True, False, True, True, False]
    assert values(spark, P.dir_prune(F.col("p")), rows, "p") == [False, False, False, True, False]
    assert values(spark, P.app_path_priority(F.col("p")), rows, "p") == [10, 50, 10, 20, 200]
    assert P.scope_sanitize("./a/../b/") == "b/" and P.scope_sanitize("/etc") is None and P.scope_blank(" . ")


def test_cycles_are_strong_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("g", "d"), ("h", "i"), ("i", "h"), ("e", "h")], ["src", "dst"])
    assert sorted(r.id for r in G.detect_cycles(edges, save).collect()) == ["a", "b", "c", "f", "h", "i"]


def test_components_with_nulls_and_loops(spark):
    rows = [(1, 2), (2, 3), (5, 4), (6, 6), (None, 1), (10, 9), (9, 8), (8, 7), (7, 10)]
    got = dict(connected_components(spark.createDataFrame(rows, "u long, v long"), save).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7, 10: 7}


def test_evict_overlay_and_delta(spark):
    nodes = spark.createDataFrame([("1", "f", "a.py", "k"), ("2", "g", "b.py", "k")], ["id", "name", "file", "kind"])
    edges = spark.createDataFrame([("1", "2"), ("2", "2")], ["src", "dst"])
    kept, left = G.evict_file(nodes, edges, nodes.where("file = 'a.py'").select("file"))
    assert [r.id for r in kept.collect()] == ["2"] and left.collect() == [("2", "2")]
    new = spark.createDataFrame([("9", "f", "a.py", "k"), ("8", "h", "a.py", "k")], ["id", "name", "file", "kind"])
    assert sorted(r.id for r in G.overlay_file(nodes, new).collect()) == ["1", "8"]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "path string, hash long")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "path string, hash long")
    assert dict(file_delta(a, b).collect()) == {"x": "added", "y": "changed", "z": "deleted"}


def test_graph_is_saved_and_loaded(spark, tmp_path):
    e = spark.createDataFrame([("a", "b")], ["src", "dst"])
    save_graph(str(tmp_path), e, e, e, e)
    assert load_graph(spark, str(tmp_path))["edges"].collect() == [("a", "b")]


def test_enclosing_block_is_the_smallest(spark):
    blocks = spark.createDataFrame([("out", "f", 1, 100), ("in", "f", 10, 20), ("else", "g", 1, 9)], "id string, file string, start_line long, end_line long")
    sites = spark.createDataFrame([("f", 15), ("f", 70), ("g", 10)], "file string, line long")
    assert sorted(N.enclosing_block(blocks, sites).collect()) == [("f", 15, "in"), ("f", 70, "out")]


def test_python_definitions():
    rows = X.parse_file("a.py", "class C:\n    def meth(self):\n        x = 1\n\nasync def foo():\n    pass\nCONST = 1\n")
    assert [(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in rows] == [("C", "class_definition", 1, 3), ("meth", "function_definition", 2, 3), ("foo", "function_definition", 5, 6)]
    assert rows[1]["parent_id"] == rows[0]["id"]
    assert X.parse_file("b.py", "def (")[0]["parse_error"]
    assert X.parse_file("b.xyz", "")[0]["parse_error"]


def test_braced_definitions():
    rust = X.parse_file("a.rs", "fn hello() {\n    // fn no() {}\n    let s = \"fn never() {}\";\n}\nstruct S { a: u8 }\nimpl Show for S {\n    fn show(&self) {}\n}\nconst X: u8 = 1;\n")
    assert [(r["name"], r["kind"]) for r in rust] == [("hello", "function_item"), ("S", "struct_item"), ("S", "impl_item"), ("show", "function_item"), ("X", "const_item")]
    assert (rust[0]["start_line"], rust[0]["end_line"]) == (1, 4) and rust[3]["parent_id"] == rust[2]["id"]
    c = X.parse_file("a.c", "int add(int a, int b);\nint add(int a, int b) {\n  return a;\n}\n")
    assert [r["kind"] for r in c] == ["function_declaration", "function_definition"]
    go = X.parse_file("a.go", "package a\nfunc Open() {}\ntype T struct{}\nfunc (t *T) Close() {}\n")
    assert [(r["name"], r["kind"]) for r in go] == [("Open", "function_declaration"), ("T", "type_spec"), ("Close", "method_declaration")]


def test_call_edges_of_the_sample(spark):
    got = {(r.caller, r.callee) for r in samples.named_edges(samples.files(spark)).collect()}
    assert {("run", "clean"), ("run", "create"), ("twice", "run"), ("clean", "strip"), ("save", "check"), ("dispatch", "handle"), ("show", "fetchAll"), ("fetchAll", "load"), ("Serve", "Open"), ("Serve", "help"), ("twice_of", "add")} <= got
    assert ("handle", "dispatch") not in got and ("strip", "strip") not in got


def test_c_declarations(spark):
    nodes = X.extract(samples.files(spark)).where("parse_error is null")
    pairs = N.c_decl_def(nodes)
    ends = nodes.select("id", "file", "name")
    row = pairs.join(ends, pairs.src == ends.id).select("file", "name", "dst").first()
    assert (row.file, row.name) == ("native/op.c", "add") and row.dst.startswith("native/op.h:function_declaration")


def test_c_declarations_of_one_name_are_not_paired(spark):
    """All of a name's definitions and prototypes: the best of each by score, file and id, without a row for each two."""
    import time

    files = ["a/m.c", "a/m.h", "b/m.h", "b/n.c", "a/tests/m.h", "m.h", "z.c"]
    rows = [(f"{k}{i}", "f", "c", files[i % 7], f"function_{k}", "static int f()" if i % 5 == 0 else "int f()") for k in ("definition", "declaration") for i in range(8000)]
    nodes = spark.createDataFrame(rows, "id string, name string, lang string, file string, kind string, source string").repartition(8)
    began = time.monotonic()
    got = {r.src: r.dst for r in N.c_decl_def(nodes).collect()}
    assert time.monotonic() - began < 90 and len(got) == 8000
    score = lambda a, b: 100 * (_stem(a) == _stem(b)) + 30 * (_home(a) == _home(b)) + 40 * b.endswith(".h") - 50 * ("tests" in b)
    _stem, _home = (lambda f: f.split("/")[-1].split(".")[0]), (lambda f: f.rpartition("/")[0])
    first = {f: min(r[0] for r in rows if r[3] == f and r[4] == "function_declaration") for f in files}
    for i in range(8000):
        f = files[i % 7]
        assert got[f"definition{i}"] == first[f if i % 5 == 0 else min(files, key=lambda g: (-score(f, g), g))]

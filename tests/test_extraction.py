"""Definitions with ids of their own, and call edges across languages, names and folders."""

import time

import pytest

from meshlight.operators import storage
from meshlight.operators.graph import canonize
from meshlight.sources import extract as X
from meshlight.sources import lexing, samples
from meshlight.streaming import changes


def edges(spark, files):
    table = spark.createDataFrame(files, "path string, source string")
    nodes = X.extract(table).where("parse_error is null")
    names = {r.id: (r.file, r.name) for r in nodes.collect()}
    return sorted((names[r.src], names[r.dst]) for r in X.call_edges(nodes, X.sites(table)).collect())


def test_c_and_cpp_call_each_other(spark):
    found = edges(spark, [
        ("a.c", "int helper(int x) {\n  return x;\n}\n"),
        ("b.cpp", "int twice(int x) {\n  return helper(x) + helper(x);\n}\n"),
        ("c.c", "int once(int x) {\n  return helper(x);\n}\n"),
        ("d.go", "package d\nfunc alone() {\n  helper(1)\n}\n"),
    ])
    assert found == [(("b.cpp", "twice"), ("a.c", "helper")), (("c.c", "once"), ("a.c", "helper"))]


def test_names_with_many_definitions_resolve_by_file_and_import_alone(spark):
    files = [(f"pkg/m{i}.py", f"def get():\n    return {i}\n\ndef use():\n    return get()\n") for i in range(30)]
    files += [("app.py", "from pkg.m7 import get\n\ndef run():\n    return get() + get()\n"), ("lost.py", "def none():\n    return get()\n")]
    found = edges(spark, files)
    assert (("app.py", "run"), ("pkg/m7.py", "get")) in found
    assert len(found) == 31 and all(src[0] == dst[0] or src[0] == "app.py" for src, dst in found)


def test_equal_definitions_have_ids_of_their_own():
    source = "class A:\n    def f(self):\n        return 1\n\nclass B:\n    def f(self):\n        return 1\n"
    rows = X.parse_file("a.py", source)
    assert len({r["id"] for r in rows}) == 4
    by = {r["id"]: r["name"] for r in rows}
    assert [by[r["parent_id"]] for r in rows if r["name"] == "f"] == ["A", "B"]


def test_long_files_take_time_in_proportion():
    def took(n):
        source = "mod m {\n" + "".join(f"fn f{i}(é: u8) {{ if a {{ g(\"{{\"); }} }}\n" for i in range(n)) + "}\n"
        began = time.perf_counter()
        rows = X.parse_file("a.rs", source)
        assert len(rows) == n + 1 and rows[-1]["start_line"] == n + 1
        assert source.encode()[rows[-1]["start_byte"] : rows[-1]["end_byte"]].decode() == rows[-1]["source"]
        return time.perf_counter() - began

    took(100)
    assert min(took(4000) for _ in range(3)) < 30 * max(0.002, min(took(400) for _ in range(3)))


def test_many_functions_take_seconds_on_lines_and_on_one():
    n = 32_000
    for glue in ("\n", " "):
        source = glue.join(f"fn f{i}(a: u8) {{ g{i}(a) }}" for i in range(n))
        began = time.perf_counter()
        rows = X.parse_rust("a.rs", source)
        calls = X.call_sites(source, "rust")
        assert time.perf_counter() - began < 8  # 24 s and more when each item looked through all before it
        assert [r["name"] for r in rows] == [f"f{i}" for i in range(n)] and rows[7]["source"] == "fn f7(a: u8) { g7(a) }"
        assert [c[2] for c in calls] == [f"g{i}" for i in range(n)] and calls[-1][0] == (n if glue == "\n" else 1)


NO = "fn no() {}"


@pytest.mark.parametrize(("lang", "text", "names"), [
    ("rust", f"/* /* */ {NO} */ fn yes() {{}}", ["yes"]),
    ("rust", f'let s = r#"{NO} " {NO}"#; fn yes() {{ let c = \'"\'; }} fn also<\'a>(x: &\'a str) {{ "{{" }}', ["yes", "also"]),
    ("rust", f"// {NO}\n/* {NO}\n{NO} */ fn yes() {{}} /* {NO}", ["yes"]),
    ("rust", f'let s = "a \\" {NO}\n{NO}"; let b = b"{{"; fn yes() {{}}', ["yes"]),
    ("typescript", "function b(x) { return /\\{/.test(x) }\nfunction c() { return 1 / 2 / 3 }\nfunction d() {}", ["b", "c", "d"]),
    ("typescript", "function a() { return x.replace(/[/\"'{]/g, '') / 2 }\nfunction b() {}", ["a", "b"]),
    ("typescript", "const t = `a ${f(`function no() {} ${1}`)} function no() {}`\nfunction yes() {}", ["t", "yes"]),
    ("typescript", "function a() { return '}' + \"{\" + y / 2; } // {\nfunction b() {}", ["a", "b"]),
    ("go", "var s = `func no() {`\nfunc yes() { x := '{' }\nfunc also() {}", ["yes", "also"]),
    ("c", "/* /* int no(void) {} */\nint yes(void) { char c = '}'; return 0; }\nint also(void) { return 1; }", ["yes", "also"]),
    ("cpp", 'int yes() { auto s = R"x(int no() { )" )x"; return 1\'000\'000; }\nint also() { return 2; }', ["yes", "also"]),
])
def test_comments_and_literals_hold_no_code(lang, text, names):
    rows = X.parse_braced("a", text, lang)
    assert [r["name"] for r in rows] == names
    assert len(lexing.masked(text, lang)) == len(text) and lexing.masked(text, lang).count("\n") == text.count("\n")
    assert all(r["source"].count("{") >= 1 and r["source"].rstrip(";").endswith(("}", "`")) for r in rows)


def test_literals_that_do_not_end_take_time_in_proportion():
    for lang in ("rust", "typescript", "go", "c", "cpp"):
        for piece in ("/*", '"', "'", "`", "`${", 'R"x(', 'r#"', "//", "/ a", "/[", "\\"):
            began = time.perf_counter()
            text = piece * 20_000
            assert len(lexing.masked(text, lang)) == len(text)
            assert time.perf_counter() - began < 3, (lang, piece)


def test_a_table_of_nodes_outlives_its_object(spark, tmp_path):
    schema = "id string, file string, name string, kind string, seq long"
    rows = spark.createDataFrame([("1", "a", "f", "k", 1)], schema)
    table = changes.NodeTable(spark, f"{tmp_path}/t", rows.schema)
    assert table.read().isEmpty()
    table.upsert(rows)
    again = changes.NodeTable(spark, f"{tmp_path}/t", rows.schema)
    assert [r.id for r in again.read().collect()] == ["1"]
    again.upsert(spark.createDataFrame([("2", "a", "f", "k", 2), ("3", "a", "g", "k", 1)], schema))
    assert sorted((r.id, r.name) for r in table.read().collect()) == [("1", "f"), ("3", "g")]


def test_a_failed_save_leaves_the_graph_before_it(spark, tmp_path):
    one = spark.createDataFrame([("a", "b")], "src string, dst string")
    storage.save_graph(str(tmp_path), one, one, one, one)
    broken = one.selectExpr("raise_error('no') as src", "dst")
    try:
        storage.save_graph(str(tmp_path), one, broken, one, one)
    except Exception as e:
        assert "no" in str(e)
    assert storage.load_graph(spark, str(tmp_path))["edges"].collect() == [("a", "b")]


def test_twins_with_null_keys_and_equal_scores(spark):
    nodes = spark.createDataFrame(
        [("a", "n", None, "h", 1.0, 5), ("b", "n", None, "h", 1.0, 7), ("c", "n", None, "h", 1.0, 7), ("d", "n", "k", "h", 0.0, 1)],
        "id string, name string, kind string, content_hash string, score double, size long",
    )
    kept, moved = canonize(nodes, spark.createDataFrame([("a", "d"), ("c", "d"), ("a", "b")], "src string, dst string"))
    assert sorted(r.id for r in kept.collect()) == ["b", "d"] and moved.collect() == [("b", "d")]


def test_call_edges_by_name_read_each_file_once(spark):
    plan = samples.named_edges(samples.files(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # definitions and sites are tables, which the joins share


def test_small_text_is_parsed_by_all_cores(spark):
    """Files that lie in one partition are dealt out, as parsing takes long for their size."""
    one = samples.files(spark).coalesce(1)
    made = samples.projects(spark.range(40).selectExpr("id as doc_id", "'word' as text").coalesce(1))
    for df in (X.extract(one), X.sites(one), made):
        assert df.rdd.getNumPartitions() >= 12
    assert X.extract(made).where("parse_error is null").groupBy("name").count().where("name like 'compute_all%'").count() == 40

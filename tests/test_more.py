"""Discovery, resolution, budgets, intents, lifecycle and the request surface."""

import pytest
from pyspark.sql import functions as F

from meshlight.functions import intent as I
from meshlight.functions import predicates as R
from meshlight.operators import resolution as V
from meshlight.plans import api, goals
from meshlight.plans import ranking as K
from meshlight.sources import extract as X
from meshlight.sources import files as FS
from meshlight.sources import samples
from meshlight.streaming import lifecycle as L


def test_discovery(spark, tmp_path):
    for p, t in {"src/a.py": "def f():\n    pass\n", "src/n.rs": "fn g() {}\n", "target/x.rs": "fn h() {}\n", "notes.txt": "x", "tests/t.py": "def t():\n    f()\n"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    found = FS.discover_paths(spark, str(tmp_path))
    assert [r.path for r in found.collect()] == ["src/a.py", "src/n.rs", "tests/t.py"]
    assert [r.dir for r in FS.dual_stack_detect(found).collect()] == ["src"]
    nodes, inventory = FS.scan_workspace(spark, str(tmp_path))
    assert sorted(r.name for r in nodes.collect()) == ["f", "g", "t"] and inventory.count() == 3
    delta = spark.createDataFrame([("src/a.py", "changed"), ("tests/t.py", "deleted"), ("src/n.rs", "same")], "path string, change string")
    assert sorted(r.name for r in FS.incremental_reparse(nodes, found, delta).collect()) == ["f", "g"]
    assert [r.line for r in FS.grep_tool(found, r"\bf\(").collect()] == [1, 2]
    assert FS.skip_patterns("# c\nbuild/\n!x\n*.log\n", ["out"]) == ["build", "out"]


def test_manifests():
    assert FS.deps_sniff({"Cargo.toml": '[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = [] }\n[dev-dependencies]\nx = "1"\n'}) == ["serde@1.0", "tokio@1.2"]
    assert FS.deps_sniff({"requirements.txt": "a==1.2\nb\n"}) == ["a@1.2", "b@*"] and FS.deps_sniff({"package.json": '{"dependencies": {"x": "^1"}}'}) == ["x@^1"]
    lock = '[[package]]\nname = "a"\nversion = "0.1.0"\ndependencies = [\n "b",\n "serde",\n]\n\n[[package]]\nname = "b"\nversion = "0.2.0"\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\nsource = "registry"\n'
    assert FS.cargo_versions(lock)["serde"] == "1.0.1" and FS.crate_edges(lock) == [("a", "b")]
    assert FS.guess_lang(["go.mod", "x"]) == "go"


@pytest.fixture(scope="module")
def project(spark):
    files = samples.files(spark)
    nodes = X.extract(files).where("parse_error is null").cache()
    return files, nodes, X.sites(files)


def test_resolution(project):
    files, nodes, sites = project
    names = {r.name: r.id for r in nodes.collect()}
    assert {(r.src, r.dst) for r in V.rust_call_edges(nodes, sites).collect()} == {(names["dispatch"], names["handle"])}
    assert V.loc_fallback_gate(nodes, "dispatch") and not V.loc_fallback_gate(nodes, "nothing")
    assert V.token_in_graph(nodes, "dispatch") and not V.exact_in_graph(nodes, "Dispatch")
    assert [r.id for r in V.seed_qualified(nodes, "Model::save").collect()] == [names["save"]]
    assert {r.name for r in V.module_interior(nodes, "app::utils").collect()} == {"clean", "strip"}
    usage = {(r.src, r.dst) for r in V.usage_edges(nodes).collect()}
    assert (names["create"], names["Model"]) in usage
    assert V.detect_full_files(files, "look at app/main.py please").count() == 1
    calls = V.collect_call_edges(nodes, sites.select("file", "line", "name"))
    assert (names["twice"], names["run"]) in {(r.src, r.dst) for r in calls.collect()}


def test_reexports(spark):
    rows = [("a.ts", "x", None), ("b.ts", "*", "a.ts"), ("c.ts", "x", "b.ts"), ("d.ts", "*", "a.ts"), ("d.ts", "*", "e.ts"), ("e.ts", "x", None), ("f.ts", "y", "g.ts"), ("g.ts", "y", "f.ts"), ("h.ts", "*", "d.ts"), ("h.ts", "x", "e.ts")]
    got = {(r.file, r.name): r.origin for r in V.ts_reexport(spark.createDataFrame(rows, "file string, name string, target string")).collect()}
    assert got == {("a.ts", "x"): "a.ts", ("e.ts", "x"): "e.ts", ("b.ts", "x"): "a.ts", ("c.ts", "x"): "a.ts", ("h.ts", "x"): "e.ts"}


def test_language_rules():
    assert X.go_imports('import (\n\tq "a/b/c"\n\t"x/y"\n)') == {"q": "a/b/c", "y": "x/y"}
    assert X.ts_imports("import d, { a as b, c } from './m';\nimport * as n from 'n';") == [("b", "a", "./m"), ("c", "c", "./m"), ("d", "default", "./m"), ("n", "*", "n")]
    assert X.ts_exports("export const a = 1;\nexport { b as c } from './d';\nexport * from './e';") == [("a", None), ("c", "./d"), ("*", "./e")]
    assert X.py_resolve("np", "array", {"np": "numpy"}, set()) == "import" and X.py_resolve("x", "f", {}, {"f"}) == "none"
    assert X.go_pkg_resolve([("1", "srv/db/db_test.go"), ("2", "srv/db/db.go")], "proj/srv/db") == "2"
    assert X.dialect_sniff("a.h", "class A {};") == "cpp" and X.dialect_sniff("a.h", "int f();") == "c"


def test_budgets(spark):
    rows = spark.createDataFrame([("s", "a::run", "src/x.py", "function_item", 5, "1", "caller", 1, 1), ("s", "go", "src/y.py", "function_item", 3, "2", "caller", 1, 2), ("s", "walk", "tests/z.py", "function_item", 9, "3", "caller", 2, 3)], "seed string, name string, file string, kind string, degree long, id string, side string, hop int, place int")
    assert [r.id for r in K.fan_out_cap(rows).collect()] == ["1"]
    assert {r.id for r in K.exclude(rows, ["run", " "]).collect()} == {"2", "3"}
    assert [r.id for r in K.focus_inject(rows, ["go"]).orderBy("place").collect()] == ["2", "1", "3"] and K.focus_missed(rows, ["go", "no"]) == ["no"]
    assert K.sample_offset(rows, 1).count() == 2 and K.cap_strings(["a", "b"], 1) == (["a"], 1) and K.hub_cap(20) == 7
    assert {r.bucket for r in K.neighbor_buckets(rows, "src/x.py").collect()} == {"noise", "same_file", "external"}
    shell = spark.createDataFrame([("mod a;", "mod_item"), ("struct A;", "struct_item"), ("struct A { x: u8 }", "struct_item")], "source string, kind string")
    got = shell.select(R.module_shell(F.col("kind"), F.col("source")), R.forward_shell(F.col("source"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False)]


def test_intents():
    assert I.intent_key("who calls") == "trace" and I.ask_route("where is parse_body defined") == ("find", "parse_body")
    assert I.prompt_intent('"x y"') == "search" and I.prompt_intent("where is a") == "location" and I.fragment("body", ["parse_body"])
    assert I.ts_paths({"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["./src/app/*"]}}}, "@app/x/y") == ["src/app/x/y"]
    assert I.mdef_parse('m.def("f", &ns::g, "doc")') == ("f", "g") and I.path_affinity("app.models", "src/app/models.py") == 2
    assert I.fuzzy_best([("Handle", 1, 1), ("handle", 0, 0), ("rehandle", 99, 99)], "handle") == "handle" and I.gnn_bucket("odd") == 14


def test_lifecycle():
    assert L.edit_region("abcXdef", "abcYYdef") == (3, 4, 5) and L.edit_region("same", "same") == (4, 4, 4)
    s = L.restore_state({"a", "b"}, {"a"}, True)
    assert s.progress() == 0.5 and not s.complete
    s.tolerance("b")
    assert s.edge_complete() and L.restore_state({"a"}, {"a"}, False).progress() == 0
    s.complete, s.inventory = True, {"a", "b", "c"}
    assert s.heal_complete() and not s.complete
    p = L.Police(1)
    assert p.police_submit("x") and not p.police_submit("y") and p.finish("x") == "y"
    assert L.drain(["a"], ["b", "a"]) == ["a", "b"] and L.auto_scope((" ./",), ["src/"], 20_000) == ("src/",) and L.defer_open("critical", 1) == "defer"


def test_surface(spark):
    nodes = spark.createDataFrame([("a", "parse_body", "src/a.py", "function_item", 1, 9, "src"), ("b", "main", "src/b.py", "function_item", 1, 5, "src")], "id string, name string, file string, kind string, start_line long, end_line long, cluster string")
    edges = spark.createDataFrame([("b", "a")], "src string, dst string")
    bridges = spark.createDataFrame([], "src string, dst string, kind string")
    assert [r.id for r in api.context_entry("who calls parse_body", nodes, edges, bridges, limit=3).collect()] == ["b"]
    with pytest.raises(ValueError):
        api.orchestrate("trace", nodes, edges, bridges, goals.Request(""))
    assert api.surgical_pick(nodes, "src/a.py", 4).first().id == "a" and api.compute_mode(3, "trace", 1) == "surgical"
    memo = api.Lru(2)
    for k in "abc":
        memo.put(k, k)
    assert memo.get("a") is None and memo.get("c") == "c" and "ask" in api.tools_list() and len(api.tools_list(True)) == 7
    assert api.render_block("f", "def f() {\n  x\n}", "signature")[0] == "def f() ..." and api.skeleton_tree([(0, "a"), (1, "b")], 1) == "a\n... 1 more"

"""Bridges, goals, freeze, labels, exports and the change stream on literal graphs."""

import pytest
from pyspark.sql import functions as F

from meshlight.operators import bridges as B
from meshlight.operators import graph as G
from meshlight.plans import analytics as A
from meshlight.plans import export, goals, harvest, neural, selection
from meshlight.sources import extract as X
from meshlight.streaming import changes

NODES = [
    ("a", "handle_request", "src/app.py", "function_item", 1), ("b", "parse_body", "src/parse.py", "function_item", 2), ("c", "handle_request", "tests/t.py", "function_item", 3),
    ("d", "Server", "src/server.py", "struct_item", 4), ("e", "main", "src/main.py", "function_item", 5),
]
EDGES = [("e", "a"), ("a", "b"), ("c", "b"), ("d", "e")]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, name string, file string, kind string, start_line long").withColumn("cluster", F.element_at(F.split("file", "/"), 1)).withColumn("end_line", F.col("start_line"))
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    return nodes, edges, spark.createDataFrame([("e", "a", "ipc"), ("e", "a", "export")], "src string, dst string, kind string")


def test_trace(graph):
    nodes, edges, bridges = graph
    rows = goals.trace_find(nodes, edges, bridges, goals.Request("x::handle_request()")).collect()
    assert {(r.side, r.hop, r.id, r.relation) for r in rows} == {("caller", 1, "e", "export"), ("callee", 1, "b", "call"), ("caller", 2, "d", "transitive")}
    assert goals.trace_find(nodes, edges, bridges, goals.Request("nothing_here")).isEmpty()
    assert goals.seed_resolve(nodes, edges, goals.Request("HANDLE_REQUEST")).first().id == "a"
    assert goals.disambiguate(nodes, goals.Request("main")) is None


def test_context_fails_closed(graph):
    nodes, edges, _ = graph
    q = goals.resolve_query(nodes, "how does parse_body work with unknownThing")
    assert "parse_body" in q["exact"] and "unknownThing" in q["unmatched"]
    ids = {r.id for r in goals.get_context(nodes, edges, "where is parse_body").collect()}
    assert "b" in ids and ids <= {"a", "b", "c"}
    assert goals.get_context(nodes, edges, "some prose only").isEmpty()


def test_freeze(graph):
    nodes, edges, bridges = graph
    rows = goals.trace_find(nodes, edges, bridges, goals.Request("handle_request"))
    lost, bad = goals.run_check(goals.freeze_shot(rows), rows.where("id <> 'b'"), True)
    assert [tuple(r) for r in lost.collect()] == [("callee", "parse_body")] and bad
    assert not goals.run_check(goals.freeze_shot(rows), rows, True)[1]


def test_arch_and_export(graph, tmp_path):
    nodes, edges, bridges = graph
    out = goals.arch_summary(nodes, edges, bridges)
    assert {r.cluster for r in out["clusters"].collect()} == {"src", "tests"} and [r.src for r in out["bridges"].collect()] == ["c"]
    index = export.dense_index(nodes)
    assert sorted(tuple(r) for r in index.collect()) == [(x[0], i) for i, x in enumerate(sorted(NODES))]
    contains = nodes.sparkSession.createDataFrame([("a", "e"), ("a", "d")], "src string, dst string")
    assert sorted(r.type for r in export.export_edges(index, edges, contains).collect()) == [0, 1, 1, 1, 1]
    export.export_write(index, edges, str(tmp_path))
    assert export.read_graph(nodes.sparkSession, str(tmp_path))[0].count() == 5
    text = export.mermaid_packed("x", [f"c{i}" for i in range(14)], ["d"])
    assert "and 2 more" in text and text.count("--> seed") == 12
    assert "struct_item Server" in export.skeleton_render(nodes)


def test_selection_and_neural(graph):
    nodes, edges, _ = graph
    deg = G.degrees(nodes, edges)
    capped = selection.cap_by_score(edges.select(F.lit("k").alias("k"), F.col("dst").alias("id"), F.lit(1).alias("score")), "k", 3).collect()
    assert [r.place for r in capped] == [1, 2, 3] and {r.omitted for r in capped} == {1}
    ranked = nodes.withColumn("score", F.lit(1.0))
    assert sorted(r.score for r in neural.diversity(ranked).collect()) == [0.15, 0.15, 0.15, 1.0, 1.0]
    assert deg.agg(F.sum("degree")).first()[0] == 8


def test_labels(spark, graph):
    nodes, edges, _ = graph
    old = spark.createDataFrame([("a", 1.0, "handles every request", "critical")], "id string, score double, note string, pole string")
    new = spark.createDataFrame([("a", 0.0, None), ("b", None, None), (None, 1.0, "x"), ("d", 0.9, "the server loop itself")], "id string, score double, note string")
    out = harvest.commit_emit(old, new, 1)
    assert {r.id for r in out.collect()} == {"a", "b"}
    assert {r.issue: r.n for r in harvest.emit_validate(harvest.emit_sanitize(new)).collect()} == {"ok": 3, "no id": 1}
    assert harvest.next_cards(nodes, old, 3, 2).count() == 2 and harvest.goals_met(50, 10, 40) and not harvest.goals_met(50, 2, 48)
    assert {(r.relation, r.id) for r in harvest.card(nodes, edges, nodes.where("id = 'a'").select("id")).collect()} == {("calls", "b"), ("called_by", "e")}


def test_bridges_from_sources(spark):
    project = {
        "src/lib.rs": "#[pyfunction]\nfn word_count(s: &str) -> usize { 0 }\n\n#[pyfunction]\n#[pyo3(name = \"search_all\")]\nfn search(s: &str) {}\n\n#[tauri::command]\npub fn open_panel() {}\n",
        "pkg/api.py": "def use_it(x):\n    return word_count(x)\n\n\ndef other(x):\n    return x.search_all()\n",
        "ui/app.ts": "export function click() {\n  return invoke('open_panel');\n}\n",
        "nat/bind.cpp": "void compute_all(int a) {\n}\n\nvoid init(int m) {\n  m.def(\"compute_all\", &compute_all);\n}\n",
    }
    files = spark.createDataFrame([*project.items()], "path string, source string")
    nodes = X.extract(files).where("parse_error is null")
    names = {r.id: r.name for r in nodes.collect()}
    found = {(names[r.src], names[r.dst], r.kind) for r in B.interconnect_maps(nodes, files, X.sites(files)).collect()}
    assert {("use_it", "word_count", "export"), ("other", "search", "export"), ("click", "open_panel", "ipc")} <= found
    assert {r.export for r in B.pybind_exports(nodes, files).collect()} == {"compute_all"}


def test_stream_upserts_and_sessions(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, file string, name string, kind string, hash long").schema
    table = changes.NodeTable(spark, f"{tmp_path}/t", schema)
    src = f"{tmp_path}/in"
    full = "id string, file string, name string, kind string, hash long, seq long"
    spark.createDataFrame([("1", "a.py", "f", "k", 10, 1), ("2", "a.py", "g", "k", 11, 1)], full).write.parquet(f"{src}/one")
    stream = lambda: spark.readStream.schema(full).option("recursiveFileLookup", "true").parquet(src)
    changes.watch(stream(), table, f"{tmp_path}/c")
    spark.createDataFrame([("9", "a.py", "f", "k", 12, 2), ("8", "b.py", "h", "k", 13, 2)], full).write.parquet(f"{src}/two")
    changes.watch(stream(), table, f"{tmp_path}/c")
    assert sorted((r.id, r.name, r.hash) for r in table.read().collect()) == [("1", "f", 12), ("2", "g", 11), ("8", "h", 13)]
    events = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00', 'modify', 'a', 1), (1, timestamp'2024-01-01 00:05:00', 'modify', 'a', 2), (1, timestamp'2024-01-01 01:00:00', 'odd', 'a', 3), (1, timestamp'2024-01-01 02:00:00', 'create', 'a', 4) AS t(user, ts, kind, path, id)")
    kept = changes.absorb(events)
    batch = changes.settle(kept, "user", "ts").collect()
    same = A.debounce(kept, "user", "ts", "id", 600).collect()
    assert sorted((r.first_ts, r.last_ts, r.n_events) for r in batch) == sorted((r.first_ts, r.last_ts, r.n_events) for r in same)


def test_update_batch(graph):
    nodes, edges, _ = graph
    parsed = nodes.where("file = 'src/parse.py'").withColumn("id", F.lit("new")).withColumn("start_line", F.lit(9).cast("long"))
    now, kept, cone = changes.update_batch(nodes, edges, parsed, parsed.select("file"))
    assert {(r.id, r.start_line) for r in now.where("name = 'parse_body'").collect()} == {("b", 9)}
    assert kept.count() == 4 and {r.file for r in cone.collect()} == {"src/parse.py", "src/app.py", "tests/t.py"}

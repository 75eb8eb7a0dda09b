"""The persisted name index: odd rows, plans that read single buckets, versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from meshlight.functions import text as T
from meshlight.operators import nameindex as N

SCHEMA = "id string, name string, file string, start_line long, weight long"


def rows_of(n=400):
    r = random.Random(4)
    words = ["get", "Group", "parse_item", "über", "Wert", "typer", "x", "if", "load::All"]
    names = ["".join(r.choices(words, k=r.randrange(1, 4))) for _ in range(60)] + ["straße 7", "é", "ab", "😀icon😀"]
    rows = [(f"n{i}", r.choice(names), f"src/{r.choice(words)}/f{i % 7}.rs", r.randrange(90), r.randrange(30)) for i in range(n)]
    return rows + [("null", None, "a/b.rs", 1, 1), ("empty", "", "a/c.rs", 1, 1), ("nofile", "lonely", None, 3, 2)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    nodes = spark.createDataFrame(rows_of(), SCHEMA)
    return N.build_name_index(nodes, f"file://{tmp_path_factory.mktemp('names')}", buckets=8)


def _best(rows, q):
    names = collections.defaultdict(list)
    for i, name, _, _, w in rows:
        if name:
            names[name].append((-w, i))
    low = q.lower()
    held = {n: min(v) for n, v in names.items() if low in n.lower()}

    def order(n):
        w = -held[n][0]
        if n == q:
            return (0, 0, n)
        return (1, -w, n) if n.lower() == low else (2, -((230 if n.lower().startswith(low) else 80) + w), n)

    best = min(held, key=order, default=None)
    return len(names[q]) if q in names else 0, sum(n.lower() == low for n in held), len(held), best, best and held[best][1]


def test_every_text_is_found_without_a_scan(spark, index):
    rows = rows_of()
    texts = sorted({x[1][a:b].strip() for x in rows if x[1] for a in range(3) for b in (a + 1, a + 2, a + 3, a + 5, 40)} | {"GET", "nowhere", "zz", "q"})
    asked = spark.createDataFrame([(t,) for t in [*texts, None, "", " x "]], "q string")
    found = {r.q: tuple(r)[1:] for r in N.fuzzy_best(index, asked).collect()}
    want = {t: _best(rows, t) for t in {t.strip() for t in [*texts, "x"]} if t}
    assert found == want and sum(v[2] > 0 for v in want.values()) > 40 and want["nowhere"][3] is None
    exact = {r.q: r.exact for r in N.exact_in_graph(index, asked).collect()}
    assert exact == {t: v[0] > 0 for t, v in want.items()}


def _token_hit(rows, q):
    strong, t = T.strong_token(q), q.lower()

    def name_hit(n):
        parts = n.replace(":", "_")
        if n == t:
            return True
        if not strong:
            return len(t.encode()) >= 3 and t in parts.replace("-", "_").split("_")
        size = len(t.encode())
        return (size >= 3 and (n.endswith("_" + t) or n.startswith(t))) or (size >= 4 and n.endswith(t)) or t in parts.split("_") or (size >= 5 and t in n)

    def path_hit(p):
        parts = p.replace("\\", "/").replace(".", "/").replace("-", "/").split("/")
        return len(t.encode()) >= 3 and (t in parts or (strong and len(t.encode()) >= 5 and t in p))

    return any(x[1] == q or (not T.junk_symbol(x[1]) and (name_hit(x[1].lower()) or path_hit((x[2] or "").lower()))) for x in rows if x[1])


def test_tokens_hit_by_the_rules_of_strong_and_weak_ones(spark, index):
    rows = rows_of()
    tokens = ["group", "Group", "item", "parse", "All", "load", "typer", "rs", "src", "f3", "src/x", "Wert", "wert", "über", "getgroup", "if", "x", "lonely", "icon", "getGroup", "nothing_here", "é", "ty"]
    found = {r.q: r.hit for r in N.token_in_graph(index, spark.createDataFrame([(t,) for t in tokens], "q string")).collect()}
    assert found == {t: _token_hit(rows, t) for t in tokens if len(t.lower().encode()) >= 2}
    assert {True, False} == set(found.values())


def test_a_lookup_reads_its_buckets_only(spark, index):
    places = N.places_of(index, "ab")
    want = sorted((f, line, i) for i, n, f, line, _ in rows_of() if n == "ab")
    assert [(r.file, r.start_line, r.id) for r in places.collect()] == want
    plan = places._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(name,ab)" in plan
    asked = spark.createDataFrame([("ab",)], "q string").withColumn("bucket", N._bucket(F.concat(F.lit("name"), F.col("q")), 8))
    files = N._only(index.table("grams"), asked, 8).select(F.input_file_name().alias("f"), "bucket").distinct().collect()
    assert {r.bucket for r in files} == {asked.first().bucket} and N._only(index.table("grams"), asked, 8).count() < index.table("grams").count()


def test_frequent_grams_are_split_and_lists_sorted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "PART_IDS", 16)
    nodes = spark.range(600).selectExpr("concat('n', id) id", "concat('common', id) name", "'a/b' file", "id start_line", "id weight")
    index = N.build_name_index(nodes, f"file://{tmp_path}/n", buckets=4)
    lists = index.table("grams").where("kind = 'name' and gram = 'omm'").collect()
    assert len(lists) > 20 and sum(len(r.ids) for r in lists) == 600 and max(len(r.ids) for r in lists) < 64
    assert all(r.ids == sorted(r.ids) for r in index.table("grams").collect())
    found = N.fuzzy_best(index, spark.createDataFrame([("common",), ("COMMON59",)], "q string")).collect()
    assert {(r.q, r.n_holding, r.best) for r in found} == {("common", 600, "common599"), ("COMMON59", 11, "common59")}


def test_versions_are_made_anew_only_for_other_rows(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    nodes = spark.createDataFrame(rows_of(50), SCHEMA)
    assert N.open_name_index(spark, path) is None
    first = N.ensure_name_index(nodes, path, 4)
    assert N.ensure_name_index(nodes.repartition(3), path, 4).path == first.path
    second = N.ensure_name_index(nodes.where("id <> 'n3'"), path, 4)
    assert second.path != first.path == N.NameIndex(spark, first.path, 4).path and N.open_name_index(spark, path).path == second.path
    assert first.table("places").count() == second.table("places").count() + 1
    none = N.build_name_index(nodes.limit(0), f"{path}0", 4)
    assert N.fuzzy_best(none, spark.createDataFrame([("a",)], "q string")).first().n_holding == 0


def test_column_rules_equal_those_of_the_prompt_side(spark):
    words = ["", " ", "a", "Abc", "abC", "ABCD", "A1", "É2ab", "x/y", "a::b", "a.rs", "snake_case", "if", "If ", "longer", "Self", "été", "ÉTÉS", "a-b-c", "ß", "Ünder", "  pad  ", "no\nway", "...", "a1b2"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rules = {"pascal": T.pascal_col, "code_shaped": T.code_shaped_col, "junk_symbol": T.junk_symbol_col, "strong_token": T.strong_token_col}
    for r in df.select("w", *(f(F.col("w")).alias(n) for n, f in rules.items())).collect():
        assert {n: r[n] for n in rules} == {n: getattr(T, n)(r.w) for n in rules if n != "x"}, r.w

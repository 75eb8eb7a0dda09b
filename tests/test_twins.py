"""Names found in whole texts against a scan with regular expressions; blocks around them by hand and by brute force."""

import collections
import random
import re

from meshlight.operators import twins as X

NODES = "id string, name string, file string, kind string, lang string, begin int, finish int"


def test_occurrences_equal_a_scan(spark):
    r = random.Random(2)
    words = ["alpha_one", "beta", "gamma::delta", "ünder_x", "a b", "漢字名", "beta.x", "::lead", "_", "--", "beta beta"]
    glue = [" ", "::", ".", "\n", "_", "é", "(", ""]
    files = [(f"f{i}", "".join(r.choice(words) + r.choice(glue) for _ in range(60))) for i in range(20)] + [("null", None), ("empty", ""), ("beta", "beta")]
    found = X.occurrences(spark.createDataFrame(files, "file string, source string"), spark.createDataFrame([(w,) for w in words], "name string"))
    got = collections.Counter((x.file, x.begin, x.finish, x.name) for x in found.collect())
    want = collections.Counter()
    for f, text in files:
        for w in words:
            if re.search(r"[^\W]", w):
                for m in re.finditer(rf"(?<!\w)(?={re.escape(w)}(?!\w))", text or ""):
                    want[f, m.start(), m.start() + len(w), w] += 1
    # a name that begins with a sign has no word before it either
    want = collections.Counter({k: v for k, v in want.items()})
    assert got == want and len({k[3] for k in want}) >= 8


def test_more_names_than_any_cap(spark):
    n = 9000
    names = spark.range(n).selectExpr("concat('symbol_', id) as name")
    files = spark.createDataFrame([("f", " ".join(f"symbol_{i}" for i in range(n)))], "file string, source string")
    assert X.occurrences(files, names).count() == n


def test_the_innermost_block_of_another_language(spark):
    text = "x" * 5000 + " word_count( " + "y" * 5000 + " word_count"
    at, last = 5001, len(text) - len("word_count")
    nodes = [
        ("target", "word_count", "core/src/lib.rs", "function_item", "rust", 0, 9), ("twin", "word_count", "core/tests/a.rs", "function_item", "rust", 0, 9),
        ("poor", "word_count", "core/a.rs", "struct_item", "rust", 0, 9),
        ("wide", "w", "app/a.py", "function_definition", "python", 0, 9000), ("near", "n", "app/a.py", "function_definition", "python", 4000, 6000),
        ("call", "c", "app/a.py", "call_expression", "python", at, at + 11), ("same", "s", "app/a.py", "function_item", "rust", at, at + 12),
        ("type", "t", "app/a.py", "class_definition", "python", at, at + 12), ("clash", "k", "app/b.rs", "function_item", "rust", 0, 99),
        ("doc", "d", "x/docs/a.py", "function_definition", "python", 0, 99), ("empty", "e", "app/a.py", "function_definition", "python", at, at),
    ]
    files = [("app/a.py", text), ("app/b.rs", "word_count"), ("x/docs/a.py", "word_count"), ("gone.py", "word_count word_counts")]
    found = X.text_twins(spark.createDataFrame(nodes, NODES), spark.createDataFrame(files, "file string, source string"))
    # the second match stands in no block, so it goes to the best block of the file, the first by id
    assert {(x.src, x.dst): x.n for x in found.collect()} == {("near", "target"): 1, ("empty", "target"): 1} and last > 9000
    none = spark.createDataFrame(nodes, NODES).limit(0)
    assert X.text_twins(none, spark.createDataFrame(files, "file string, source string")).isEmpty()


def test_names_that_begin_alike(spark):
    """Candidates are as many as the words of the text, not times the names that begin with the same word."""
    import time

    n = 2000
    names = spark.range(n).selectExpr("concat('common word_', id) as name").union(spark.createDataFrame([("common word_1, common word_2",), ("(common word_3).",)], "name string"))
    text = " ".join(f"common word_{i % (2 * n)}," for i in range(4 * n)) + " (common word_3)."
    began = time.monotonic()
    got = collections.Counter(r.name for r in X.occurrences(spark.createDataFrame([("f", text)], "file string, source string"), names).collect())
    assert time.monotonic() - began < 60
    want = collections.Counter({f"common word_{i}": 2 for i in range(n)}) + collections.Counter({"common word_3": 1, "common word_1, common word_2": 2})
    # at the end of the text the dot is the name's own
    assert got == want + collections.Counter({"(common word_3).": 1})


def test_matches_are_exchanged_once_and_not_written(spark, monkeypatch):
    """Any block of another language than the name's may be chosen, for texts of one file together, and no match is written on the way."""
    r = random.Random(5)
    names = {"alpha_one": "rust", "beta_two.": "go", "(gamma_x": None, "delta four": "python"}
    nodes = [(f"t{k}", name, f"lib/{k}", "function_item", lang, 0, 1) for k, (name, lang) in enumerate(names.items())]
    files = [(f"f{i}", " ".join(r.choice([*names, "(gamma_x)", "beta_two", "word,", "\n"]) for _ in range(80))) for i in range(12)] + [("f0", "alpha_one beta_two."), ("f1", None), (None, "alpha_one")]
    for i in range(12):
        for k in range(r.randint(0, 9)):
            a = r.randint(0, 600)
            nodes.append((f"b{i}_{k}", "block", f"f{i}", r.choice(["struct_item", "function_item", "call"]), r.choice(["rust", "go", "python", None]), a, a + r.choice([0, 9, 40, 300, 700])))
    want = collections.Counter()
    spot = {(f, m.start(), name) for f, text in files for name in names for m in re.finditer(rf"(?<!\w)(?={re.escape(name)}(?!\w))", text or "") if f}
    score = {"struct_item": 40, "function_item": 50, "call": -20}
    for f, begin, name in spot:
        other = [b for b in nodes if b[2] == f and b[4] != names[name]]
        around = [b for b in other if b[5] < b[6] and b[5] <= begin and begin + len(name) <= b[6]]
        if around or other:
            best = min(around, key=lambda b: (-score[b[3]], b[6] - b[5], b[0])) if around else min(other, key=lambda b: (-score[b[3]], b[0]))
            want[best[0], next(n[0] for n in nodes if n[1] == name)] += 1
    written, before = [], X.save
    monkeypatch.setattr(X, "save", lambda df, name: (written.append(name), before(df, name))[1])
    found = X.text_twins(spark.createDataFrame(nodes, NODES), spark.createDataFrame(files, "file string, source string"))
    assert {(x.src, x.dst): x.n for x in found.collect()} == dict(want) and len(want) > 30
    assert written == ["targets", "names"]  # and hits and held, before


def test_lines_of_documents_are_made_without_an_exchange(spark, tmp_path):
    from meshlight import catalogue_index as C

    spark.createDataFrame([(1, "ab\n\nçd\n", "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    nodes, _ = C._doc_blocks(spark, str(tmp_path))
    lines = sorted((r.id, r.begin, r.finish) for r in nodes.where("name = 'line'").collect())
    assert lines == [("d:1:0", 0, 2), ("d:1:1", 3, 3), ("d:1:2", 4, 6), ("d:1:3", 7, 7), ("d:3:0", 0, 0)]
    assert "Exchange" not in nodes._jdf.queryExecution().toString()

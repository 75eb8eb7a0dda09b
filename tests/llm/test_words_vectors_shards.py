"""Spelling variants, centroids and shards against brute force, on odd rows too."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlight.llm import centroids, sharding, variants
from meshlight.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no fixture tables")
@pytest.mark.parametrize("name", ["op11_variants", "op12_centroids", "op13_shards"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(want) and want


# ---------------------------------------------------------------- variants


def _edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for w in n:
        others = [v for v in n if _edits(v, w)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n}


def test_variants_by_brute_force(spark):
    r = random.Random(3)
    # few letters and runs of equal ones, so that words have many near words, also by skipping in a run
    words = ["".join(r.choice("aabéz") for _ in range(r.randrange(6, 9))) for _ in range(300)] + ["prefix" + c * k for c in "abcé" for k in range(4)]
    texts = [" ".join(r.choices(words, k=120)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (3, texts[4]), (900, None), (901, ""), (902, "12 §§ --- ×÷ " * 9)]
    rows += [(1000 + i, "Chainaa " * 5 + "chainab " * 30 + "chainbb " * 160 + "chainbc " * 900) for i in range(1)]
    rows += [(2000 + i, f"{'long' * 5000} {'long' * 2500}x{'long' * 2500} ÉTRANGER étranger") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("root", F.lit(""))
    got = variants.variants(docs)
    found = [tuple(x) for x in got.collect()]
    want = _variants(rows)
    assert set(found) == want and len(found) == len(want)
    chain = {x[0]: x[2] for x in found}
    assert chain["chainaa"] == "chainbc" and sum(x[4] > 1 for x in found) > 50
    assert [r.word for r in variants.variants(docs.limit(0)).collect()] == []
    assert variants.variants(docs.repartition(7)).count() == len(found)
    with pytest.raises(ValueError, match="ratio"):
        variants.variants(docs, ratio=1)


def test_light_edges_are_few(spark):
    # a trie in which each node has one long and one short way: no word may have more light edges than the logarithm
    words = ["a" * i + "b" * 6 for i in range(200)]
    table = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    most = max(r["count"] for r in variants.light_edges(table).groupBy("id").count().collect())
    assert most <= math.log2(len(words)) + 1


# ---------------------------------------------------------------- centroids


def _lloyd(rows):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:16]
    c = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(3):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, vs in groups.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    at = [(i, *near(v)) for i, v in kept]
    spent = collections.Counter()
    for _, d, j in at:
        spent[j] += d
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return collections.Counter((i, j, d, spent[j], sum(spent.values()), sha[j]) for i, d, j in at)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_centroids_by_brute_force(spark):
    r = random.Random(8)
    same = [r.uniform(-1, 1) for _ in range(64)]
    rows = [(i, [r.uniform(-2, 2) for _ in range(64)]) for i in range(150)] + [(500 + i, same) for i in range(90)]
    rows += [(None, same), (None, same), (7, same), (800, None), (801, []), (802, [1.0] * 63), (803, [1.0] * 65), (804, [None] + [1.0] * 63), (805, [float("nan")] * 64), (806, [float("inf")] * 64)]
    table = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA)
    rows = [(x.vec_id, x.embedding) for x in table.collect()]  # as floats
    table = table.withColumn("cluster", F.lit("x")).withColumn("q", F.lit(1)).withColumn("weight", F.lit(None))
    assert collections.Counter(map(tuple, centroids.clusters(table).collect())) == _lloyd(rows)
    assert collections.Counter(map(tuple, centroids.clusters(table.repartition(7)).collect())) == _lloyd(rows)
    assert centroids.clusters(table.limit(0)).collect() == [] and centroids.clusters(table.where("vec_id = 800")).collect() == []
    few = table.where("vec_id in (3, 7, 9)")
    assert collections.Counter(map(tuple, centroids.clusters(few).collect())) == _lloyd([x for x in rows if x[0] in (3, 7, 9)])


def test_large_components_are_exact_or_held(spark):
    big = [(i, [float((i * 37 + j) % 9) * 1e4 for j in range(64)]) for i in range(40)]
    table = spark.createDataFrame([(*x, 0) for x in big], SCHEMA)
    assert collections.Counter(map(tuple, centroids.clusters(table).collect())) == _lloyd(big)
    held = spark.createDataFrame([(1, [1e30] * 64, 0), (2, [-1e30] * 64, 0), (3, [0.5] * 64, 0)], SCHEMA)
    assert {x.vec_id: x.distance for x in centroids.clusters(held, n_clusters=1, rounds=0).collect()}
    assert {abs(v) for x in centroids.quantised(held).where("vec_id < 3").collect() for v in x.q} == {centroids.BOUND}
    q = np.array([[centroids.BOUND] * 64, [-centroids.BOUND] * 64])
    assert centroids.nearest(q, q[:1])[1].tolist() == [0, 64 * (2 * centroids.BOUND) ** 2]


# ---------------------------------------------------------------- shards

KEYS = np.random.default_rng(5).integers(0, 2**64, 40_000, dtype=np.uint64)


@pytest.mark.parametrize("n", [1, 2, 5, 15, 16, 17, 24, 33])
def test_one_more_shard_takes_rows_only_into_itself(n):
    a, b = sharding.place(KEYS, sharding.even_tree(n)), sharding.place(KEYS, sharding.even_tree(n + 1))
    moved = a != b
    assert set(b[moved]) == {n} and abs(moved.mean() * (n + 1) - 1) < 0.1
    share = np.bincount(a, minlength=n) * n / len(KEYS)
    assert 0.85 < share.min() and share.max() < 1.15


def test_weights_decide_shares_and_confine_moves():
    tree = sharding.even_tree(24)

    def weighted(i, w):
        return tree._replace(shards=tuple(s._replace(weight=w) if j == i else s for j, s in enumerate(tree.shards)))

    full, half = sharding.place(KEYS, tree), sharding.place(KEYS, weighted(5, 0.5))
    moved = full != half
    assert set(full[moved]) == {5} and abs((half == 5).mean() * 23.5 - 0.5) < 0.1
    wide = sharding.Tree(tuple(sharding.Shard(r, 0, 0) for r in range(2)) + (sharding.Shard(0, 1, 0),), ((1.0,), (3.0,)))
    share = np.bincount(sharding.place(KEYS, wide)) / len(KEYS)
    assert np.allclose(share, [0.2, 0.2, 0.6], atol=0.02)
    for bad in (sharding.Shard(0, 0, 0, 0.0), sharding.Shard(0, 0, 0, 1.5)):
        with pytest.raises(ValueError, match="weight"):
            sharding.place(KEYS[:1], sharding.Tree((bad,)))
    with pytest.raises(ValueError, match="free place"):
        sharding.place(KEYS[:1], sharding.Tree((sharding.Shard(0, 0, 0), sharding.Shard(0, 0, 0))))


def test_slots_are_gapless_and_rows_of_an_id_stay_together(spark, tmp_path):
    rows = [(i % 300, f"text {i}") for i in range(900)] + [(None, None)] * 5 + [(None, "x" * 300_000), (2, ""), (2, None), (3, "é" * 10)] + [(7, "same")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("s")).withColumn("size", F.lit(1)).withColumn("slot", F.lit(0))
    found = sharding.shards(docs).collect()
    by_shard, by_id = collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        by_shard[r.shard].append(r)
        by_id[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 24)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by_shard.values()) and all(len(s) == 1 for s in by_id.values())
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    again = sharding.shards(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, found))
    assert sharding.shards(docs.limit(0)).collect() == [] and {r.shard for r in sharding.shards(docs, 1).collect()} == {0}
    sharding.write_shards(docs, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in found}
    assert back.count() == len(rows) and {(r.shard // 16, r.shard % 4) for r in found} == {(r.region, r.rack) for r in back.select("region", "rack").distinct().collect()}

"""Walks of all nodes against a walk of one node in plain Python; long chains and rings."""

import random

import pytest
from pyspark.sql import functions as F

from meshlight.plans import spine as W

NODES = "id string, name string, file string, kind string, score double"


def _graph(seed, n=120, m=260):
    r = random.Random(seed)
    names = ["handle_it", "run_all", "main", "dispatch_x", "my_context", "try_it", "plain", "other", "get", "x", "test_it"]
    kinds = ["function_item"] * 6 + ["method_definition", "struct_item", "call_expression"]
    nodes = [(f"n{i}", r.choice(names), r.choice(["src/a.rs", "lib/b.rs", "tests/c.rs"]) if i % 4 == 0 else "src/a.rs", r.choice(kinds), float(r.randrange(4))) for i in range(n)]
    edges = [(f"n{r.randrange(n)}", f"n{int(n * r.random() ** 2)}") for _ in range(m)] + [("n1", "n1"), ("gone", "n2"), ("n2", "gone"), ("n3", "n4"), ("n3", "n4"), ("n4", "n3")]
    return nodes, edges


def _rank(name):
    return 3 if name.startswith(("handle_", "run_")) else 2 if name == "main" or name.startswith("dispatch_") or "context" in name else 1 if name.startswith(("try_", "do_")) else 0


def _walks(nodes, edges, noise, steps=4, halt=5, limit=None):
    info = {x[0]: x for x in nodes}
    up = {i: sorted({a for a, b in edges if b == i and a in info and not noise[a]}) for i in info}

    def order(a):
        return (len(up[a]), -_rank(info[a][1]), -info[a][4], info[a][1], a)

    out = []
    for seed, _, _, kind, _ in nodes:
        if kind == "struct_item":
            continue
        at, met = seed, [seed]
        for step in range(1, steps + 1):
            open_ = [a for a in up[at] if a not in met]
            if not open_ or len(open_) > halt:
                break
            at = min(open_, key=order)
            met.append(at)
            out.append((seed, step, at))
            if len(up[at]) > halt:
                break
    ends = {}
    for seed in info:
        at, met = seed, [seed]
        while up[at] and len(up[at]) <= halt and (others := [a for a in up[at] if a != at]):
            at = min(others, key=order)
            if at in met:
                met = None
                break
            met.append(at)
        ends[seed] = (at, len(met) - 1) if met else (None, None)
    return sorted(out), ends


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_equal_one_by_one(spark, seed):
    nodes, edges = _graph(seed)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "src string, dst string")
    noise = {r.id: r.noise for r in n.select("id", W.spine_noise(n).alias("noise")).collect()}
    walks, ends = _walks(nodes, edges, noise)
    assert sorted(map(tuple, W.spines(n, e).collect())) == walks and {s for _, s, _ in walks} == {1, 2, 3, 4}
    assert {r.id: (r.entry, r.hops) for r in W.entries(n, e).collect()} == ends and None in {v[0] for v in ends.values()}
    assert W.spines(n.limit(0), e).isEmpty() and W.entries(n, e.limit(0)).where("hops <> 0 or entry <> id").isEmpty()


def test_long_chains_and_rings_take_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("concat('c', id) id", "concat('c', id + 1) to", "1L hops")
    ends, rounds = W._chase(chain)
    assert rounds <= 18 and ends.where(f"moving or to <> 'c{n}'").isEmpty() and ends.agg(F.sum("hops")).first()[0] == n * (n + 1) // 2
    ring = spark.range(n).selectExpr("concat('r', id) id", f"concat('r', (id + 1) % {n}) to", "1L hops")
    ends, rounds = W._chase(ring)
    assert rounds <= 18 and ends.where("moving").count() == n


def test_a_ring_beside_short_walks_ends_the_rounds(spark):
    """A circle does not keep all rows moving for as many rounds as a walk over all of them could need."""
    ring = spark.range(4000).selectExpr("concat('r', id) as id", "concat('r', (id + 1) % 4000) as to", "1L as hops")
    walk = spark.range(9).selectExpr("concat('w', id) as id", "concat('w', id + 1) as to", "1L as hops")
    ends, rounds = W._chase(ring.union(walk))
    assert rounds <= 6 and ends.where("moving").count() == 4000
    assert {(r.id, r.to, r.hops) for r in ends.where("not moving").collect()} == {(f"w{i}", "w9", 9 - i) for i in range(9)}

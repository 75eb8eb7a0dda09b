"""Nodes on cycles against reachability; long chains, rings and trees in few rounds."""

import random

import pytest

from meshlight.operators import graph as G
from meshlight.operators.storage import save


def _cyclic(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for n in after:
        seen, todo = set(), list(after[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        if n in seen:
            out.add(n)
    return out


class Counted:
    def __init__(self):
        self.n = 0

    def __call__(self, df, name):
        self.n += name in ("jumps", "colour", "front", "peeled", "cc")
        return save(df, name)


@pytest.mark.parametrize("seed", range(3))
def test_nodes_on_cycles_equal_reachability(spark, seed):
    r = random.Random(seed)
    edges = []
    for part in range(12):  # parts of several densities, with chains, rings, loops and edges both ways between them
        n = r.randrange(3, 12)
        edges += [(f"{part}.{r.randrange(n)}", f"{part}.{r.randrange(n)}") for _ in range(r.randrange(n, 2 * n))]
    for k in range(6):
        names = [f"c{k}.{i}" for i in range(r.randrange(2, 9))]
        edges += list(zip(names, names[1:], strict=False)) + [(r.choice(edges)[0], names[0]), (names[-1], r.choice(edges)[r.randrange(2)])]
    ring = [f"r{i}" for i in range(9)]
    edges += list(zip(ring, ring[1:] + ring[:1], strict=True)) + [("r4", edges[0][0]), ("lone", "lone"), (None, "x"), ("x", None)]
    table = spark.createDataFrame(edges, "src string, dst string")
    want = _cyclic([e for e in edges if None not in e])
    assert {x.id for x in G.detect_cycles(table, save).collect()} == want and 20 < len(want)
    assert G.detect_cycles(table.limit(0), save).isEmpty()


def test_the_length_of_chains_and_rings_hardly_counts(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("id src", "id + 1 dst")
    ring = spark.range(n).selectExpr(f"id + 1000000 src", f"1000000 + (id + 1) % {n} dst")
    # a ring with a leg at each node, and a path whose edges go both ways
    legs = spark.range(2000).selectExpr("id + 3000000 src", "3000000 + (id + 1) % 2000 dst").union(spark.range(2000).selectExpr("id + 4000000", "id + 3000000"))
    path = spark.range(2000).selectExpr("id + 5000000 src", "id + 5000001 dst")
    both = path.union(path.select("dst", "src"))
    rounds = Counted()
    found = G.detect_cycles(chain.union(ring).union(legs).union(both), rounds)
    assert found.count() == n + 2000 + 2001 and found.where("id < 1000000 or id between 4000000 and 4999999").isEmpty()
    assert rounds.n < 120  # all steps of all loops together, forwards and backwards

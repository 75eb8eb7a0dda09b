"""Rendering under a budget against the greedy rule in plain Python, on few and on many partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlight.plans import budget as B

COSTS = "id string, first int, score double, c0 long, c1 long, c2 long"


def _greedy(rows, budget):
    out = {}
    for i, _, _, *costs in sorted(rows, key=lambda x: (x[1], -x[2], x[0])):
        form = next((f for f, c in enumerate(costs) if c is not None and c <= budget), 3)
        cost = costs[form] if form < 3 else 0
        budget -= cost
        out[i] = ([*B.FORMS, "omitted"][form], cost)
    return out


def _rows(seed, n):
    r = random.Random(seed)
    return [(f"i{i}", r.randrange(3), float(r.randrange(9)), r.choice([None, r.randrange(1, 400)]), r.choice([None, r.randrange(1, 90)]), r.randrange(1, 30)) for i in range(n)]


@pytest.mark.parametrize("budget", [0, 7, 300, 2000])
def test_scan_equals_the_greedy_rule(spark, budget):
    rows = _rows(budget, 700)
    table = spark.createDataFrame(rows, COSTS)
    want = _greedy(rows, budget)
    for parts in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            assert {r.id: (r.fidelity, r.cost) for r in B.render_budget(table, budget).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert B.render_budget(table.limit(0), budget).collect() == []


def test_functions_chain():
    costs = np.array([[9, 4, 2], [B._NONE, B._NONE, 3], [50, 5, B._NONE], [1, 1, 1]] * 5, np.int64)
    whole, a, b = B._after(costs, 60), B._after(costs[:7], 60), B._after(costs[7:], 60)
    assert (b[a] == whole).all()
    assert [int(60 - B._settle(costs, 60)[1].sum()), 0] == [whole[60], whole[0]]


def test_a_tight_budget_omits_blocks(spark):
    # fifteen functions of falling score: the best in full, none over the budget, some left out
    rows = [(f"n{i:02}", f"fn_{i}", "function_item", "test.rs", 10, 30, 100.0 - 5 * i, f"fn fn_{i}() {{ /* some code here */ }}") for i in range(15)]
    blocks = spark.createDataFrame(rows, "id string, name string, kind string, file string, start_line int, end_line int, score double, source string")
    got = {r.id: r for r in B.render_budget(B.block_costs(blocks), 400).collect()}
    assert got["n00"].fidelity == got["n03"].fidelity == "full" and sum(r.cost for r in got.values()) <= 400
    assert {"omitted", "full"} <= {r.fidelity for r in got.values()}
    hub = B.block_costs(blocks, "surgical", blocks.select("id").where("id = 'n00'")).collect()
    assert [r.id for r in hub if r.first == 0 and r.c0 is None] == ["n00"]
    assert {r.first for r in B.block_costs(blocks, "compressed").collect()} == {0, 2} and {r.first for r in B.block_costs(blocks, "architecture").collect()} == {0, 2}
    odd = blocks.limit(1).select("id", *(F.lit(None).cast("string").alias(c) for c in ("name", "kind", "file", "source")), *(F.lit(None).cast("int").alias(c) for c in ("start_line", "end_line", "score")))
    assert B.block_costs(odd, "mini").first().c2 == len("-  ()\n")


def _truncated(text, cap):
    def cut(most):
        raw = text.encode()
        if len(raw) <= most:
            return text
        part = raw[:most].decode(errors="ignore")
        return part[: part.rfind("\n")] if "\n" in part else part

    if cap == 0 or len(text.encode()) <= 4 * cap and len(text) <= cap:
        return text if cap else ""
    return cut(4 * cap) if len(cut(4 * cap)) <= cap else cut(2 * cap)


def test_truncation_at_bytes_and_lines(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "é", "漢", "😀", "\n", "b "]) for _ in range(n)) for n in range(0, 60)] + ["\n", "é" * 9, "😀" * 9, "x" * 500]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    for cap in (0, 1, 2, 3, 5, 10, 23):
        got = {r.i: r.t for r in table.select("i", B.truncate_tokens(F.col("t"), cap).alias("t")).collect()}
        assert got == {i: _truncated(t, cap) for i, t in enumerate(texts)} | {99: None}

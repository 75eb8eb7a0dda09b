"""The first bridges of the trade graph are made from one meeting of orders and items, and are those of the graph's views."""

from pyspark.sql import functions as F

from meshlight import catalogue as C
from meshlight.operators import graph as G
from meshlight.operators.storage import save
from meshlight.sources.views import load


def tables(spark, at):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")

    put("region", [(0, "A"), (1, "B"), (2, "B")], "r_regionkey long, r_name string")  # two regions of one name are one cluster
    put("nation", [(i, f"n{i}", i % 3) for i in range(5)], "n_nationkey long, n_name string, n_regionkey long")
    put("customer", [(i, f"c{i}", i % 6, "x") for i in range(1, 12)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string")  # some of no nation
    put("supplier", [(i, i % 5) for i in range(1, 6)], "s_suppkey long, s_nationkey long")
    put("part", [(i, f"p{i}", "b", "t") for i in range(1, 8)], "p_partkey long, p_name string, p_brand string, p_type string")
    put("orders", [(i, i % 13) for i in range(30)], "o_orderkey long, o_custkey long")  # some of no customer
    put("lineitem", [(i % 33, i % 7, i % 9) for i in range(120)], "l_orderkey long, l_suppkey long, l_partkey long")  # of no order, supplier or part
    return str(at)


def test_bridges_are_those_of_the_views(spark, tmp_path):
    at = tables(spark, tmp_path)
    nodes, edges = C.trade(spark, at)
    want = G.find_bridges(nodes, edges, load(spark, at, "trade_bridges"), cap=1000)
    ranked = G.first_bridges(C.crossing_trade(spark, at), cap=1000, shown=C.shown_id)
    got = ranked.select(C.shown_id(F.col("src")), C.shown_id(F.col("dst")), "fan_in").collect()
    assert [tuple(r) for r in got] == [(r.src, r.dst, r.fan_in) for r in want.collect()] and len(got) > 40
    assert C.QUERIES["find_bridges"](spark, at).collect() == want.limit(20).collect()
    scans = C.crossing_trade(spark, at)._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("o_orderkey#") and scans.count("Relation [o_orderkey") == 1  # twice in the views' edges and bridges


def test_rows_below_the_first_targets_are_left_out_and_ties_are_not(spark):
    rows = [(s, d, r) for d in range(9) for s in range(d // 3 + 2) for r in [(s + d) % 3]] + [(1, 100, 3), (2, 101, 0)]
    crossing = spark.createDataFrame(rows, "src long, dst long, rank int")
    every = [tuple(r) for r in G.first_bridges(crossing, 1000).select("src", "dst", "rank", "fan_in").collect()]
    fan = {d: sum(x[1] == d for x in rows) for _, d, _ in rows}
    assert every == sorted(((s, d, r, fan[d]) for s, d, r in rows), key=lambda x: (-x[2], -x[3], x[0], x[1]))
    for cap in (1, 3, 8, 11, 50):
        found = G.first_bridges(crossing, cap, save).select("src", "dst", "rank", "fan_in").collect()
        assert [tuple(r) for r in found] == every[:cap], cap

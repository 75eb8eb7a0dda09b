"""Walks up the callers of all nodes at once, and the cycles that walks run into."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import neighbor_noise_name, testish_block
from ..functions.text import TYPE_KINDS
from ..operators.storage import forget, save

#: Steps of a walk, and the number of callers above which it halts (fixed values).
STEPS, HALT = 4, 5


def spine_noise(nodes: DataFrame) -> Column:
    """Test code, names that say nothing, and what is no function: no walk goes through these."""
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in nodes.columns else F.lit("")
    callable_ = F.lower("kind").rlike("function|method|fn")
    return testish_block(F.col("file"), F.col("name"), source) | neighbor_noise_name(F.col("name")) | ~callable_


def entry_name_rank(name: Column) -> Column:
    """3 for handlers and runners, 2 for mains, dispatchers and contexts, 1 for tries, else 0."""
    n = F.lower(name)
    return F.when(n.rlike("^(handle_|run_)"), 3).when((n == "main") | n.rlike("^dispatch_|context"), 2).when(n.rlike("^(try_|do_)"), 1).otherwise(0)


def caller_lists(nodes: DataFrame, edges: DataFrame, halt: int = HALT) -> DataFrame:
    """``(id, fan, callers)``: a node's number of product callers, and the callers besides itself, best first, where they are at most ``halt``.

    Best is the one with the fewest product callers of its own, then by rank of its
    name as an entry, score, name and id.  Lists are made of nodes with few callers
    only, so no list is long, however many callers a hub has.
    """
    usable = nodes.where(~spine_noise(nodes)).select(F.col("id").alias("src"), "name", "score")
    calls = edges.select("src", "dst").distinct().join(usable, "src").join(nodes.select(F.col("id").alias("dst")), "dst")
    calls = save(calls, "calls")
    fan = save(calls.groupBy("dst").agg(F.count("*").alias("fan"), F.sum((F.col("src") != F.col("dst")).cast("long")).alias("others")), "fan")
    few = calls.where("src <> dst").join(fan.where(F.col("others") <= halt).select("dst"), "dst", "left_semi")
    ranked = few.join(fan.select(F.col("dst").alias("src"), F.col("fan").alias("up")), "src", "left")
    key = F.struct(F.coalesce("up", F.lit(0).cast("long")).alias("up"), (-entry_name_rank(F.col("name"))).alias("rank"), (-F.col("score")).alias("score"), "name", F.col("src").alias("id"))
    lists = ranked.groupBy("dst").agg(F.sort_array(F.collect_list(key)).alias("callers"))
    return fan.join(lists, "dst", "left").select(F.col("dst").alias("id"), "fan", "callers")


def spines(nodes: DataFrame, edges: DataFrame, halt: int = HALT, steps: int = STEPS) -> DataFrame:
    """``(seed, step, id)``: the walk from every node of ``nodes(id, name, file, kind, score)`` that is no type, ``steps`` calls up at most.

    A walk goes to the best caller that it has not met.  It stops where there is
    none or more than ``halt`` to choose from, and at a caller which itself has
    more than ``halt``.  Each step moves all walks by one join.
    """
    lists = save(caller_lists(nodes, edges, halt), "callers").withColumnRenamed("id", "__mesh_at")
    types = F.lower("kind").rlike("|".join(TYPE_KINDS))
    now = nodes.where(~types).select(F.col("id").alias("seed"), F.col("id").alias("__mesh_at"), F.array("id").alias("met"))
    done: list[DataFrame] = []
    for step in range(1, steps + 1):
        choice = F.filter("callers", lambda c: ~F.array_contains(F.col("met"), c["id"]))
        moved = now.join(lists, "__mesh_at").withColumn("best", F.try_element_at(choice, F.lit(1))).where("best is not null")
        moved = save(moved.select("seed", F.col("best.id").alias("__mesh_at"), F.col("best.up").alias("up"), F.concat("met", F.array("best.id")).alias("met")), "step")
        done.append(moved.select("seed", F.lit(step).alias("step"), F.col("__mesh_at").alias("id")))
        now = moved.where(F.col("up") <= halt).drop("up")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def entries(nodes: DataFrame, edges: DataFrame, halt: int = HALT) -> DataFrame:
    """``(id, entry, hops)``: where the walk without a limit of steps ends, and after how many calls; null for walks that never end.

    The best caller of each node makes a functional graph.  Pointers are doubled:
    after n rounds each has jumped over 2^n calls, so the rounds grow with the
    logarithm of the longest walk that ends.  Along it all shorter ones end too, so
    what still moves when a round brings no walk to its end goes round in a circle.
    """
    lists = caller_lists(nodes, edges, halt)
    first = lists.where((F.col("fan") <= halt) & (F.size("callers") > 0)).select("id", F.col("callers")[0]["id"].alias("to"), F.lit(1).cast("long").alias("hops"))
    ends, _ = _chase(first)
    walked = ends.where("not moving").select("id", F.col("to").alias("entry"), "hops")
    stays = nodes.select("id").join(ends.select("id"), "id", "left_anti").select("id", F.col("id").alias("entry"), F.lit(0).cast("long").alias("hops"))
    circles = ends.where("moving").selectExpr("id", "cast(null as string) as entry", "cast(null as bigint) as hops")
    return walked.union(stays).union(circles)


def _chase(now: DataFrame) -> tuple[DataFrame, int]:
    """The last pointer of each row of ``(id, to, hops)``, whether it was still ``moving`` in the last round, and the rounds that it took."""
    now = save(now, "jumps")
    moved = now.count()
    most = math.ceil(math.log2(max(1, moved))) + 1
    for round_ in range(1, most + 1):
        onward = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        new = now.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moving"))
        before, now = now, save(new, "jumps")
        forget(before)
        moves = now.where("moving").count()
        if moves in (0, moved):
            return now, round_
        moved = moves
    return now, most

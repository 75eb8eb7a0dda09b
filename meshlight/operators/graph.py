"""Graph operators over ``nodes(id, name, file, kind, lang, ...)``, ``edges(src, dst)`` and ``bridges(src, dst, kind)``.

Everything is a join or an aggregation, keyed by node id; adjacency lists are
never built.  Edge tables are bags until ``normalize_adjacency``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

Save = Callable[[DataFrame, str], DataFrame]

#: The stronger kind of bridge wins.
BRIDGE_RANK = {"export": 3, "ipc": 2, "twin": 1}


def bridge_rank(kind: Column) -> Column:
    rank = F.lit(0)
    for name, value in BRIDGE_RANK.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return rank


# ---------------------------------------------------------------- adjacency


def children(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``(src, dst)`` of the given ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src").select("src", "dst")


def callers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``(src, dst)`` into the given ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst").select("src", "dst")


def bridge_children(bridges: DataFrame, ids: DataFrame) -> DataFrame:
    return bridges.join(ids.select(F.col("id").alias("src")).distinct(), "src").select("src", "dst", "kind")


def bridge_callers(bridges: DataFrame, ids: DataFrame) -> DataFrame:
    return bridges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst").select("src", "dst", "kind")


def bridge_kind_between(bridges: DataFrame) -> DataFrame:
    """The strongest kind of each pair."""
    best = F.max_by("kind", bridge_rank(F.col("kind")))
    return bridges.groupBy("src", "dst").agg(best.alias("kind"))


def normalize_adjacency(edges: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each call edge once, each bridge pair with its strongest kind."""
    return edges.select("src", "dst").distinct(), bridge_kind_between(bridges)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, in_degree, out_degree, degree)`` of every node."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select(F.col("dst"), F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    out = nodes.select("id").join(sums, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def total_edges(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"))


def interconnect_summary(bridges: DataFrame) -> DataFrame:
    return bridges.groupBy("kind").agg(F.count("*").alias("n_bridges"))


def degree_counts(deg: DataFrame) -> list[tuple[int, int]]:
    """(degree, nodes) from the greatest degree down: a row for each distinct degree, of which e edges allow at most 2 * sqrt(e)."""
    return [(r["degree"], r["n"]) for r in deg.groupBy("degree").agg(F.count("*").alias("n")).orderBy(F.desc("degree")).collect()]


def degree_at(counts: list[tuple[int, int]], rank: int) -> int:
    """The degree at a rank (1-based, descending)."""
    upto = 0
    for degree, n in counts:
        upto += n
        if upto >= rank:
            return degree
    return 0


def compute_hubs(nodes: DataFrame, edges: DataFrame, save: Save, share: float = 0.05) -> DataFrame:
    """Build-time hubs by ``edges``, each there once: eligible nodes whose degree reaches that of rank ``floor(share * n)``, ties kept.

    Kinds with primitive, builtin or macro and names of three bytes or fewer are not
    eligible; nodes without edges are never hubs.
    """
    fit = nodes.where(~F.lower("kind").rlike("primitive|builtin|macro") & (F.octet_length("name") > 3))
    deg = save(degrees(fit, edges), "degrees")
    counts = degree_counts(deg)
    n = sum(x for _, x in counts)
    least = degree_at(counts, max(1, min(n, int(share * n))))
    return deg.where((F.col("degree") >= least) & (F.col("degree") > 0)).select("id", "degree", F.col("degree").cast("double").alias("score"))


def hub_threshold(nodes: DataFrame, edges: DataFrame, save: Save, share: float = 0.05) -> int:
    """Query-time hub rule: the degree at the sorted index ``min(max(floor(share * n), 1), n - 1)`` of all nodes."""
    counts = degree_counts(save(degrees(nodes, edges), "degrees"))
    n = sum(x for _, x in counts)
    return degree_at(counts, min(max(int(share * n), 1), n - 1) + 1) if n else 0


# ---------------------------------------------------------------- traversal


def expand_hops(edges: DataFrame, seeds: DataFrame, hops: int, save: Save | None = None) -> DataFrame:
    """``(id, hop)``: nodes within ``hops`` undirected steps of ``seeds(id)``, with the least number of steps.

    With ``save`` each step but the last is written, so that no hop is computed twice.
    """
    ways = (edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        # Each direction meets the frontier, which is small, before anything is exchanged to be made distinct.
        a, b = (way.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")) for way in ways)
        near = a.union(b).distinct()
        front = near.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        if save and hop < hops:
            front = save(front, "front")
        seen = seen.union(front)
    return seen


def trace_neighborhood(edges: DataFrame, seed: DataFrame, depth: int = 2) -> DataFrame:
    """``(side, hop, id)`` around ``seed(id)``: both first hops, then both second hops, each node once.

    The sides share what is visited: a caller is no callee, and nothing of hop 1
    comes again at hop 2.
    """
    up1 = callers(edges, seed).select(F.col("src").alias("id")).distinct().join(seed, "id", "left_anti")
    down1 = children(edges, seed).select(F.col("dst").alias("id")).distinct().join(seed, "id", "left_anti").join(up1, "id", "left_anti")
    out = up1.select(F.lit("caller").alias("side"), F.lit(1).alias("hop"), "id").union(down1.select(F.lit("callee"), F.lit(1), "id"))
    if depth < 2:
        return out
    seen = seed.select("id").union(up1).union(down1)
    up2 = callers(edges, up1).select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti")
    down2 = children(edges, down1).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").join(up2, "id", "left_anti")
    return out.union(up2.select(F.lit("caller"), F.lit(2), "id")).union(down2.select(F.lit("callee"), F.lit(2), "id"))


def hop_split(rows: DataFrame) -> DataFrame:
    """Direct and transitive rows of each side."""
    return rows.groupBy("side").agg(
        F.sum((F.col("hop") == 1).cast("long")).alias("direct"), F.sum((F.col("hop") > 1).cast("long")).alias("transitive")
    )


def detect_cycles(edges: DataFrame, save: Save, rounds: int = 1000) -> DataFrame:
    """``(id)``: the nodes on a directed cycle.

    The graph is first made small without losing a cycle: nodes without an incoming or
    without an outgoing edge are dropped, chains of nodes with one edge in and one
    out become one edge, found by pointer doubling, and nodes with edges both ways
    become one node.  Each step shrinks long chains, rings and trees at once, so
    their length hardly counts.  A node inside a chain is on a cycle exactly if the
    edge that stands for it is.  What is left is taken apart by colours.
    """
    now = save(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct(), "cycle")
    found = [save(now.where("src = dst").select(F.col("src").alias("id")), "loops")]
    now = save(now.where("src <> dst"), "cycle")
    nodes = now.select(F.col("src").alias("id")).union(now.select("dst")).distinct()
    # What each node is by now: a node, or a part of the edge (a, b).
    place = save(nodes.select("id", F.col("id").alias("a"), F.lit(None).cast(edges.schema["src"].dataType).alias("b")), "place")
    size = now.count()
    for _ in range(rounds):
        if not size:
            break
        now, place, done = _contracted(now, place, save)
        found.append(done)
        before, size = size, now.count()
        if size == before:
            break
    if size:
        parts = _strong(now, save, rounds)
        x, y = parts.toDF("a", "p"), parts.toDF("b", "q")
        found.append(save(place.where("b is null").join(x, "a").select("id"), "cyclic"))
        found.append(save(place.where("b is not null").join(x, "a").join(y, "b").where("p = q").select("id"), "cyclic"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def _contracted(edges: DataFrame, place: DataFrame, save: Save) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: edges, places and ``(id)`` of nodes that are now known to be on a cycle."""
    edges, _ = _peel(edges, save, 1)
    ends = edges.select(F.col("src").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    single = save(ends.groupBy("n").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 and i = 1").select("n"), "single")
    if single.isEmpty():
        short, rows, done = edges, place, place.select("id").limit(0)
    else:
        short, rows, done = _bridged(edges, place, single, save)
    # Edges both ways: one node, whose members are all on cycles.
    mutual = save(short.join(short.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).where("src < dst"), "mutual")
    if mutual.isEmpty():
        return _alive(short, rows, save(done.distinct(), "cyclic"), save)
    merged = save(connected_components(mutual.toDF("u", "v"), save), "merged")
    done = done.union(rows.where("b is null").join(merged.select(F.col("node").alias("a")), "a", "left_semi").select("id"))
    to = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))
    joined = short.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    joined = joined.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst")).distinct()
    rows = rows.join(to("a"), "a", "left").join(to("b"), "b", "left").select("id", F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
    rows = save(rows, "place")
    done = save(done.union(rows.where("a = b").select("id")).distinct(), "cyclic")
    joined = save(joined.where("src <> dst"), "cycle")
    return _alive(joined, rows.where("b is null or a <> b"), done, save)


def _alive(edges: DataFrame, place: DataFrame, done: DataFrame, save: Save) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places of dropped nodes, of edges that lead nowhere and of nodes that are done go."""
    alive = save(edges.select(F.col("src").alias("a")).union(edges.select("dst")).distinct(), "alive")
    rows = place.join(alive, "a", "left_semi").join(alive.select(F.col("a").alias("b"), F.lit(True).alias("there")), "b", "left")
    rows = rows.where("b is null or there").select("id", "a", "b").join(done, "id", "left_anti")
    return edges, save(rows, "place"), done


def _bridged(edges: DataFrame, place: DataFrame, single: DataFrame, save: Save) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with one in place of each chain of ``single(n)``, places, and ``(id)`` of the nodes of rings.

    A node with one edge in and one out points to the next; the pointers end at the nodes between chains.
    """
    ahead = _chain_ends(edges, single, "src", "dst", save)
    behind = _chain_ends(edges, single, "dst", "src", save)
    # A chain without an end is a ring.
    moves = save(ahead.withColumnRenamed("to", "z").join(behind.withColumnRenamed("to", "y"), "n"), "moves")
    ring = moves.where("z is null").select("n")
    kept = edges.join(single.withColumnRenamed("n", "src"), "src", "left_anti").join(single.withColumnRenamed("n", "dst"), "dst", "left_anti").select("src", "dst")
    bridged = moves.where("z is not null").select(F.col("y").alias("src"), F.col("z").alias("dst")).distinct()
    short = save(kept.union(bridged).distinct(), "short")
    a, b = moves.select(F.col("n").alias("a"), "y", "z"), moves.select(F.col("n").alias("b"), F.col("z").alias("bz"), F.lit(True).alias("in"))
    rows = place.join(a, "a", "left").join(b, "b", "left").select("id", "a", "b", "y", "z", "bz", "in")
    node_in = F.col("b").isNull() & F.col("y").isNotNull()
    rows = rows.select(
        "id", F.coalesce("y", "a").alias("a"), F.when(node_in, F.col("z")).when(F.col("in"), F.col("bz")).otherwise(F.col("b")).alias("b"),
    )
    on_ring = place.join(ring.withColumnRenamed("n", "a"), "a", "left_semi").select("id")
    rows = save(rows.join(on_ring, "id", "left_anti"), "place")
    done = on_ring
    # A chain that comes back to where it began: the node there and the chain are on a cycle.
    looped = short.where("src = dst").select(F.col("src").alias("a")).distinct()
    done = done.union(rows.where("a = b").select("id")).union(rows.where("b is null").join(looped, "a", "left_semi").select("id"))
    short = save(short.where("src <> dst"), "short")
    rows = rows.where("b is null or a <> b")
    return short, rows, done


def _chain_ends(edges: DataFrame, single: DataFrame, src: str, dst: str, save: Save) -> DataFrame:
    """``(n, to)``: where the chain of each ``single(n)`` leads along ``src`` -> ``dst``, by pointer doubling; null in a ring."""
    now = save(edges.select(F.col(src).alias("n"), F.col(dst).alias("to")).join(single, "n"), "jumps")
    most = math.ceil(math.log2(max(1, now.count()))) + 1
    for _ in range(most):
        on = now.select(F.col("n").alias("to"), F.col("to").alias("next"))
        new = now.join(on, "to", "left").select("n", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moving"))
        new = save(new, "jumps")
        now = new.select("n", "to")
        if new.where("moving").isEmpty():
            return now
    return new.select("n", F.when(~F.col("moving"), F.col("to")).alias("to"))


def _strong(now: DataFrame, save: Save, rounds: int) -> DataFrame:
    """``(id, part)``: the strong components of two nodes or more.

    Every node gets the colour of the greatest node that reaches it, and the nodes
    that their colour's node is reached from are its strong component.  Components
    are taken out round by round.
    """
    parts: DataFrame | None = None
    for _ in range(rounds):
        now, n = _peel(now, save)
        if not n:
            return parts if parts is not None else now.select(F.col("src").alias("id"), F.col("src").alias("part"))
        colour = _reach(now, save)
        # backwards from each colour's own node, inside the colour
        inner = save(
            now.join(colour.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src")
            .join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("c")),
            "inner",
        )
        core = save(colour.where("id = c").select("id", "c"), "core")
        front = core
        while True:
            more = inner.join(front.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            front = save(more.join(core, ["id", "c"], "left_anti"), "front")
            if front.isEmpty():
                break
            core = save(core.union(front), "core")
        sizes = core.groupBy("c").count().where("count > 1").select("c")
        fresh = core.join(sizes, "c").select("id", F.col("c").alias("part"))
        parts = save(fresh if parts is None else parts.union(fresh), "parts")
        gone = core.select("id")
        now = save(
            now.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "cycle"
        )
    raise RuntimeError("strong components did not settle")


def _peel(edges: DataFrame, save: Save, most: int | None = None) -> tuple[DataFrame, int]:
    """Edges without those of nodes that nothing leads to or from, in ``most`` rounds or until none is left, and their number."""
    n = edges.count()
    while n and most != 0:
        most = most and most - 1
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = save(kept, "peeled")
        m = kept.count()
        edges = kept
        if m == n:
            break
        n = m
    return edges, n


def _reach(edges: DataFrame, save: Save) -> DataFrame:
    """``(id, c)``: the greatest node that reaches each node (itself included)."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    colour = save(nodes.withColumn("c", F.col("id")), "colour")
    while True:
        sent = edges.join(colour.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "c")
        new = save(colour.union(sent).groupBy("id").agg(F.max("c").alias("c")), "colour")
        changed = not new.join(colour, ["id", "c"], "left_anti").isEmpty()
        colour = new
        if not changed:
            return colour


# ---------------------------------------------------------------- identity


def canonize(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapses nodes that share (name, kind, content_hash): the one with the higher score, then the longer source, then the least id.

    Edges are moved to the kept ids, loops and repeats dropped.
    """
    group = ["name", "kind", "content_hash"]
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    names = [F.col(c).alias(f"_{c}") for c in group]
    # aggregates, not a window: a large group of copies is summed where it is read
    top = nodes.groupBy(*names).agg(F.max(F.struct("score", "size")).alias("_top"))
    first = nodes.join(top, same).where(F.struct("score", "size").eqNullSafe(F.col("_top"))).groupBy(*[f"_{c}" for c in group]).agg(F.min("id").alias("keep_id"))
    kept = nodes.join(first, same).drop(*[f"_{c}" for c in group])
    ids = kept.select("id", "keep_id")
    moved = (
        edges.join(ids.select(F.col("id").alias("src"), F.col("keep_id").alias("s")), "src", "left")
        .join(ids.select(F.col("id").alias("dst"), F.col("keep_id").alias("d")), "dst", "left")
        .select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst")).where("src <> dst").distinct()
    )
    return kept.where("id = keep_id").drop("keep_id"), moved


def evict_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops the nodes of ``files(file)`` and every edge at them."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select("id")
    kept = nodes.join(files.select("file").distinct(), "file", "left_anti")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left.select("src", "dst")


def clear_outbound(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select("src", "dst")


def overlay_file(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows of a file, under the old id where (file, name, kind) stayed; rows that went are dropped."""
    keys = ["file", "name", "kind"]
    ids = old.groupBy(*keys).agg(F.min("id").alias("old_id"))
    return new.join(ids, keys, "left").withColumn("id", F.coalesce("old_id", "id")).drop("old_id").select(*new.columns)


def reverse_dependents(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``(file)``: other files with a node that calls into the ``changed(file)`` ones."""
    ids = nodes.join(changed.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("dst"))
    into = edges.join(ids, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return nodes.join(into, "id", "left_semi").select("file").distinct().join(changed.select("file"), "file", "left_anti")


# ---------------------------------------------------------------- hashes


def hex_number(text: Column) -> Column:
    """The first 15 hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def module_key(path: Column) -> Column:
    """The parent directory, ``.`` at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def module_hashes(nodes: DataFrame) -> DataFrame:
    """``(module, n_files, hash)``: an order-free fold of the (path, hash) rows of each directory."""
    files = nodes.groupBy("file").agg(F.min("content_hash").alias("h"))
    return files.groupBy(module_key(F.col("file")).alias("module")).agg(
        F.count("*").alias("n_files"), F.bit_xor(hex_number(F.concat_ws("=", "file", "h"))).alias("hash")
    )


def trace_epoch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row that changes with any file and with the number of nodes or edges."""
    e = edges.agg(F.count("*").alias("n_edges"))
    return nodes.agg(F.bit_xor(hex_number(F.concat_ws("=", "file", "content_hash"))).alias("epoch"), F.count("*").alias("n_nodes")).join(F.broadcast(e))


# ---------------------------------------------------------------- clusters


def find_bridges(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, cap: int = 20, save: Save | None = None) -> DataFrame:
    """Edges between clusters, typed bridges before calls, ranked by kind, fan-in of the target and ids; the first ``cap``.

    With ``save`` the crossing edges, which are read twice, are made once.
    """
    typed = bridge_kind_between(bridges).withColumn("rank", bridge_rank(F.col("kind")))
    plain = edges.select("src", "dst").distinct().join(typed.select("src", "dst"), ["src", "dst"], "left_anti")
    every = typed.union(plain.select("src", "dst", F.lit("call"), F.lit(0)))
    at = nodes.select("id", "cluster")
    crossing = (
        every.join(at.select(F.col("id").alias("src"), F.col("cluster").alias("from_cluster")), "src")
        .join(at.select(F.col("id").alias("dst"), F.col("cluster").alias("to_cluster")), "dst")
        .where("from_cluster <> to_cluster")
    )
    return first_bridges(crossing, cap, save).select("src", "dst", "kind", "from_cluster", "to_cluster", "fan_in")


def first_bridges(crossing: DataFrame, cap: int = 20, save: Save | None = None, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The first ``cap`` of ``crossing(src, dst, rank, ...)``, each once, by rank, fan-in of the target and the ids as ``shown``, with ``fan_in``.

    With ``save`` the crossing edges are exchanged for no join: a target's best place is
    that of its best rank and its fan-in, and rows below the best places of the first
    ``cap`` targets are not among the first.
    """
    if save:
        crossing = save(crossing, "crossing")
    fan = crossing.groupBy("dst").agg(F.count("*").alias("fan_in"), F.max("rank").alias("top"))
    if save:
        fan = save(fan, "fan")
        first = fan.orderBy(F.desc("top"), F.desc("fan_in")).limit(cap).select("top", "fan_in").collect()
        if len(first) == cap:
            top, least = min((r.top, r.fan_in) for r in first)
            fan = fan.where((F.col("top") > top) | ((F.col("top") == top) & (F.col("fan_in") >= least)))
        if fan.limit(100_001).count() <= 100_000:  # else many targets are equal
            fan = F.broadcast(fan)
    return crossing.join(fan.drop("top"), "dst").orderBy(F.desc("rank"), F.desc("fan_in"), shown(F.col("src")), shown(F.col("dst"))).limit(cap)


def cluster_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("cluster").agg(F.count("*").alias("n_nodes"), F.countDistinct("file").alias("n_files"))

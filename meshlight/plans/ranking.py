"""Ranking ladders, neighbour buckets, budgets and set operations of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import predicates as R
from ..functions import text as T
from ..operators import graph as G

# ---------------------------------------------------------------- ladders


def homonym_score(path: Column, kind: Column, name: Column) -> Column:
    """Path priority, tier and a file named like the symbol."""
    return P.app_path_priority(path) + T.role_tier(kind) + P.stem_match(path, name)


def locations_rank(rows: DataFrame, preferred: str | None = None, cap: int = 16) -> DataFrame:
    """Places of a name: the preferred one, production, path priority, entry, score, file, line."""
    first = F.col("id") == preferred if preferred else F.lit(False)
    keys = [first.desc(), P.noise_block(F.col("file")).asc(), P.app_path_priority(F.col("file")).desc(), R.entry_hint(F.col("file"), F.col("name")).desc(), F.desc("score"), "file", "start_line", "id"]
    return rows.orderBy(*keys).limit(cap)


def seed_pick(rows: DataFrame) -> DataFrame:
    """One row: landmarks of an entry, then public symbols, then the homonym ladder."""
    keys = [R.entry_landmark(F.col("file"), F.col("name")).desc(), (~F.startswith("name", F.lit("_"))).desc(), homonym_score(F.col("file"), F.col("kind"), F.col("name")).desc(), "file", "id"]
    return rows.orderBy(*keys).limit(1)


def lift_defs(scoped: DataFrame, every: DataFrame, pinned: bool) -> DataFrame:
    """Definitions out of scope where the scope has none but calls, unless a file is pinned."""
    if pinned or not scoped.where(T.role_tier(F.col("kind")) > 10).isEmpty():
        return scoped
    return every.where(T.role_tier(F.col("kind")) > 10)


def sort_pack(rows: DataFrame, scope: str | None) -> DataFrame:
    """In scope first, production, score, name, id."""
    inside = P.scope_in_neighbor(F.col("file"), scope) if scope else F.lit(True)
    return rows.orderBy(inside.desc(), P.noise_block(F.col("file")).asc(), F.desc("score"), "name", "id")


def hub_priority(degree: Column, path: Column, name: Column) -> Column:
    """Degree, times two for entries, a tenth for noise."""
    return degree * F.when(R.entry_landmark(path, name), 2.0).when(P.noise_block(path), 0.1).otherwise(1.0)


def hub_scored(rows: DataFrame, cap: int) -> DataFrame:
    """Hubs unique by name in the order of score; the reported score is the larger of priority and node score."""
    order = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    one = rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").orderBy(F.desc("score"), "name").limit(cap)
    return one.withColumn("score", F.greatest("score", hub_priority(F.col("degree"), F.col("file"), F.col("name"))))


def module_rank(kind: Column, path: Column, name: Column, query: str, is_hub: Column, has_source: Column) -> Column:
    """Tier in thousands; 500 for the query's name, the stem's bonus, 50 for a hub, 10 for a source."""
    return (
        T.role_tier(kind) * 1000 + F.when(F.lower(name) == query.lower(), 500).otherwise(0) + P.stem_match(path, name)
        + F.when(is_hub, 50).otherwise(0) + F.when(has_source, 10).otherwise(0)
    )


def pick_c_decl(rows: DataFrame) -> DataFrame:
    """Of ``rows(src, dst, score, static)`` the best positive one, else the first that is not static."""
    order = Window.partitionBy("src").orderBy((F.col("score") > 0).desc(), F.when(F.col("score") > 0, -F.col("score")).otherwise(0), F.col("static").asc(), "dst")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1 and (score > 0 or not static)").drop("r")


def ipc_rank(path: Column, span: Column) -> Column:
    """Production 100, application path, less the length of the block."""
    return F.when(P.noise_block(path), 0).otherwise(100) + P.app_path_priority(path) - F.least(span, F.lit(90))


def ipc_dedup(rows: DataFrame) -> DataFrame:
    """The best caller of ``rows(file, callee, id, span)`` for each (file, callee)."""
    order = Window.partitionBy("file", "callee").orderBy(ipc_rank(F.col("file"), F.col("span")).desc(), "id")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def ipc_find_callers(nodes: DataFrame, symbol: str, rule=None) -> DataFrame:
    """Nodes whose text names one command."""
    from ..operators.bridges import IpcRule

    rule = rule or IpcRule()
    return nodes.where(F.col("lang").isin(*rule.caller_langs) & F.array_contains(F.regexp_extract_all("source", F.lit(rule.pattern), F.lit(1)), symbol))


def top_neighbors(edges: DataFrame, scores: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``(id, neighbor, place)``: the best neighbours in either direction."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor")).union(edges.select("dst", "src")).distinct()
    rows = both.join(ids, "id", "left_semi").join(scores.select(F.col("id").alias("neighbor"), "score"), "neighbor")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "neighbor")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("id", "neighbor", "place")


def top_by_degree(arcs: DataFrame, n: int, shown) -> DataFrame:
    """``(id, neighbor, place)``: ``top_neighbors`` of a graph whose edges all meet a hub, by degree; ``shown`` makes ids of numbers.

    ``arcs(leaf, hub, degree, listed)``: each edge once, with the leaf's degree, null
    if it is no node, and whether the hub is one.  An edge is exchanged by its hub,
    which gives the hub's degree and its best leaves, and by its leaf.
    """
    at = Window.partitionBy("hub")
    rows = arcs.withColumn("r", F.dense_rank().over(at.orderBy(F.desc_nulls_last("degree"), shown(F.col("leaf"))))).withColumn("of_hub", F.count("*").over(at))
    leaf = F.when((F.col("r") <= n) & F.col("degree").isNotNull(), F.struct(F.col("hub").alias("id"), F.col("leaf").alias("neighbor"), F.col("degree").alias("score")))
    hub = F.when(F.col("listed"), F.struct(F.col("leaf").alias("id"), F.col("hub").alias("neighbor"), F.col("of_hub").alias("score")))
    rows = rows.select(F.explode(F.filter(F.array(leaf, hub), lambda x: x.isNotNull())).alias("x")).select("x.*")
    order = Window.partitionBy("id").orderBy(F.desc("score"), shown(F.col("neighbor")))
    # Edges that name no leaf may be alike.
    best = rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= n).select("id", "neighbor", "place").distinct()
    return best.select(shown(F.col("id")).alias("id"), shown(F.col("neighbor")).alias("neighbor"), "place")


def neighbor_buckets(rows: DataFrame, seed_file: str) -> DataFrame:
    """``bucket``: noise, same file, or external, in which rows keep their order."""
    return rows.withColumn("bucket", F.when(P.noise_block(F.col("file")), "noise").when(F.col("file") == seed_file, "same_file").otherwise("external"))


# ---------------------------------------------------------------- budgets


def cap_strings(values: list[str], n: int) -> tuple[list[str], int]:
    return values[:n], max(0, len(values) - n)


def exclude_norm(names: list[str], cap: int = 64) -> list[str]:
    return [*dict.fromkeys(x.strip() for x in names if x.strip())][:cap]


def exclude(rows: DataFrame, names: list[str]) -> DataFrame:
    """Without the names, and without names that end in ``::name``."""
    for x in exclude_norm(names):
        rows = rows.where((F.col("name") != x) & ~F.endswith("name", F.lit("::" + x)))
    return rows


def sample_offset(rows: DataFrame, n: int) -> DataFrame:
    """Without the first ``n`` places, 500 at most."""
    return rows.where(F.col("place") > min(n, 500))


def focus_inject(rows: DataFrame, focus: list[str]) -> DataFrame:
    """Listed direct callers get the first places."""
    hit = F.col("name").isin(*focus) & (F.col("side") == "caller") & (F.col("hop") == 1) if focus else F.lit(False)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(hit.desc(), "place", "id")))


def focus_missed(rows: DataFrame, focus: list[str]) -> list[str]:
    found = {r["name"] for r in rows.where(F.col("name").isin(*focus)).select("name").distinct().collect()} if focus else set()
    return [x for x in focus if x not in found]


def fan_out_cap(rows: DataFrame, fan_out: int = 20, visited: int = 200) -> DataFrame:
    """``rows(seed, id, name, file, kind, degree)``: noise and tests out, seven keys, ``fan_out`` a seed and ``visited`` in all."""
    fit = rows.where(~R.neighbor_noise_name(F.col("name")) & ~P.noise_block(F.col("file")))
    order = Window.partitionBy("seed").orderBy(T.role_tier(F.col("kind")).desc(), P.app_path_priority(F.col("file")).desc(), F.desc("degree"), "name", "file", "id")
    return fit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fan_out).orderBy("place", "seed").limit(visited)


def locality_sort(rows: DataFrame) -> DataFrame:
    return rows.orderBy(P.island_key(F.col("file")), "file")


def edge_batch(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """``batch`` of ``files(path, bytes)``: runs along the paths that keep to both limits, by running totals of each island.

    An island (two leading components) is never joined with another, so no total
    is global.
    """
    order = Window.partitionBy("island").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.withColumn("island", P.island_key(F.col("path")))
    by_bytes = F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / most_bytes)
    by_files = F.floor(F.count("*").over(order) / most_files)
    return rows.withColumn("batch", F.concat_ws("#", "island", F.greatest(by_bytes, by_files).cast("string"))).drop("island")


def budget_mins(n: int, poles: tuple[str, ...] = ("critical", "rejected")) -> dict[str, int]:
    return {p: max(1, n // 4) for p in poles}


def detail_pref(mode: str, index: int, score: float) -> str:
    if mode == "surgical" or (mode == "full" and index < 8):
        return "full"
    return "full" if index == 0 and score > 0 else "signature" if index < 6 else "minimal"


def full_code_gate(used: int, cost: int, budget: int) -> bool:
    return used + cost <= budget * 3 // 4


def hub_cap(most: int, share: float = 0.35) -> int:
    return min(max(round(most * share), 1), most)


def rank_full(rows: DataFrame, prompt_names: list[str]) -> DataFrame:
    """Rows with a text score over 1.5 or a neural score, ranked; a name of the prompt never falls below its text score."""
    fit = rows.where((F.col("text_score") > 1.5) | (F.coalesce("neural", F.lit(0.0)) != 0))
    base = F.col("text_score") * (1 + F.coalesce("heuristic", F.lit(0.0)))
    blend = F.when(F.coalesce("neural", F.lit(0.0)) != 0, 0.9 * base + 0.1 * F.col("neural")).otherwise(base)
    exact = F.lower("name").isin(*[x.lower() for x in prompt_names]) if prompt_names else F.lit(False)
    return fit.withColumn("score", F.when(exact, F.greatest(blend, F.col("text_score"))).otherwise(blend)).orderBy(F.desc("score"), "id")


# ---------------------------------------------------------------- sets and iteration


def collect_bfs(edges: DataFrame, seeds: DataFrame, depth: int, multiplier: int = 20) -> DataFrame:
    """``(id, hop)`` in the order of the walk, at most ``depth * multiplier`` nodes: nearer ones, then callees before callers, then ids."""
    near = G.expand_hops(edges, seeds, depth)
    down = edges.select(F.col("dst").alias("id")).distinct().withColumn("d", F.lit(0))
    return near.join(down, "id", "left").orderBy("hop", F.coalesce("d", F.lit(1)), "id").limit(depth * multiplier).select("id", "hop")


def collect_scored(edges: DataFrame, seeds: DataFrame, hubs: DataFrame, scores: DataFrame, hops: int) -> DataFrame:
    """``(id)``: the walk includes hubs but goes on only to their five best neighbours."""
    seen = seeds.select("id").distinct()
    front = seen
    best = top_neighbors(edges, scores, hubs, 5)
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor")).union(edges.select("dst", "src")).distinct()
    plain = both.join(hubs.select("id"), "id", "left_anti").union(best.select("id", "neighbor"))
    for _ in range(hops):
        front = plain.join(front, "id").select(F.col("neighbor").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.union(front)
    return seen


def peers_dedupe(peers: DataFrame, hard: DataFrame) -> DataFrame:
    """Peers that are no hard callers by (name, file) or (name, base name)."""
    base = lambda d: d.withColumn("b", P.basename(F.col("file")))
    return base(peers).join(base(hard).select("name", "b").distinct(), ["name", "b"], "left_anti").drop("b")


def peer_rows(peers: DataFrame, cap: int = 8) -> DataFrame:
    return peers.where(~P.noise_block(F.col("file"))).orderBy("file", "name", "id").limit(cap)


def partition_cores(rows: DataFrame) -> DataFrame:
    """``core``: core from 1, soft from 0.5, utility below; soft rows are core where no core is."""
    top = rows.agg(F.max((F.col("score") >= 1).cast("int")).alias("any"))
    part = F.when(F.col("score") >= 1, "core").when(F.col("score") >= 0.5, F.when(F.col("any") == 1, "soft").otherwise("core")).otherwise("utility")
    return rows.join(F.broadcast(top)).withColumn("core", part).drop("any")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """A bag; uniqueness comes with ``normalize_adjacency``."""
    return edges.unionByName(more)


add_bridges = add_edges


def merge_wave(graph: dict[str, DataFrame], wave: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {k: graph[k].unionByName(wave[k]) if k in wave else graph[k] for k in graph}


def apply_maps(edges: DataFrame, bridges: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Derived rows ``(src, dst, kind)``: calls go to the edges, others to the bridges."""
    return edges.union(derived.where("kind = 'call'").select("src", "dst")), bridges.union(derived.where("kind <> 'call'").select("src", "dst", "kind"))


def scope_suggest(pins: list[str], cap: int = 8) -> list[str]:
    return [*dict.fromkeys(s for p in pins if (s := P.scope_sanitize(p)))][:cap]


def collapse_serious(nodes: DataFrame) -> DataFrame:
    """Production definitions of tier 50 and up."""
    return nodes.where((T.role_tier(F.col("kind")) >= 50) & ~P.noise_block(F.col("file")))


def collapse_alts(nodes: DataFrame) -> DataFrame:
    return nodes.where((T.role_tier(F.col("kind")) != 10) & ~P.noise_block(F.col("file")))


def pin_locations(nodes: DataFrame) -> DataFrame:
    """Serious files, else all of the collision."""
    serious = collapse_serious(nodes)
    return (serious if not serious.isEmpty() else collapse_alts(nodes)).select("file").distinct()


# ---------------------------------------------------------------- counts


def lang_count(nodes: DataFrame) -> DataFrame:
    return collapse_serious(nodes).agg(F.countDistinct("lang").alias("n_langs"))


def edge_census(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Direct, transitive, shown and omitted rows."""
    s = shown.agg(F.count("*").alias("shown"))
    out = rows.agg(F.sum((F.col("hop") == 1).cast("long")).alias("direct"), F.sum((F.col("hop") > 1).cast("long")).alias("transitive"), F.count("*").alias("n"))
    return out.join(F.broadcast(s)).withColumn("omitted", F.col("n") - F.col("shown")).drop("n")


def reconstruct_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with an end of an edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "id", "left_semi").select("file").distinct()


def edgeable_inventory(files: DataFrame) -> DataFrame:
    return files.where(R.edge_buildable(F.col("path")))


def open_files(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge-buildable files without an edge."""
    return edgeable_inventory(files).join(reconstruct_files(nodes, edges).withColumnRenamed("file", "path"), "path", "left_anti")


def arch_budget(n_files: int, scoped: bool) -> int:
    return min(400, max(40, n_files // (4 if scoped else 20)))


def lang_histogram_peers(entries: list[str], lang: str, cap: int = 3) -> list[str]:
    """Parent directories of entries, else the usual ones of the language."""
    usual = {"rust": ["src/"], "python": ["src/", "lib/"], "typescript": ["src/", "app/"], "go": ["cmd/", "pkg/"], "cpp": ["src/", "include/"]}
    found = [*dict.fromkeys(e.rsplit("/", 1)[0] + "/" for e in entries if "/" in e)]
    return (found or usual.get(lang, []))[:cap]


def peer_schedule(langs: set[str], sources: list[str]) -> tuple[bool, list[str]]:
    """Whether cross-language passes are due, and why."""
    reasons = []
    if "python" in langs and langs & {"rust", "c", "cpp"}:
        reasons.append("native and script sources")
    if "typescript" in langs and "rust" in langs:
        reasons.append("front end and native commands")
    if any("#[pyfunction]" in s or ".def(" in s for s in sources):
        reasons.append("export markers")
    return bool(reasons), reasons


def node_degree(degrees: DataFrame, node: str) -> int:
    r = degrees.where(F.col("id") == node).select("degree").first()
    return r[0] if r else 0


def in_degree(degrees: DataFrame, node: str) -> int:
    r = degrees.where(F.col("id") == node).select("in_degree").first()
    return r[0] if r else 0


def total_bridges(bridges: DataFrame) -> DataFrame:
    return bridges.agg(F.count("*").alias("n_bridges"))


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.xxhash64("source").alias("hash"))


content_hash = F.xxhash64


def scope_hash(files: DataFrame, scope: str) -> DataFrame:
    """Order-free hash of the files in a scope."""
    return files.where(P.scope_dir(F.col("path"), scope)).agg(F.bit_xor(F.xxhash64("path", "hash")).alias("hash"), F.count("*").alias("n_files"))


def scope_files_count(files: DataFrame, scope: str) -> DataFrame:
    return files.where(P.scope_dir(F.col("path"), scope)).agg(F.count("*").alias("n_files"))


def scope_estimate(file_hits: int, n_nodes: int, n_files: int, cap: int = 50_000) -> int:
    return min(cap, file_hits * -(-n_nodes // max(1, n_files)))


def scope_heal(files: DataFrame, scope: str) -> str | None:
    """The scope without ``..``, as the file or the directory that it names."""
    s = P.scope_sanitize(scope)
    if s is None:
        return None
    s = s.rstrip("/")
    return s if not files.where(F.col("path") == s).isEmpty() else s + "/"

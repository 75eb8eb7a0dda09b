"""The goals: trace, architecture and prompt context, with their reports; freeze and check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import noise_block, scope_include
from ..operators import graph as G
from ..operators import names as N
from . import analytics as A
from . import selection as S
from .budget import block_costs, render_budget


@dataclass
class Request:
    """Defaults of a request (fixed values)."""

    query: str = ""
    scopes: tuple[str, ...] = ()
    depth: int = 2
    max_tokens: int = 4000
    max_results: int = 8
    risk_files: int = 2


def depth_cap(depth: int | None) -> int:
    return min(max(depth or 2, 1), 2)


def homonym_risk(name: str) -> bool:
    return name.lower() in T.TRACE_NOISE or sum(c.isalnum() for c in name) <= 8


def seed_resolve(nodes: DataFrame, edges: DataFrame, request: Request) -> DataFrame:
    """``(id)`` of the seed, or nothing.

    Exact names in scope, else exact names anywhere; the best homonym of them.
    Only if no row has the name are names compared without case, and the result
    must still be the identifier that was asked for.
    """
    name = T.normalize_seed(request.query)
    exact = N.name_lookup(nodes, name)
    scoped = exact.where(scope_include(F.col("file"), list(request.scopes)))
    rows = scoped if not scoped.isEmpty() else exact
    if rows.isEmpty():
        rows = nodes.where(F.lower("name") == name.lower())
    rows = N.filter_seeds(rows.withColumn("name", F.lower("name")))
    return N.pick_homonym(rows, G.degrees(rows, edges)).select("id")


def disambiguate(nodes: DataFrame, request: Request) -> DataFrame | None:
    """Locations to choose from if the name is a risky homonym of several production files and no file is pinned."""
    name = T.normalize_seed(request.query)
    if any("." in s.rsplit("/", 1)[-1] for s in request.scopes) or not homonym_risk(name):
        return None
    rows = N.name_lookup(nodes, name).where(scope_include(F.col("file"), list(request.scopes)))
    files = A.serious_files(rows)
    return N.name_locations(rows) if files.count() >= request.risk_files else None


def confidence(edges_full: bool, edges_any: bool, indexed: bool) -> str:
    return "edges_full" if edges_full else "edges_partial" if edges_any else "index_exact" if indexed else "inventory"


def receipt(rows: DataFrame, complete: bool) -> dict:
    """Counts and the rung of confidence of a trace."""
    n = {r["side"]: (r["direct"], r["transitive"]) for r in G.hop_split(rows).collect()}
    return {"confidence": confidence(complete, bool(n), True), "callers": n.get("caller", (0, 0)), "callees": n.get("callee", (0, 0))}


def basis_tag(hop, bridge_kind):
    return F.coalesce(bridge_kind, F.when(hop > 1, "transitive").otherwise("call"))


def trust_band(hop, noise):
    return F.when(noise, "low").when(hop > 1, "medium").otherwise("high")


def trace_find(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, request: Request) -> DataFrame:
    """Packed rows around the seed with relation and trust; no rows without a seed."""
    seed = seed_resolve(nodes, edges, request)
    rows = G.trace_neighborhood(edges, seed, depth_cap(request.depth)).join(nodes.select("id", "name", "file"), "id")
    scored = rows.join(G.degrees(nodes, edges).select("id", F.col("degree").alias("score")), "id")
    typed = G.bridge_kind_between(bridges)
    near = G.bridge_callers(typed, seed).select(F.col("src").alias("id"), "kind").union(G.bridge_children(typed, seed).select(F.col("dst"), "kind"))
    near = near.groupBy("id").agg(F.max_by("kind", G.bridge_rank(F.col("kind"))).alias("bridge"))
    packed = S.pack_neighbors(scored, request.max_tokens).join(near, "id", "left")
    return packed.select(
        "side", "hop", "id", "name", "file", "score", "place", basis_tag(F.col("hop"), F.col("bridge")).alias("relation"), trust_band(F.col("hop"), noise_block(F.col("file"))).alias("trust")
    )


def arch_summary(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, hubs: int = 20) -> dict[str, DataFrame]:
    """Directories, hubs, clusters and cross-cluster bridges."""
    return {
        "directories": A.arch_rollup(nodes), "hubs": A.hub_unique(nodes, G.degrees(nodes, edges), hubs),
        "clusters": G.cluster_summary(nodes), "bridges": G.find_bridges(nodes, edges, bridges),
    }


def resolve_query(nodes: DataFrame, prompt: str) -> dict[str, list[str]]:
    """Tokens of the prompt by what the graph knows: hits of names or paths, exact names, strong ones without a hit."""
    tokens = T.raw_tokens(prompt)
    if not tokens:
        return {"graph_hits": [], "exact": [], "unmatched": []}
    checks = []
    for i, t in enumerate(tokens):
        strong, lit = T.strong_token(t), F.lit(t)
        checks += [
            F.max((T.name_hit(F.col("name"), lit, strong) | T.path_hit(F.col("file"), lit, strong)).cast("int")).alias(f"h{i}"), F.max((F.col("name") == lit).cast("int")).alias(f"e{i}")
        ]
    r = nodes.agg(*checks).first()
    hits = [t for i, t in enumerate(tokens) if r[f"h{i}"]]
    return {"graph_hits": hits, "exact": [t for i, t in enumerate(tokens) if r[f"e{i}"]], "unmatched": [t for t in tokens if t not in hits and T.strong_token(t)]}


def ranking_tokens(query: dict[str, list[str]]) -> list[str]:
    """Strong hits, else exact hits, else none: prose never seeds."""
    return [t for t in query["graph_hits"] if T.strong_token(t)] or query["exact"]


def get_context(nodes: DataFrame, edges: DataFrame, prompt: str, request: Request | None = None) -> DataFrame:
    """``(id, name, file, score, fidelity, cost)``: retrieved nodes and their neighbours, rendered into the token budget."""
    request = request or Request()
    found = S.retrieve_subgraph(nodes, ranking_tokens(resolve_query(nodes, prompt)))
    around = G.expand_hops(edges, found.select("id"), 1).join(found, "id", "left")
    deg = G.degrees(nodes, edges).select("id", T.heuristic_score(F.col("in_degree"), F.col("out_degree"), F.lit(False), F.lit(False), F.lit(False), F.lit(9999)).alias("heuristic"))
    rows = S.rank_selection(around.join(deg, "id").withColumn("text_score", F.coalesce("text_score", F.lit(1.0))))
    rows = S.select_blocks(rows.join(nodes, "id"), request.max_results)
    missing = {c: F.lit(0) for c in ("start_line", "end_line") if c not in rows.columns} | ({} if "source" in rows.columns else {"source": F.col("name")})
    shown = render_budget(block_costs(rows.withColumns(missing)), request.max_tokens)
    return rows.select("id", "name", "file", "score").join(shown, "id")


# ---------------------------------------------------------------- freeze


def freeze_shot(rows: DataFrame) -> DataFrame:
    """``(side, name)`` of the direct neighbours of a trace."""
    return rows.where("hop = 1").select("side", "name").distinct()


def run_check(shot: DataFrame, rows: DataFrame, complete: bool) -> tuple[DataFrame, bool]:
    """What a new trace lost against the frozen one, and whether that is a regression."""
    lost = A.diff_shots(shot, freeze_shot(rows))
    return lost, A.hard_fail(lost, complete)

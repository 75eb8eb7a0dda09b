"""The request surface: entry pipeline, goal switch, tools, caches and health."""

from __future__ import annotations

from collections import OrderedDict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intent import ask_remap, ask_route
from ..functions.text import truncate_tokens
from ..operators import graph as G
from ..operators import names as N
from ..operators.bridges import IpcRule
from . import analytics as A
from . import goals
from .export import CONTAINS, dense_index, export_edges

TOOLS = {"ask": "a question in words", "who_calls": "callers and callees of a symbol", "get_context": "code for a prompt", "overview": "an architecture summary"}
EXPERT_TOOLS = {"collisions": "names with several definitions", "export": "the graph as JSON", "check": "a frozen trace against a new one"}


class Lru:
    """A bounded cache, least recently used out first."""

    def __init__(self, size: int):
        self.size, self.rows = size, OrderedDict()

    def get(self, key):
        if key in self.rows:
            self.rows.move_to_end(key)
            return self.rows[key]
        return None

    def put(self, key, value) -> None:
        self.rows[key] = value
        self.rows.move_to_end(key)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)


def trace_memo() -> Lru:
    """Traces by (query, epoch): a changed graph never hits."""
    return Lru(512)


def query_cache() -> Lru:
    return Lru(128)


def request_ring(size: int = 64) -> deque:
    return deque(maxlen=size)


def orchestrate(goal: str, nodes: DataFrame, edges: DataFrame, bridges: DataFrame, request: goals.Request):
    """Trace, find or architecture; other goals and blank queries are refused."""
    if goal == "arch":
        return goals.arch_summary(nodes, edges, bridges)
    if not request.query.strip():
        raise ValueError("a query is needed")
    if goal == "trace":
        options = goals.disambiguate(nodes, request)
        return options if options is not None else goals.trace_find(nodes, edges, bridges, request)
    if goal == "find":
        return N.name_locations(N.name_lookup(nodes, goals.T.normalize_seed(request.query)))
    raise ValueError(f"no such goal: {goal}")


def context_entry(question: str, nodes: DataFrame, edges: DataFrame, bridges: DataFrame, **arguments):
    """Route, clean the arguments, and answer."""
    goal, subject = ask_route(question)
    request = goals.Request(**({"query": subject} | ask_remap(arguments)))
    return goals.get_context(nodes, edges, question, request) if goal == "context" else orchestrate(goal, nodes, edges, bridges, request)


def compute_mode(target_line: int | None, goal: str, max_tokens: int) -> str:
    return "surgical" if target_line is not None else "outline" if goal == "arch" else "full" if max_tokens >= 16_000 else "balanced"


def surgical_pick(nodes: DataFrame, file: str, line: int) -> DataFrame:
    """Blocks around a line, the smallest first."""
    hit = nodes.where((F.col("file") == file) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
    return hit.orderBy(F.col("end_line") - F.col("start_line"), "id")


def compose(rows: DataFrame, mode: str) -> DataFrame:
    """Rows with a score (all of them in surgical mode), best first."""
    kept = rows if mode == "surgical" else rows.where("score > 0")
    return kept.orderBy(F.desc("score"), "id")


def render_block(name: str, source: str, fidelity: str) -> tuple[str, int]:
    """Text of a block and its cost: whole, the first lines up to the brace, or the name."""
    if fidelity == "full":
        text = source
    elif fidelity == "signature":
        text = "\n".join(source.split("\n")[:4]).split("{", 1)[0].rstrip() + " ..."
    else:
        text = name
    return text, len(text)


def collisions_api(nodes: DataFrame, least_files: int = 3, cap: int = 50) -> DataFrame:
    return N.name_collisions(nodes, least_files, cap)


def graph_export_all(nodes: DataFrame, edges: DataFrame, contains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All nodes with their degree, all edges by index."""
    index = dense_index(nodes)
    return index.join(G.degrees(nodes, edges).select("id", "degree"), "id"), export_edges(index, edges, contains)


export_graph = graph_export_all


def contains_edges(nodes: DataFrame) -> DataFrame:
    """Parent to child, of type ``CONTAINS``."""
    return nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit(CONTAINS).alias("type"))


def skeleton_tree(rows: list[tuple[int, str]], cap: int = 120) -> str:
    """Indented lines of (depth, text), with a note of what is left out."""
    lines = ["  " * d + t for d, t in rows[:cap]]
    return "\n".join([*lines, f"... {len(rows) - cap} more"] if len(rows) > cap else lines)


def monorepo_plan(nodes: DataFrame, n_nodes: int, large: int = 10_000) -> list[str]:
    """Scopes for a large graph that came without one."""
    return [r["dir"] + "/" for r in A.top_dir_scopes(nodes).collect()] if n_nodes >= large else []


def audit_funnel(rows: DataFrame, cap: int = 10) -> list[dict]:
    """The best ranked rows, for a log."""
    return [r.asDict() for r in rows.orderBy(F.desc("score"), "id").limit(cap).collect()]


def ipc_rules(configured: list[dict]) -> tuple[IpcRule, ...]:
    """Rules of a configuration, after the default one."""
    return (IpcRule(), *(IpcRule(**c) for c in configured))


def warm(roots: list[str], known: set[str]) -> list[str]:
    return [r for r in dict.fromkeys(roots) if r not in known]


def health(roots: dict[str, float]) -> dict:
    return {"status": "ok", "roots": [{"root": r, "progress": p} for r, p in sorted(roots.items())]}


def tools_list(expert: bool = False) -> dict[str, str]:
    return TOOLS | EXPERT_TOOLS if expert else dict(TOOLS)


def cut(text: str, budget: int) -> str:
    return truncate_tokens(text, budget)

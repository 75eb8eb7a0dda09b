"""States of a graph build: batches, completeness, progress, confidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.names import name_locations

JIT_FILES, SCOPE_FILES, SMALL_CONE = 64, 48, 64  # fixed values


def edit_region(old: str, new: str) -> tuple[int, int, int]:
    """(start, old end, new end) of what differs between common prefix and suffix."""
    n = min(len(old), len(new))
    a = next((i for i in range(n) if old[i] != new[i]), n)
    b = next((i for i in range(n - a) if old[-1 - i] != new[-1 - i]), n - a)
    return a, len(old) - b, len(new) - b


def recollect(edges: DataFrame, nodes: DataFrame, file: str, fresh: DataFrame) -> DataFrame:
    """Outbound edges of one file replaced."""
    ids = nodes.where(F.col("file") == file).select("id")
    return G.clear_outbound(edges, ids).union(fresh.select("src", "dst"))


def update_single(nodes, edges, parsed, file: str):
    from .changes import update_batch

    return update_batch(nodes, edges, parsed, parsed.sparkSession.createDataFrame([(file,)], "file string"))


def drain(pending: list[str], more: list[str]) -> list[str]:
    """Pending paths and those that came meanwhile, each once."""
    return [*dict.fromkeys([*pending, *more])]


def full_edge_build(files: DataFrame, nodes: DataFrame, sites: Callable[[DataFrame], DataFrame], edges: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Edges of all files: one plan, in which Spark makes the batches."""
    return edges(nodes, sites(files)).select("src", "dst").distinct()


def ensure_call_graph(files: DataFrame, targets: DataFrame, cap: int = JIT_FILES) -> DataFrame:
    """The target files to resolve now; the cap is that of an interactive request."""
    return files.join(targets.select("path").distinct(), "path", "left_semi").orderBy("path").limit(cap)


scoped_parse = ensure_call_graph


def finalize(nodes: DataFrame, edges: DataFrame, save) -> dict[str, DataFrame]:
    """Cycles, hubs and the name index of a graph."""
    return {"cycles": G.detect_cycles(edges, save), "hubs": G.compute_hubs(nodes, edges.select("src", "dst").distinct(), save), "index": name_locations(nodes)}


def post_pass(cone: int, complete: bool) -> bool:
    """Whether whole-graph passes are due: not after a small change."""
    return not complete or cone > SMALL_CONE


@dataclass
class EdgeState:
    """Which files of the inventory have their edges."""

    inventory: set[str] = field(default_factory=set)
    done: set[str] = field(default_factory=set)
    barren: set[str] = field(default_factory=set)
    complete: bool = False

    def edge_complete(self) -> bool:
        return not (self.inventory - self.done - self.barren)

    def tolerance(self, path: str) -> None:
        """Closes a file that can never yield edges."""
        self.barren.add(path)

    def heal_complete(self) -> bool:
        """Reopens a state that claims to be complete while files are open."""
        if self.complete and not self.edge_complete():
            self.complete = False
            return True
        return False

    def progress(self) -> float:
        return 1.0 if not self.inventory else len((self.done | self.barren) & self.inventory) / len(self.inventory)


def restore_state(inventory: set[str], edged: set[str], same_semantics: bool) -> EdgeState:
    """After a load: edges count only if their meaning has not changed."""
    s = EdgeState(inventory, edged if same_semantics else set())
    s.complete = same_semantics and s.edge_complete()
    return s


class Police:
    """One lane per root, and a number of roots at once."""

    def __init__(self, slots: int = 2):
        self.slots, self.busy, self.waiting = slots, set(), []

    def police_submit(self, root: str) -> bool:
        """True if the work may begin; else it waits."""
        if root in self.busy or len(self.busy) >= self.slots:
            if root not in self.waiting:
                self.waiting.append(root)
            return False
        self.busy.add(root)
        return True

    def finish(self, root: str) -> str | None:
        self.busy.discard(root)
        return next((self.waiting.pop(i) for i, r in enumerate(self.waiting) if r not in self.busy), None)

    jit_blocking = police_submit


def sleep_tick(last_used: dict[str, float], now: float, idle_s: float = 900) -> list[str]:
    return sorted(r for r, t in last_used.items() if now - t > idle_s)


def defer_open(tier: str, n_nodes: int) -> str:
    return "defer" if tier == "critical" or (tier == "high" and n_nodes > 100_000) else "allow"


def auto_scope(scopes: tuple[str, ...], planned: list[str], n_nodes: int, large: int = 10_000) -> tuple[str, ...]:
    """The planned scopes where none is given and the graph is large."""
    return tuple(planned) if n_nodes >= large and not any(s.strip(" ./") for s in scopes) else tuple(scopes)

"""Top-k selection, packing and rendering under budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import module_key
from ..functions.text import block_score, junk_symbol_col, module_kw
from ..operators.graph import expand_hops
from ..operators.storage import save


def cap_by_score(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """The best ``cap`` rows of each key, with their place and how many were left out."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).where(F.col("place") <= cap)
    # The counts come from an aggregate of their own, so that the best rows are already picked on the map side.
    sizes = rows.groupBy(F.col(key).alias("__mesh_key")).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("omitted"))
    return ranked.join(sizes, F.col(key).eqNullSafe(F.col("__mesh_key"))).drop("__mesh_key")


def select_blocks(rows: DataFrame, cap: int = 8) -> DataFrame:
    """The best rows, one for each (name, file)."""
    order = Window.partitionBy("name", "file").orderBy(F.desc("score"), "id")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").orderBy(F.desc("score"), "id").limit(cap)


def l0_modules(nodes: DataFrame, tokens: list[str], cap: int = 32) -> DataFrame:
    """Modules by keyword score."""
    modules = nodes.select(module_key(F.col("file")).alias("module")).distinct()
    total = F.lit(0)
    for t in tokens:
        total = total + module_kw(F.col("module"), F.lit(t))
    return modules.withColumn("score", total).where("score > 0").orderBy(F.desc("score"), "module").limit(cap)


def retrieve_subgraph(nodes: DataFrame, tokens: list[str], cap: int = 4096, top: int = 128) -> DataFrame:
    """``(id, text_score)``: nodes of the best modules by token score, all nodes if those have none; nothing without tokens.

    The gate of 1.5 leaves out what only an overshadowed name reached.
    """
    if not tokens:
        return nodes.select("id", F.lit(0.0).alias("text_score")).limit(0)
    score = F.lit(0.0)
    for t in tokens:
        score = score + block_score(F.col("name"), F.col("file"), F.lit(t))
    scored = nodes.withColumn("text_score", score).where("text_score > 1.5")
    near = scored.join(F.broadcast(l0_modules(nodes, tokens)), module_key(F.col("file")) == F.col("module"), "left_semi")  # 32 rows
    found = near if not near.isEmpty() else scored
    return found.orderBy(F.desc("text_score"), "id").limit(cap).select("id", "text_score").limit(top)


def retrieve_with_hops(nodes: DataFrame, edges: DataFrame, tokens: list[str], top: int = 128, hops: int = 2, modules: int = 32, cap: int = 4096) -> DataFrame:
    """``(id, text_score)``: the ``top`` nodes by token score and all within ``hops`` calls of them in either direction.

    Nodes of the best modules and of what lies below them are scored first, all
    nodes if those have no score; junk names are no seeds.  Nodes that the hops bring
    have their own score, 0 if no token hits them.  Nothing without tokens.
    """
    if not tokens:
        return nodes.select("id", F.lit(0.0).alias("text_score")).limit(0)
    score = F.lit(0.0)
    for t in tokens:
        score = score + block_score(F.col("name"), F.col("file"), F.lit(t))
    every = nodes.withColumn("text_score", score)
    scored = save(every.where(~junk_symbol_col(F.col("name")) & (F.col("text_score") > 0)).select("id", "file", "text_score"), "scored")
    m, below = F.col("module"), F.concat("module", F.lit("/"))
    inside = (F.col("file") == m) | F.startswith("file", below) | (module_key(F.col("file")) == m)
    near = scored.join(F.broadcast(l0_modules(nodes, tokens, modules)), inside, "left_semi")  # ``modules`` rows
    found = near if not near.isEmpty() else scored
    seeds = save(found.orderBy(F.desc("text_score"), "id").limit(min(top, cap)).select("id"), "seeds")
    return expand_hops(edges, seeds, hops, save).select("id").join(every.select("id", "text_score"), "id")


def rank_selection(rows: DataFrame) -> DataFrame:
    """Text score times one and the heuristic score."""
    return rows.withColumn("score", F.col("text_score") * (1 + F.col("heuristic")))


def pack_neighbors(rows: DataFrame, char_budget: int = 4000, per_dir: int = 2) -> DataFrame:
    """Rows ``(side, hop, id, name, file, score)`` that fit a text budget, sides in turn, ``per_dir`` of a directory first.

    The cost of a line is 20 and the lengths of name and file.  Ranks and running
    sums are windows over one trace.
    """
    d = F.row_number().over(Window.partitionBy("side", module_key(F.col("file"))).orderBy("hop", F.desc("score"), "id"))
    rows = rows.withColumn("late", (d > per_dir).cast("int"))
    place = F.row_number().over(Window.partitionBy("side").orderBy("late", "hop", F.desc("score"), "id"))
    rows = rows.withColumn("place", place).withColumn("cost", 20 + F.length("name") + F.length("file"))
    used = F.sum("cost").over(Window.orderBy("place", "side").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where((F.col("used") <= char_budget) | (F.col("place") == 1)).drop("late")


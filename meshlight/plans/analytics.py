"""Aggregations, rollups and set comparisons over the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import NOISE_DIRS, dirs, module_key, noise_block
from ..functions.text import role_tier


def lang_census(files: DataFrame) -> DataFrame:
    return files.groupBy("lang").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"))


def lang_void(census: DataFrame, least: int = 50, times: int = 4) -> DataFrame:
    """Whether one language dominates: enough files, and ``times`` as many as the next."""
    top = census.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n_files"), "lang")))  # one row per language
    first = F.max(F.when(F.col("rk") == 1, F.col("n_files")))
    second = F.coalesce(F.max(F.when(F.col("rk") == 2, F.col("n_files"))), F.lit(0))
    return top.agg(((first >= least) & (first >= times * second)).alias("dominated"), F.max(F.when(F.col("rk") == 1, F.col("lang"))).alias("lang"))


def lang_presence(files: DataFrame) -> DataFrame:
    return files.select("lang").distinct()


def repo_shape(files: DataFrame) -> DataFrame:
    """Files at the top and below, number of top directories, and the shape they make."""
    d = F.size(dirs(F.col("file")))
    out = files.agg(
        F.sum((d == 0).cast("long")).alias("root_files"), F.sum((d > 0).cast("long")).alias("nested_files"),
        F.countDistinct(F.when(d > 0, F.element_at(dirs(F.col("file")), 1))).alias("top_dirs"),
    )
    shape = F.when(F.col("nested_files") == 0, "flat").when(F.col("top_dirs") == 1, "single").when(F.col("top_dirs") >= 8, "monorepo").otherwise("layered")
    return out.withColumn("shape", shape)


def scope_repair(nodes: DataFrame, cap: int = 10) -> DataFrame:
    """Two-level prefixes by their number of files."""
    scope = F.array_join(F.slice(F.split("file", "/"), 1, 2), "/")
    return nodes.groupBy(scope.alias("scope")).agg(F.countDistinct("file").alias("n_files")).orderBy(F.desc("n_files"), "scope").limit(cap)


def dir_facets(nodes: DataFrame, ids: DataFrame, cap: int = 8) -> DataFrame:
    """Parent directories of the given nodes by count."""
    at = nodes.join(ids.select("id").distinct(), "id")
    return at.groupBy(module_key(F.col("file")).alias("facet")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "facet").limit(cap)


def top_dir_scopes(nodes: DataFrame, cap: int = 8) -> DataFrame:
    """Top directories by files, without noise directories."""
    top = nodes.select(F.element_at(F.split("file", "/"), 1).alias("dir"), "file").where(~F.col("dir").isin(*NOISE_DIRS))
    return top.groupBy("dir").agg(F.countDistinct("file").alias("n_files")).orderBy(F.desc("n_files"), "dir").limit(cap)


def toc_dirs(nodes: DataFrame, cap: int = 40) -> DataFrame:
    return nodes.select(F.element_at(F.split("file", "/"), 1).alias("dir")).where(~F.col("dir").isin(*NOISE_DIRS)).distinct().orderBy("dir").limit(cap)


def arch_rollup(nodes: DataFrame) -> DataFrame:
    """Files and nodes of every two-level directory."""
    d = F.array_join(F.slice(F.split("file", "/"), 1, 2), "/")
    return nodes.groupBy(d.alias("dir")).agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_nodes"))


def hub_unique(nodes: DataFrame, degrees: DataFrame, cap: int) -> DataFrame:
    """The busiest nodes, one for each name."""
    order = Window.partitionBy("name").orderBy(F.desc("degree"), "id")
    one = degrees.select("id", "degree").join(nodes.select("id", "name"), "id").withColumn("r", F.row_number().over(order)).where("r = 1")
    return one.orderBy(F.desc("degree"), "name").limit(cap).select("name", "id", "degree")


def spine_walk(nodes: DataFrame, edges: DataFrame, seed: DataFrame, halt: int = 5, steps: int = 4) -> DataFrame:
    """``(step, id)``: greedy walk up the callers, at each step the one with the largest fan-in, then name and id.

    Stops at a caller without callers or with more than ``halt``.
    """
    fan = edges.groupBy("dst").agg(F.count("*").alias("in_degree")).withColumnRenamed("dst", "src")
    now, out = seed.select("id"), seed.select(F.lit(0).alias("step"), "id")
    for step in range(1, steps + 1):
        up = edges.join(now.withColumnRenamed("id", "dst"), "dst").select("src").distinct().join(fan, "src").where(F.col("in_degree") <= halt)
        named = up.join(nodes.select(F.col("id").alias("src"), "name"), "src")
        now = named.orderBy(F.desc("in_degree"), "name", "src").limit(1).select(F.col("src").alias("id"))
        out = out.union(now.select(F.lit(step).alias("step"), "id"))
    return out


def edge_progress(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with a node on an edge, and files without."""
    on = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("e", F.lit(1))
    files = nodes.select("id", "file").join(on, "id", "left").groupBy("file").agg(F.max("e").alias("e"))
    return files.agg(F.count("e").alias("edged"), (F.count("*") - F.count("e")).alias("open"))


def serious_files(nodes: DataFrame) -> DataFrame:
    """Production files with a definition of tier 50 or more."""
    return nodes.where((role_tier(F.col("kind")) >= 50) & ~noise_block(F.col("file"))).select("file").distinct()


def collision_files(nodes: DataFrame) -> DataFrame:
    return nodes.where((role_tier(F.col("kind")) != 10) & ~noise_block(F.col("file"))).select("file").distinct()


def set_lost(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.distinct().join(after.distinct(), before.columns, "left_anti")


def diff_shots(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(side, name)`` rows of a frozen trace that a new one lost."""
    return set_lost(before.select("side", "name"), after.select("side", "name"))


def hard_fail(lost: DataFrame, complete: bool) -> bool:
    """A regression: a complete graph lost a caller, a callee or a bridge."""
    return complete and not lost.isEmpty()


def debounce(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Sessions of events with no pause longer than the gap: (key, first_ts, last_ts, n_events)."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    pause = F.col(ts) - F.lag(ts).over(order) <= F.expr(f"INTERVAL {gap_seconds} SECOND")
    marked = events.select(key, ts, tie).withColumn("new", F.when(pause, 0).otherwise(1)).withColumn("n", F.sum("new").over(order))
    return marked.groupBy(key, "n").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events")).drop("n")


def label_validate(labels: DataFrame) -> DataFrame:
    """Number of labels by issue."""
    q, t = F.col("quality"), F.col("toxic")
    issue = F.when(q.isNull() | t.isNull(), "null").when(~q.isin(0, 1) | ~t.isin(0, 1), "range").when((q == 1) & (t == 1), "conflict").otherwise("ok")
    return labels.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def polarity_caps(labels: DataFrame, pole: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` labels of each pole: the feature is the cap, so that neither fills the set.

    Ranks go by a top-k per partition before the exchange.
    """
    w = Window.partitionBy(pole).orderBy(order)
    return labels.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).select(order, pole)


def harvest_status(labels: DataFrame, pole: str) -> DataFrame:
    return labels.agg(
        F.count("*").alias("n_labelled"), F.sum((F.col(pole) == 1).cast("long")).alias("critical"), F.sum((F.col(pole) == 0).cast("long")).alias("rejected")
    )


def coverage(omitted: Column, rolled: Column, shown: Column) -> Column:
    """Whole: something is shown, nothing rolled up or left out."""
    return (shown > 0) & (omitted == 0) & ~rolled

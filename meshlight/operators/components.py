"""Connected components over an edge DataFrame, without collecting edges or nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def connected_components(edges: DataFrame, save: Callable[[DataFrame, str], DataFrame], rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its least node.

    Alternates large-star and small-star steps: every step hangs the neighbours
    of a node on the least of them, so the number of edges never grows and each
    component ends as one star.  ``save(df, name)`` must cut the lineage (a
    checkpoint or a table in shared storage).  Null ends are ignored; an empty
    edge table gives an empty result.
    """
    now = save(_down(edges.select("u", "v").dropna()), "cc")
    mark = _fingerprint(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, save(_down(small.union(low.select("u", F.col("m").alias("v")))), "cc")
        if hasattr(before, "saved_path"):
            forget(before)
        was, mark = mark, _fingerprint(now)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """Two edge sets are equal exactly if these are, but for hash collisions."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum(F.hash("u", "v").cast("long"))).first())

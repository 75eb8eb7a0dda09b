"""Label harvesting: cards, sampling, validation and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import call_target_kind, type_target_kind

LCG_A, LCG_C = 6364136223846793005, 1442695040888963407  # fixed values of the generator


def lcg(seed: int, n: int) -> list[int]:
    out, x = [], seed
    for _ in range(n):
        x = (x * LCG_A + LCG_C) % 2**64
        out.append(x >> 33)
    return out


def labelable(nodes: DataFrame) -> DataFrame:
    return nodes.where(call_target_kind(F.col("kind")) | type_target_kind(F.col("kind")))


def card(nodes: DataFrame, edges: DataFrame, ids: DataFrame, cap: int = 6) -> DataFrame:
    """``(card, relation, place, id, name)``: the first neighbours of each node by name, ``cap`` a relation."""
    down = edges.join(ids.select(F.col("id").alias("src")), "src").select(F.col("src").alias("card"), F.lit("calls").alias("relation"), F.col("dst").alias("id"))
    up = edges.join(ids.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("card"), F.lit("called_by").alias("relation"), F.col("src").alias("id"))
    order = Window.partitionBy("card", "relation").orderBy("name", "id")
    return down.union(up).distinct().join(nodes.select("id", "name"), "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("card", "relation", "place", "id", "name")


def next_cards(nodes: DataFrame, labelled: DataFrame, seed: int, n: int) -> DataFrame:
    """``n`` unlabelled nodes by a seeded hash: a sampling operator, so ``n`` is its feature."""
    key = lcg(seed, 1)[0]
    left = labelable(nodes).join(labelled.select("id"), "id", "left_anti")
    return left.orderBy(F.xxhash64("id", F.lit(key)), "id").limit(n).select("id", "name", "file")


def emit_sanitize(labels: DataFrame) -> DataFrame:
    """Nulls filled; a label without a note and with score 0 is rejected."""
    return labels.select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.trim("note"), F.lit("")).alias("note")).withColumn(
        "pole", F.when(F.col("score") >= 0.5, "critical").otherwise("rejected")
    )


def stub_note(note):
    return (F.length(F.trim(note)) < 12) | F.lower(F.trim(note)).isin("todo", "n/a", "none", "important function", "helper function")


def emit_validate(labels: DataFrame) -> DataFrame:
    """Number of labels by issue."""
    issue = F.when(F.col("id").isNull(), "no id").when((F.col("score") < 0) | (F.col("score") > 1), "range").when((F.col("pole") == "critical") & stub_note(F.col("note")), "stub").otherwise("ok")
    return labels.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def emit_caps(labels: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` labels of each pole: a full pole takes no more."""
    order = Window.partitionBy("pole").orderBy(F.desc("score"), "id")
    return labels.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).drop("r")


def commit_emit(old: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """Old labels stay, new ones of unknown ids are added, then the caps apply."""
    fresh = emit_sanitize(new).where("id is not null").dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti")
    return emit_caps(old.select("id", "score", "note", "pole").union(fresh.select("id", "score", "note", "pole")), cap)


def goals_met(n_labelled: int, critical: int, rejected: int, least: int = 40) -> bool:
    """Enough labels, a tenth of them of either pole."""
    return n_labelled >= least and min(critical, rejected) * 10 >= n_labelled

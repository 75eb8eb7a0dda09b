"""Greedy rendering under a token budget, as a scan of functions of the budget that is left.

Blocks are taken in order; each takes the first of its forms that still fits, or
none.  Whether one fits depends on all before it, but what a run of blocks does is a
function from the budget before it to the budget after it, and such functions can
be chained.  So each range partition makes its function for every budget at once,
the partitions are chained, and each then settles its own blocks, all in parallel.
A function is a table with an entry for each budget: its size is bounded by the
budget, whatever the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import save

FORMS = ("full", "signature", "minimal")
#: No form: larger than any budget.
_NONE = np.int64(1) << 62
#: Kinds of types (fixed values).
_TYPES = ("struct_item", "enum_item", "trait_item", "type_item")


def preferred_form(mode: str, index: Column, score: Column, kind: Column, source: Column) -> Column:
    """0 for full, 1 for signature, 2 for minimal, by the mode of the request and a block's place by score."""
    if mode == "surgical":
        return F.when((index < 3) | (score > 80), 0).otherwise(2)
    if mode == "implementation":
        return F.when((index < 7) | (score > 70), 0).otherwise(1)
    if mode == "architecture":
        return F.when(kind.isin(*_TYPES) | F.contains(source, F.lit("pub ")), 1).otherwise(2)
    if mode in ("compressed", "mini"):
        return F.lit(2 if mode == "compressed" else 1)
    return F.when((index < 4) | (score > 85), 0).when(index < 8, 1).otherwise(2)


def form_texts() -> tuple[Column, Column, Column]:
    """The three forms of a block ``(name, kind, file, start_line, end_line, score, source)``."""
    at = F.concat(F.lit("\nFile: "), F.col("file"), F.lit(":"), F.col("start_line").cast("string"))
    full = F.concat(F.lit("### "), "name", F.lit(" [score: "), F.format_string("%.1f", F.col("score").cast("double")), F.lit("]"), at, F.lit("-"), F.col("end_line").cast("string"), F.lit("\n```\n"), "source", F.lit("\n```\n\n"))
    lines = F.slice(F.split(F.regexp_replace("source", r"\r?\n\z", ""), r"\r?\n"), 1, 4)
    heads = F.transform(lines, lambda line: F.regexp_replace(F.substring_index(line, "{", 1), r"^\s+|\s+$", ""))
    signature = F.concat(F.lit("### "), "name", F.lit(" (signature)"), at, F.lit("\n"), F.array_join(heads, "\n"), F.lit("\n```\n\n"))
    return full, signature, F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")\n"))


def block_costs(blocks: DataFrame, mode: str = "balanced", hubs: DataFrame | None = None) -> DataFrame:
    """``(id, first, score, c0, c1, c2)``: what each form would cost in characters, null for one that is not tried, and the order of consideration.

    Hubs are never tried in full.  Null fields read as empty or 0.  The best two by
    score and id come first whatever form they get.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "kind", "file", "source")}
    rows = blocks.withColumns(text | {"score": F.coalesce(F.col("score").cast("double"), F.lit(0.0))})
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("start_line", "end_line")})
    best = rows.orderBy(F.desc("score"), "id").limit(8).select("id", "score").collect()  # only the first eight have a place that counts
    index = F.lit(8)
    for i, r in reversed(list(enumerate(best))):
        index = F.when((F.col("id") == r.id) & (F.col("score") == r.score), i).otherwise(index)
    rows = rows.withColumn("index", index)
    rows = rows.withColumn("want", preferred_form(mode, F.col("index"), F.col("score"), F.col("kind"), F.col("source")))
    hub = F.lit(False)
    if hubs is not None:
        rows, hub = rows.join(hubs.select("id", F.lit(True).alias("hub")).distinct(), "id", "left"), F.coalesce(F.col("hub"), F.lit(False))
    full, signature, least = form_texts()
    costs = [F.when((F.col("want") <= 0) & ~hub, F.length(full)), F.when(F.col("want") <= 1, F.length(signature)), F.length(least)]
    first = F.when(F.col("index") < 2, 0).otherwise(F.col("want"))
    return rows.select("id", first.alias("first"), "score", *(c.cast("long").alias(f"c{i}") for i, c in enumerate(costs)))


def _costs(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([pdf[c].fillna(-1).astype(np.int64).where(pdf[c].notna(), _NONE).to_numpy() for c in ("c0", "c1", "c2")], axis=1)


def _after(costs: np.ndarray, budget: int) -> np.ndarray:
    """For every budget up to ``budget`` what is left after all rows."""
    left, back = np.arange(budget + 1, dtype=np.int64), np.arange(budget + 1)
    least = np.minimum.accumulate(costs.min(1)[::-1])[::-1]
    for i, row in enumerate(costs):
        if least[i] > left.max():
            break
        taken = np.where(left >= row[0], row[0], np.where(left >= row[1], row[1], np.where(left >= row[2], row[2], 0)))
        if taken.any():
            left, at = np.unique(left - taken, return_inverse=True)
            back = at[back]
    return left[back]


def _settle(costs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The form that each row gets, 3 for none, and its cost; only rows that take something are visited."""
    form, cost = np.full(len(costs), 3, np.int32), np.zeros(len(costs), np.int64)
    cheap, i = costs.min(1), 0
    while i < len(costs):
        ahead = np.flatnonzero(cheap[i:] <= budget)
        if not len(ahead):
            break
        i += int(ahead[0])
        form[i] = int(np.flatnonzero(costs[i] <= budget)[0])
        cost[i] = costs[i, form[i]]
        budget -= int(cost[i])
        i += 1
    return form, cost


def render_budget(costs: DataFrame, budget: int) -> DataFrame:
    """``(id, fidelity, cost)`` for each row of ``costs(id, first, score, c0, c1, c2)``: full, signature, minimal or omitted.

    Rows are considered by ``first``, falling score and id; each gets the first form
    that the budget left by those before it allows.  Rows alike in all of these are
    in one partition or in neighbouring ones, and interchangeable.
    """
    spark = costs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("first"), F.desc("score"), F.col("id")]
    rows = save(costs.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "costs")

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "score", "id"], ascending=[True, False, True], kind="stable")
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "left": [_after(_costs(pdf), budget)]})

    parts = rows.groupBy("part").applyInPandas(table, "part int, left array<long>")
    left, before = budget, {}
    for r in save(parts, "tables").orderBy("part").toLocalIterator():  # a table of a fixed size at a time
        before[r.part] = left
        left = r.left[left]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "score", "id"], ascending=[True, False, True], kind="stable")
        form, cost = _settle(_costs(pdf), before[int(pdf["part"].iloc[0])])
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "fidelity": np.array([*FORMS, "omitted"], object)[form], "cost": cost})

    return rows.groupBy("part").applyInPandas(settle, f"id {costs.schema['id'].dataType.simpleString()}, fidelity string, cost long")


def _cut(text: Column, most: int) -> Column:
    """The text up to ``most`` bytes, no character split, and if it is longer then up to its last line break there."""
    raw = text.cast("binary")
    def goes_on(i: int) -> Column:
        return F.hex(F.substring(raw, F.lit(i), F.lit(1))).rlike("^[89AB]")

    # A character has at most three bytes that go on; the cut moves back to where it begins.
    back = F.when(~goes_on(most + 1), 0).when(~goes_on(most), 1).when(~goes_on(most - 1), 2).otherwise(3)
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(most) - back), "utf-8")
    line = F.regexp_extract(cut, r"(?s)^(.*)\n", 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.when(F.contains(cut, F.lit("\n")), line).otherwise(cut))


def truncate_tokens(text: Column, cap: int) -> Column:
    """The text if it has at most ``cap`` tokens, else its first 4 ``cap`` bytes to a line break if those do, else its first 2 ``cap``.

    The last step bounds bytes, not tokens.  Null stays null; a cap of 0 gives empty text.
    """
    if cap <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    first = _cut(text, 4 * cap)
    return F.when((F.octet_length(text) <= 4 * cap) & (F.length(text) <= cap), text).when(F.length(first) <= cap, first).otherwise(_cut(text, 2 * cap))

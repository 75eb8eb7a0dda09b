"""Mixing of sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash and queued; a source whose target
exceeds its size is queued again, for up to ``max_epochs`` rounds.  A queue entry
is a packet of at most a quantum of words, so a long document is several.  Its
virtual finish time is the cumulative words of its source up to its end, divided
by the source's target.  All packets are range-sorted by finish time and taken
until their running total reaches the budget; the packet that crosses it is taken
in part, all later ones are left.

The quantum is the budget divided by ``PRECISION`` packets for each source on
average, so it grows with the corpus.  What finishes by virtual time 1 fits the
budget, as that is the sum of the targets; so a source gets its target but for
less than a packet, or a few words of packets beyond it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_total, written

MAX_EPOCHS = 3
PRECISION = 1000
_ROW, _TEXT = "__mesh_row", "__mesh_text"


def cycling_weights(rank: Column) -> Column:
    """1, 2, 3, repeating, for the first, second, ... source."""
    return ((rank - 1) % 3 + 1).cast("double")


def targets(
    sizes: DataFrame, weights: Callable[[Column], Column], budget: int | None = None, max_epochs: int = MAX_EPOCHS
) -> tuple[DataFrame, int, int]:
    """``(source, source_size, target)`` for ``sizes(source, source_size)``, the budget, and a quantum of words.

    Sources are ranked by code point, null last.  The target is
    ``min(max_epochs * size, level * weight)`` with the level at which the
    targets add up to the budget (all sizes, if none is given): what a full
    source cannot take is shared again by weight.
    """
    sizes = sizes.withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = running_total(sizes, [F.col("_null"), F.col("source")], F.lit(1), "_rank")
    ranked = ranked.withColumn("_w", weights(F.col("_rank"))).withColumn("_cap", F.col("source_size") * float(max_epochs))
    ranked = written(ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")), "sources")
    sums = ranked.agg(F.sum("source_size"), F.sum("_cap"), F.max("_ratio"), F.sum("_w"), F.count("*")).first()
    total, high, weight = min(sums[0] if budget is None else budget, int(sums[1] or 0)) if sums[4] else 0, sums[2] or 0.0, sums[3] or 1.0
    # The level rises through the ratios at which sources fill up; the sums are whole numbers, so exact.
    level = total / weight
    while True:
        got = ranked.where(F.col("_ratio") <= level).agg(F.sum("_cap"), F.sum("_w")).first()
        full, open_ = got[0] or 0.0, weight - (got[1] or 0.0)
        new = (total - full) / open_ if open_ > 0 else high
        if new <= level:
            break
        level = new
    target = F.when(F.col("_ratio") <= level, F.col("_cap")).otherwise(F.lit(level) * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target")), total, max(1, total // (PRECISION * max(1, sums[4])))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, weights: Callable[[Column], Column] = cycling_weights, seed: int = 7, max_epochs: int = MAX_EPOCHS, budget: int | None = None
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row for each row of ``docs(doc_id, text, source)``.

    ``taken`` are the words that the mix takes of the document, repeats counted:
    at most ``max_epochs`` times its size.  Null or empty text has size 0 and
    nothing is taken; the null source is a source.  Ties of the shuffle are
    broken by doc_id, size and a hash of the text; rows that tie in these as well
    are alike in all that is returned, so reruns agree.  Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias(_TEXT)).withColumn(_ROW, F.monotonically_increasing_id())
    return _mix(written(rows, "sizes"), weights, seed, max_epochs, budget).drop(_ROW)


def mixed(
    docs: DataFrame, weights: Callable[[Column], Column] = cycling_weights, seed: int = 7, max_epochs: int = MAX_EPOCHS, budget: int | None = None
) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, all columns, with ``size, source_size, target, taken`` (replaced if there).

    Rows of one id and size are told apart by their text, so the same texts stay in
    any number of partitions; of equal rows any stays.
    """
    made = ("size", "source_size", "target", "taken")
    base = written(docs.drop(*made).withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    rows = written(base.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias(_TEXT), _ROW), "sizes")
    taken = _mix(rows, weights, seed, max_epochs, budget).where("taken > 0").select(_ROW, *made)
    return base.join(taken.hint("shuffle_merge"), _ROW).drop(_ROW)


def _mix(rows: DataFrame, weights: Callable[[Column], Column], seed: int, max_epochs: int, budget: int | None) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal, budget, quantum = targets(sizes, weights, budget, max_epochs)
    goal = written(goal, "targets").withColumnRenamed("source", "_s")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    order = [F.col("source"), F.col("_key"), F.col("doc_id"), F.col("size"), F.col(_TEXT), F.col(_ROW)]
    queued = running_total(rows.withColumn("_key", key), order, F.col("size"), "_end", reset="source")
    queued = queued.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    queued = written(queued, "queue")
    # No packet that begins later than this is reached: what all sources may lack at time 1 is a packet each.
    left = goal.where(F.col("target") < F.col("source_size") * float(max_epochs)).agg(F.count("*"), F.sum("target")).first()
    reach = 1 + (left[0] + 1) * quantum / left[1] if left[1] else 1.0
    entries = queued.where("size > 0 and target > 0").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    entries = entries.withColumn("_from", F.col("_end") - F.col("size") + F.col("_round") * F.col("source_size"))
    entries = entries.where(F.col("_from") < F.col("target") * reach)
    packets = entries.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(quantum).cast("long"))))
    packets = packets.withColumn("_words", F.least(F.lit(quantum).cast("long"), F.col("size") - F.col("_part")))
    packets = packets.withColumn("_finish", (F.col("_from") + F.col("_part") + F.col("_words")) / F.col("target"))
    order = [F.col(n) for n in ("_finish", "_key", "doc_id", "size", _TEXT, _ROW, "_round", "_part")]
    queue = running_total(packets.select(_ROW, _TEXT, "_words", "_finish", "_key", "doc_id", "size", "_round", "_part"), order, F.col("_words"), "_total")
    words = F.least(F.col("_words"), F.greatest(F.lit(0), F.lit(budget) - F.col("_total") + F.col("_words")))
    taken = queue.select(_ROW, words.alias("taken")).where("taken > 0").groupBy(_ROW).agg(F.sum("taken").alias("taken"))
    found = queued.join(taken, _ROW, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", _ROW)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':7')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
f AS (SELECT *, cap / w AS ratio, sum(cap) OVER (ORDER BY cap / w) AS used, sum(w) OVER (ORDER BY cap / w) AS gone FROM r),
b AS (SELECT CAST(sum(source_size) AS BIGINT) AS budget, CAST(sum(w) AS DOUBLE) AS weight, greatest(1, CAST(sum(source_size) AS BIGINT) // (1000 * count(*))) AS quantum FROM r),
l AS (SELECT greatest(max(budget / weight), max(CASE WHEN gone < weight THEN (budget - used) / (weight - gone) END)) AS level FROM f, b),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE level * w END AS target FROM f, l),
q AS (
  SELECT d.doc_id, d.size, d.k, t.source_size, t.target, row_number() OVER () AS id,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS began
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT q.*, round, part, least(quantum, size - part) AS words, (began + round * source_size + part + least(quantum, size - part)) / target AS finish
  FROM q, b, (SELECT unnest([0, 1, 2]) AS round), LATERAL (SELECT unnest(range(0, size, quantum)) AS part) WHERE size > 0 AND target > 0),
g AS (SELECT id, words, CAST(sum(words) OVER (ORDER BY finish, k, doc_id, size, id, round, part ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM p),
m AS (SELECT id, CAST(sum(least(words, greatest(0, budget - upto + words))) AS BIGINT) AS taken FROM g, b GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN m USING (id)
"""

"""Reproducible sampling of what to label next: the generator's n-th number for the n-th row, on whatever machine that is.

The generator is a linear congruential one, so its state after any number of steps
is one multiplication and one addition, found by squaring.  A row's number is thus
made from its dense index alone, in parallel, and equals that of a sequential run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .export import dense_index
from .harvest import goals_met, labelable

U64 = np.uint64
#: Factor and step of the generator, and what mixes the number of labelled nodes into its first state (fixed values).
FACTOR, STEP, SEED_FACTOR = 6364136223846793005, 1, 0x9E3779B97F4A7C15


def first_state(n_labelled: int, query: str) -> int:
    """The state before the first draw of a batch."""
    return (n_labelled * SEED_FACTOR + len(query.encode()) + 1) % 2**64


def draws_at(state: int, index: np.ndarray) -> np.ndarray:
    """The draws (31 bits) number ``index`` (from 0) of the sequential generator that starts at ``state``."""
    steps = index.astype(U64) + U64(1)
    factor, plus = np.ones(len(steps), U64), np.zeros(len(steps), U64)
    a, c = U64(FACTOR), U64(STEP)
    with np.errstate(over="ignore"):
        while steps.any():
            odd = (steps & U64(1)).astype(bool)
            factor[odd], plus[odd] = factor[odd] * a, plus[odd] * a + c
            a, c = a * a, c * (a + U64(1))
            steps >>= U64(1)
        return ((U64(state) * factor + plus) >> U64(33)).astype(np.int64)


def with_draws(indexed: DataFrame, state: int, per_row: int = 1) -> DataFrame:
    """``indexed(id, idx)`` with ``draw0``, ``draw1``, ...: row i has the draws ``i * per_row`` and on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.column(1).to_numpy() * per_row
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(draws_at(state, at + j)) for j in range(per_row))], ["id", "idx", *(f"draw{j}" for j in range(per_row))])

    kind = indexed.schema["id"].dataType.simpleString()
    return indexed.select("id", F.col("idx").cast("long").alias("idx")).mapInArrow(run, f"id {kind}, idx long, " + ", ".join(f"draw{j} long" for j in range(per_row)))


def weighted_sample(weights: DataFrame, state: int, n: int) -> DataFrame:
    """``(id, place)``: ``n`` of ``weights(id, weight)`` without replacement, in the order drawn; a sampling operator, so ``n`` is its feature.

    Each id waits an exponential time with its weight as rate, and the first ``n``
    are taken: as if they were drawn one by one, each in proportion to its weight
    among those left.  Weights of 0 or less and null ones are never drawn.
    """
    drawn = with_draws(dense_index(weights), state).join(weights.where("weight > 0"), "id")
    wait = -F.log((F.col("draw0") + 0.5) / float(1 << 31)) / F.col("weight")
    first = drawn.select("id", wait.alias("wait")).orderBy("wait", "id").limit(n)
    return first.select("id", F.row_number().over(Window.orderBy("wait", "id")).alias("place"))  # n rows


def walk_places(state: int, n: int, size: int) -> list[int]:
    """Places of ``n`` draws from ``size`` rows of which each taken one is replaced by the last; two numbers of the generator for each draw.

    Only the rows that moved are held, so this is as large as the batch.
    """
    moved: dict[int, int] = {}
    out = []
    for k in range(min(n, size)):
        at = int(draws_at(state, np.array([2 * k + 1]))[0]) % (size - k)
        out.append(moved.get(at, at))
        last = size - k - 1
        moved[at] = moved.pop(last, last)
    return out


def walk_sample(eligible: DataFrame, state: int, n: int) -> DataFrame:
    """``(id, place)``: ``n`` of ``eligible(id)`` by the random walk, in the order drawn; the ids stay distributed."""
    indexed = dense_index(eligible)
    size = indexed.count()
    places = [(p, i + 1) for i, p in enumerate(walk_places(state, n, size))]
    at = eligible.sparkSession.createDataFrame(places, "idx long, place int")
    return indexed.join(F.broadcast(at), "idx").select("id", "place")  # n rows


def card_batch(
    nodes: DataFrame, labelled: DataFrame, query: str, n: int, degrees: DataFrame | None = None, least: int = 40
) -> DataFrame | None:
    """``(id, place, name, file)`` of the next batch, or nothing if ``labelled(id, pole)`` meets the goals.

    Nodes that can be labelled and are not yet are drawn by the random walk, or with
    ``degrees(id, degree)`` in proportion to one more than their degree.  The same
    labels and query give the same batch.
    """
    poles = dict(labelled.groupBy("pole").count().where("pole in ('critical', 'rejected')").collect())  # two rows
    n_labelled = labelled.count()
    if goals_met(n_labelled, poles.get("critical", 0), poles.get("rejected", 0), least):
        return None
    left = labelable(nodes).join(labelled.select("id"), "id", "left_anti").select("id", "name", "file")
    state = first_state(n_labelled, query)
    if degrees is None:
        taken = walk_sample(left.select("id"), state, n)
    else:
        weight = (F.coalesce("degree", F.lit(0)) + 1).alias("weight")
        taken = weighted_sample(left.select("id").join(degrees, "id", "left").select("id", weight), state, n)
    return left.join(F.broadcast(taken), "id").select("id", "place", "name", "file")

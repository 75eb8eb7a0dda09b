"""Draws by index against the sequential generator; samples against drawing one by one."""

import collections

import numpy as np

from meshlight.plans import sampling as M


def _sequence(state, n):
    out = []
    for _ in range(n):
        state = (state * M.FACTOR + M.STEP) % 2**64
        out.append(state >> 33)
    return out


def test_any_draw_is_that_of_the_sequential_generator(spark):
    want = _sequence(12345, 3000)
    assert M.draws_at(12345, np.arange(3000)).tolist() == want
    assert M.draws_at(7, np.array([0, 2**40, 5])).tolist()[::2] == [_sequence(7, 6)[0], _sequence(7, 6)[5]]
    rows = spark.range(1000).selectExpr("concat('n', lpad(id, 4, '0')) id", "id idx").repartition(5)
    got = {r.idx: (r.draw0, r.draw1, r.draw2) for r in M.with_draws(rows, 12345, 3).collect()}
    assert got == {i: tuple(want[3 * i : 3 * i + 3]) for i in range(1000)}


def test_the_walk_equals_taking_from_a_list(spark):
    for size, n in ((1, 3), (9, 9), (50, 20), (300, 300)):
        draws, ids, out = _sequence(99, 2 * n), list(range(size)), []
        for k in range(min(n, size)):
            at = draws[2 * k + 1] % len(ids)
            out.append(ids[at])
            ids[at] = ids[-1]
            ids.pop()
        assert M.walk_places(99, n, size) == out
    table = spark.range(300).selectExpr("concat('n', lpad(id, 4, '0')) id")
    for parts in (1, 7):
        got = {r.place: r.id for r in M.walk_sample(table.repartition(parts), 99, 20).collect()}
        assert got == {i + 1: f"n{p:04}" for i, p in enumerate(M.walk_places(99, 20, 300))}
    assert M.walk_sample(table.limit(0), 1, 5).isEmpty()


def test_heavier_rows_come_first_as_often_as_they_weigh(spark):
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 5.0), ("zero", 0.0), ("none", None)], "id string, weight double")
    first = collections.Counter()
    x = M.draws_at(1, np.arange(8000)).reshape(2000, 4)  # what the rows get, without a job for each
    wait = -np.log((x[:, :3] + 0.5) / 2**31) / np.array([1.0, 2.0, 5.0])
    first.update(wait.argmin(1).tolist())
    assert abs(first[2] / 2000 - 5 / 8) < 0.04 and abs(first[0] / 2000 - 1 / 8) < 0.03
    got = [r.id for r in M.weighted_sample(table, 5, 9).orderBy("place").collect()]
    assert sorted(got) == ["a", "b", "c"]


def test_a_batch_leaves_out_what_is_labelled_and_ends_at_the_goals(spark):
    nodes = spark.createDataFrame([(f"n{i}", "f", "a.rs", "function_item" if i % 3 else "call_expression") for i in range(30)], "id string, name string, file string, kind string")
    done = spark.createDataFrame([("n1", "critical"), ("n2", "rejected")], "id string, pole string")
    got = [r.id for r in M.card_batch(nodes, done, "q", 50).collect()]
    assert sorted(got) == sorted(f"n{i}" for i in range(30) if i % 3 and i not in (1, 2))
    again = {r.id: r.place for r in M.card_batch(nodes.repartition(5), done, "q", 5).collect()}
    assert again == {r.id: r.place for r in M.card_batch(nodes, done, "q", 5).collect()} and len(again) == 5
    assert M.card_batch(nodes, done, "q", 5, least=2) is None

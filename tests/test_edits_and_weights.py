"""Edit regions of pairs against the rule character by character; weights from a file."""

import random
import struct

import numpy as np
import pytest

from meshlight.operators import edits
from meshlight.plans import neural


def _region(old, new):
    k = 0
    while k < min(len(old), len(new)) and old[k] == new[k]:
        k += 1
    j = 0
    while j < min(len(old), len(new)) - k and old[-1 - j] == new[-1 - j]:
        j += 1
    a, b, c = old[:k], old[: len(old) - j], new[: len(new) - j]
    points = [x for t in (a, b, c) for x in (t.count("\n"), len(t) - t.rfind("\n") - 1)]
    return (*(len(t.encode()) for t in (a, b, c)), *points)


def test_regions_never_split_a_character(spark):
    r = random.Random(6)
    letters = "ab\né©漢😀😁ã"
    rows = [("", ""), ("", "é"), ("é", ""), ("é", "©"), ("aéb", "aãb"), ("😀", "😁"), ("abcXdef", "abcYYdef"), ("same", "same"), ("aaa", "aa"), ("x" * 9000 + "é", "x" * 9000 + "è")]
    for _ in range(400):
        t = [r.choice(letters) for _ in range(r.randrange(12))]
        a = r.randrange(len(t) + 1)
        rows.append(("".join(t), "".join(t[:a] + [r.choice(letters) for _ in range(r.randrange(3))] + t[a + r.randrange(3) :])))
    table = spark.createDataFrame([(i, o, w, "k") for i, (o, w) in enumerate(rows)] + [(-1, None, "n", None)], "i int, old string, new string, `a b` string")
    got = {x.i: tuple(x)[2:] for x in edits.edit_regions(table).collect()}
    assert got == {i: _region(o, w) for i, (o, w) in enumerate(rows)} | {-1: _region("", "n")}
    assert edits.edit_regions(table.limit(0)).isEmpty()


@pytest.fixture(scope="module")
def features(spark):
    r = np.random.default_rng(3)
    return spark.createDataFrame([(i, r.normal(size=40).tolist()) for i in range(30)], "id long, x array<double>"), spark.createDataFrame([(i % 30, (i * 7) % 30) for i in range(60)], "src long, dst long")


def _forward(features, edges, w1, w2):
    x = {r.id: np.array(r.x[: len(w1)]) for r in features.collect()}
    near = {i: [x[i]] for i in x}
    for e in edges.collect():
        if e.src in x and e.dst in x:
            near[e.dst].append(x[e.src])
            near[e.src].append(x[e.dst])
    return {i: float(np.tanh(np.mean(v, 0) @ np.array(w1)) @ np.array(w2)) for i, v in near.items()}


def test_weights_from_a_file_and_without_one(spark, tmp_path, features):
    x, edges = features
    flat = np.random.default_rng(1).normal(size=neural.LAYER_2[1] + 50).astype("<f4")
    (tmp_path / "w.bin").write_bytes(flat.tobytes())
    (tmp_path / "short.bin").write_bytes(struct.pack("<3f", 1, 2, 3))
    (tmp_path / "empty.bin").write_bytes(b"")
    here = f"file://{tmp_path}"
    w1, w2 = neural.gnn_weights(spark, [f"{here}/none.bin", f"{here}/short.bin", f"{here}/empty.bin", f"{here}/w.bin"])
    assert np.array(w1).shape == (32, 32) and w1[1][0] == float(flat[32]) and w2[-1] == float(flat[1055])
    assert neural.gnn_weights(spark, [f"{here}/none.bin", f"{here}/short.bin"]) == (neural.W1, neural.W2)
    for weights in ((neural.W1, neural.W2), (w1, w2)):
        got = {r.id: r.score for r in neural.gnn_forward(x, edges, *weights).collect()}
        want = _forward(x, edges, *weights)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    texts = spark.createDataFrame([(1, 2.0), (99, 1.0)], "id long, text_score double")
    by = {r.id: r.score for r in neural.neural_apply(x, edges, texts, weights=(w1, w2)).collect()}
    assert abs(by[1] - (1.8 + 0.1 * _forward(x, edges, w1, w2)[1])) < 1e-9 and by[99] == 0.9
    assert neural.gnn_forward(x.limit(0), edges).isEmpty()


def test_the_plan_holds_no_thousand_products(features):
    plan = neural.gnn_forward(*features)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" * ") < 200 and "MapInArrow" in plan

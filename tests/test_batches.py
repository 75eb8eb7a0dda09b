"""Settled batches from a stream in several orders against a sequential simulation; node tables merged on read."""

import datetime
import glob
import random

import pytest
from pyspark.sql import functions as F

from meshlight.streaming import batches as B

DAY = 86_400_000
START = datetime.datetime(2024, 1, 1)


def _changes(seed, n=260):
    r = random.Random(seed)
    out, at = [], 0
    for i in range(n):
        at += r.choice([5, 10, 10, 20, 20, 40, 60, 80, 100, 150, 240, 250, 300, 700, 3000])
        out.append((f"k{r.randrange(3)}", at, f"src/f{r.randrange(20):02}.rs"))
    return out


def _simulated(changes, settle, cooldown, size):
    """One clock per key, one millisecond at a time."""
    out = []
    for key in sorted({c[0] for c in changes}):
        mine = sorted((ms, p) for k, ms, p in changes if k == key)
        phase, ends, waiting, place, i = "idle", 0, set(), 0, 0
        for ms in range(mine[0][0], mine[-1][0] + 20 * (settle + cooldown)):
            if phase == "settling" and ms == ends:
                gone = sorted(waiting)[:size]
                waiting -= set(gone)
                out.append((key, ms, place, tuple(gone), len(waiting)))
                place, phase, ends = place + 1, "cooling", ms + cooldown
            if phase == "cooling" and ms == ends:
                phase, ends = ("settling", ms + settle) if waiting else ("idle", 0)
            while i < len(mine) and mine[i][0] == ms:
                waiting.add(mine[i][1])
                phase = "settling" if phase == "idle" else phase
                ends = ms + (settle if phase == "settling" else cooldown)
                i += 1
        assert not waiting
    return sorted(out)


@pytest.mark.parametrize("order", ["sorted", "blocks", "shuffled"])
def test_batches_in_any_order_of_arrival(spark, tmp_path, order):
    changes = _changes(7)
    r = random.Random(1)
    rows = [*changes]
    if order == "blocks":  # neighbouring blocks of twenty change places
        rows = [x for i in range(0, len(rows), 40) for x in rows[i + 20 : i + 40] + rows[i : i + 20]]
    if order == "shuffled":
        rows.sort(key=lambda c: c[1] + r.randrange(-9000, 9000))
    late = {"sorted": "1 second", "blocks": "60 seconds", "shuffled": "20 seconds"}[order]
    files = [rows[i : i + 45] for i in range(0, len(rows), 45)] + [[("end", 10 * DAY, "z")], [(None, 10 * DAY, "z"), ("end", 10 * DAY, None)]]
    for i, part in enumerate(files):
        table = [(k, START + datetime.timedelta(milliseconds=ms), p) for k, ms, p in part]
        spark.createDataFrame(table, "key string, ts timestamp, path string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for f in glob.glob(f"{tmp_path}/in/*.parquet"):
            if "/part-" in f:
                import os

                os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
                os.rename(f, f"{tmp_path}/in/f{i:03}.parquet")
    stream = spark.readStream.schema("key string, ts timestamp, path string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = B.run_to_end(B.settled_batches(stream, late), f"file://{tmp_path}/run").collect()
    base = int(START.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    found = sorted((x.key, x.fired_ms - base, x.place, tuple(x.paths), x.waiting) for x in got if x.key != "end")
    want = _simulated(changes, B.SETTLE_MS, B.COOLDOWN_MS, B.BATCH)
    assert found == want and max(len(x[3]) for x in want) == 8 and any(x[4] for x in want)


SCHEMA = "id string, file string, name string, kind string, seq long, size long"


def test_an_upsert_writes_its_own_rows_alone(spark, tmp_path):
    def table(*rows):
        return spark.createDataFrame(rows, f"{SCHEMA}, gone boolean")

    nodes = B.MergedNodes(spark, f"file://{tmp_path}/n", SCHEMA, buckets=4)
    assert nodes.read().isEmpty()
    nodes.upsert(table(*[(f"i{i}", f"f{i % 9}", f"n{i}", "fn", i, i, False) for i in range(50)]), 0)
    before = set(glob.glob(f"{tmp_path}/n/*/bucket=*/*.parquet"))
    times = {f: open(f, "rb").read() for f in before}
    nodes.upsert(table(("new", "f1", "n1", "fn", 99, 700, None)), 1)
    added = set(glob.glob(f"{tmp_path}/n/*/bucket=*/*.parquet")) - before
    assert len(added) == 1 and {f: open(f, "rb").read() for f in before} == times
    row = nodes.read("f1").where("name = 'n1'").collect()
    assert [(r.id, r.size) for r in row] == [("i1", 700)] and nodes.read().count() == 50
    nodes.upsert(table(("again", "f1", "n1", "fn", 100, 800, False)), 1)  # the batch comes again
    assert nodes.read("f1").where("size = 800").isEmpty()
    nodes.upsert(table(("x", "f1", "n1", "fn", 101, 0, True), ("y", "f2", "n2", "fn", 101, 0, True)), 2)
    nodes.upsert(table(("z", "f2", "n2", "fn", 102, 5, False), ("z", "f2", "n2", "fn", 103, 6, False)), 3)
    def all_of():
        return {(r.file, r.name): (r.id, r.size) for r in nodes.read().collect()}

    now = all_of()
    assert ("f1", "n1") not in now and now["f2", "n2"] == ("z", 6) and len(now) == 49
    nodes.compact()
    assert all_of() == now and nodes._now()["deltas"] == []
    nodes.upsert(table(("late", "f3", "n3", "fn", 1, 9, False)), 4)
    assert all_of()["f3", "n3"] == ("i3", 9)
    plan = nodes.read("f3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and F is not None

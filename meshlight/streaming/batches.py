"""The change feed in settled batches: a stateful operator with event-time timers, and node tables merged on read.

A key (a workspace) collects the paths that change.  Once no change has come for the
settle time, a batch of at most so many paths goes out; what is left waits.  A
cooldown without changes follows, then, if paths wait, the next settle time.
Arrivals may be out of order within the delay of the watermark: a change is
acted upon when the watermark has passed it, so any order gives the same batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.storage import read_pointer, write_pointer

#: Milliseconds of quiet before a batch and after it, and paths of a batch (fixed values).
SETTLE_MS, COOLDOWN_MS, BATCH = 250, 400, 8
IDLE, SETTLING, COOLING = 0, 1, 2
OUT = "key string, fired_ms long, place int, paths array<string>, waiting int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settle:
    """The state of one key: a phase, when it ends, and the paths that wait.  ``place`` counts its batches."""

    def __init__(self, settle: int, cooldown: int, batch: int, phase: int = IDLE, ends: int = 0, place: int = 0):
        self.settle, self.cooldown, self.batch = settle, cooldown, batch
        self.phase, self.ends, self.place = phase, ends, place

    def until(self, ms: int, waiting: set[str]) -> Iterator[tuple[int, int, list[str], int]]:
        """Ends the phases that end by ``ms``; yields the batches that go out, in order of path."""
        while self.phase != IDLE and self.ends <= ms:
            at = self.ends
            if self.phase == SETTLING:
                gone = sorted(waiting)[: self.batch]
                waiting.difference_update(gone)
                self.phase, self.ends = COOLING, at + self.cooldown
                yield at, self.place, gone, len(waiting)
                self.place += 1
            elif waiting:
                self.phase, self.ends = SETTLING, at + self.settle
            else:
                self.phase = IDLE

    def change(self, ms: int, path: str, waiting: set[str]) -> None:
        """A change at ``ms``, after ``until(ms)``: whatever phase runs is prolonged."""
        waiting.add(path)
        if self.phase == IDLE:
            self.phase = SETTLING
        self.ends = ms + (self.cooldown if self.phase == COOLING else self.settle)


class _Processor(StatefulProcessor):
    """``Settle`` over state stores: early changes in a list, waiting paths in a map, the phase in a value."""

    def __init__(self, settle: int, cooldown: int, batch: int):
        self.times = settle, cooldown, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", "ms long, path string")
        self.waiting = handle.getMapState("waiting", "path string", "since long")
        self.now = handle.getValueState("now", "phase int, ends long, place int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.early.appendList(list(zip(pdf["ms"].astype(int).tolist(), pdf["path"].tolist(), strict=True)))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: Any, mark: int) -> Iterator[pd.DataFrame]:
        changes = sorted((int(r[0]), r[1]) for r in self.early.get())
        due = [c for c in changes if c[0] <= mark]
        state = Settle(*self.times, *(map(int, self.now.get()) if self.now.exists() else ()))
        before = {k[0] for k in self.waiting.keys()}
        paths, out = set(before), []
        for ms, path in due:
            out += state.until(ms, paths)
            state.change(ms, path, paths)
        out += state.until(mark, paths)
        if due:
            later = changes[len(due) :]
            self.early.put(later) if later else self.early.clear()
        else:
            later = changes
        for path in before - paths:
            self.waiting.removeKey((path,))
        for path in paths - before:
            self.waiting.updateValue((path,), (mark,))
        self.now.update((state.phase, state.ends, state.place))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        nexts = [c[0] for c in later[:1]] + ([state.ends] if state.phase != IDLE else [])
        if nexts:
            self.handle.registerTimer(max(min(nexts), mark + 1))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "fired_ms": [o[0] for o in out], "place": [o[1] for o in out], "paths": [o[2] for o in out], "waiting": [o[3] for o in out]})

    def close(self) -> None:
        pass


def settled_batches(changes: DataFrame, late: str, settle_ms: int = SETTLE_MS, cooldown_ms: int = COOLDOWN_MS, batch: int = BATCH) -> DataFrame:
    """``(key, fired_ms, place, paths, waiting)`` of a stream ``changes(key, ts, path)``: each key's batches as they fall due.

    A change that comes when a phase ends is after it; changes of one time are taken
    by path.  Null keys, times and paths are left out.  State of a key is its changes
    within ``late`` and its waiting paths.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = changes.where("key is not null and ts is not null and path is not null")
    rows = rows.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "path")
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Processor(settle_ms, cooldown_ms, batch), outputStructType=OUT, outputMode="Append", timeMode="eventtime"
    )


def run_to_end(batches: DataFrame, path: str) -> DataFrame:
    """Runs the stream over all that is there now; what came out, as a table under ``path``."""
    query = batches.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return batches.sparkSession.read.schema(batches.schema).parquet(f"{path}/out")


# ---------------------------------------------------------------- merge on read


class MergedNodes:
    """Nodes in buckets of their file: a base and deltas, merged when read.

    An upsert writes its own rows alone.  The last row of each (file, name, kind)
    by (version, seq) counts, under the id that its first row had; a row whose
    ``gone`` is true takes the node away, and what comes after is a new one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.names = StructType.fromDDL(schema).names
        self.stored = f"{schema}, gone boolean, version long, first string, bucket int"

    def _now(self) -> dict:
        return read_pointer(self.spark, f"{self.path}/current") or {"base": None, "deltas": [], "version": 0, "batch": -1}

    def _files(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        parts = [self.spark.read.schema(self.stored).parquet(f"{self.path}/{f}") for f in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def _write(self, rows: DataFrame, version: int, compact: bool) -> str:
        folder = f"{'base' if compact else 'delta'}-{version}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int")
        placed = rows.withColumn("bucket", bucket).repartition("bucket") if compact else rows.withColumn("bucket", bucket)
        placed.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def upsert(self, batch: DataFrame, batch_id: int = 0) -> None:
        """``foreachBatch`` target; a batch that comes again after a restart changes nothing."""
        now = self._now()
        if batch_id <= now["batch"]:
            return
        version = now["version"] + 1
        rows = batch if "gone" in batch.columns else batch.withColumn("gone", F.lit(False))
        rows = rows.select(*self.names, F.coalesce("gone", F.lit(False)).alias("gone"), F.lit(version).cast("long").alias("version"), F.lit(None).cast("string").alias("first"))
        folder = self._write(rows, version, False)
        write_pointer(self.spark, f"{self.path}/current", now | {"deltas": [*now["deltas"], folder], "version": version, "batch": batch_id})

    def read(self, file: str | None = None) -> DataFrame:
        """All nodes, or those of one file, of which only its bucket is read."""
        rows = self._merged(file)
        return rows.select(*self.names)

    def _merged(self, file: str | None = None) -> DataFrame:
        now = self._now()
        rows = self._files([*([now["base"]] if now["base"] else []), *now["deltas"]])
        if file is not None:
            bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(file)), F.lit(self.buckets)).cast("int")).first()[0]
            rows = rows.where((F.col("bucket") == bucket) & (F.col("file") == file))
        key = ["file", "name", "kind"]
        # A node begins after the last row that took it away.
        at = F.struct("version", "seq")
        ended = F.max(F.when(F.col("gone"), at)).alias("ended")
        live = F.struct(at.alias("at"), *[F.col(c) for c in self.names if c not in key])
        first = F.struct(at.alias("at"), F.coalesce("first", "id").alias("id"))
        # Two rows per key are enough: the last, and the first since the node was last taken away.
        ends = rows.groupBy(*key).agg(ended)
        kept = rows.join(ends.where("ended is not null"), key, "left") if "ended" not in rows.columns else rows
        kept = kept.where(F.col("ended").isNull() | (at > F.col("ended")))
        last = kept.groupBy(*key).agg(F.max(live).alias("l"), F.min(first).alias("f"), F.max("version").alias("version"))
        values = {c: F.col(f"l.{c}") for c in self.names if c not in key} | {"id": F.col("f.id")}
        return last.select(*key, *(v.alias(c) for c, v in values.items()), "version")

    def compact(self) -> None:
        """Writes the merged nodes as the new base; readers of the version before keep their files."""
        now = self._now()
        rows = self._merged().withColumn("first", F.col("id")).withColumn("gone", F.lit(False))
        version = now["version"] + 1
        folder = self._write(rows.select(*self.names, "gone", "version", "first"), version, True)
        write_pointer(self.spark, f"{self.path}/current", now | {"base": folder, "deltas": [], "version": version})

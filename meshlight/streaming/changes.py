"""The change feed as a stream: debounced sessions, upserts with stable ids, dirty cones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import overlay_file, reverse_dependents
from ..operators.storage import read_pointer, write_pointer

KINDS = ("create", "modify", "remove")


def absorb(changes: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Events of a known kind with a path."""
    return changes.where(F.col("kind").isin(*kinds) & F.col("path").isNotNull())


def settle(changes: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of changes without a pause longer than the gap.

    On a stream a session comes out once the watermark has passed its end, so
    state is bounded by the sessions that are still open.
    """
    timed = changes.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if changes.isStreaming else timed
    grouped = timed.groupBy(key, F.session_window("_ts", gap).alias("w"))
    return grouped.agg(F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"), F.count("*").alias("n_events")).drop("w")


def update_batch(nodes: DataFrame, edges: DataFrame, parsed: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with the ``changed(file)`` files replaced by ``parsed`` (ids stay where name and kind stay), edges without those that lost an end, and the files to resolve again."""
    files = changed.select("file").distinct()
    old = nodes.join(files, "file", "left_semi")
    fresh = overlay_file(old, parsed)
    now = nodes.join(files, "file", "left_anti").select(*nodes.columns).union(fresh.select(*nodes.columns))
    gone = old.select("id").join(fresh.select("id"), "id", "left_anti")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    cone = reverse_dependents(nodes, edges, files).union(files)
    return now, kept, cone


class NodeTable:
    """Nodes in versions under a folder; a version is complete before the pointer in the folder names it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        now = read_pointer(self.spark, f"{self.path}/current")
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{now['version']}")

    def upsert(self, batch: DataFrame, batch_id: int = 0) -> None:
        """``foreachBatch`` target: the last row of each (file, name, kind) wins and keeps the id it had.

        A batch that comes again after a restart changes nothing but the version.
        """
        last = batch.groupBy("file", "name", "kind").agg(F.max(F.struct("seq", *[c for c in self.schema.names if c not in ("file", "name", "kind", "seq")])).alias("r"))
        rows = last.select("file", "name", "kind", "r.*").select(*self.schema.names)
        now = self.read()
        kept = now.join(rows.select("file", "name", "kind"), ["file", "name", "kind"], "left_anti").select(*self.schema.names)
        version = f"v{batch_id}-{uuid.uuid4().hex}"
        kept.union(overlay_file(now, rows).select(*self.schema.names)).write.parquet(f"{self.path}/{version}")
        write_pointer(self.spark, f"{self.path}/current", {"version": version})


def watch(stream: DataFrame, table: NodeTable, checkpoint: str):
    """Runs the upsert over all that is available now; returns the finished query."""
    query = stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

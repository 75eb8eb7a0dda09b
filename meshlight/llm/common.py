"""Session helpers that every corpus operator shares."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.storage import forget, new_path
from ..operators.storage import save as written

__all__ = ["arrow_map", "forget", "key_words", "lean", "maybe_among", "new_path", "release", "running_total", "store_of", "table", "tune", "with_fields", "written"]

#: Rows handed to a Python worker at once; texts are long, so batches stay small.
ARROW_ROWS = 512


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, or of an absolute path without a scheme."""
    return fs.FileSystem.from_uri(uri)


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for rows that hold whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, **fields: DataType) -> StructType:
    """The schema of ``df`` and further columns after its own, whatever their names hold."""
    return StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in fields.items())])


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Gives memory that a task has freed back to the system; workers stay alive between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; what it has freed is released when the task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are skipped."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(lean(run), schema)


KEY_BITS = 1 << 23


def key_words(keys: DataFrame, h: Column) -> DataFrame:
    """``(__mesh_w, __mesh_bits)``: a filter of fixed size over the hashes ``h`` of ``keys``; ``KEY_BITS / 64`` rows at most."""
    b = F.pmod(h, F.lit(KEY_BITS))
    bit = F.expr("shiftleft(1L, cast(__mesh_b & 63 as int))")
    return keys.select(b.alias("__mesh_b")).groupBy(F.shiftright("__mesh_b", 6).alias("__mesh_w")).agg(F.bit_or(bit).alias("__mesh_bits"))


def maybe_among(df: DataFrame, words: DataFrame, h: Column) -> DataFrame:
    """Adds ``__mesh_maybe``: false only if ``h`` is none of the hashes that made ``words``.

    The filter is broadcast, which its size allows whatever made it; one that
    fills up marks more rows, and only costs time.
    """
    at = df.withColumn("__mesh_b", F.pmod(h, F.lit(KEY_BITS)))
    hit = at.join(F.broadcast(words), F.shiftright("__mesh_b", 6) == F.col("__mesh_w"), "left")
    found = F.expr("coalesce((shiftright(__mesh_bits, cast(__mesh_b & 63 as int)) & 1) = 1, false)")
    return hit.withColumn("__mesh_maybe", found).drop("__mesh_b", "__mesh_w", "__mesh_bits")


def running_total(df: DataFrame, order: list[Column], value: Column, name: str, reset: str | None = None) -> DataFrame:
    """Add ``name``: the inclusive running sum of ``value`` (long) in ``order``.

    With ``reset`` the sum restarts for each value of that column, which must be
    the leading sort key.  No group meets in one task: rows are range-partitioned
    on the whole order, summed inside each partition, and every partition then
    gets the total of the partitions before it.  What reaches a single task is
    one row per partition and group that begins or goes on there.
    """
    spark = df.sparkSession
    keys = [f"_k{i}" for i in range(len(order))]
    group = F.col(reset) if reset else F.lit(0)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns(dict(zip(keys, order, strict=True))).withColumn("_v", value.cast("long"))
    ranged = written(ranged.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_p", *([reset] if reset else [])).orderBy(*keys)
    sums = ranged.groupBy("_p", group.alias("_g")).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_p").alias("_q"), "_g", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    local = ranged.withColumn(name, F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = local.join(offsets, (F.col("_p") == F.col("_q")) & group.eqNullSafe(F.col("_g")), "left")
    return joined.withColumn(name, F.col(name) + F.coalesce(F.col("_o"), F.lit(0))).drop("_p", "_q", "_g", "_o", "_v", *keys)

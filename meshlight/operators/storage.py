"""Tables in shared storage: checkpoints of iterations, and the persisted graph."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION, EDGE_VERSION = 1, 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset and all of Spark runs in one process, as in tests, a
    temporary folder is set for the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meshlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a step to the shared folder and reads it back: the lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_path = path
    return back


def forget(*saved: DataFrame) -> None:
    """Deletes tables that ``save`` returned and that no result still to be computed reads."""
    for df in saved:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def save_graph(path: str, nodes: DataFrame, edges: DataFrame, bridges: DataFrame, files: DataFrame) -> None:
    """Persists the four tables as a new version; the graph before it stays whole until the manifest names the new one."""
    spark = nodes.sparkSession
    version = uuid.uuid4().hex
    for name, df in (("nodes", nodes), ("edges", edges), ("bridges", bridges), ("files", files)):
        df.write.parquet(f"{path}/{version}/{name}")
    write_pointer(spark, f"{path}/manifest", {"version": version, "schema_version": SCHEMA_VERSION, "edge_version": EDGE_VERSION})


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables; nothing if the schema changed, no edges or bridges if only their meaning did."""
    v = read_pointer(spark, f"{path}/manifest")
    if v is None or v["schema_version"] != SCHEMA_VERSION:
        return None
    out = {n: spark.read.parquet(f"{path}/{v['version']}/{n}") for n in ("nodes", "edges", "bridges", "files")}
    if v["edge_version"] != EDGE_VERSION:
        out |= {n: out[n].limit(0) for n in ("edges", "bridges")}
    return out


def write_pointer(spark: SparkSession, folder: str, values: dict) -> None:
    """Appends a pointer file; it is written under another name first, so a reader sees all of it or nothing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(conf)
    number = max([int(n) for n in _pointers(spark, folder)], default=0) + 1
    part = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    out = store.create(part, True)
    out.write(bytearray(json.dumps(values).encode()))
    out.close()
    if not store.rename(part, jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}")):
        raise RuntimeError(f"another writer has set pointer {number} of {folder}")


def _pointers(spark: SparkSession, folder: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return sorted(n for n in names if n.isdigit())


def read_pointer(spark: SparkSession, folder: str) -> dict | None:
    """The values of the last pointer, nothing if there is none."""
    names = _pointers(spark, folder)
    if not names:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(folder, names[-1])
    source = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
    finally:
        source.close()


def file_delta(now: DataFrame, saved: DataFrame) -> DataFrame:
    """``(path, change)`` of ``(path, hash)`` tables: added, changed, deleted or same."""
    a, b = now.select("path", F.col("hash").alias("h1")), saved.select("path", F.col("hash").alias("h2"))
    change = F.when(F.col("h2").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h1") != F.col("h2"), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def stat_fingerprint(files: DataFrame) -> DataFrame:
    """``(max_mtime, total_bytes, n_files)``."""
    return files.agg(F.max("mtime").alias("max_mtime"), F.sum("bytes").alias("total_bytes"), F.count("*").alias("n_files"))


def stat_match(a: DataFrame, b: DataFrame) -> bool:
    return a.first() == b.first()

"""Graph exports: dense indices, typed edges, JSON and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import save

CONTAINS, CALLS, IMPLEMENTS, REFERENCES = range(4)


def dense_index(nodes: DataFrame) -> DataFrame:
    """``(id, idx)`` with idx 0, 1, ... in the order of ids.

    Ids are range-partitioned and numbered inside each range; a range begins
    where the ones before it end.  Only a count per range meets in one task.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(nodes.select("id").repartitionByRange(n, "id").withColumn("p", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("id")))
    sizes = ranged.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("o", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select("p", "o"), "p").select("id", (F.col("o") + F.col("i") - 1).alias("idx"))


def export_edges(index: DataFrame, edges: DataFrame, contains: DataFrame | None = None) -> DataFrame:
    """``(from_idx, to_idx, type)``: calls, then containment between pairs that no call joins in either direction."""
    a = index.select(F.col("id").alias("src"), F.col("idx").alias("from_idx"))
    b = index.select(F.col("id").alias("dst"), F.col("idx").alias("to_idx"))
    calls = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").select("from_idx", "to_idx", F.lit(CALLS).alias("type"))
    if contains is None:
        return calls
    more = contains.select("src", "dst").distinct().join(a, "src").join(b, "dst").select("from_idx", "to_idx", F.lit(CONTAINS).alias("type"))
    pair = [F.least("from_idx", "to_idx").alias("x"), F.greatest("from_idx", "to_idx").alias("y")]
    taken = calls.select(*pair).distinct()
    return calls.union(more.select("*", *pair).join(taken, ["x", "y"], "left_anti").drop("x", "y"))


def export_write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines of nodes and edges under a folder."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def mermaid_packed(title: str, callers: list[str], callees: list[str], cap: int = 12) -> str:
    """Flowchart text of one seed, ``cap`` rows a side and a note of the rest."""

    def quoted(s: str) -> str:
        return '"' + s.replace('"', "'") + '"'

    lines = ["flowchart LR", f"  seed[{quoted(title)}]"]
    for side, rows in (("up", callers), ("down", callees)):
        for i, name in enumerate(rows[:cap]):
            lines.append(f"  {side}{i}[{quoted(name)}]")
            lines.append(f"  {side}{i} --> seed" if side == "up" else f"  seed --> {side}{i}")
        if len(rows) > cap:
            lines.append(f"  {side}_more[{quoted(f'and {len(rows) - cap} more')}]")
    return "\n".join(lines)


def skeleton_render(nodes: DataFrame, cap: int = 200) -> str:
    """Text tree of files and their symbols, at most ``cap`` lines (it is one page of text)."""
    rows = nodes.orderBy("file", "start_line", "id").select("file", "name", "kind").limit(cap).collect()
    out, last = [], None
    for r in rows:
        if r["file"] != last:
            out.append(r["file"])
            last = r["file"]
        out.append(f"  {r['kind']} {r['name']}")
    return "\n".join(out[:cap])


def search_md(rows: list[dict]) -> str:
    return "\n".join(f"- **{r['name']}** `{r['file']}` ({r['degree']})" for r in rows)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")

"""A persisted index of names and paths: places, terms, and n-gram posting lists.

Four tables in buckets, each sorted on its key and with a Parquet Bloom filter on it:

* ``places``: name -> file, line and id, in that order, as the rows stand in the graph;
* ``terms``: each different name or path once, with the best node of the name;
* ``grams``: n-gram of the lower-cased term -> sorted ids of the terms that hold it,
  in parts by ranges of ids, so that the list of a frequent n-gram is many rows;
* ``counts``: n-gram -> length of its list.

A text is looked up by its rarest n-gram: only the terms on that list are read and
compared.  Texts of one and two characters have n-grams of their own length, so there
is no text that must scan.  A name is read from its bucket alone.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .storage import read_pointer, save, write_pointer

BUCKETS = 64
#: Ids in a row of ``grams``, about.
PART_IDS = 1 << 15
_TABLES = {
    "places": "name string, file string, start_line long, id string, bucket int",
    "terms": "key long, kind string, term string, low string, n long, weight long, best string, useful boolean, bucket int",
    "grams": "kind string, gram string, part long, ids array<long>, bucket int",
    "counts": "kind string, gram string, listed long, bucket int",
}
#: Rank of what begins with the text, and of what holds it elsewhere (fixed values).
BEGINS, HOLDS = 23, 8


class NameIndex(NamedTuple):
    """Where a version of the index lies, and how many buckets it has."""

    spark: SparkSession
    path: str
    buckets: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """The different runs of each of ``sizes`` characters; a text shorter than all of them has none."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def of(n: int) -> Column:
        starts = F.when(F.size(letters) >= n, F.sequence(F.lit(1), F.size(letters) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(letters, i, F.lit(n)), ""))

    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def _write(df: DataFrame, path: str, key: list[str], bloom: str) -> None:
    """In folders by ``bucket``, in order of ``key``; a bucket with many rows of one key is still several files."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", *key]
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{bloom}", "true").parquet(path)


def _terms(nodes: DataFrame) -> DataFrame:
    """``(kind, term, n, weight, best, useful)``: names, and paths of files that hold a name which is no junk."""
    best = F.min(F.struct((-F.col("weight")).alias("less"), F.col("id").alias("id"))).alias("b")
    names = nodes.groupBy(F.lit("name").alias("kind"), F.col("name").alias("term")).agg(F.count("*").alias("n"), best)
    names = names.select("kind", "term", "n", (-F.col("b.less")).alias("weight"), F.col("b.id").alias("best"), (~T.junk_symbol_col(F.col("term"))).alias("useful"))
    paths = nodes.where(~T.junk_symbol_col(F.col("name")) & (F.coalesce(F.col("file"), F.lit("")) != ""))
    paths = paths.groupBy(F.lit("path").alias("kind"), F.col("file").alias("term")).agg(F.count("*").alias("n"))
    return names.union(paths.select("kind", "term", "n", F.lit(0).cast("long"), F.lit(None).cast("string"), F.lit(True)))


def build_name_index(nodes: DataFrame, path: str, buckets: int = BUCKETS) -> NameIndex:
    """Writes a version of the index of ``nodes(id, name, file, start_line, weight)`` and makes it the current one.

    Null and empty names are not indexed, nor is their row's file.  Readers of the
    version before keep it whole.  ``weight`` (long) is what ranks the nodes of a name.
    """
    spark = nodes.sparkSession
    index = NameIndex(spark, f"{path}/{uuid.uuid4().hex}", buckets)
    at = index.path
    named = nodes.where("name is not null and name <> ''").select("id", "name", "file", "start_line", F.col("weight").cast("long"))
    places = named.select(_bucket(F.col("name"), buckets).alias("bucket"), "name", "file", F.col("start_line").cast("long"), F.col("id").cast("string"))
    _write(places, f"{at}/places", ["name", "file", "start_line", "id"], "name")
    # Names and paths are told apart by the key, not by the table.
    key = F.xxhash64("kind", "term")
    made = _terms(named).select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"), "kind", "term", F.lower("term").alias("low"), "n", "weight", "best", "useful")
    _write(made, f"{at}/terms", ["key"], "key")
    terms = index.table("terms")
    n_terms = terms.count()
    bits = max(0, math.ceil(math.log2(max(1, n_terms / PART_IDS))))
    part = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    single = terms.select("kind", "key", part.alias("part"), F.explode(_grams(F.col("low"), (1, 2, 3))).alias("gram"))
    lists = single.groupBy("kind", "gram", "part").agg(F.sort_array(F.collect_list("key")).alias("ids"))
    lists = lists.withColumn("bucket", _bucket(F.concat("kind", "gram"), buckets))
    _write(lists, f"{at}/grams", ["kind", "gram", "part"], "gram")
    _write(index.table("grams").groupBy("bucket", "kind", "gram").agg(F.sum(F.size("ids")).alias("listed")), f"{at}/counts", ["kind", "gram"], "gram")
    stamp = named.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("id", "name", "file", "start_line", "weight").cast("decimal(38,0)")), F.lit(0))).first()
    write_pointer(spark, f"{path}/current", {"at": at, "buckets": buckets, "rows": stamp[0], "stamp": str(stamp[1])})
    return index


def open_name_index(spark: SparkSession, path: str) -> NameIndex | None:
    """The current version, nothing if none was written."""
    found = read_pointer(spark, f"{path}/current")
    return NameIndex(spark, found["at"], found["buckets"]) if found else None


def ensure_name_index(nodes: DataFrame, path: str, buckets: int = BUCKETS) -> NameIndex:
    """The current version if it was made of the same rows, else a new one."""
    found = read_pointer(nodes.sparkSession, f"{path}/current")
    if found:
        named = nodes.where("name is not null and name <> ''").withColumn("weight", F.col("weight").cast("long"))
        stamp = named.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("id", "name", "file", "start_line", "weight").cast("decimal(38,0)")), F.lit(0))).first()
        if (found["rows"], found["stamp"]) == (stamp[0], str(stamp[1])):
            return NameIndex(nodes.sparkSession, found["at"], found["buckets"])
    return build_name_index(nodes, path, buckets)


def places_of(index: NameIndex, name: str) -> DataFrame:
    """``(name, file, start_line, id)`` of one name, read from its bucket and row groups."""
    bucket = index.spark.range(1).select(_bucket(F.lit(name), index.buckets)).first()[0]
    return index.table("places").where((F.col("bucket") == bucket) & (F.col("name") == name)).drop("bucket").orderBy("file", "start_line", "id")


def _only(table: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The folders that ``wanted(bucket)`` needs; their numbers, at most ``buckets``, are known before the plan is made."""
    needed = sorted(r.bucket for r in wanted.select("bucket").distinct().limit(buckets).collect())
    return table.where(F.col("bucket").isin(needed)) if len(needed) < buckets else table


def holding(index: NameIndex, texts: DataFrame, kind: str = "name") -> DataFrame:
    """``(q, term, low, n, weight, best, useful)``: for each of ``texts(q)`` the terms that hold it in any case.

    Null and empty texts hold nowhere; repeated ones are looked up once.
    """
    asked = texts.where("q is not null and q <> ''").select("q").distinct()
    asked = asked.withColumn("ql", F.lower("q"))
    size = F.least(F.lit(3), F.length("ql"))
    grams = F.when(size == 3, _grams(F.col("ql"), (3,))).when(size == 2, _grams(F.col("ql"), (2,))).otherwise(_grams(F.col("ql"), (1,)))
    asked = save(asked.select("q", "ql", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.concat(F.lit(kind), F.col("gram")), index.buckets)), "asked")
    counts = _only(index.table("counts"), asked, index.buckets).where(F.col("kind") == kind).select("bucket", "gram", "listed")
    known = asked.join(counts, ["bucket", "gram"], "left")
    # A text with an n-gram that no term has is held by none.
    rarest = known.groupBy("q", "ql").agg(F.min(F.struct("listed", "gram", "bucket")).alias("g"), F.bool_and(F.col("listed").isNotNull()).alias("all"))
    rarest = save(rarest.where("all").select("q", "ql", "g.gram", "g.bucket"), "rarest")
    lists = _only(index.table("grams"), rarest, index.buckets).where(F.col("kind") == kind).select("bucket", "gram", "ids")
    found = rarest.join(lists, ["bucket", "gram"]).select("q", "ql", F.explode("ids").alias("key"))
    terms = index.table("terms").where(F.col("kind") == kind).drop("kind", "bucket")
    return found.join(terms, "key").where(F.contains("low", "ql")).drop("key", "ql")


def fuzzy_best(index: NameIndex, texts: DataFrame) -> DataFrame:
    """``(q, n_exact, n_folded, n_holding, best, best_id)`` for each different text of ``texts(q)``; white space at its ends is cut.

    The best name is the text itself, else the same in another case, else what
    holds it by ten times the rank plus its weight; of equals the first by code
    point.  Its best node has the largest weight, then the least id.  The counts are
    of nodes with that name, of names in any case, and of names that hold the text.
    """
    asked = texts.select(F.trim("q").alias("q")).where("q <> ''").distinct()
    found = holding(index, asked)
    same, folded = F.col("term") == F.col("q"), F.col("low") == F.lower("q")
    rank = F.when(F.startswith("low", F.lower("q")), BEGINS).otherwise(HOLDS) * 10 + F.col("weight")
    order = F.struct(F.when(same, 0).when(folded, 1).otherwise(2).alias("step"), F.when(same, F.lit(0)).when(folded, -F.col("weight")).otherwise(-rank).alias("less"), "term", "best")
    best = found.groupBy("q").agg(
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("n_exact"), F.sum(folded.cast("long")).alias("n_folded"), F.count("*").alias("n_holding"), F.min(order).alias("b")
    )
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(n, zero).alias(n) for n in ("n_exact", "n_folded", "n_holding")]
    return asked.join(best, "q", "left").select("q", *counts, F.col("b.term").alias("best"), F.col("b.best").alias("best_id"))


def exact_in_graph(index: NameIndex, texts: DataFrame) -> DataFrame:
    """``(q, exact)`` for each different text of ``texts(q)``: whether it is a name; null and empty ones are left out."""
    asked = texts.select(F.trim("q").alias("q")).where("q <> ''").distinct()
    asked = save(asked.withColumn("key", F.xxhash64(F.lit("name"), "q")).withColumn("bucket", F.pmod("key", F.lit(index.buckets)).cast("int")), "asked")
    terms = _only(index.table("terms"), asked, index.buckets).where("kind = 'name'").select("key", F.col("term").alias("q"), F.lit(True).alias("exact"))
    return asked.join(terms, ["key", "q"], "left").select("q", F.coalesce("exact", F.lit(False)).alias("exact"))


def token_in_graph(index: NameIndex, tokens: DataFrame) -> DataFrame:
    """``(q, hit)`` for each different token of ``tokens(q)`` of two bytes or more: whether it hits a name or a path.

    A name hits by its whole, by what the rules for strong and weak tokens allow;
    every rule asks that the name or path holds the token, so the index finds all.
    Junk names hit by their whole only.
    """
    asked = tokens.where("octet_length(lower(q)) >= 2").select("q").distinct()
    asked = save(asked, "tokens")
    strong = T.strong_token_col(F.col("q"))
    names = holding(index, asked).where((F.col("term") == F.trim("q")) | F.col("useful") & F.when(strong, T.name_hit(F.col("term"), F.col("q"), True)).otherwise(T.name_hit(F.col("term"), F.col("q"), False)))
    paths = holding(index, asked.where("octet_length(lower(q)) >= 3"), "path").where(F.when(strong, T.path_hit(F.col("term"), F.col("q"), True)).otherwise(T.path_hit(F.col("term"), F.col("q"), False)))
    hits = names.select("q").union(paths.select("q")).distinct().withColumn("hit", F.lit(True))
    return asked.join(hits, "q", "left").select("q", F.coalesce("hit", F.lit(False)).alias("hit"))

"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

Each region deals out a row's hash draws as a stream of arrivals whose rate is the
region's room.  An arrival goes down the tree: a weighted hash draw picks the rack,
another the place in the rack, and the shard that stands at the place takes it with
the shard's share of the place's room; an empty place takes nothing and the stream
goes on.  The region whose first taken arrival is the earliest gets the row.  That
time is exponential with the weight of the region's shards as its rate, so every
subtree gets rows in proportion to its weight.

Room is fixed and only weights change, so a weight that grows adds taken arrivals at
that one place: rows move into that shard and from nowhere else to anywhere else,
and a weight that shrinks only lets rows go.  No row looks at more than a few
arrivals of each region, however many racks and shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import lean, running_total, tune, with_fields
from .tokens import U64, mix

SHARDS, RACKS, PLACES = 24, 4, 4
_ARRIVAL, _TIME, _RACK, _PLACE, _TAKE = (U64(n << 40) for n in range(1, 6))


class Shard(NamedTuple):
    """Where a shard stands, and the part of its place's room that it fills: above 0, at most 1."""

    region: int
    rack: int
    place: int
    weight: float = 1.0


class Tree(NamedTuple):
    """Shards by number, and the room of every place of every rack, alike in all regions."""

    shards: tuple[Shard, ...]
    room: tuple[tuple[float, ...], ...] = ((1.0,) * PLACES,) * RACKS


def even_tree(shards: int) -> Tree:
    """``shards`` of equal weight: a region is filled rack by rack in turn before the next one is opened."""
    size = RACKS * PLACES
    return Tree(tuple(Shard(i // size, i % RACKS, i % size // RACKS) for i in range(shards)))


def _unit(key: np.ndarray, lane: np.uint64) -> np.ndarray:
    """A draw above 0 and below 1 for each key."""
    return ((mix(key ^ lane) >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _pick(key: np.ndarray, lane: np.uint64, weights: np.ndarray) -> np.ndarray:
    """The child with the least exponential draw of its weight, for each key; ``weights`` has a row for each key or one for all."""
    draws = np.stack([-np.log(_unit(key, lane + U64(i))) for i in range(weights.shape[-1])], axis=1)
    with np.errstate(divide="ignore"):
        return (draws / weights).argmin(1)


def place(keys: np.ndarray, tree: Tree) -> np.ndarray:
    """The shard of each 64-bit key."""
    width = max(map(len, tree.room))
    room = np.array([[*r, *[0.0] * (width - len(r))] for r in tree.room])
    best, shard = np.full(len(keys), np.inf), np.full(len(keys), -1, np.int32)
    for region in sorted({s.region for s in tree.shards}):
        weight, number = np.zeros(room.shape), np.full(room.shape, -1, np.int32)
        for i, s in enumerate(tree.shards):
            if s.region == region:
                if not 0 < s.weight <= 1 or number[s.rack, s.place] >= 0 or room[s.rack, s.place] <= 0:
                    raise ValueError(f"shard {i} needs a free place with room and a weight of at most 1")
                weight[s.rack, s.place], number[s.rack, s.place] = s.weight, i
        left, time, k = np.arange(len(keys)), np.zeros(len(keys)), 0
        while len(left):
            draw = mix(keys[left] ^ mix(np.array([(region << 24) + k], U64) ^ _ARRIVAL))
            time = time - np.log(_unit(draw, _TIME)) / room.sum()
            rack = _pick(draw, _RACK, room.sum(1)[None, :])
            at = _pick(draw, _PLACE, room[rack])
            early = time < best[left]
            takes = early & (_unit(draw, _TAKE) < weight[rack, at])
            best[left[takes]], shard[left[takes]] = time[takes], number[rack[takes], at[takes]]
            go_on = early & ~takes
            left, time, k = left[go_on], time[go_on], k + 1
    return shard


def with_shards(docs: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """``docs`` with an int column for each tree: the shard of the row's doc_id, null being an id like any other."""
    tune(docs.sparkSession)
    key = F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = docs.withColumn("__mesh_key", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(k[:8] for k in batch.column(batch.num_columns - 1).to_pylist()), "<u8")
                found = [pa.array(place(keys, tree)) for tree in trees.values()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], *trees])

    return keyed.mapInArrow(lean(run), with_fields(docs, **{name: IntegerType() for name in trees}))


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row for each row of ``docs(doc_id, text)``.

    The law is ``key``: doc_id and the number of shards decide, and ``grown_shard``
    is the shard were there one more.  Null text has 0 bytes and the checksum of
    empty text; null doc_ids share a shard, as all rows of one doc_id do.  Slots
    number the rows of a shard from 0 by doc_id (null first), size and checksum;
    rows alike in these are alike in all that is returned, so reruns agree.  Equal
    texts are no unit here.  Other columns are ignored; an empty table gives an
    empty result.
    """
    if n_shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    rows = with_shards(rows, {"shard": even_tree(n_shards), "grown_shard": even_tree(n_shards + 1)})
    order = [F.col("shard"), F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.monotonically_increasing_id()]
    slots = running_total(rows, order, F.lit(1), "__mesh_place", reset="shard")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__mesh_place") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: Tree | None = None) -> None:
    """Writes ``docs``, all columns, to a folder for each region, rack and shard, in order of doc_id inside a file.

    A folder gets a file from each task that holds rows of it, so a shard is written
    by many tasks.  The columns ``region``, ``rack`` and ``shard`` are replaced if there.
    """
    tree = tree or even_tree(SHARDS)
    rows = with_shards(docs.drop("region", "rack", "shard"), {"shard": tree})
    stands = docs.sparkSession.createDataFrame([(i, s.region, s.rack) for i, s in enumerate(tree.shards)], "shard int, region int, rack int")
    placed = rows.join(F.broadcast(stands), "shard").sortWithinPartitions("region", "rack", "shard", "doc_id")
    placed.write.partitionBy("region", "rack", "shard").parquet(path)


def _mixed(x: str) -> str:
    """``tokens.mix`` (its fixed constants) as an expression over a UHUGEINT below 2^64."""
    out, whole = f"[({x} + 11400714819323198485) % 18446744073709551616]", " % 18446744073709551616"
    for shift, factor in ((30, " * 13787848793156543929" + whole), (27, " * 10723151780598845931" + whole), (31, "")):
        out = f"list_transform({out}, lambda v: xor(v, v >> {shift}){factor})"
    return f"({out})[1]"


def _drawn(lane: np.uint64, i: int = 0) -> str:
    return f"({_mixed(f'xor(draw, {int(lane) + i}::UHUGEINT)')} >> 11)"


def _first_of(lane: np.uint64, n: int) -> str:
    """The child of the largest draw: of equal weights it is the one picked."""
    draws = f"[{', '.join(_drawn(lane, i) for i in range(n))}]"
    return f"(list_transform([{draws}], lambda l: list_position(l, list_max(l)))[1] - 1)"


#: CRC-32 of the text ``x`` (a column), with ``t`` the table of the 256 bytes from ``CRC_TABLE``.
CRC_TABLE = """
crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(x: str) -> str:
    units = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({units}, lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1]), 4294967295), 4294967295)"


SQL = f"""
WITH RECURSIVE {CRC_TABLE.strip()},
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
         CAST(md5_number_upper(coalesce(CAST(doc_id AS VARCHAR), '')) AS UHUGEINT) AS key FROM documents, crc),
a AS (
  SELECT key, n, r, 0 AS k, CAST(0 AS DOUBLE) AS time, -1 AS shard
  FROM (SELECT DISTINCT key FROM d), (SELECT unnest([{SHARDS}, {SHARDS + 1}]) AS n), (SELECT unnest(range({-(-(SHARDS + 1) // 16)})) AS r)
  UNION ALL
  SELECT key, n, r, k + 1, time - ln(({_drawn(_TIME)} + 0.5) / 9007199254740992.0) / 16.0, CASE WHEN slot < n THEN slot ELSE -1 END
  FROM (
    SELECT *, CAST(r * 16 + {_first_of(_PLACE, PLACES)} * 4 + {_first_of(_RACK, RACKS)} AS INTEGER) AS slot FROM (
      SELECT *, {_mixed(f"xor(key, {_mixed(f'xor(CAST(r * 16777216 + k AS UHUGEINT), {int(_ARRIVAL)}::UHUGEINT)')})")} AS draw FROM a WHERE shard < 0))),
w AS (SELECT key, n, arg_min(shard, time) AS shard FROM a WHERE shard >= 0 GROUP BY key, n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, s.shard AS shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, g.shard AS grown_shard
FROM d JOIN w AS s ON s.key = d.key AND s.n = {SHARDS} JOIN w AS g ON g.key = d.key AND g.n = {SHARDS + 1}
"""

"""Benchmark decontamination with suffix arrays of the training texts.

The words of a chunk of whole documents form one shard; its suffix array is
built by prefix doubling on word ranks.  Every suffix of every benchmark item is
binary-searched in every shard, as a pair of bounds on its first ``window``
words, so that all occurrences and their locations come out; those that no
longer match holds are extended word by word, which gives the longest verbatim
match of each item.  A document word inside any occurrence is hit.  Shards need
no exchange of text.

The benchmark is the stated query set.  It is written to the shared folder in
blocks of at most ``block_words`` words.  The documents are read once: a task
holds some megabytes of shards and takes the blocks one after the other, so its
memory is bounded however large the benchmark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, new_path, store_of, tune
from .tokens import U64, chunks, span_hash, split_words

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 700_000  # about 4 MB of text; a shard ends with the piece of text that reaches them
HELD_BYTES = 4 << 20  # text of the rows that a task holds at once
_END = U64(0)


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``h`` in the order of the next ``depth`` values or more (ends sort first)."""
    values = np.unique(h)
    rank = np.searchsorted(values, h).astype(np.int64) + 1
    step, sa = 1, None
    while step < depth:
        nxt = np.zeros(len(h), np.int64)
        nxt[: max(len(h) - step, 0)] = rank[step:]
        key = (rank << 32) | nxt
        sa = np.argsort(key, kind="stable")
        key = key[sa]
        new = np.concatenate([[1], (key[1:] != key[:-1]).astype(np.int64)])
        rank = np.empty(len(h), np.int64)
        rank[sa] = np.cumsum(new)
        if new.all():
            break
        step *= 2
    return sa if sa is not None else np.argsort(rank, kind="stable")


class Block:
    """Items of the benchmark as one array of word hashes, and the windows in it."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids, hashes, size = ids, [], []
        for t in chunks(pa.array(texts, pa.string())):
            words, folded = split_words(t)
            hashes.append(span_hash(folded, words.start, words.end))
            size.append(np.diff(words.first))
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        size = np.concatenate(size) if size else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        n = np.maximum(size - window + 1, np.minimum(size, 1))
        self.item = np.repeat(np.arange(len(size)), n)
        self.pos = np.arange(len(self.item)) - np.repeat(np.cumsum(n) - n, n) + self.first[:-1][self.item]
        self.length = np.minimum(window, size[self.item])


def _bound(text: np.ndarray, sa: np.ndarray, block: Block, upper: bool) -> np.ndarray:
    """For each window the first suffix not below it (or above all that start with it)."""
    lo, hi = np.zeros(len(block.pos), np.int64), np.full(len(block.pos), len(sa), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        at, query, length = sa[mid], block.pos[open_], block.length[open_]
        less, tied, live, j = np.zeros(len(open_), bool), np.ones(len(open_), bool), np.arange(len(open_)), 0
        while live.size:
            here = at[live] + j
            v = np.where(here < len(text), text[np.minimum(here, len(text) - 1)], _END)
            q = block.h[query[live] + j]
            less[live[v < q]] = True
            tied[live[v != q]] = False
            j += 1
            live = live[(v == q) & (length[live] > j)]
        go = less | (tied & upper)
        lo[open_] = np.where(go, mid + 1, lo[open_])
        hi[open_] = np.where(go, hi[open_], mid)
    return lo


class Shard:
    """The words of some whole texts with their suffix array; text i is h[first[i]:first[i + 1]]."""

    def __init__(self, h: np.ndarray, first: np.ndarray, window: int):
        self.first, self.window = first, window
        self.text = np.insert(h, first[1:], _END)  # a sentinel after each text keeps matches inside it
        self.sa = suffix_array(self.text, window)
        self.hit = np.zeros(len(h), bool)
        self.found: list[tuple[int, str, int, int, int]] = []

    def search(self, block: Block) -> None:
        """Adds the hit words, and for each text and item the longest match (text, item, words, place, item place)."""
        if not len(self.hit) or not len(block.pos):
            return
        lo, hi = (_bound(self.text, self.sa, block, up) for up in (False, True))
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return
        place = self.sa[np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        text = np.searchsorted(self.first[1:] + np.arange(len(self.first) - 1), place, "left")  # the sentinel of text i is at first[i + 1] + i
        marks = np.zeros(len(self.hit) + 1, np.int64)
        np.add.at(marks, place - text, 1)
        np.add.at(marks, place - text + block.length[which], -1)
        self.hit |= np.cumsum(marks)[:-1] > 0
        # a match that goes on to the left is part of the one that begins there
        pos, item = block.pos[which], block.item[which]
        before = np.where(place > 0, self.text[place - 1], _END)
        whole = (pos == block.first[item]) | (before == _END) | (before != block.h[pos - 1])
        place, text, pos, item, size = (x[whole] for x in (place, text, pos, item, block.length[which]))
        live = np.arange(len(place))
        while live.size:
            there = pos[live] + size[live]
            inside = there < block.first[item[live] + 1]
            live, there = live[inside], there[inside]
            live = live[self.text[place[live] + size[live]] == block.h[there]]
            size[live] += 1
        order = np.lexsort((pos, place, -size, item, text))
        text, item = text[order], item[order]
        best = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))[: len(order)]
        order, text, item = order[best], text[best], item[best]
        at = place[order] - text - self.first[text]
        rows = zip(text.tolist(), item.tolist(), size[order].tolist(), at.tolist(), (pos[order] - block.first[item]).tolist(), strict=True)
        self.found += [(t, block.ids[i], n, a, b) for t, i, n, a, b in rows]

    def runs(self, text: int) -> list[dict]:
        hit = self.hit[self.first[text] : self.first[text + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]

    def matches(self) -> list[list[dict]]:
        """For each text the longest match of each item, by item."""
        best: list[dict[str, dict]] = [{} for _ in range(len(self.first) - 1)]
        for t, item, words, at, item_at in self.found:
            was = best[t].get(item)
            if was is None or (-words, at, item_at) < (-was["words"], was["at"], was["item_at"]):
                best[t][item] = {"item": item, "words": words, "at": at, "item_at": item_at}
        return [[x[i] for i in sorted(x)] for x in best]


def _shards(texts: pa.Array, window: int) -> Iterator[Shard]:
    """The texts of a column in shards, in order."""
    hashes, sizes, held = [], [], 0
    for t in chunks(texts):
        words, folded = split_words(t)
        hashes.append(span_hash(folded, words.start, words.end))
        sizes.append(np.diff(words.first))
        held += len(hashes[-1])
        if held >= SHARD_WORDS or t.hi == len(texts):
            yield Shard(np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), window)
            hashes, sizes, held = [], [], 0


_RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last")]))
_MATCH = T.ArrayType(T.StructType([T.StructField("item", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("words", "at", "item_at")]))
_RUN_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last")]))
_MATCH_ARROW = pa.list_(pa.struct([("item", pa.string()), *((n, pa.int64()) for n in ("words", "at", "item_at"))]))


def write_blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """The items by id in files of a bounded number of words; the rows are streamed to the driver."""
    folder, paths = new_path(spark, "benchmark"), []
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)

    def flush(ids: list[str], texts: list[str]) -> None:
        paths.append(f"{folder}/{len(paths)}.pickle")
        with store.open_output_stream(f"{base}/{len(paths) - 1}.pickle") as out:
            out.write(pickle.dumps(Block(ids, texts, window)))

    ids, texts, held = [], [], 0
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for row in rows.orderBy("i", "t").toLocalIterator():
        n = len(row.t) // 2 + 1  # no more words than this
        if ids and held + n > block_words:
            flush(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        held += n
    flush(ids, texts)
    return paths


def _read(path: str) -> Block:
    store, base = store_of(path)
    with store.open_input_stream(base) as source:
        return pickle.loads(source.read())


_PREFIX = "__mesh_"
_ADDED = ("n_words", "n_hit", "matches", "hit")


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``__mesh_n_words, __mesh_n_hit, __mesh_matches, __mesh_hit`` (see ``contamination``)."""
    spark = docs.sparkSession
    tune(spark)
    paths = write_blocks(spark, benchmark, window, block_words)

    def work(held: list[pa.RecordBatch], only: Block | None) -> Iterator[pa.RecordBatch]:
        shards = [list(_shards(batch.column("text"), window)) for batch in held]
        for path in paths:
            block = only or _read(path)
            for s in (s for group in shards for s in group):
                s.search(block)
        for batch, group in zip(held, shards, strict=True):
            n_words = np.concatenate([np.diff(s.first) for s in group])
            n_hit = np.concatenate([np.diff(np.concatenate([[0], np.cumsum(s.hit)])[s.first]) for s in group])
            matches = [m for s in group for m in s.matches()]
            runs = [s.runs(i) if m else [] for s in group for i, m in enumerate(s.matches())]
            cols = [pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(matches, _MATCH_ARROW), pa.array(runs, _RUN_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *(_PREFIX + n for n in _ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _read(paths[0]) if len(paths) == 1 else None
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= HELD_BYTES:
                yield from work(held, only)
                held, size = [], 0
        if held:
            yield from work(held, only)

    kinds = (T.LongType(), T.LongType(), _MATCH, _RUN)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(_PREFIX + n, k) for n, k in zip(_ADDED, kinds, strict=True))])
    return docs.mapInArrow(lean(run), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, hit, matches)`` for each row of ``docs(doc_id, text)``.

    ``items`` are the distinct ids of benchmark items with an occurring window,
    as sorted strings; ``hit`` the runs of hit words (indices, both inclusive);
    ``matches`` the longest verbatim match of each item, with its number of words
    and where it begins in the document and in the item (the first in the
    document, then in the item, if several are as long).
    Null text has no words; items with null id or without words match nothing;
    items that share an id count as one.  An empty benchmark hits nothing.
    Rows are treated alone, in one block or several: repeats and null ids stay.
    """
    found = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, block_words)
    n_words, n_hit, matches, hit = (F.col(_PREFIX + n) for n in _ADDED)
    items = F.transform(matches, lambda m: m["item"])
    return found.select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), hit.alias("hit"), matches.alias("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of a benchmark item."""
    found = marked(docs, benchmark, window, block_words).where(F.col(_PREFIX + "n_hit") == 0)
    return found.select(*[f"`{n}`" for n in docs.columns])


SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, row_number() OVER () AS id, CAST(doc_id AS VARCHAR) AS name, text FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), CAST(item_id AS VARCHAR), text FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT kind, id, name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM t),
n AS (SELECT kind, id, name, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
g AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY kind, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS gram FROM n),
q AS (SELECT DISTINCT name AS item, least(n, 10) AS size, word, gram FROM g WHERE kind = 'b' AND i <= greatest(n - 10, 0)),
h AS (
  SELECT id, i, 10 AS size, item FROM g JOIN q USING (gram) WHERE kind = 'd' AND q.size = 10 AND i + 10 <= n
  UNION ALL
  SELECT id, i, q.size, item FROM g JOIN q USING (word) WHERE kind = 'd' AND q.size < 10 AND starts_with(g.gram || ' ', q.gram || ' ')),
c AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS place FROM h) GROUP BY id),
f AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT CAST(w.name AS BIGINT) AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (id) LEFT JOIN f USING (id) WHERE kind = 'd'
"""

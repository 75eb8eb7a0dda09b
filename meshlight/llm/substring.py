"""Substring de-duplication by hashing of lines, cut at sentence ends.

Each line of a text is cut after ``.``, ``!`` or ``?`` that white space follows.
The ``min_words`` words from the start of each such unit on are hashed, in their
normal form (case, punctuation and spacing dropped), however short the units
are; so one short unit is no evidence, and many in the same order are.  Since
repeated passages are often pasted into the middle of a line, the windows of
``min_words`` words that are least by hash among ``GAP`` in a row are hashed as
well (winnowing): two texts that share ``GAP + min_words - 1`` words in a row
share a digest, wherever the passage begins.

Digests are grouped over all documents; the occurrence with the least (doc_id,
position) stays and every other one is a repeat.  Both ends of a chain of repeats
are compared with the kept document word by word and extended as far as the words
agree.  No more than ``GAP`` words are needed for that, as a longer match holds a
further digest.  A unit of at most ``LONG_WORDS`` words that is repeated in part
only stays whole.  Runs of ``min_words`` words or more are removed, with their
offsets in the original text kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, key_words, maybe_among, written
from .tokens import U64, Texts, Words, chunks, code_points, group_hash, mix, powers, span_hash, split_words

MIN_WORDS = 20
GAP = 32
LONG_WORDS = 16
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13, 0xFF]] = True
_NONE = U64(0xFFFFFFFFFFFFFFFF)


def _units(t: Texts, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that end a unit, which of them ends each word's, and whether a word is its unit's first."""
    d = t.data
    after = np.append(d[1:], 0xFF)
    cut = np.flatnonzero((d == 10) | (_STOP[d] & _SPACE[after]) | (d == 0xFF))
    unit = np.searchsorted(cut, words.start)
    return cut, unit, np.append(True, (unit[1:] != unit[:-1]) | (words.doc[1:] != words.doc[:-1]))


def _grams(h: np.ndarray, words: Words, k: int) -> np.ndarray:
    """For each word a hash of the k words from it on; ``_NONE`` where the text ends before."""
    out = np.full(len(h), _NONE, U64)
    if len(h) >= k:
        power, inverse = powers(len(h) + 1)
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(h * power[: len(h)], out=total[1:])
        n = len(h) - k + 1
        inside = np.arange(n) + k <= words.first[1:][words.doc[:n]]
        out[:n] = np.where(inside, mix((total[k:] - total[:-k]) * inverse[:n]), _NONE)
    return out


def _least(g: np.ndarray) -> np.ndarray:
    """Whether a value is the least of some ``GAP`` values in a row."""
    if len(g) < GAP:
        return np.zeros(len(g), bool)
    low, step = g, 1
    while step < GAP:
        low, step = np.minimum(low[:-step], low[step:]), step * 2
    up, step = np.pad(low, GAP - 1), 1
    while step < GAP:
        up, step = np.maximum(up[:-step], up[step:]), step * 2
    return up == g


def _prints(k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        out = []
        for t in chunks(batch.column("text")):
            words, folded = split_words(t)
            if not len(words.start):
                continue
            g = _grams(span_hash(folded, words.start, words.end), words, k)
            at = np.flatnonzero((_units(t, words)[2] | _least(g)) & (g != _NONE))
            doc = words.doc[at]
            out.append([ids[t.lo + doc], at - words.first[doc], g[at].view(np.int64)])
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "pos", "d"])

    return run


def _around(h: np.ndarray, words: Words, at: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """A row for each word in ``at``: the hashes of the words about it, 0 beyond its text."""
    i = at[:, None] + np.arange(-GAP, k + GAP)
    inside = (i >= words.first[doc][:, None]) & (i < words.first[doc + 1][:, None])
    return np.where(inside, h[np.clip(i, 0, len(h) - 1)], U64(0))


def _kept_words(k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        asked, n = batch.column("at").flatten().to_numpy(zero_copy_only=False), batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        out = []
        for t in chunks(batch.column("text")):
            words, folded = split_words(t)
            mine = (row >= t.lo) & (row < t.hi)
            doc, pos = row[mine] - t.lo, asked[mine]
            fits = pos + k <= np.diff(words.first)[doc]
            doc, pos = doc[fits], pos[fits]
            if len(doc):
                found = _around(span_hash(folded, words.start, words.end), words, words.first[doc] + pos, doc, k)
                out.append((ids[t.lo + doc], pos, [x.tobytes() for x in found]))
        if not out:
            return None
        parts = list(zip(*out, strict=True))
        cols = [pa.array(np.concatenate(parts[0])), pa.array(np.concatenate(parts[1]).astype(np.int64)), pa.array([x for p in parts[2] for x in p], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["k_doc", "k_pos", "about"])

    return run


def _runs(k: int, min_words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        flat, n = batch.column("at").flatten(), batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        pos, digest, least = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("pos", "d", "least"))
        about = flat.field("about")
        ends = about.is_valid().to_numpy(zero_copy_only=False)
        out = []
        for t in chunks(batch.column("text")):
            words, folded = split_words(t)
            size = np.diff(words.first)
            mine = np.flatnonzero((row >= t.lo) & (row < t.hi))
            mine = mine[pos[mine] + k <= size[row[mine] - t.lo]]
            if not len(mine):
                continue
            h = span_hash(folded, words.start, words.end)
            doc = row[mine] - t.lo
            at = words.first[doc] + pos[mine]
            # rows that repeat a doc_id get each other's places
            good = _grams(h, words, k)[at].view(np.int64) == digest[mine]
            left, right = np.zeros(len(mine), np.int64), np.full(len(mine), k)
            edge = np.flatnonzero(ends[mine] & good)
            if len(edge):
                own = _around(h, words, at[edge], doc[edge], k)
                kept = np.frombuffer(b"".join(about.take(pa.array(mine[edge])).to_pylist()), U64).reshape(own.shape)
                same = (own == kept) & (own != 0)
                left[edge] = np.cumprod(same[:, GAP - 1 :: -1], axis=1).sum(axis=1)
                right[edge] = np.cumprod(same[:, GAP:], axis=1).sum(axis=1)
                good[edge] &= right[edge] >= k
            begin = np.maximum(at - left, words.first[doc] + least[mine])
            good &= begin < at + right
            marks = np.zeros(len(h) + 1, np.int64)
            np.add.at(marks, begin[good], 1)
            np.add.at(marks, (at + right)[good], -1)
            hit = np.cumsum(marks)[:-1] > 0
            cut, unit, fresh = _units(t, words)
            head = np.flatnonzero(fresh)
            long = np.diff(np.append(head, len(h)))
            number = np.cumsum(fresh) - 1
            covered = np.add.reduceat(hit.astype(np.int64), head)
            hit &= ((covered == long) | (long > LONG_WORDS))[number]
            other = np.append(True, words.doc[1:] != words.doc[:-1])
            first = np.flatnonzero(hit & (other | ~np.append(False, hit[:-1])))
            last = np.flatnonzero(hit & (np.append(other[1:], True) | ~np.append(hit[1:], False)))
            enough = last - first + 1 >= min_words
            first, last = first[enough], last[enough]
            where = code_points(t.data)
            base = where[t.start[words.doc[first]]]
            stop = cut[unit[last]]
            stop = np.where((t.data[stop] == 10) | (t.data[stop] == 0xFF), stop, stop + 1)
            whole = np.append(fresh[1:], True)[last]
            out.append([
                ids[t.lo + words.doc[first]], where[words.start[first]] - base, where[np.where(whole, stop, words.end[last])] - base,
                last - first + 1, number[last] - number[first] + 1,
            ])
        if not out:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)).cast(pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "end", "words", "units"]
        )

    return run


def _with(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The documents that have ``places(doc_id, at)``; only those that may have some are exchanged."""
    h = F.xxhash64("doc_id")
    marked = maybe_among(docs, key_words(places.select("doc_id"), h), h).where("__mesh_maybe").drop("__mesh_maybe")
    return marked.join(places, "doc_id")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, end, words, units)``: the runs to remove, in code points, end exclusive.

    Null and empty texts have no units.  Rows with a null doc_id take no part.
    Rows that repeat a doc_id count as one document, and what they hold at the
    same position as one occurrence: equal rows repeat nothing.
    Of occurrences in one text that overlap, the part beyond the kept one goes.
    """
    k = min_words
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = arrow_map(docs, _prints(k), "doc_id long, pos long, d long")
    seen = prints.groupBy("d").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("keep"))
    seen = seen.where("n > 1").select("d", F.col("keep.doc_id").alias("k_doc"), F.col("keep.pos").alias("k_pos"))
    again = prints.join(seen, "d").where("doc_id != k_doc or pos != k_pos")
    chain = Window.partitionBy("doc_id", "k_doc", F.col("pos") - F.col("k_pos")).orderBy("pos")
    inner = F.coalesce((F.col("pos") - F.lag("pos").over(chain) <= k) & (F.lead("pos").over(chain) - F.col("pos") <= k), F.lit(False))
    least = F.when(F.col("doc_id") == F.col("k_doc"), F.col("k_pos") + k).otherwise(0)
    again = written(again.select("*", inner.alias("inner"), least.alias("least")), "repeats")
    kept = written(again.where("not inner").select(F.col("k_doc").alias("doc_id"), "k_pos").groupBy("doc_id").agg(F.collect_set("k_pos").alias("at")), "kept")
    about = arrow_map(_with(docs, kept), _kept_words(k), "k_doc long, k_pos long, about binary")
    names = ["doc_id", "pos", "d", "least", "about"]
    ends = again.where("not inner").join(about, ["k_doc", "k_pos"]).select(*names)
    places = ends.union(again.where("inner").select(*names[:4], F.lit(None).cast("binary").alias("about")))
    places = written(places.groupBy("doc_id").agg(F.collect_list(F.struct(*names[1:])).alias("at")), "places")  # bounded by the text's length
    runs = arrow_map(_with(docs, places), _runs(k, min_words), "doc_id long, start long, end long, words long, units long")
    return runs.groupBy("doc_id", "start", "end").agg(F.max("words").alias("words"), F.max("units").alias("units"))


def _line_prints(least: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        out = []
        for t in chunks(batch.column("text")):
            words, folded = split_words(t)
            cut = np.flatnonzero((t.data == 10) | (t.data == 0xFF))
            first = np.searchsorted(words.start, np.append(0, cut + 1))
            many = np.flatnonzero(np.diff(first) >= max(least, 1))
            if not len(many):
                continue
            h = span_hash(folded, words.start, words.end)
            keys = [group_hash(x, first)[many].view(np.int64) for x in (h, mix(h))]
            doc = words.doc[first[many]]
            where = code_points(t.data)
            begin = np.append(0, cut[:-1] + 1)[many]
            out.append([ids[t.lo + doc], where[begin] - where[t.start[doc]], where[cut[many]] - where[t.start[doc]], np.diff(first)[many], *keys])
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(pa.int64()) for x in zip(*out, strict=True)], _LINE)

    return run


_LINE = ["doc_id", "start", "end", "words", "k1", "k2"]


def repeated_lines(docs: DataFrame, line_words: int = 1) -> DataFrame:
    """``(doc_id, start, end, words)``: whole lines of ``line_words`` words or more that an earlier line equals in its words.

    Of equal lines the one with the least (doc_id, start) stays, however many
    there are; offsets are code points without the line break.  Nulls and rows
    that repeat a doc_id are treated as in ``repeated_runs``.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = written(arrow_map(docs, _line_prints(line_words), ", ".join(f"{n} long" for n in _LINE)), "lines")
    seen = lines.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("keep")).where("n > 1")
    seen = seen.select("k1", "k2", F.col("keep.doc_id").alias("k_doc"), F.col("keep.start").alias("k_start"))
    h = F.xxhash64("k1", "k2")
    again = maybe_among(lines, key_words(seen, h), h).where("__mesh_maybe").join(seen, ["k1", "k2"])
    return again.where("doc_id != k_doc or start != k_start").select("doc_id", "start", "end", "words").distinct()


def _merged(spans: DataFrame) -> DataFrame:
    """``(doc_id, start, end)`` without overlaps; the spans of a document are bounded by its length."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = island.withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_part")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` cut and ``removed``: the cut spans of the original.

    Repeated runs of ``min_words`` words go, and with ``line_words`` repeated
    lines of that many words as well, however short.  Rows without repeats keep
    their text; ``removed`` is then empty.  So do rows without a doc_id, and null
    texts stay null.  Rows of one doc_id are cut at the same places.
    """
    spans = repeated_runs(docs, min_words).select("doc_id", "start", "end")
    if line_words is not None:
        spans = spans.union(repeated_lines(docs, line_words).select("doc_id", "start", "end"))
    runs = _merged(spans).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__mesh_removed")  # bounded by the text's length
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = docs.drop("removed").join(runs, "doc_id", "left").withColumn("removed", F.coalesce("__mesh_removed", none)).drop("__mesh_removed")
    edges = F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))),
        "removed",
        F.array(F.struct(F.length("text").cast("long").alias("start"), F.length("text").cast("long").alias("end"))),
    )
    kept = F.transform(
        F.sequence(F.lit(0), F.size(edges) - 2),
        lambda i: F.substring(F.col("text"), (edges[i]["end"] + 1).cast("int"), (edges[i + 1]["start"] - edges[i]["end"]).cast("int")),
    )
    return joined.withColumn("text", F.when(F.size("removed") > 0, F.array_join(kept, "")).otherwise(F.col("text")))

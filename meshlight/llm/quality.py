"""Quality selection by importance resampling.

Two generative models of hashed n-grams are estimated: one of the raw corpus,
from all its documents, and one of target text, from rows that are labelled
good.  The log weight of a document is the sum of the log ratios of its n-grams.
Documents are sampled without replacement in proportion to their weights by the
Gumbel top-k trick: the k largest sums of log weight and Gumbel noise are kept.

N-grams are tokens (words with case folded, and runs of punctuation as they are)
and pairs of adjacent token shapes (lower, Title, UPPER, digits, the punctuation
itself, each marked if it repeats the word before).  The target model is
smoothed towards the raw one by ``PSEUDO`` counts, so that an n-gram too rare to
judge has a ratio near one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, lean, running_total, tune, with_fields, written
from .tokens import U64, Texts, chunks, mix, span_hash

BUCKETS = 10_000
TARGET_ROWS = 50_000  # bound of the labelled sample that the target model is fitted on
PSEUDO = 50.0

_KIND = np.full(256, 2, np.int8)  # 0 space, 1 word, 2 punctuation
_KIND[[0x20, 9, 10, 11, 12, 13, 0xFF]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[128:255] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _sum(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def ngrams(t: Texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a chunk and the text each is in."""
    d = t.data
    kind = _KIND[d]
    change = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    stop = np.append(change[1:], len(d))
    real = kind[change] != 0
    start, end = change[real], stop[real]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(t.start, start, "right") - 1
    word = kind[start] == 1
    h = span_hash(_FOLD[d], start, end)
    up, low, digit = (_sum((d >= a) & (d <= b)) for a, b in ((65, 90), (97, 122), (48, 57)))
    n_up, n_low, n_digit = (x[end] - x[start] for x in (up, low, digit))
    shape = np.where(n_digit == end - start, 3, np.where((n_up > 1) & (n_low == 0), 2, np.where(n_up > 0, 1, 0))).astype(U64)
    at = np.flatnonzero(word)
    same = np.zeros(len(h), bool)
    same[at[1:]] = (h[at[1:]] == h[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    shape = np.where(word, shape + U64(4) * same.astype(U64), h)
    gap = np.append(start[1:] > end[:-1], True)
    pair = mix(shape[:-1] * U64(0x9E3779B97F4A7C15) + mix(shape[1:] + gap[:-1].astype(U64)))
    inside = doc[1:] == doc[:-1]
    every = np.concatenate([h, pair[inside]])
    return (mix(every) % U64(buckets)).astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def fit(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, pseudo: float = PSEUDO) -> np.ndarray:
    """Log ratio per bucket, from all rows of ``docs(doc_id, text)`` and the target rows among them.

    ``target_ids(doc_id)`` must be bounded (see ``target_sample``); it is broadcast.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(target_ids.select("doc_id").distinct().withColumn("_target", F.lit(True))), "doc_id", "left"
    )
    tune(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.array([x is True for x in batch.column("_target").to_pylist()], bool)
            for t in chunks(batch.column("text")):
                b, doc = ngrams(t, buckets)
                raw += np.bincount(b, minlength=buckets)
                target += np.bincount(b[good[t.lo + doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = marked.mapInArrow(lean(count), "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # one per bucket
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    expected = raw / raw.sum() * target.sum()
    return np.log((target + pseudo) / (expected + pseudo))


def target_sample(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of labelled good rows: all, or the first ``rows`` by a hash if there are more."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 11, prefix: str = "") -> DataFrame:
    """``docs`` with ``log_weight`` and ``gumbel_key`` added, their names after ``prefix`` (columns of those names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    weight, key = f"{prefix}log_weight", f"{prefix}gumbel_key"
    base = docs.drop(weight, key)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros(batch.num_rows)
        for t in chunks(batch.column("text")):
            b, doc = ngrams(t, len(shared.value))
            out[t.lo : t.hi] = np.bincount(doc, shared.value[b], t.hi - t.lo)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, weight])

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return arrow_map(base, run, with_fields(base, **{weight: T.DoubleType()})).withColumn(key, F.col(weight) - F.log(-F.log(uniform)))


def threshold(keys: DataFrame, k: int | None = None) -> float:
    """The least kept key: the k-th largest.  If no k is given it is the number of rows whose weight is at least one."""
    if k is None:
        k = keys.where("log_weight >= 0").count()
    ranked = running_total(keys.select("gumbel_key"), [-F.col("gumbel_key")], F.lit(1), "_rank")
    found = ranked.where(F.col("_rank") <= k).agg(F.min("gumbel_key")).first()[0]
    return float("inf") if found is None else found


def select(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, k: int | None = None) -> DataFrame:
    """The sampled rows as ``(doc_id, log_weight, gumbel_key)``.

    The sample has k rows; if no k is given, it is the number of documents that
    are likelier under the target model than under the raw one, so the sample
    size follows the corpus.  Null and empty texts have weight one.  Rows with
    equal keys (the same doc_id and text) are kept or dropped together.  Without
    labelled good rows all ratios are one and, with no k, every row is kept.  Rows
    of one doc_id share its Gumbel draw, and so do all rows without one.  An empty
    table gives an empty result.
    """
    ratio = fit(docs, target_sample(labels, target_rows), buckets)
    keys = written(weigh(docs.select("doc_id", "text"), ratio).drop("text"), "weights")
    return keys.where(F.col("gumbel_key") >= threshold(keys, k))


def filter_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS, k: int | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns."""
    ratio = fit(docs, target_sample(labels, target_rows), buckets)
    keys = written(weigh(docs.select("doc_id", "text"), ratio).select("log_weight", "gumbel_key"), "weights")
    kept = weigh(docs, ratio, prefix="__mesh_").where(F.col("__mesh_gumbel_key") >= threshold(keys, k))
    return kept.drop("__mesh_log_weight", "__mesh_gumbel_key")

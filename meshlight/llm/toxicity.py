"""Toxicity by weak supervision.

Voters are a seed lexicon, text patterns, and terms mined from the labelled rows:
whole words and word stems of 3 to 9 bytes that occur once, twice or three times
at least.  A generative label model
estimates by EM how often each voter fires in either class; it also estimates
the correlation of voters within the classes and shares the evidence among those
that fire together.  The label itself is one more voter, with an error rate of
its own.  A linear classifier is then trained on the posterior labels and scores
every text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .tokens import _BYTE, U64, Texts, chunks, mix, span_hash, split_words

SAMPLE_ROWS = 8_000  # bound of the labelled sample that everything is fitted on
TERMS = 300  # mined voters
FOLDS = 5
STEMS = range(3, 10)
LEVELS = 3  # a term votes apart for one, two, three or more occurrences

# General English insults, as seed voters.
LEXICON = "idiot moron stupid scum trash worthless loser pathetic disgusting clown fool dumb ugly hate jerk liar".split()
PATTERNS = (
    re.compile(rb"\b(you|your|u) (are|r|is)? ?(a|an|so|such)? ?(idiot|moron|stupid|loser|fool|liar)", re.I),
    re.compile(rb"\b(shut up|go away|get lost|drop dead)\b", re.I),
    re.compile(rb"!{3,}"),
)


class Model(NamedTuple):
    keys: np.ndarray  # sorted term keys
    weights: np.ndarray  # of the terms, in the order of keys, by level
    patterns: np.ndarray  # weights of PATTERNS
    several: float  # weight of the number of distinct words with a term, beyond one, as a logarithm
    bias: float


def term_keys(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words and stems, the text of each, and the word of each."""
    words, folded = split_words(t)
    whole = span_hash(folded, words.start, words.end)
    padded = np.append(folded, np.zeros(max(STEMS), np.uint8))
    head = np.full(len(words.start), 7, U64)
    keys, docs, at = [whole], [words.doc], [np.arange(len(whole))]
    for i in range(max(STEMS)):
        head = head * U64(0x9E3779B97F4A7C15) + _BYTE[padded[words.start + i]]
        if i + 1 in STEMS:
            long_ = np.flatnonzero(words.end - words.start > i + 1)
            keys.append(mix(head[long_]))
            docs.append(words.doc[long_])
            at.append(long_)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(at)


def _word_key(word: str) -> int:
    t = next(chunks(pa.array([word])))
    words, folded = split_words(t)
    return int(span_hash(folded, words.start, words.end)[0])


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, text, toxic)`` of labelled rows outside the held-out fold, ``sample_rows`` at most.

    The sample is the first by a hash of doc_id; only its ids and labels, which
    the bound limits, are broadcast.  Of several rows of an id one is used, that
    with the least hash of its text.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = F.min_by(F.struct("text"), F.xxhash64("text"))["text"].alias("text")
    return rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(one, F.max("toxic").alias("toxic"))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _count_terms(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
    parts = []
    for t in chunks(batch.column("text")):
        key, doc, _ = term_keys(t)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(key)))
        base, bad = key[at], toxic[t.lo + doc[at]]
        for level in range(1, LEVELS + 1):
            some = times >= level
            key, bad = base[some], bad[some]
            base, times = base[some], times[some]
            if not len(key):
                break
            firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            pos = np.add.reduceat(bad.astype(np.int64), firsts)
            parts.append((key[firsts], np.full(len(firsts), level), key[firsts], pos, np.diff(np.append(firsts, len(key))) - pos))
    if not parts:
        return None
    _, level, base, pos, neg = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(base.view(np.int64)), pa.array(level), pa.array(pos), pa.array(neg)], ["key", "level", "pos", "neg"])


def mine_terms(rows: DataFrame, terms: int = TERMS) -> np.ndarray:
    """(key, level) of the ``terms`` most telling words and stems of the training rows."""
    n = rows.groupBy("toxic").count().collect()
    bad = sum(r["count"] for r in n if r["toxic"])
    good = sum(r["count"] for r in n) - bad
    if not bad or not good:
        return np.zeros((0, 2), np.int64)
    counted = arrow_map(rows.select("text", "toxic"), _count_terms, "key long, level long, pos long, neg long")
    sums = counted.groupBy("key", "level").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (bad + 1)) - F.log((F.col("neg") + 0.5) / (good + 1))
    least = max(3, bad // 200)
    best = sums.where(F.col("pos") >= least).withColumn("odds", odds).where((F.col("odds") > 1.5) & (F.col("pos") * 2 > F.col("neg")))
    best = best.orderBy((F.col("odds") * F.sqrt("pos")).desc(), "key", "level").limit(terms)
    return np.array([(r["key"], r["level"]) for r in best.select("key", "level").collect()], np.int64).reshape(-1, 2)


def _lookup(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions in ``key`` that are among the sorted ``keys``."""
    if not len(keys):
        return np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[keys & U64(0xFFFF)] = True
    at = np.flatnonzero(maybe[key & U64(0xFFFF)])
    found = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
    return at[keys[found] == key[at]]


def votes(t: Texts, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, voter) that fire, the pattern votes of each text, and its number of words with a term.

    Voter ``i * LEVELS + level - 1`` is the term with key i, so often or more.
    """
    key, doc, word = term_keys(t)
    at = _lookup(keys, key)
    term, n = np.searchsorted(keys, key[at]), max(len(keys), 1)
    pairs, times = np.unique(doc[at] * n + term, return_counts=True)
    times = np.minimum(times, LEVELS)
    owner = np.repeat(pairs, times)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    flagged = np.unique(word[at])
    text_of = np.zeros(int(word.max()) + 1 if len(word) else 0, np.int64)
    text_of[word[at]] = doc[at]
    count = np.bincount(text_of[flagged], minlength=len(t.start))
    raw = t.data.tobytes()
    marks = np.zeros((len(t.start), len(PATTERNS)))
    for j, p in enumerate(PATTERNS):
        for m in p.finditer(raw):
            marks[np.searchsorted(t.start, m.start(), "right") - 1, j] = 1
    return owner // n, owner % n * LEVELS + level, marks, count


def label_model(fired: np.ndarray, gold: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of class 1 for each row, from ``fired`` (rows, voters) and the given labels.

    Each voter has its firing rate in either class.  After a first estimate the
    correlation of the voters, within the classes, tells how many independent
    voices a voter shares its evidence with.
    """
    post = np.clip(gold.astype(float), 0.02, 0.98)
    share = np.ones(fired.shape[1])
    for i in range(rounds):
        n1, n0 = post.sum(), (1 - post).sum()
        rate1 = (post @ fired + 0.2) / (n1 + 1)
        rate0 = ((1 - post) @ fired + 0.05) / (n0 + 1)
        wrong = np.clip((post @ (1 - gold) + 1) / (n1 + 10), 0.005, 0.3), np.clip(((1 - post) @ gold + 1) / (n0 + 10), 0.005, 0.3)
        if i == 2 and fired.shape[1]:
            centred = fired - np.outer(post, rate1) - np.outer(1 - post, rate0)
            scale = np.sqrt((centred**2).mean(axis=0)) + 1e-9
            corr = (centred.T @ centred) / len(fired) / np.outer(scale, scale)
            share = 1 / np.maximum(1, (np.clip(np.abs(corr), 0, 1) * (np.abs(corr) > 0.3)).sum(axis=1))
        odds = np.log(n1 / n0)
        odds = odds + (fired * share) @ np.log(rate1 / rate0) + ((1 - fired) * share) @ np.log((1 - rate1) / (1 - rate0))
        odds = odds + np.where(gold == 1, np.log((1 - wrong[0]) / wrong[1]), np.log(wrong[0] / (1 - wrong[1])))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def _linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> Model:
    """The model, learnt from labelled rows outside the held-out fold only."""
    rows = training_rows(docs, labels, sample_rows)
    seeds = np.array([_word_key(w) for w in LEXICON], U64)
    mined = mine_terms(rows, terms)
    keys = np.unique(np.concatenate([seeds, np.ascontiguousarray(mined[:, 0]).view(U64)]))
    voters = np.unique(np.concatenate([np.searchsorted(keys, seeds) * LEVELS, np.searchsorted(keys, np.ascontiguousarray(mined[:, 0]).view(U64)) * LEVELS + mined[:, 1] - 1]))
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        fired, marks, counts = [[] for _ in range(batch.num_rows)], [], []
        for t in chunks(batch.column("text")):
            doc, voter, m, c = votes(t, shared.value)
            for d, v in zip(doc.tolist(), voter.tolist(), strict=True):
                fired[t.lo + d].append(v)
            marks.append(m)
            counts.append(c)
        m = pa.array(np.concatenate(marks).tolist(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic").cast(pa.int64()), pa.array(fired, pa.list_(pa.int64())), m, pa.array(np.concatenate(counts))],
            ["doc_id", "toxic", "fired", "marks", "n"],
        )

    voted = arrow_map(rows, vote, "doc_id long, toxic long, fired array<long>, marks array<double>, n long")
    found = sorted(voted.collect(), key=lambda r: (r["doc_id"], r["n"], r["fired"]))  # at most sample_rows rows of votes
    if not found or len({bool(r["toxic"]) for r in found}) < 2:
        prior = np.mean([bool(r["toxic"]) for r in found]) if found else 0.0
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(keys, np.zeros(len(keys) * LEVELS), np.zeros(len(PATTERNS)), 0.0, float(np.log(prior / (1 - prior))))
    fired = np.zeros((len(found), len(keys) * LEVELS), np.float32)
    for i, r in enumerate(found):
        fired[i, r["fired"]] = 1
    fired = np.column_stack([fired[:, voters], [r["marks"] for r in found]]).astype(float)
    gold = np.array([bool(r["toxic"]) for r in found], float)
    several = np.log2(np.maximum([r["n"] for r in found], 1))
    w = _linear(np.column_stack([fired, several]), label_model(fired, gold))
    weights = np.zeros(len(keys) * LEVELS)
    weights[voters] = w[: len(voters)]
    return Model(keys, weights, w[len(voters) : -2], float(w[-2]), float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``; null and empty texts get the score of no vote."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m: Model = shared.value
        out = np.full(batch.num_rows, m.bias)
        for t in chunks(batch.column("text")):
            doc, voter, marks, count = votes(t, m.keys)
            out[t.lo : t.hi] += np.bincount(doc, m.weights[voter], t.hi - t.lo) + marks @ m.patterns + m.several * np.log2(np.maximum(count, 1))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-out)))], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text)``.

    Inputs of a score are the text alone.  Repeated ids are scored row by row; a
    doc_id labelled twice counts as toxic if either label says so.  A null
    doc_id is scored and not held out.  Without labels of both classes every
    text gets the share of label 1.
    """
    scored = score(docs, fit(docs, labels, sample_rows, terms))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

"""One-edit spelling variants by merging the light subtrees of a trie.

The words are a trie.  At each node the child with the most words is heavy, the
others are light, and the end of a word that goes on as another counts as light.
For every light edge on its path, of which a word has at most the logarithm of the
number of words, the word is put into the tree beside it with one error: with the
character after the node replaced by the heavy one (R), with it skipped (S), and
behind the heavy one, which is what skipping the heavy one looks like from here (I).
So the smaller tree is always merged into the larger.  Terminals that coincide are
the pairs of one edit: an entry with a word, or two R entries of the same node.

Any two words of one edit part at one node.  If they differ by a replacement there,
one of both edges is light (R).  If the longer one's edge is light, S finds it; if it
is heavy, the shorter one's edge is light and I does.  Of a run of equal letters only
the last is skipped, which is the one at that node.  So every pair is found once.

A node is known by its depth and a hash of its prefix.  Nodes whose hashes collide
share their heavy child, which costs time at most: any choice of it gives all pairs.
Entries meet by their whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, tune, written
from .sharding import CRC_TABLE, crc_sql
from .tokens import U64, mix, powers

MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 6, 5, 5, 199
RUN = r"[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes of at most this depth are broadcast: the alphabet has 90 letters, so there are at most 1 + 90 + 90 * 90.
TOP = 2


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """``(word, n)``: the lower-cased runs of letters of whole texts, some with a letter dropped by the hash of doc_id and run."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    found = F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= min_length)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__mesh_id"), F.explode(found).alias("run"))
    h = F.crc32(F.encode(F.concat("__mesh_id", F.lit(":"), "run"), "utf-8"))
    runs = runs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each word: depth, hash of the prefix, and the next letter, empty at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(1).to_pylist()
        letters = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), "<u4")
        last = np.flatnonzero(letters == 0)
        start = np.concatenate([[0], last[:-1] + 1])
        count = last - start + 1
        first = np.repeat(start, count)
        depth = np.arange(len(letters)) - first
        power, inverse = powers(len(letters) + 1)
        total = np.zeros(len(letters) + 1, U64)
        np.cumsum(mix(letters.astype(U64)) * power[:-1], out=total[1:])
        node = mix((total[:-1] - total[first]) * inverse[first] + depth.astype(U64))
        ids = np.repeat(batch.column(0).to_numpy(), count)
        alphabet = np.unique(letters)
        names = pa.array([chr(c) if c else "" for c in alphabet.tolist()])
        nexts = pa.DictionaryArray.from_arrays(np.searchsorted(alphabet, letters).astype(np.int32), names).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), nexts], ["id", "p", "node", "x"])


def light_edges(words: DataFrame) -> DataFrame:
    """``(id, p, x, h)`` of ``words(id, word)``: the letter ``x`` after the first ``p`` is not the heavy one ``h``; ``x`` is empty at the end."""
    steps = words.select("id", "word").mapInArrow(lean(_steps), "id long, p int, node long, x string")
    sizes = steps.groupBy("p", "node", "x").agg(F.count("*").alias("size"))
    heavy = F.max(F.struct((F.col("x") != "").alias("letter"), "size", "x"))["x"]
    nodes = written(sizes.groupBy("p", "node").agg(heavy.alias("h"), F.count("*").alias("edges")).where("edges > 1").drop("edges"), "nodes")
    top = steps.where(F.col("p") <= TOP).join(F.broadcast(nodes.where(F.col("p") <= TOP)), ["p", "node"])
    deep = steps.where(F.col("p") > TOP).join(nodes.where(F.col("p") > TOP), ["p", "node"])
    return top.union(deep).where("x != h").select("id", "p", "x", "h")


def errata(words: DataFrame) -> DataFrame:
    """``(z, p, kind, word, n)``: each word of ``words(id, word, n)`` put beside each of its light edges with one error."""
    at = light_edges(words).join(words, "id")
    made = """inline(filter(array(
        named_struct('kind', 'R', 'z', concat(substring(word, 1, p), h, substring(word, p + 2))),
        named_struct('kind', 'S', 'z', concat(substring(word, 1, p), substring(word, p + 2))),
        named_struct('kind', 'I', 'z', concat(substring(word, 1, p), h, substring(word, p + 1)))),
        e -> e.kind = 'I' or x != '' and (e.kind = 'R' or x != substring(word, p + 2, 1))))"""
    return at.selectExpr("p", "word", "n", made)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best)`` of ``words(id, word, n)``: the number of words one edit away, and ``(-n, word)`` of the first of them.

    No group is unfolded into its pairs: two R entries of one node differ in a
    letter only, so a group has at most as many as the alphabet, and each member
    needs its size and its first two.
    """
    entries = written(errata(words), "errata")
    group = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word")))
    beside = entries.where("kind = 'R'").groupBy("z", "p").agg(group.alias("g")).where("size(g) > 1")
    beside = beside.select("g", F.size("g").alias("k"), F.explode("g").alias("m"))
    first = F.when(F.col("m") == F.col("g")[0], F.col("g")[1]).otherwise(F.col("g")[0])
    beside = beside.select(F.col("m")["word"].alias("word"), (F.col("k") - 1).cast("long").alias("near"), first.alias("best"))
    found = entries.select("z", "word", "n").join(words.select(F.col("word").alias("z"), F.col("n").alias("zn")), "z")
    ends = F.explode(F.array(
        F.struct(F.col("word").alias("of"), F.struct((-F.col("zn")).alias("less"), F.col("z").alias("word")).alias("best")),
        F.struct(F.col("z").alias("of"), F.struct((-F.col("n")).alias("less"), "word").alias("best")),
    ))
    met = found.select(ends.alias("e")).select(F.col("e.of").alias("word"), F.lit(1).cast("long").alias("near"), "e.best")
    return beside.union(met).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, depth: int) -> DataFrame:
    """``(word, root)``: the last of each chain of ``forms(word, form)`` of at most ``depth`` links, by pointer doubling."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, depth))))):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("__mesh_next"))
        before, now = now, written(now.join(onward, "root", "left").select("word", F.coalesce("__mesh_next", "root").alias("root")), "roots")
        forget(before)
    return now


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, a row for each word of ``docs(doc_id, text)``.

    A word's form is the most frequent word one edit away, the first in code-point
    order of equals, if it is at least ``ratio`` times as frequent; ``root`` follows
    forms to the last.  Null text has no words and a null doc_id is hashed as
    empty; repeated rows count as often as they stand.  Other columns are ignored;
    a table without words gives an empty result.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 a form need not be more frequent, so chains need not end")
    tune(docs.sparkSession)
    words = written(vocabulary(docs, min_length, min_count, noise).withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words.select("id", "word", "n"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    found = written(found, "forms")
    # A form is at least ratio times as frequent, so the largest count bounds the length of chains.
    most = found.agg(F.max("n")).first()[0] or 1
    ends = roots(found.where("form is not null"), int(math.log(most, ratio)) + 1)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = rf"""
WITH RECURSIVE {CRC_TABLE.strip()},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT run, concat(doc_id, ':', run) AS k, count(*) AS n FROM r WHERE length(run) >= {MIN_LENGTH} GROUP BY run, k),
h AS (SELECT run, n, {crc_sql("k")} AS h FROM o, crc),
c AS (SELECT CASE WHEN h % {NOISE} = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
x AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less FROM p),
e AS (
  SELECT a.word AS a, b.word AS b FROM x AS a JOIN x AS b ON a.i = b.i AND a.less = b.less AND a.word != b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.less = w.word
  UNION SELECT w.word, x.word FROM x JOIN w ON x.less = w.word),
b AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {{'less': -n, 'word': b}}) AS form, max(n) AS form_n FROM e JOIN w ON w.word = e.b GROUP BY a),
f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n
  FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM f UNION ALL
      SELECT s.word, coalesce(f.form, s.at), f.form IS NULL FROM s JOIN f ON f.word = s.at WHERE NOT s.done)
SELECT word, form, s.at AS root, n, n_near, form_n FROM f JOIN s USING (word) WHERE s.done
"""

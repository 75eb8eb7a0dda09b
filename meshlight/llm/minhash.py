"""Near-duplicate detection with BagMinHash.

Documents are bags of five-word shingles.  BagMinHash draws, for every shingle
and every unit of its multiplicity, a Poisson process of points (time, slot); a
signature slot keeps the earliest time of all points that fall in it, so two
slots agree with exactly the weighted Jaccard similarity of the bags.  The units
are grouped hierarchically in dyadic blocks (1], (1, 2], (2, 4], ...; one process of the
block's whole rate stands for all its units, and a block covered in part keeps
the points whose level lies under the multiplicity).  Points are drawn in
ascending time and a process stops once its time passes the largest slot of its
document, which takes about ``n + m log m`` points instead of ``n * m``.

Candidates share a band of slots and agree in enough slots of a short signature
(eight bits a slot); each is verified on the exact multiset overlap.  Buckets of
many members that the leaders leave apart are compared in blocks instead, on the
exact overlap of all their members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import arrow_map, forget, key_words, maybe_among, release, written
from .tokens import CHUNK_BYTES, U64, chunks, group_hash, mix, shingles, span_hash, split_words

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
MARGIN = 0.25  # by which the share of agreeing slots of a pair may lie under its similarity
SMALL = 32  # members of a bucket whose pairs are joined; larger ones are compared in blocks
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
LANES = 7  # slots in a long of the short signature: eight bits and a guard bit each


def bag(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with multiplicities, sorted by document."""
    if not len(h):
        return h, doc, doc
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, doc: np.ndarray, count: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash of weighted items: float64 [docs, slots]; inf where a document has no item."""
    sig = np.full(docs * slots, np.inf)
    if not len(h):
        return sig.reshape(docs, slots)
    # One process for each item and dyadic block (2**(b-1), 2**b]; block 0 is the unit (0, 1].
    blocks = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64), 0) + 1
    item = np.repeat(np.arange(len(h)), blocks)
    block = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0))
    below = np.where(block == 0, 0, size)
    reach = np.minimum(count[item] - below, size)  # levels of the block under the multiplicity
    seed = mix(h[item] ^ (block.astype(U64) * U64(0xD6E8FEB86659FD93)))
    base, rate, time = doc[item] * slots, size.astype(np.float64), np.zeros(len(item))
    full = reach == size
    step = 0
    while len(seed):
        step += 1
        r = mix(seed + U64(step * 0xA24BAED4963EE407 % 2**64))
        time = time - np.log1p((r >> U64(11)) * -(2.0**-53)) / rate
        r = mix(r)
        slot = ((r >> U64(40)) * U64(slots) >> U64(24)).astype(np.int64)
        ok = full | ((r & U64(0xFFFFFFFF)) % size.astype(U64) < reach.astype(U64))
        np.minimum.at(sig, (base + slot)[ok], time[ok])
        live = time < sig.reshape(docs, slots).max(axis=1)[base // slots]
        seed, base, rate, time, full, size, reach = (x[live] for x in (seed, base, rate, time, full, size, reach))
    return sig.reshape(docs, slots)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _sketch(k: int, bands: int, rows: int):
    slots = bands * rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, shorts, buckets, some, sizes = [], [], [], [], []
        for t in chunks(batch.column("text")):
            words, folded = split_words(t)
            h = span_hash(folded, words.start, words.end)
            raw = span_hash(t.data, t.start, t.end)
            empty = np.diff(words.first) == 0
            key = np.stack([group_hash(h, words.first), group_hash(mix(h), words.first)], axis=1)
            key[empty, 0], key[empty, 1] = raw[empty], ~raw[empty]
            keys.append(key)
            sig = signatures(*bag(*shingles(h, words.first, k)), len(t.start), slots)
            bits = mix(sig.view(U64))
            n = len(bits)
            first = np.arange(n * bands + 1) * rows
            band = group_hash(bits.ravel(), first).reshape(n, bands)
            buckets.append(mix(band + np.arange(bands, dtype=U64)).view(np.int64))
            short = np.zeros((n, -(-slots // LANES) * LANES), U64)
            short[:, :slots] = bits & U64(0xFF)
            short = short.reshape(n, -1, LANES) << (np.arange(LANES, dtype=U64) * U64(9))
            shorts.append(np.bitwise_or.reduce(short, axis=2).view(np.int64))
            some.append(~empty)
            sizes.append(t.end - t.start)
        key = np.concatenate(keys)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)),
                pa.array(np.concatenate(some)), pa.array(np.concatenate(sizes).astype(np.int64)), _lists(np.concatenate(shorts)), _lists(np.concatenate(buckets)),
            ],
            ["doc_id", "k1", "k2", "words", "size", "sig", "buckets"],
        )

    return run


def _agreeing(x: str, y: str, slots: int):
    """Number of slots in which two short signatures agree: a lane of the XOR that is not zero reaches its guard bit."""
    ones = sum(0xFF << (9 * i) for i in range(LANES))
    guard = sum(0x100 << (9 * i) for i in range(LANES))
    differ = F.lit(0)
    for i in range(-(-slots // LANES)):
        d = F.col(f"{x}.sig")[i].bitwiseXOR(F.col(f"{y}.sig")[i])
        differ = differ + F.bit_count((d + F.lit(ones)).bitwiseAND(F.lit(guard)))
    return F.lit(slots) - differ


def overlap(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Exact multiset Jaccard similarity of the shingles of each pair of texts."""
    out = np.zeros(len(a))
    a, b = a.cast(pa.large_string()), b.cast(pa.large_string())
    size = np.asarray(pc.binary_length(a)) + np.asarray(pc.binary_length(b))
    lo = 0
    while lo < len(a):
        # pairs of about CHUNK_BYTES together, one at least
        hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo : lo + 64]), CHUNK_BYTES, "right")))
        x, y = a.slice(lo, hi - lo), b.slice(lo, hi - lo)
        order = np.arange(2 * len(x)).reshape(2, -1).T.ravel()  # a0 b0 a1 b1 ..., so a pair stays together
        for t in chunks(pa.concat_arrays([x, y]).take(pa.array(order)), 1 << 62):
            words, folded = split_words(t)
            h, doc, count = bag(*shingles(span_hash(folded, words.start, words.end), words.first, k))
            pair, n = doc // 2, len(x)
            order2 = np.lexsort((doc, h, pair))
            h, pair, count = h[order2], pair[order2], count[order2]
            total = np.bincount(pair, count, n)
            same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
            common = np.bincount(pair[1:][same], np.minimum(count[1:], count[:-1])[same], n)
            out[lo:hi] = common / np.maximum(total - common, 1)
        lo = hi
    return out


def _verify(k: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sim = overlap(batch.column("ta"), batch.column("tb"), k)
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim)], ["a", "b", "similarity"])

    return run


def _units(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text its shingles, the n-th occurrence of one as a unit of its own, so that overlaps of sets are those of bags."""
    units, owner = [], []
    for t in chunks(texts):
        words, folded = split_words(t)
        h, doc, count = bag(*shingles(span_hash(folded, words.start, words.end), words.first, k))
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        units.append(mix(np.repeat(h, count) + nth.astype(U64) * U64(0xD6E8FEB86659FD93)))
        owner.append(np.repeat(doc, count) + t.lo)
    return (np.concatenate(units), np.concatenate(owner)) if units else (np.zeros(0, U64), np.zeros(0, np.int64))


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int, cols: int) -> np.ndarray:
    """Number of units that text i of ``a`` and text j of ``b`` share, for all i < rows and j < cols.

    Units that many texts hold go through a matrix product, a block of units at
    a time; for the others the pairs of texts that hold them are counted.
    """
    out = np.zeros((rows, cols))
    known = np.intersect1d(a[0], b[0])
    if not len(known):
        return out
    sides = []
    for units, owner in (a, b):
        at = np.searchsorted(known, units)
        mine = known[np.minimum(at, len(known) - 1)] == units
        order = np.argsort(at[mine], kind="stable")
        sides.append((at[mine][order], owner[mine][order]))
    (au, ao), (bu, bo) = sides
    na, nb = np.bincount(au, minlength=len(known)), np.bincount(bu, minlength=len(known))
    dense = na * nb * 64 >= rows * cols
    column = np.cumsum(dense) - 1
    for lo in range(0, int(dense.sum()), 1024):
        x, y = np.zeros((rows, 1024), np.float32), np.zeros((cols, 1024), np.float32)
        for m, u, o in ((x, au, ao), (y, bu, bo)):
            use = dense[u] & (column[u] >= lo) & (column[u] < lo + 1024)
            m[o[use], column[u[use]] - lo] = 1
        out += x @ y.T
    light = np.flatnonzero(~dense[au])
    per, start = nb[au[light]], (np.cumsum(nb) - nb)[au[light]]
    done = np.cumsum(per)
    lo = 0
    while lo < len(light):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + (1 << 20), "right")))
        n = per[lo:hi]
        j = np.repeat(start[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(ao[light[lo:hi]], n) * cols + bo[j], minlength=rows * cols).reshape(rows, cols)
        lo = hi
    return out


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """One row for each node but the first of every component of the bipartite links: (a node, the component's least)."""
    out, free = [], linked.any(axis=1)
    while free.any():
        rows, cols = np.zeros(len(left), bool), np.zeros(len(right), bool)
        rows[np.argmax(free)] = True
        while True:
            cols = linked[rows].any(axis=0)
            more = rows | linked[:, cols].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        free &= ~rows
        nodes = np.unique(np.concatenate([left[rows], right[cols]]))
        out += [(int(x), int(nodes[0])) for x in nodes[1:]]
    return out


def _compare(k: int, threshold: float):
    """Links of a pair of blocks; the rows of its left block have ``side`` 0, of its right 1, of a block with itself 2."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side, node = group.column("side").to_numpy(), group.column("node").to_numpy()
        units, owner = _units(group.column("text").combine_chunks(), k)
        size = np.bincount(owner, minlength=len(node))
        parts = []
        for mine in (side != 1, side != 0):
            new = np.cumsum(mine) - 1
            use = mine[owner]
            parts.append((units[use], new[owner[use]]))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        common = overlaps(*parts, len(left), len(right))
        linked = common >= threshold * (size[left][:, None] + size[right][None, :] - common)
        linked &= node[left][:, None] != node[right][None, :]
        found = _forest(linked, node[left], node[right])
        del parts, units, owner, common, linked
        release()
        return pa.table({"a": pa.array([y for _, y in found], pa.int64()), "b": pa.array([x for x, _ in found], pa.int64())})

    return run


def wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of ``ids(doc_id)``, each doc_id once.

    The ids first go, as bits of a filter of fixed size, to where the texts are
    read, so that few other texts are exchanged; the join after it decides.
    """
    near = maybe_among(docs, key_words(ids, F.xxhash64("doc_id")), F.xxhash64("doc_id")).where("__mesh_maybe").select("doc_id", "text")
    return near.join(ids.hint("shuffle_merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def verified(pairs: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``doc_id`` whose texts reach the threshold."""
    texts = wanted(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b").select("a", "b", "ta", "tb")
    return arrow_map(both, _verify(k), "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def _in_blocks(members: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) that connect what the exact links within each bucket of ``members(bucket, node, component, size)`` connect.

    The members outside a bucket's largest component are compared with each
    other and with that component, in blocks of about ``BLOCK_ROWS`` texts or
    ``BLOCK_BYTES``; each pair of blocks is a task's group of its own, so none
    grows with the bucket, and only a spanning forest of its links comes out.
    """
    per = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    top = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "component")).alias("top"))

    def blocks(n, size):
        return F.ceil(F.greatest(n / BLOCK_ROWS, size / BLOCK_BYTES, F.lit(1e-9))).cast("int")

    top = top.select(
        "bucket", F.col("top.component").alias("core"), blocks(F.col("top.n"), F.col("top.bytes")).alias("inner"),
        blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("outer"),
    )
    rows = members.join(top, "bucket").withColumn("is_core", F.col("component") == F.col("core"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("is_core"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))

    def key(kind, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    own, outer, inner = F.col("block"), F.sequence(F.lit(0), F.col("outer") - 1), F.sequence(F.lit(0), F.col("inner") - 1)
    with_core = F.transform(inner, lambda j: key(1, own, j, F.lit(0)))
    with_outer = F.transform(outer, lambda j: key(0, F.least(own, j), F.greatest(own, j), F.when(own < j, 0).when(own > j, 1).otherwise(2)))
    from_core = F.transform(outer, lambda i: key(1, i, own, F.lit(1)))
    meets = F.when(F.col("is_core"), from_core).otherwise(F.concat(with_core, with_outer))
    texts = wanted(docs, members.select(F.col("node").alias("doc_id")).distinct()).select(F.col("doc_id").alias("node"), "text")
    rows = rows.select("bucket", "node", meets.alias("meets")).join(texts.hint("shuffle_merge"), "node")
    rows = rows.select("bucket", "node", "text", F.explode("meets").alias("m")).select("bucket", "node", "text", "m.*")
    return rows.groupBy("bucket", "kind", "i", "j").applyInArrow(_compare(k, threshold), "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``(doc_id, class_id, keep)``, one row for each row of ``docs(doc_id, text)``.

    A class is a connected component of the links: equal word sequences, or a
    multiset Jaccard similarity of ``words``-word shingles of at least
    ``similarity``.  ``class_id`` is the least doc_id of the class, whose row is
    kept.  With 24 bands of 4 slots a pair at the threshold shares no band with
    probability below 4e-6.

    Equal texts are one node from the start, so a group of copies costs one
    node.  In every bucket a leader is compared with all members: the member that
    meets most others over its buckets, which the others are copies of if any is.
    Pairs of a bucket that are in different components after that are compared
    too: in a bucket of at most ``SMALL`` members whenever their signatures agree
    in ``similarity - MARGIN`` of the slots, which a pair at the threshold misses
    with probability 1e-9 and which also decides for the leader; in a larger one
    all of them, in blocks.  No pair is left out by a cap.  For a large bucket whose
    members stay apart the time grows with the square of their number, and so do
    the rows exchanged, each member's text once for every ``BLOCK_ROWS`` others; the
    memory of a task does not.

    Null text reads as empty; texts without words are alike only if equal.
    Rows that share a doc_id belong to one class, whatever their texts, and link it
    to all that any of them is like.  Rows with a null doc_id form no links: their
    class_id is null and they are kept.  Other columns are ignored, an empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = "doc_id long, k1 long, k2 long, words boolean, size long, sig array<long>, buckets array<long>"
    sketch = written(arrow_map(docs, _sketch(words, bands, rows), schema), "sketch")
    keyed = sketch.where("doc_id is not null")
    text_of = F.struct("k1", "k2")
    several = keyed.groupBy("doc_id").agg(F.min(text_of).alias("lo"), F.max(text_of).alias("hi")).where("lo != hi").select("doc_id")
    several = written(several, "several")
    links = ids = None
    if not several.isEmpty():
        docs, links, ids = _apart(docs, several)
        keyed = written(arrow_map(docs, _sketch(words, bands, rows), schema), "sketch").where("doc_id is not null")
    known = _classes(docs, keyed, links, words, similarity, bands * rows)
    if ids is not None:
        # back from the ids of rows to those of documents
        known = known.join(ids.withColumnRenamed("row_id", "doc_id"), "doc_id", "left").select(F.coalesce("was", "doc_id").alias("doc_id"), "class_id")
        known = written(known, "known")
        least = known.groupBy("class_id").agg(F.min("doc_id").alias("least"))
        known = known.join(least, "class_id").select("doc_id", F.col("least").alias("class_id"))
    none = sketch.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return known.union(none).withColumn("keep", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _apart(docs: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` with ids of their own for the rows of ``several(doc_id)``, links ``(u, v)`` between those of a document, and ``(row_id, was)``.

    Only rows that may have such an id are exchanged.
    """
    marked = maybe_among(docs, key_words(several, F.xxhash64("doc_id")), F.xxhash64("doc_id"))
    alone = marked.where("not __mesh_maybe or doc_id is null").select("doc_id", "text")
    rest = marked.where("__mesh_maybe and doc_id is not null").select("doc_id", "text")
    top = docs.agg(F.max("doc_id")).first()[0]
    rows = rest.join(several.hint("shuffle_merge"), "doc_id", "left_semi")
    rows = written(rows.select(F.col("doc_id").alias("was"), "text", (F.lit(top) + 1 + F.monotonically_increasing_id()).alias("doc_id")), "apart")
    ids = rows.select(F.col("doc_id").alias("row_id"), "was")
    first = ids.groupBy("was").agg(F.min("row_id").alias("v"))
    links = ids.join(first, "was").where("row_id != v").select(F.col("row_id").alias("u"), "v")
    others = alone.union(rest.join(several.hint("shuffle_merge"), "doc_id", "left_anti"))
    return others.union(rows.select("doc_id", "text")), written(links, "shared"), ids


def _classes(docs: DataFrame, keyed: DataFrame, shared: DataFrame | None, words: int, similarity: float, slots: int) -> DataFrame:
    """``(doc_id, class_id)`` of ``docs`` where each id has one sequence of words, with ``shared(u, v)`` as links besides."""
    least = int((similarity - MARGIN) * slots)
    nodes = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    member = written(keyed.select("doc_id", "k1", "k2").join(nodes, ["k1", "k2"]).select("doc_id", "node"), "member")
    reps = member.where("doc_id = node").select("node").distinct()
    sigs = keyed.where("words").select(F.col("doc_id").alias("node"), "size", "sig", "buckets")
    sigs = written(sigs.join(reps.hint("shuffle_merge"), "node", "left_semi").dropDuplicates(["node"]), "signature")
    spread = sigs.select("node", "size", F.explode("buckets").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    inside = written(spread.join(sizes, "bucket"), "bucket")
    met = inside.join(inside.groupBy("node").agg(F.sum("n").alias("met")), "node")
    leaders = met.groupBy("bucket").agg(F.max(F.struct("met", -F.col("node"))).alias("most")).select("bucket", (-F.col("most.col2")).alias("leader"))
    stars = inside.join(leaders, "bucket").select("node", "leader").where("node != leader")
    pairs = written(
        stars.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs"
    )
    sig = sigs.select("node", "sig").hint("shuffle_merge")
    close = pairs.join(sig.alias("x"), F.col("a") == F.col("x.node")).join(sig.alias("y"), F.col("b") == F.col("y.node"))
    close = written(close.where(_agreeing("x", "y", slots) >= least).select("a", "b"), "close")
    shared = _between(member, shared)
    links = written(verified(close, docs, words, similarity).select("a", "b"), "links")
    parts = written(connected_components(links.select(F.col("b").alias("u"), F.col("a").alias("v")).union(shared), written), "parts")

    # Members that still lie in different components of one bucket.
    comp = inside.select("bucket", "node", "size", "n").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = comp.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    open_ = written(comp.join(split.select("bucket"), "bucket", "left_semi"), "open")
    few = open_.where(F.col("n") <= SMALL).join(sig, "node")
    x, y = few.alias("x"), few.alias("y").hint("shuffle_merge")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    rest = x.join(y, apart & (_agreeing("x", "y", slots) >= least)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    rest = written(rest.join(pairs.hint("shuffle_merge"), ["a", "b"], "left_anti"), "rest")
    more = written(verified(rest, docs, words, similarity).select("a", "b"), "more")
    many = written(_in_blocks(open_.where(F.col("n") > SMALL), docs, words, similarity), "blocks")
    every = links.union(more).union(many)
    final = connected_components(every.select(F.col("b").alias("u"), F.col("a").alias("v")).union(shared), written)
    forget(sigs, inside, pairs, close, links, parts, open_, rest, more, many)
    return member.join(final, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))


def _between(member: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Links between rows as links between the nodes that stand for their texts."""
    if shared is None:
        return member.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    node = member.distinct()
    both = shared.join(node.toDF("u", "x"), "u").join(node.toDF("v", "y"), "v").where("x != y")
    return both.select(F.col("x").alias("u"), F.col("y").alias("v"))

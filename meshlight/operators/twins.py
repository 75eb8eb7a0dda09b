"""Twins: whole texts scanned for the names of definitions in other languages, in one pass for all names.

Every identifier of every text, and what follows as far as a name may begin so, is
looked up in the names as a whole; a filter of fixed size, made of all names and
their beginnings, leaves out most of the rest before anything is exchanged.  There is
no limit on the number of names.  A match belongs to the innermost
block around it that is in another language than the name's definition; it is found
where the text is, so that matches are exchanged once, counted by block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bridges import worthy_name
from .storage import save

#: Kinds that can be the target of a twin (fixed values).
TARGETS = [
    "function_definition", "function_declaration", "function_item", "method_definition", "method_declaration", "class_declaration", "class_definition",
    "class_specifier", "struct_specifier", "type_spec", "interface_declaration", "struct_item", "enum_item", "trait_item", "type_item",
]
#: Places whose texts are not scanned (fixed values).
SKIPPED = r"noxfile|/docs/|/guide/|/site/|glossary|/\.github/|conftest\.py"
#: Code points of a bin of a file's blocks; rows of a batch of the scan.
BIN, ROWS = 256, 1 << 16
FILTER_BITS = 1 << 22
_WORD = re.compile(r"\w+")


def target_score(name: Column, file: Column, kind: Column) -> Column:
    """Product code before fixtures, long names before short, functions before types."""
    f = F.lower(file)
    demo = F.when(f.contains("/examples/"), F.when(kind.contains("function") | name.contains("_"), 15).otherwise(-10)).otherwise(0)
    return (
        F.when(f.rlike("/fixtures/|/bench"), -40).otherwise(0) + demo + F.when(f.rlike("/src/|/lib/|/include/"), 25).otherwise(0)
        + F.least(F.octet_length(name), F.lit(40)) + F.when(kind.rlike("function|method"), 10).otherwise(0)
    )


def block_score(kind: Column, name: Column) -> Column:
    """Functions before types before the rest, calls last; named ones before unnamed."""
    k = F.lower(kind)
    base = F.when(k.rlike("function|method"), 50).when(k.rlike("class|struct|impl|interface|trait"), 40).when(k.contains("call"), -20).otherwise(0)
    return base + F.when((F.octet_length(name) >= 3) & (name != "test_default"), 10).otherwise(0)


def twin_targets(nodes: DataFrame) -> DataFrame:
    """``(name, dst, dst_lang)``: for each worthy name its best definition outside of tests, by score and id."""
    fit = nodes.where(F.col("kind").isin(*TARGETS) & worthy_name(F.col("name")) & ~F.lower("file").rlike(r"_test\.|/tests?/"))
    best = F.min(F.struct((-target_score(F.col("name"), F.col("file"), F.col("kind"))).alias("s"), "id", "lang")).alias("b")
    return fit.groupBy("name").agg(best).select("name", F.col("b.id").alias("dst"), F.col("b.lang").alias("dst_lang"))


def _keyed(names: DataFrame) -> DataFrame:
    """``(name, core, lead, tail)``: each name that has a letter or digit, its part from the first identifier to the last, and the number of signs on both sides of it."""
    keyed = names.select("name").distinct().withColumn("core", F.regexp_extract("name", r"(?Us)[\p{L}\p{N}_](?:.*[\p{L}\p{N}_])?", 0)).where("core <> ''")
    return keyed.withColumn("lead", F.instr("name", F.col("core")) - 1).withColumn("tail", F.length("name") - F.col("lead") - F.length("core"))


def _name_filter(keyed: DataFrame) -> list[np.ndarray]:
    """Bits for the hashes of all cores of ``_keyed``, of what they begin with up to each of their other words, and of the names; of a fixed size whatever their number."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for name, core in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = at = 0
                for m in _WORD.finditer(core):
                    h, at = zlib.crc32(core[at : m.end()].encode(), h), m.end()
                    found[0].append(h % FILTER_BITS)
                    found[1].append(int(at < len(core)))
                found[0].append(zlib.crc32(name.encode()) % FILTER_BITS)
                found[1].append(2)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int32())], ["h", "of"])

    words = keyed.select("name", "core").mapInArrow(hashes, "h long, of int").groupBy("of", F.shiftright("h", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("bits"))
    out = np.zeros((3, FILTER_BITS >> 5), np.uint32)
    for r in words.collect():  # at most 3 * FILTER_BITS / 32 rows
        out[r.of, r.w] = r.bits
    return [*out]


def _flags(filters: list[np.ndarray]) -> bytes:
    """A byte for each bit of all filters: 1 for a core, 2 for what one begins with, 4 for a name."""
    bits = [np.unpackbits(x.astype("<u4").view(np.uint8), bitorder="little") << k for k, x in enumerate(filters)]
    return np.bitwise_or.reduce(bits).tobytes()


def _cores(text: str, flags: bytes) -> Iterator[tuple[int, int, str, str]]:
    """``(begin, finish, before, after)`` of what may be a core, with the signs on both sides.

    From each identifier the scan goes on for as long as a core may begin so.
    """
    crc, spans = zlib.crc32, [m.span() for m in _WORD.finditer(text)]
    last = len(spans) - 1
    for i, (a, z) in enumerate(spans):
        h, k = crc(text[a:z].encode()), i
        while f := flags[h % FILTER_BITS] & 3:
            if f & 1:
                # Where the text begins or ends a line break stands for it, which no name reaches.
                yield a, z, text[spans[i - 1][1] : a] if i else "\n" + text[:a], text[z : spans[k + 1][0]] if k < last else text[z:] + "\n"
            if not f & 2 or k == last:
                break
            k += 1
            h, z = crc(text[z : spans[k][1]].encode(), h), spans[k][1]


def occurrences(files: DataFrame, names: DataFrame) -> DataFrame:
    """``(file, begin, finish, name)``: where ``names(name)`` stand in ``files(file, source)`` as whole words, in code points.

    Names without a letter or digit, and null texts, occur nowhere.  Occurrences may
    overlap; repeated rows of a file are repeated.  A core meets its names as a whole,
    so no text is joined to candidates.
    """
    keyed = _keyed(names)
    filters = _name_filter(keyed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _flags(filters)
        found: tuple[list, ...] = ([], [], [], [], [])

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(f, pa.int32() if k == 1 else pa.string()) for k, f in enumerate(found)], ["file", "at", "core", "before", "after"])
            for f in found:
                f.clear()
            return made

        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, z, before, after in _cores(text or "", flags):
                    for column, v in zip(found, (file, a, text[a:z], before, after), strict=True):
                        column.append(v)
                    if len(found[0]) >= ROWS:
                        yield out()
        if found[0]:
            yield out()

    met = files.select("file", "source").mapInArrow(scan, "file string, at int, core string, before string, after string").join(keyed, "core")
    head = (F.col("lead") < F.length("before")) & (F.expr("right(before, lead)") == F.expr("left(name, lead)"))
    foot = (F.col("tail") < F.length("after")) & (F.expr("left(after, tail)") == F.expr("right(name, tail)"))
    return met.where(head & foot).select("file", (F.col("at") - F.col("lead")).alias("begin"), (F.col("at") - F.col("lead") + F.length("name")).alias("finish"), "name")


#: A block as the scan sees it: score, begin, finish, id and language.
Block = tuple[int, int | None, int | None, str, str | None]


def _two(blocks: Iterable[Block]) -> tuple[Block | None, Block | None]:
    """The first block, and the first of another language than its."""
    one = None
    for b in blocks:
        if one is None:
            one = b
        elif b[4] != one[4]:
            return one, b
    return one, None


def _sources(blocks: list[Block]):
    """A function from a match's span to its block and, for names of that block's language, the next best of another."""
    bins: dict[int, list[Block]] = {}
    held = [b for b in blocks if b[1] is not None and b[2] is not None and b[1] < b[2]]
    for b in sorted(held, key=lambda b: (-b[0], b[2] - b[1], b[3])):
        for k in range(b[1] // BIN, (b[2] - 1) // BIN + 1):
            bins.setdefault(k, []).append(b)
    best = _two(sorted(blocks, key=lambda b: (-b[0], b[3])))

    def of(begin: int, finish: int) -> tuple[Block | None, Block | None]:
        one, two = _two(b for b in bins.get(begin // BIN, ()) if b[1] <= begin and finish <= b[2])
        if one is None:
            return best
        return one, two or (best[0] if best[0][4] != one[4] else best[1])

    return of


def _named(texts: list[str], sides: list[tuple[int, int]], flags: bytes) -> Iterator[tuple[int, int, str]]:
    """``(begin, finish, name)`` of what may be a name with ``sides`` (lead, tail), once for all texts of a file."""
    seen: set | None = set() if len(texts) > 1 else None
    for text in texts:
        for a, z, before, after in _cores(text, flags):
            for lead, tail in sides:
                if lead < len(before) and tail < len(after):
                    row = (a - lead, z + tail, text[a - lead : z + tail])
                    if flags[zlib.crc32(row[2].encode()) % FILTER_BITS] & 4 and (seen is None or row not in seen):
                        if seen is not None:
                            seen.add(row)
                        yield row


def text_twins(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``(src, dst, n)``: blocks whose text names a definition in another language, and how often.

    ``nodes(id, name, file, kind, lang, begin, finish)`` have spans in code points of
    ``files(file, source)``.  A match goes to the block around it with the best
    score, then the innermost, then the least id; one that no block of another
    language holds goes to the best such block of its file, the first by id; if the
    file has none it is left out.

    The language of a name is not known where its text is scanned, but only the best
    block and the best of another language than that one's can be chosen.  So texts
    and blocks meet by file, and matches leave it as numbers of a name and two blocks.
    """
    targets = save(twin_targets(nodes), "targets")
    keyed = save(_keyed(targets), "names")
    filters = _name_filter(keyed)
    sides = sorted((r.lead, r.tail) for r in keyed.select("lead", "tail").distinct().collect())  # as many as there are kinds of signs around names
    texts = files.where(F.col("file").isNotNull() & F.col("source").isNotNull() & ~F.lower("file").rlike(SKIPPED))
    block = F.struct(block_score(F.col("kind"), F.col("name")).alias("score"), F.col("begin").cast("int").alias("a"), F.col("finish").cast("int").alias("z"), F.col("id").alias("src"), "lang")
    blocks = nodes.where(~F.lower("file").rlike(SKIPPED)).select("file", block.alias("block"))
    parts = texts.select("file", "source", F.lit(None).cast(blocks.schema["block"].dataType).alias("block")).union(blocks.select("file", F.lit(None).cast("string"), "block"))
    whole = parts.groupBy("file").agg(F.collect_list("source").alias("texts"), F.collect_list("block").alias("blocks")).where((F.size("texts") > 0) & (F.size("blocks") > 0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _flags(filters)
        found: tuple[list, ...] = ([], [], [], [], [])

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(f, pa.int64() if k == 4 else pa.string()) for k, f in enumerate(found)], ["name", "src", "lang", "other", "n"])
            for f in found:
                f.clear()
            return made

        for batch in batches:
            lists = batch.column(1)
            at, rows = lists.offsets.to_pylist(), list(zip(*(f.to_pylist() for f in lists.values.flatten()), strict=True))
            for k, own in enumerate(batch.column(0).to_pylist()):
                of, met = _sources(rows[at[k] : at[k + 1]]), Counter()
                for begin, finish, name in _named(own, sides, flags):
                    met[name, *of(begin, finish)] += 1
                for (name, one, two), n in met.items():
                    for column, v in zip(found, (name, one[3], one[4], two and two[3], n), strict=True):
                        column.append(v)
                if len(found[0]) >= ROWS:
                    yield out()
        if found[0]:
            yield out()

    met = whole.select("texts", "blocks").mapInArrow(scan, "name string, src string, lang string, other string, n long").join(targets, "name")
    src = F.when(~F.col("lang").eqNullSafe(F.col("dst_lang")), F.col("src")).otherwise(F.col("other"))
    return met.select(src.alias("src"), "dst", "n").where("src is not null").groupBy("src", "dst").agg(F.sum("n").alias("n"))

"""What differs between two versions of a text, for tables of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

COLUMNS = ("start", "old_end", "new_end", "start_row", "start_column", "old_end_row", "old_end_column", "new_end_row", "new_end_column")


def _differs(a: np.ndarray, b: np.ndarray) -> int:
    """The first place where two arrays of one length differ, or their length."""
    at, step = 0, 4096
    while at < len(a):
        here = a[at : at + step] != b[at : at + step]
        if here.any():
            return at + int(here.argmax())
        at, step = at + step, step * 2
    return len(a)


def _point(raw: bytes, at: int) -> tuple[int, int]:
    """Row, and column in characters, of an offset in bytes."""
    line = np.frombuffer(raw, np.uint8)[raw.rfind(b"\n", 0, at) + 1 : at]
    return raw.count(b"\n", 0, at), int(np.count_nonzero(line & 0xC0 != 0x80))


def edit_region(old: str, new: str) -> tuple[int, ...]:
    """The bytes between the longest common prefix and the longest common suffix after it, no character split; then the three points."""
    a, b = old.encode(), new.encode()
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    start = _differs(x[:n], y[:n])
    while 0 < start < len(x) and x[start] & 0xC0 == 0x80:
        start -= 1
    same = _differs(x[start:][::-1][: n - start], y[start:][::-1][: n - start])
    ends = []
    for z in (x, y):
        end = len(z) - same
        while end < len(z) and z[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
    return (start, *ends, *_point(a, start), *_point(a, ends[0]), *_point(b, ends[1]))


def edit_regions(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the region that differs between ``old`` and ``new`` in place of both; null reads as empty."""
    kept = pairs.drop("old", "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.num_columns - 2
                rows = [edit_region(o or "", w or "") for o, w in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
                made = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*batch.schema.names[:n], *COLUMNS])

    schema = StructType([*kept.schema.fields, *(StructField(c, LongType()) for c in COLUMNS)])
    return pairs.select(*(f"`{c}`" for c in kept.columns), "old", "new").mapInArrow(run, schema)

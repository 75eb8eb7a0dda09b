"""Vectorised text kernels over Arrow string columns.

Texts of a batch are laid end to end as UTF-8 bytes and treated together, so the
cost of a numpy call is paid once for a few megabytes.  A word is a run of ASCII
letters and digits (A-Z folded) and of bytes from 0x80 up, that is of all code
points beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEP = 0xFF  # in no UTF-8 text
CHUNK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:255] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64) * U64(0x632BE59BD9B4E019))
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse, modulo 2**64, for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = (n >> 18) + 1 << 18
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


class Texts(NamedTuple):
    """Rows lo..hi of a batch; text i is data[start[i]:end[i]], followed by SEP."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Slices of a string column of about ``limit`` bytes; null reads as empty.

    One text is never split, however long it is.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        ends = offsets[lo + 1 : hi + 1] - offsets[lo]
        n = np.arange(hi - lo)
        out = np.insert(data[offsets[lo] : offsets[hi]], ends, SEP)
        yield Texts(lo, hi, out, offsets[lo:hi] - offsets[lo] + n, ends + n)
        lo = hi


class Words(NamedTuple):
    """Byte spans of words in a chunk, the text each is in, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # len(texts) + 1


def split_words(t: Texts, folded: np.ndarray | None = None) -> tuple[Words, np.ndarray]:
    folded = _FOLD[t.data] if folded is None else folded
    inside = np.empty(len(folded) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = _WORD[folded]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    first = np.searchsorted(start, np.append(t.start, len(folded)))
    doc = np.repeat(np.arange(len(t.start)), np.diff(first))
    return Words(start, end, doc, first), folded


def span_hash(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span that depends on its bytes alone."""
    n = len(folded)
    power, inverse = powers(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[folded] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))


def group_hash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the sequence h[first[i]:first[i+1]] for each i."""
    power, inverse = powers(len(h) + 1)
    total = np.empty(len(h) + 1, U64)
    total[0] = 0
    np.cumsum(h * power[: len(h)], out=total[1:])
    a, b = first[:-1], first[1:]
    return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(U64))


_LANE = mix(np.arange(64, dtype=U64) + U64(77)) | U64(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the text each is in, in text order.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    n, docs = len(h), len(first) - 1
    count = np.diff(first)
    m = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
    doc = np.repeat(np.arange(docs), m)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m) + first[:-1][doc]
    out = np.zeros(len(doc), U64)
    stop = first[1:][doc]
    for j in range(k):
        pos = at + j
        if j:
            ok = pos < stop
            out += np.where(ok, h[np.minimum(pos, n - 1)] * _LANE[j], U64(0x5BD1E995 + j))
        else:
            out += h[pos] * _LANE[0]
    return mix(out), doc


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset 0..len, the number of code points that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out

"""Progressive JPEG in numpy: many images of a batch are coded side by side.

The decoder accumulates the scans of an image (spectral selection and successive
approximation, DC and AC, first and refining) into coefficient arrays.  Entropy
coded segments, that is what lies between restart markers, of all scans of one
kind and of all images of the batch are lanes of one loop: a step decodes a
symbol of every lane.  The planes are then inverse-transformed in numpy, chroma
is upsampled, and the full-resolution RGB tensor comes out.

Bytes are stored losslessly as quantised coefficients, 64 to a block, with all
quantiser steps one: the byte 0 is the coefficient 0, and the other bytes are the
magnitudes from 2 up with either sign, bytes that are frequent in text first.
So text has no coefficient that the first scans leave at zero.  Blocks fill the
luma plane and then the two chroma planes (4:2:0).
"""

from __future__ import annotations

import heapq
import re
import struct
from typing import NamedTuple

import numpy as np

AC_RESTART, DC_RESTART = 8, 32  # blocks or MCUs between restart markers
MOST_COLUMNS = 4095  # MCUs in a row
COMMENT = b"payload-bytes="

#: Fixed values of the format: natural positions of the 64 coefficients in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), np.int64)

_FREQUENT = b" etnaoirshdlucmgfpvbywqkzjx.,\n" + bytes([0xC3, 0xA9, 0xA8]) + b"ETAOINSHRDLUCMGFPVBYWQKZJX"
_RANKED = [*dict.fromkeys([*_FREQUENT, *range(1, 256)])]
#: Coefficient of each byte, and the byte of each coefficient (from -BIAS up).
BIAS = 160
TO_COEF = np.zeros(256, np.int16)
TO_COEF[_RANKED] = [(2 + i // 2) * (1 - 2 * (i % 2)) for i in range(255)]
TO_BYTE = np.zeros(2 * BIAS, np.uint8)
TO_BYTE[TO_COEF + BIAS] = np.arange(256)


# ---------------------------------------------------------------- Huffman tables


def huffman_lengths(weights: dict[int, float]) -> tuple[list[int], list[int]]:
    """Counts of codes by length 1..16 and the symbols in code order; no code is all ones."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((0.0, len(heap), (-1,)))  # takes the longest code, which is then left out
    heapq.heapify(heap)
    length = dict.fromkeys([*weights, -1], 0)
    n = len(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            length[s] += 1
        n += 1
        heapq.heappush(heap, (a + b, n, x + y))
    bits = [0] * 64
    for s in length.values():
        bits[s] += 1
    for i in range(63, 16, -1):
        while bits[i] > 0:
            j = i - 2
            while bits[j] == 0:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    last = max(i for i in range(17) if bits[i])
    bits[last] -= 1
    order = sorted(weights, key=lambda s: (length[s], -weights[s], s))
    return bits[1:17], order


def codes(bits: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol (length 0: no code)."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    now = i = 0
    for n, count in enumerate(bits, 1):
        for _ in range(count):
            code[symbols[i]], size[symbols[i]] = now, n
            now += 1
            i += 1
        now <<= 1
    return code, size


def lookup(bits: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 leading bits: symbol * 32 + code length (0 where no code fits)."""
    out = np.zeros(1 << 16, np.int32)
    code, size = codes(bits, symbols)
    for s in symbols:
        out[code[s] << (16 - size[s]) : (code[s] + 1) << (16 - size[s])] = s * 32 + size[s]
    return out


def _weights(kind: str) -> dict[int, float]:
    """What symbols weigh in text that is stored byte by byte."""
    if kind == "dc":
        return {s: 1.0 / (1 + abs(s - 4)) for s in range(10)}
    if kind == "refine":
        out = {0x01: 1.0, 0xF0: 0.02} | {r << 4 | 1: 0.6 / (1 + r) for r in range(1, 16)}
        return out | {r << 4: 4.0 if r == 0 else 0.001 for r in range(15)}
    sizes = [0, 0.40, 0.38, 0.15, 0.06, 0.01, 0.002, 0.0002]  # magnitudes of bytes have 7 bits at most
    out = {r << 4 | s: sizes[s] * 0.02**r + 1e-7 for r in range(16) for s in range(1, 8)}
    return out | {0x00: 0.004, 0xF0: 0.0005} | {r << 4: 1e-6 for r in range(1, 15)}


_KINDS = ("dc", "first", "refine")
TABLES = {k: huffman_lengths(_weights(k)) for k in _KINDS}
CODES = {k: codes(*TABLES[k]) for k in _KINDS}


# ---------------------------------------------------------------- encoding


def _bit_length(a: np.ndarray) -> np.ndarray:
    return np.frexp(a.astype(np.float32))[1].astype(np.int64)


class Packed(NamedTuple):
    data: np.ndarray  # stuffed bytes of all segments
    start: np.ndarray
    end: np.ndarray


def pack(value: np.ndarray, size: np.ndarray, segment: np.ndarray, segments: int) -> Packed:
    """Bits of the items of each segment (ascending), filled up with ones to bytes, 0xFF stuffed."""
    total = np.bincount(segment, size, segments).astype(np.int64)
    n_bytes = (total + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(n_bytes)])
    before = np.cumsum(size) - size
    seg_bits = np.cumsum(total) - total
    pos = before - seg_bits[segment] + begin[segment] * 8
    word, off = pos >> 5, pos & 31
    wide = value.astype(np.uint64) << (64 - off - size).astype(np.uint64)
    words = np.zeros(int(begin[-1] // 4 + 3), np.uint64)
    if len(word):
        firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[firsts]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), firsts)
        words[word[firsts] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), firsts)
    data = words.astype(">u4").view(np.uint8)[: begin[-1]].copy()
    some = n_bytes > 0
    data[begin[1:][some] - 1] |= ((1 << (n_bytes * 8 - total)[some]) - 1).astype(np.uint8)
    full = np.flatnonzero(data == 0xFF)
    stuffed = np.insert(data, full + 1, 0)
    shift = np.searchsorted(full, begin)  # a 0xFF before an edge moves it by one
    edge = begin + shift
    return Packed(stuffed, edge[:-1], edge[1:])


def _dense(size: np.ndarray, value: np.ndarray, width: int, segment: np.ndarray, segments: int) -> Packed:
    at = np.flatnonzero(size)
    return pack(value[at], size[at].astype(np.int64), segment[at // width], segments)


def ac_first(coef: np.ndarray, ss: int, se: int, al: int, segment: np.ndarray, segments: int) -> Packed:
    """First AC scan of blocks (rows of 64, zigzag order)."""
    code, length = CODES["first"]
    width = se - ss + 2
    v = coef[:, ss : se + 1].astype(np.int64)
    a = np.abs(v) >> al
    row, col = np.nonzero(a)
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    before = np.where(first, -1, np.append(-1, col[:-1])) if len(row) else col
    run = col - before - 1
    mag = a[row, col]
    bits = _bit_length(mag)
    extra = np.where(v[row, col] > 0, mag, (1 << bits) - 1 - mag)
    symbol = (run & 15) << 4 | bits
    size, value = np.zeros(len(coef) * width, np.uint8), np.zeros(len(coef) * width, np.uint32)
    at = row * width + before + 1
    for z in range(3):
        more = (run >> 4) > z
        size[at[more] + 16 * z], value[at[more] + 16 * z] = length[0xF0], code[0xF0]
    at = at + (run & ~15)
    size[at], value[at] = length[symbol] + bits, code[symbol] << bits | extra
    last = np.full(len(coef), -1)
    last[row] = col  # the last of a row wins
    ends = np.flatnonzero(last < se - ss)
    size[ends * width + last[ends] + 1], value[ends * width + last[ends] + 1] = length[0], code[0]
    return _dense(size, value, width, segment, segments)


def ac_refine(coef: np.ndarray, ss: int, se: int, al: int, segment: np.ndarray, segments: int) -> Packed:
    """Refining AC scan that adds bit ``al``."""
    code, length = CODES["refine"]
    n, width = len(coef), 2 * (se - ss + 2)
    v = coef[:, ss : se + 1].astype(np.int64)
    a = np.abs(v) >> al
    size, value = np.zeros(n * width, np.uint8), np.zeros(n * width, np.uint32)
    whole = (a > 1).all(axis=1)
    full = np.flatnonzero(whole)
    if len(full):  # only corrections after the end of block: 32 bits at once
        bits = np.packbits((a[full] & 1).astype(np.uint8), axis=1)
        chunks_ = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 4))).view(">u4").astype(np.uint32)
        at = full * width
        size[at], value[at] = length[0], code[0]
        for i in range(chunks_.shape[1]):
            m = min(32, se - ss + 1 - 32 * i)
            size[at + 1 + i], value[at + 1 + i] = m, chunks_[:, i] >> (32 - m)
    part = np.flatnonzero(~whole)
    a, v = a[part], v[part]
    row, col = np.nonzero(a > 1)
    at = part[row] * width + 2 * col + 1
    size[at], value[at] = 1, a[row, col] & 1
    row, col = np.nonzero(a <= 1)  # had no history
    index = np.arange(len(row)) - np.searchsorted(row, row)
    place = np.full((len(part), se - ss + 2), se - ss + 1)
    place[row, index] = col
    new = a[row, col] == 1
    row, col, index = row[new], col[new], index[new]
    same = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    before = np.where(same, np.append(-1, index[:-1]), -1) if len(row) else index
    run = index - before - 1
    for z in range(4):
        more = np.flatnonzero((run >> 4) > z)
        # each stands after the zero that the symbol before it took
        prior = before[more] + 16 * z
        at = part[row[more]] * width + 2 * np.where(prior < 0, 0, place[row[more], np.maximum(prior, 0)] + 1)
        size[at], value[at] = length[0xF0], code[0xF0]
    prior = before + (run & ~15)
    at = part[row] * width + 2 * np.where(prior < 0, 0, place[row, np.maximum(prior, 0)] + 1)
    symbol = (run & 15) << 4 | 1
    size[at], value[at] = length[symbol] + 1, code[symbol] << 1 | (v[row, col] > 0)
    last = np.full(len(part), -1)
    last[row] = col
    ends = np.flatnonzero(last < se - ss)
    at = part[ends] * width + 2 * (last[ends] + 1)
    size[at], value[at] = length[0], code[0]
    return _dense(size, value, width, segment, segments)


def dc_first(values: np.ndarray, component: np.ndarray, al: int, segment: np.ndarray, segments: int) -> Packed:
    """First DC scan; values in MCU order."""
    code, length = CODES["dc"]
    v = values.astype(np.int64) >> al
    diff = np.empty(len(v), np.int64)
    for c in np.unique(component):
        at = np.flatnonzero(component == c)
        fresh = np.append(True, segment[at][1:] != segment[at][:-1])
        diff[at] = v[at] - np.where(fresh, 0, np.append(0, v[at][:-1]))
    bits = _bit_length(np.abs(diff))
    extra = np.where(diff > 0, diff, (1 << bits) - 1 + diff)
    return pack(code[bits] << bits | extra, length[bits] + bits, segment, segments)


class Plan(NamedTuple):
    """Geometry of an image for a number of payload blocks."""

    columns: int
    rows: int

    @property
    def mcus(self) -> int:
        return self.columns * self.rows


def plan(blocks: int) -> Plan:
    mcus = -(-blocks // 6)
    rows = -(-mcus // MOST_COLUMNS)
    return Plan(-(-mcus // rows), rows)


def mcu_order(p: Plan) -> np.ndarray:
    """Blocks (luma raster, then Cb, then Cr) in the order of interleaved scans."""
    y, x = np.divmod(np.arange(p.mcus), p.columns)
    top = 2 * y * 2 * p.columns + 2 * x
    return np.column_stack([top, top + 1, top + 2 * p.columns, top + 2 * p.columns + 1, 4 * p.mcus + np.arange(p.mcus), 5 * p.mcus + np.arange(p.mcus)]).ravel()


#: (components, Ss, Se, Ah, Al) of the scans, in order.
SCRIPT = (
    ((1, 2, 3), 0, 0, 0, 1),
    ((1,), 1, 5, 0, 1),
    ((2,), 1, 63, 0, 1),
    ((3,), 1, 63, 0, 1),
    ((1,), 6, 63, 0, 1),
    ((1, 2, 3), 0, 0, 1, 0),
    ((1,), 1, 63, 1, 0),
    ((2,), 1, 63, 1, 0),
    ((3,), 1, 63, 1, 0),
)


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _tables(destination: int, kind: str, ac: int) -> bytes:
    bits, symbols = TABLES[kind]
    return _marker(0xC4, bytes([ac << 4 | destination, *bits, *symbols]))


_QUANT = _marker(0xDB, bytes([0, *[1] * 64]))
_DHT = _tables(0, "dc", 0) + _tables(0, "first", 1) + _tables(1, "refine", 1)
_SOS = [
    _marker(0xDD, struct.pack(">H", DC_RESTART if ss == 0 else AC_RESTART))
    + _marker(0xDA, bytes([len(comps), *[x for c in comps for x in (c, 1 if ah else 0)], ss, se, ah << 4 | al]))
    for comps, ss, se, ah, al in SCRIPT
]


def _frame(p: Plan, n_bytes: int) -> bytes:
    size = struct.pack(">BHHB", 8, 16 * p.rows, 16 * p.columns, 3)
    return b"\xff\xd8" + _marker(0xFE, COMMENT + str(n_bytes).encode()) + _QUANT + _marker(0xC2, size + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + _DHT


def encode(payloads: list[np.ndarray], n_bytes: list[int]) -> list[bytes]:
    """One progressive JPEG for each payload (uint8, a positive multiple of 64 long)."""
    plans = [plan(len(p) // 64) for p in payloads]
    counts = np.array([6 * p.mcus for p in plans])
    base = np.concatenate([[0], np.cumsum(counts)])
    coef = np.zeros((int(base[-1]), 64), np.int16)
    for i, p in enumerate(payloads):
        coef[base[i] : base[i] + len(p) // 64] = TO_COEF[p].reshape(-1, 64)
    bounds = {1: (0, 4), 2: (4, 5), 3: (5, 6)}
    scans: list[list[bytes]] = []
    interleaved = np.concatenate([base[i] + mcu_order(p) for i, p in enumerate(plans)])
    for comps, ss, se, ah, al in SCRIPT:
        if ss == 0:
            order, per = interleaved, 6
            units = [p.mcus for p in plans]
            restart = DC_RESTART
        else:
            lo, hi = bounds[comps[0]]
            order, per = np.concatenate([np.arange(base[i] + lo * p.mcus, base[i] + hi * p.mcus) for i, p in enumerate(plans)]), 1
            units = [(hi - lo) * p.mcus for p in plans]
            restart = AC_RESTART
        units = np.array(units)
        per_image = -(-units // restart)
        first = np.concatenate([[0], np.cumsum(per_image)])
        image = np.repeat(np.arange(len(plans)), units)
        unit = np.arange(len(image)) - np.repeat(np.cumsum(units) - units, units)
        segment = np.repeat(first[image] + unit // restart, per)
        total = int(first[-1])
        rows = coef[order]
        if ss == 0 and ah == 0:
            component = np.tile([0, 0, 0, 0, 1, 2], len(order) // 6)
            out = dc_first(rows[:, 0], component, al, segment, total)
        elif ss == 0:
            out = pack((rows[:, 0].astype(np.int64) >> al) & 1, np.ones(len(rows), np.int64), segment, total)
        else:
            out = (ac_refine if ah else ac_first)(rows, ss, se, al, segment, total)
        # restart markers stand between the segments of an image
        number = np.arange(total) - np.repeat(first[:-1], per_image)
        inner = np.flatnonzero(number > 0)
        data = np.insert(out.data, np.repeat(out.start[inner], 2), np.column_stack([np.full(len(inner), 0xFF), 0xD0 + (number[inner] - 1) % 8]).ravel().astype(np.uint8))
        moved = out.start + 2 * np.searchsorted(inner, np.arange(total), "right")
        begin = moved[first[:-1]]
        stop = np.append(begin[1:], len(data))
        raw = data.tobytes()
        scans.append([raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
    return [
        _frame(p, n_bytes[i]) + b"".join(_SOS[k] + scans[k][i] for k in range(len(SCRIPT))) + b"\xff\xd9" for i, p in enumerate(plans)
    ]


# ---------------------------------------------------------------- decoding


class Component(NamedTuple):
    h: int
    v: int
    quant: np.ndarray  # zigzag order
    across: int  # blocks in a row of the padded plane
    down: int
    seen_across: int  # blocks in a row of a scan of this component alone
    seen_down: int
    first: int  # of its blocks in the batch


class Image:
    def __init__(self) -> None:
        self.width = self.height = 0
        self.components: list[Component] = []
        self.comment: list[bytes] = []
        self.mcus = (0, 0)


class Scan(NamedTuple):
    first: int  # block of the batch that ``order`` counts from
    count: int
    order: np.ndarray | None  # of its blocks, where they are not in a row
    component: np.ndarray | None  # of each, in interleaved scans
    per: int  # blocks in an MCU
    restart: int
    ss: int
    se: int
    ah: int
    al: int
    tables: tuple[int, ...]  # per block of an MCU
    comps: tuple[int, ...]
    begin: int
    end: int


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


_MASK = (1 << np.arange(32)) - 1
_HALF = np.concatenate([[0], 1 << np.arange(31)])


class Batch:
    """The parsed images of a batch and their coefficients."""

    def __init__(self, files: list[bytes]):
        self.raw = b"".join(files)
        self.images: list[Image] = []
        self.scans: list[list[Scan]] = []  # by the number of the scan in its image
        self.luts: list[np.ndarray] = []
        self._known: dict[bytes, int] = {}
        self._orders: dict[tuple, tuple] = {}
        self._segments: dict[tuple, list] = {}
        self.blocks = 0
        at = 0
        for f in files:
            self._parse(f, at)
            at += len(f)
        self.coef = np.zeros((self.blocks + 1, 64), np.int32)
        data = np.frombuffer(self.raw, np.uint8)
        keep = np.ones(len(data), bool)
        keep[1:] = ~((data[1:] == 0) & (data[:-1] == 0xFF))
        self.new = np.concatenate([[0], np.cumsum(keep)])
        marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
        self.marks = marks
        clean = np.append(data[keep], np.full(16, 0xFF, np.uint8)).astype(np.uint64)
        self.window = clean[:-4] << np.uint64(32)
        for i in range(1, 5):
            self.window |= clean[i : len(clean) - 4 + i] << np.uint64(32 - 8 * i)
        self.limit = (len(self.window) - 1) * 8

    def _lut(self, bits: bytes, symbols: bytes) -> int:
        key = bits + symbols
        if key not in self._known:
            self._known[key] = len(self.luts)
            self.luts.append(lookup(list(bits), list(symbols)))
        return self._known[key]

    @staticmethod
    def _quants(body: bytes) -> list[tuple[int, np.ndarray]]:
        found, i = [], 0
        while i < len(body):
            wide = body[i] >> 4
            found.append((body[i] & 15, np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int32)))
            i += 65 + 64 * wide
        return found

    def _huffman(self, body: bytes) -> list[tuple[int, int]]:
        found, i = [], 0
        while i < len(body):
            m = sum(body[i + 1 : i + 17])
            found.append((body[i], self._lut(body[i + 1 : i + 17], body[i + 17 : i + 17 + m])))
            i += 17 + m
        return found

    def _parse(self, f: bytes, base: int) -> None:
        if f[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        image, at, scan = Image(), 2, 0
        quants: dict[int, np.ndarray] = {}
        tables: dict[int, int] = {}
        ids: dict[int, int] = {}
        restart = 0
        while True:
            while f[at] == 0xFF and f[at + 1] == 0xFF:
                at += 1
            code = f[at + 1]
            if code == 0xD9:
                break
            n = struct.unpack_from(">H", f, at + 2)[0]
            body = f[at + 4 : at + 2 + n]
            at += 2 + n
            if code == 0xFE:
                image.comment.append(body)
            elif code in (0xDB, 0xC4):
                if (code, body) not in self._segments:
                    self._segments[code, body] = self._quants(body) if code == 0xDB else self._huffman(body)
                (quants if code == 0xDB else tables).update(self._segments[code, body])
            elif code == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif code == 0xC2:
                precision, image.height, image.width, n_comps = struct.unpack_from(">BHHB", body)
                if precision != 8 or not image.height:
                    raise ValueError("only 8-bit frames of a known height")
                comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_comps)]
                hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
                image.mcus = across, down = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
                for cid, h, v, q in comps:
                    ids[cid] = len(image.components)
                    seen = -(-(-(-image.width * h // hm)) // 8), -(-(-(-image.height * v // vm)) // 8)
                    image.components.append(Component(h, v, quants[q], across * h, down * v, *seen, self.blocks))
                    self.blocks += across * h * down * v
            elif code in (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                raise ValueError("only Huffman-coded progressive frames")
            elif code == 0xDA:
                m = body[0]
                chosen = [(ids[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(m)]
                ss, se, approx = body[1 + 2 * m], body[2 + 2 * m], body[3 + 2 * m]
                comps = tuple(c for c, _ in chosen)
                first, count, order, component = self._order(image, comps)
                per = 1 if m == 1 else sum(image.components[c].h * image.components[c].v for c, _ in chosen)
                picked = []
                for c, t in chosen:
                    times = 1 if m == 1 else image.components[c].h * image.components[c].v
                    picked += [tables.get(t >> 4, -1) if ss == 0 else tables[16 + (t & 15)]] * times
                stop = _NEXT.search(f, at)
                end = stop.start() if stop else len(f)
                while len(self.scans) <= scan:
                    self.scans.append([])
                self.scans[scan].append(Scan(first, count, order, component, per, restart, ss, se, approx >> 4, approx & 15, tuple(picked), comps, base + at, base + end))
                scan += 1
                at = end
                if not stop:
                    break
        self.images.append(image)

    def _order(self, image: Image, chosen: tuple[int, ...]) -> tuple[int, int, np.ndarray | None, np.ndarray | None]:
        """First block, number of blocks, and their order and components where they need telling."""
        comps = [image.components[c] for c in chosen]
        c, base = comps[0], min(c.first for c in comps)
        if len(comps) == 1 and c.seen_across == c.across:
            return c.first, c.across * c.seen_down, None, None
        key = tuple((c.first - base, *c[:2], *c[3:7]) for c in comps)
        if key not in self._orders:
            if len(comps) == 1:
                y, x = np.divmod(np.arange(c.seen_across * c.seen_down), c.seen_across)
                self._orders[key] = y * c.across + x, None
            else:
                y, x = np.divmod(np.arange(image.mcus[0] * image.mcus[1]), image.mcus[0])
                columns, which = [], []
                for i, c in enumerate(comps):
                    for dy in range(c.v):
                        for dx in range(c.h):
                            columns.append(c.first - base + (y * c.v + dy) * c.across + x * c.h + dx)
                            which.append(i)
                self._orders[key] = np.column_stack(columns).ravel(), np.tile(which, len(y))
        order, component = self._orders[key]
        return base, len(order), order, component

    # -- lanes

    def decode(self) -> np.ndarray:
        """Accumulates all scans; coefficients of all blocks, zigzag order, not dequantised."""
        k = 0
        while k < len(self.scans):
            group = [*self.scans[k]]
            k += 1
            # following scans that touch other coefficients run in the same loop
            while k < len(self.scans) and self._apart(group, self.scans[k]):
                group += self.scans[k]
                k += 1
            for kind in ("dc first", "dc refine", "ac first", "ac refine"):
                mine = [s for s in group if (s.ss == 0, s.ah > 0) == (kind[:2] == "dc", kind.endswith("refine"))]
                if mine:
                    getattr(self, "_" + kind.replace(" ", "_"))(mine)
        return self.coef[: self.blocks]

    @staticmethod
    def _apart(group: list[Scan], more: list[Scan]) -> bool:
        kinds = [{(s.ss, s.se, s.ah > 0, s.comps) for s in x} for x in (group, more)]
        for ss, se, refines, comps in kinds[0]:
            for ss2, se2, refines2, comps2 in kinds[1]:
                if refines != refines2 or (ss == 0) != (ss2 == 0) or (ss2 <= se and ss <= se2 and {*comps} & {*comps2}):
                    return False
        return True

    def _lanes(self, scans: list[Scan]) -> tuple[np.ndarray, ...]:
        """Bit position, first and last index into the joined order, and scan of each segment."""
        begin, end, count, per, restart = (np.array(x, np.int64) for x in zip(*[(s.begin, s.end, s.count, s.per, s.restart) for s in scans], strict=True))
        units = count // per
        step = np.where(restart > 0, restart, units)
        marks = np.searchsorted(self.marks, begin)
        n = np.minimum(-(-units // step), np.searchsorted(self.marks, end) - marks + 1)
        own = np.repeat(np.arange(len(scans)), n)
        number = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        edge = begin[own]
        later = np.flatnonzero(number)
        edge[later] = self.marks[marks[own[later]] + number[later] - 1] + 2
        at = (np.cumsum(count) - count)[own]
        size = (step * per)[own]
        return self.new[edge] * 8, at + number * size, at + np.minimum((number + 1) * size, count[own]), own

    def _peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 32 bits."""
        return (self.window[pos >> 3] >> (8 - (pos & 7)).astype(np.uint64)).astype(np.int64) & 0xFFFFFFFF

    def _bits(self, pos: np.ndarray) -> np.ndarray:
        return (self._peek(pos) >> 31) & 1

    def _symbols(self, pos: np.ndarray, table: np.ndarray, luts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self._peek(pos)
        entry = luts[table + (x >> 16)].astype(np.int64)
        return entry >> 5, entry & 31, x

    def _joined(self, scans: list[Scan]) -> tuple[np.ndarray, np.ndarray]:
        first, count = (np.array(x, np.int64) for x in zip(*[(s.first, s.count) for s in scans], strict=True))
        order = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        at = 0
        for s in scans:
            if s.order is not None:
                order[at : at + s.count] = s.first + s.order
            at += s.count
        return order, np.concatenate(self.luts)

    @staticmethod
    def _of(scans: list[Scan], own: np.ndarray, name: str) -> np.ndarray:
        return np.array([getattr(s, name) for s in scans], np.int64)[own]

    def _dc_first(self, scans: list[Scan]) -> None:
        order, luts = self._joined(scans)
        pos, lo, hi, own = self._lanes(scans)
        segment_of = np.repeat(np.arange(len(lo)), hi - lo)
        diff = np.zeros(len(order), np.int64)
        per = max(s.per for s in scans)
        table = np.array([[s.tables[i % s.per] << 16 for i in range(per)] for s in scans], np.int64)
        n_per = self._of(scans, own, "per")
        lane_own, at = own, lo.copy()
        step = np.zeros(len(lo), np.int64)
        while len(at):
            t = table[lane_own, step % n_per]
            size, used, x = self._symbols(np.minimum(pos, self.limit), t, luts)
            extra = (x >> (32 - used - size)) & ((1 << size) - 1)
            diff[at] = np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1) * (size > 0)
            pos, at, step = pos + used + size, at + 1, step + 1
            if (done := at >= hi).any():
                pos, at, step, hi, lane_own, n_per = (v[~done] for v in (pos, at, step, hi, lane_own, n_per))
        which = np.concatenate([s.component if s.component is not None else np.zeros(s.count, np.int64) for s in scans])
        shift = np.repeat([s.al for s in scans], [s.count for s in scans])
        for c in np.unique(which):
            sel = np.flatnonzero(which == c)
            total = np.cumsum(diff[sel])
            seg = segment_of[sel]
            heads = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            total -= np.repeat(total[heads] - diff[sel][heads], np.diff(np.append(heads, len(sel))))
            self.coef[order[sel], 0] = total << shift[sel]

    def _dc_refine(self, scans: list[Scan]) -> None:
        order, _ = self._joined(scans)
        pos, lo, hi, own = self._lanes(scans)
        n = hi - lo
        at = np.repeat(pos - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.coef[order, 0] |= (self._bits(np.minimum(at, self.limit)) << np.repeat(self._of(scans, own, "al"), n)).astype(np.int32)

    def _ac_first(self, scans: list[Scan]) -> None:
        order, luts = self._joined(scans)
        # symbol and length -> bits taken in all, run, size
        code, size = luts & 31, luts >> 5 & 15
        luts = ((code + np.where((size == 0) & (luts >> 9 < 15), luts >> 9, size)) << 9 | luts >> 9 << 4 | size).astype(np.int64)
        pos, at, hi, own = self._lanes(scans)
        ss, se, al = (self._of(scans, own, x) for x in ("ss", "se", "al"))
        table = np.array([s.tables[0] << 16 for s in scans], np.int64)[own]
        flat = self.coef.ravel()
        k, base = ss.copy(), order[at] * 64
        while len(at):
            pos = np.minimum(pos, self.limit)
            x = self._peek(pos)
            entry = luts[table + (x >> 16)]
            size = entry & 15
            used = entry >> 9  # of the code and what belongs to it
            extra = (x >> (32 - used)) & _MASK[size]
            k = k + (entry >> 4 & 31)
            # a symbol without value writes a zero where one is
            flat[base + np.minimum(k, 63)] = (extra - np.where(extra < _HALF[size], _MASK[size], 0)) << al
            pos = pos + used
            k += 1
            if not size.all():
                end = np.flatnonzero((size == 0) & (entry >> 4 & 31 != 15))
                r = entry[end] >> 4 & 31
                at[end] += (1 << r) + ((x[end] >> (32 - used[end])) & _MASK[r]) - 1
                k[end] = 64
            over = np.flatnonzero(k > se)
            if len(over):
                at[over] += 1
                k[over] = ss[over]
                base[over] = order[np.minimum(at[over], len(order) - 1)] * 64
                done = at >= hi
                if done.any():
                    pos, at, hi, ss, se, al, table, k, base = (v[~done] for v in (pos, at, hi, ss, se, al, table, k, base))

    def _ac_refine(self, scans: list[Scan]) -> None:
        order, luts = self._joined(scans)
        pos, at, hi, own = self._lanes(scans)
        ss, se, al = (self._of(scans, own, x) for x in ("ss", "se", "al"))
        table = np.array([s.tables[0] << 16 for s in scans], np.int64)[own]
        low = np.repeat([s.ss for s in scans], [s.count for s in scans])
        high = np.repeat([s.se for s in scans], [s.count for s in scans])
        shift = np.repeat([s.al for s in scans], [s.count for s in scans])
        rows = self.coef[order]
        column = np.arange(64)
        inside = (column >= low[:, None]) & (column <= high[:, None])
        zero = inside & (rows == 0)
        past = inside & (rows != 0)
        n_past = past.sum(axis=1)
        # places are needed of blocks that hold zeros; row 0 stands for all others
        part = np.flatnonzero(zero.any(axis=1))
        at_part = np.zeros(len(rows), np.int64)
        at_part[part] = np.arange(1, len(part) + 1)

        def places(mask: np.ndarray) -> np.ndarray:
            r, c = np.nonzero(mask)
            out = np.full((len(mask) + 1, 65), 64, np.int64)
            out[r + 1, np.arange(len(r)) - np.searchsorted(r, r)] = c
            return out

        zero_at, past_at = places(zero[part]), places(past[part])
        new_block, new_col, new_sign = [], [], []
        rec: list[tuple[np.ndarray, ...]] = []  # block, corrections before, corrections, bit position
        zi, seen, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while len(at):
            coded = left == 0
            symbol, used, x = self._symbols(np.minimum(pos, self.limit), table, luts)
            size, run = symbol & 15, symbol >> 4
            ends = coded & (size == 0) & (run < 15)
            r = np.where(ends, run, 0)
            left = np.where(ends, (1 << r) + ((x >> (32 - used - r)) & ((1 << r) - 1)), left)
            pos = pos + np.where(coded, used, 0) + r
            steps = coded & ~ends
            new = steps & (size > 0)
            sign = (x >> (31 - used)) & 1
            pos = pos + new
            target = zero_at[at_part[at], np.minimum(np.where(steps, zi + run, 64), 64)]
            target = np.where(steps, np.minimum(target, se + 1), se + 1)
            # corrections of what lies before the target
            upto = np.where(steps & (target <= se), target - ss - (zi + run), n_past[at])
            rec.append((at, seen, upto - seen, pos))
            pos = pos + upto - seen
            if new.any():
                i = np.flatnonzero(new & (target <= se))
                new_block.append(at[i])
                new_col.append(target[i])
                new_sign.append(sign[i])
            seen, zi = upto, np.where(steps, zi + run + 1, 64)
            ran = left > 0
            left = left - ran
            over = np.flatnonzero(ran | (target >= se))
            if len(over):
                at = at.copy()
                at[over] += 1
                zi[over] = 0
                seen = seen.copy()
                seen[over] = 0
                done = at >= hi
                if done.any():
                    pos, at, hi, ss, se, table, zi, seen, left = (v[~done] for v in (pos, at, hi, ss, se, table, zi, seen, left))
        if rec:
            block, before, n, where = (np.concatenate(v) for v in zip(*rec, strict=True))
            # a block without zeros: all its corrections are in a row
            whole = np.flatnonzero((at_part[block] == 0) & (n > 0))
            if len(whole):
                b, w = block[whole], np.minimum(where[whole], self.limit)
                head = np.column_stack([self._peek(w), self._peek(np.minimum(w + 32, self.limit))]).astype(">u4")
                bits = np.unpackbits(np.ascontiguousarray(head).view(np.uint8), axis=1).astype(np.int32)
                for first, last in set(zip(low[b].tolist(), high[b].tolist(), strict=True)):
                    i = np.flatnonzero((low[b] == first) & (high[b] == last))
                    r = rows[b[i], first : last + 1]
                    rows[b[i], first : last + 1] = r + np.sign(r) * (bits[i, : last - first + 1] << shift[b[i], None]).astype(np.int32)
            some = (n > 0) & (at_part[block] > 0)
            block, before, n, where = block[some], before[some], n[some], where[some]
            ordinal = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            b = np.repeat(block, n)
            c = past_at[at_part[b], np.repeat(before, n) + ordinal]
            set_ = np.flatnonzero(self._bits(np.minimum(np.repeat(where, n) + ordinal, self.limit)))
            b, c = b[set_], c[set_]
            rows[b, c] += (np.sign(rows[b, c]) << shift[b]).astype(np.int32)
        if new_block:
            b, c, s = (np.concatenate(v) for v in (new_block, new_col, new_sign))
            rows[b, c] = (np.where(s, 1, -1) << shift[b]).astype(np.int32)
        self.coef[order] = rows


_SCALE = 2048.0
_u = np.arange(8)
_COS = np.cos((2 * _u[:, None] + 1) * _u[None, :] * np.pi / 16) * np.where(_u == 0, np.sqrt(0.125), 0.5)  # [x, u]
#: From zigzag coefficients to 64 samples, scaled and rounded, so that sums are exact whatever their order.
_INVERSE = np.rint(np.einsum("yv,xu->vuyx", _COS, _COS).reshape(64, 64)[ZIGZAG] * _SCALE)


def samples(coef: np.ndarray) -> np.ndarray:
    """Inverse transform of dequantised blocks: uint8 [n, 8, 8]."""
    small = not len(coef) or np.abs(coef).max() <= 500
    kind = np.float32 if small else np.float64  # products and sums stay whole numbers that it holds
    out = coef.astype(kind) @ _INVERSE.astype(kind)
    out = np.floor((out + kind(_SCALE / 2)) / kind(_SCALE)) + kind(128)
    return np.clip(out, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Full-resolution tensor [height, width, 3] (or one channel thrice) from the samples of the batch."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        p = blocks[c.first : c.first + c.across * c.down].reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3)
        planes.append(p.reshape(c.down * 8, c.across * 8).astype(np.int16))

    def spread(p: np.ndarray, c: Component) -> np.ndarray:
        p = np.repeat(p, hm // c.h, axis=1) if hm > c.h else p
        p = np.repeat(p, vm // c.v, axis=0) if vm > c.v else p
        return p[: image.height, : image.width]

    comps = image.components
    if len(planes) < 3:
        return np.stack([spread(planes[0], comps[0]).astype(np.uint8)] * 3, axis=-1)
    # JFIF conversion in 16-bit fixed point; chroma terms are made before they are upsampled
    y = spread(planes[0], comps[0])
    cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, terms in enumerate((((91881, cr, 2),), ((-22554, cb, 1), (-46802, cr, 2)), ((116130, cb, 1),))):
        if len({(comps[k].h, comps[k].v) for _, _, k in terms}) == 1:
            term = spread(((sum(f * p for f, p, _ in terms) + 32768) >> 16).astype(np.int16), comps[terms[0][2]])
        else:
            term = ((sum(f * spread(p, comps[k]) for f, p, k in terms) + 32768) >> 16).astype(np.int16)
        out[..., i] = np.clip(y + term, 0, 255)
    return out


def tensors(batch: Batch, coef: np.ndarray) -> list[np.ndarray]:
    quant = np.concatenate([np.tile(c.quant, (c.across * c.down, 1)) for i in batch.images for c in i.components]) if any((c.quant != 1).any() for i in batch.images for c in i.components) else 1
    blocks = samples(coef * quant)
    return [rgb(i, blocks) for i in batch.images]


def payload(image: Image, coef: np.ndarray) -> tuple[int, bytes]:
    """Stored length before padding, and the padded payload, from the coefficients of the batch."""
    n = int(image.comment[0][len(COMMENT) :])
    first = image.components[0].first
    blocks = max(1, -(-n // 64))
    return n, TO_BYTE[coef[first : first + blocks] + BIAS].tobytes()

"""Secret scans with one combined deterministic automaton.

All rules are compiled by subset construction and minimisation into one
transition array, and every text is read once by it.  Where the automaton says
that a match of a rule ends, the span is fixed with the automaton of that rule
alone: matches are leftmost, longest and non-overlapping within their rule.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton
from .common import arrow_map, with_fields
from .tokens import chunks, code_points


class Rule(NamedTuple):
    kind: str
    pattern: str
    fold: bool = False  # ASCII letters in either case
    least: int = 1  # bytes of the match
    tail: int = 0  # least bytes of the value, the run of VALUE bytes that ends the match


VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _KEY + r"([A-Za-z0-9+/_.=-]+)", fold=True, tail=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([(r.pattern, r.fold) for r in rules], search=True)
        self.one = [Automaton([(r.pattern, r.fold)], search=False) for r in rules]
        self.values = [Automaton([(_KEY, True)], search=False) if r.tail else None for r in rules]
        self.hits = np.repeat(self.all.accept, self.all.classes)

    def scan(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes over a buffer of texts with separators, sorted."""
        state = self.all.run(data)
        mask = self.hits[state]
        found: list[tuple[int, int, int]] = []
        if not mask.any():
            return found
        idle = np.flatnonzero(state == 0)  # no match is under way after these bytes
        raw = data.tobytes()
        for r, rule in enumerate(self.rules):
            done = 0
            for end in np.flatnonzero(mask >> r & 1).tolist():
                if end < done:
                    continue
                before = int(np.searchsorted(idle, end)) - 1
                at = max(done, int(idle[before]) + 1 if before >= 0 else 0)
                while at <= end:
                    stop = self.one[r].longest(raw, at)
                    if stop > 0:
                        if stop - at >= rule.least and self._value(r, raw, at, stop) >= rule.tail:
                            found.append((at, r, stop))
                        done = stop
                        break
                    at += 1
        found.sort()
        return found

    def _value(self, r: int, raw: bytes, start: int, stop: int) -> int:
        """Length of the value after the longest key that leaves one."""
        if self.values[r] is None:
            return 0
        # the separator is the first ':' or '=' after the name: names hold neither
        at = start
        while raw[at] not in b":=":
            at += 1
        at += 1
        while raw[at] == 32:
            at += 1
        at += raw[at] in b"\"'"
        return stop - at


_KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int64())]))
_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "rule")]))
_HIDDEN = "__mesh_secrets"


@functools.cache
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _finder(scanner: Scanner, name: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for t in chunks(batch.column("text")):
            found = scanner.scan(t.data)
            if not found:
                continue
            where = code_points(t.data)
            text = np.searchsorted(t.start, [x[0] for x in found], "right") - 1
            for i, (a, r, b) in zip(text.tolist(), found, strict=True):
                base = where[t.start[i]]
                spans[t.lo + i].append({"start": int(where[a] - base), "end": int(where[b] - base), "rule": r})
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _KIND)], [*batch.schema.names, name])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """``docs`` with ``secrets`` (or ``name``): spans (start, end, rule) in code points, by start, then rule.

    A column of that name is replaced.  Null and empty texts have no spans;
    spans of different rules may overlap.  Every row is treated alone, so
    repeats, ties and nulls elsewhere change nothing.
    """
    base = docs.drop(name)
    scanner = base.sparkSession.sparkContext.broadcast(scanner_of(rules))
    return arrow_map(base, lambda b: _finder(scanner.value, name)(b), with_fields(base, **{name: _SPANS}))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs``, each secret in ``text`` replaced by ``[kind]``.

    Overlapping spans are replaced as one, named by the first.  ``n_chars``, if
    there, is set to the new length of texts that changed.
    """
    found = find_secrets(docs, rules, _HIDDEN)
    kinds = [r.kind for r in rules]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        texts, sizes = {}, {}
        for i, s in enumerate(batch.column(_HIDDEN).to_pylist()):
            if s:
                t = batch.column("text")[i].as_py()
                out, at = [], 0
                for x in s:
                    if x["start"] >= at:
                        out += [t[at : x["start"]], f"[{kinds[x['rule']]}]"]
                    at = max(at, x["end"])
                texts[i] = "".join(out) + t[at:]
                sizes[i] = len(texts[i])
        if not texts:
            return batch
        cols = list(batch.columns)
        for name, new in (("text", texts), ("n_chars", sizes)):
            if name in names and (name == "text" or pa.types.is_integer(batch.schema.field(name).type)):
                k = names.index(name)
                old = cols[k].to_pylist()
                cols[k] = pa.array([new.get(i, v) for i, v in enumerate(old)], cols[k].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(found, run, found.schema).drop(_HIDDEN)


def listed(spans: list[dict] | None, rules: tuple[Rule, ...] = RULES, kinds: int | None = None) -> str:
    return ",".join(f"{rules[s['rule']].kind}:{s['start']}:{s['end']}" for s in spans or [] if kinds is None or s["rule"] < kinds)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def report(docs: DataFrame) -> DataFrame:
    """Counts, span list and digest of the base kinds for each row of ``docs(doc_id, text)``.

    Null text reads as empty and has no spans; each row is treated alone, repeated
    and null ids too; other columns are ignored; an empty table gives an empty result.
    """
    found = find_secrets(docs.select("doc_id", "text"))

    def joined(spans):
        names = F.array(*[F.lit(r.kind) for r in RULES])
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", names[s["rule"].cast("int")], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(i: int):
        return F.size(F.filter("secrets", lambda s: s["rule"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter("secrets", lambda s: s["rule"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))

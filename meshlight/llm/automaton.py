"""Byte regexes compiled to one deterministic automaton.

Supported: literals, ``\\xHH`` and other escapes, classes, groups, ``|``, ``?``,
``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``.  A negated class holds no byte
from 0xF8 up, which occurs in no UTF-8 text, so the separator between texts
always leads back to the start.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

_ESCAPES = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11}
_DIGITS = frozenset(range(48, 58))
_NAMED = {"d": _DIGITS, "s": frozenset(b" \t\n\r\f\v"), "w": _DIGITS | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}}
_ALL = frozenset(range(0xF8))


class _Parser:
    """Builds a nondeterministic automaton: ``step[state]`` lists (bytes, next), ``free[state]`` empty moves."""

    def __init__(self) -> None:
        self.step: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.p, self.i, self.fold = pattern, 0, fold
        tree = self.choice()
        if self.i != len(pattern):
            raise ValueError(f"unbalanced at {self.i}: {pattern}")
        return self.build(tree)

    def choice(self):
        options = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return ("or", options)

    def sequence(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.repeat(self.atom()))
        return ("seq", parts)

    def repeat(self, node):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                close = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : close].partition(",")
                bounds = int(low), (int(high) if high else None) if comma else int(low)
                self.i = close + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("times", node, *bounds)
        return node

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.choice()
            self.i += 1
            return node
        if c == "[":
            return ("set", self.folded(self.members()))
        if c == ".":
            return ("set", _ALL - {10})
        if c == "\\":
            return ("set", self.folded(self.escape()))
        codes = c.encode()
        return ("seq", [("set", self.folded(frozenset([b]))) for b in codes]) if len(codes) > 1 else ("set", self.folded(frozenset(codes)))

    def escape(self) -> frozenset:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        return _NAMED.get(c) or frozenset([_ESCAPES.get(c, ord(c))])

    def members(self) -> frozenset:
        negated = self.p[self.i] == "^"
        self.i += negated
        found: set[int] = set()
        begun = self.i
        while self.p[self.i] != "]" or self.i == begun:
            one = self.member()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]" and len(one) == 1:
                self.i += 1
                found |= set(range(min(one), min(self.member()) + 1))
            else:
                found |= one
        self.i += 1
        return _ALL - found if negated else frozenset(found)

    def member(self) -> frozenset:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            return self.escape()
        if ord(c) > 127:
            raise ValueError("classes are of ASCII or \\xHH")
        return frozenset([ord(c)])

    def folded(self, s: frozenset) -> frozenset:
        if not self.fold:
            return s
        return s | {b ^ 32 for b in s if 65 <= b <= 90 or 97 <= b <= 122}

    def build(self, node) -> tuple[int, int]:
        kind = node[0]
        a, b = self.state(), self.state()
        if kind == "set":
            self.step[a].append((node[1], b))
        elif kind == "or":
            for option in node[1]:
                x, y = self.build(option)
                self.free[a].append(x)
                self.free[y].append(b)
        elif kind == "seq":
            at = a
            for part in node[1]:
                x, y = self.build(part)
                self.free[at].append(x)
                at = y
            self.free[at].append(b)
        else:
            _, inner, low, high = node
            at = a
            for _ in range(low):
                x, y = self.build(inner)
                self.free[at].append(x)
                at = y
            if high is None:
                x, y = self.build(inner)
                self.free[at] += [x, b]
                self.free[y] += [x, b]
            else:
                self.free[at].append(b)
                for _ in range(high - low):
                    x, y = self.build(inner)
                    self.free[at].append(x)
                    self.free[y].append(b)
                    at = y
        return a, b


class Automaton:
    """Minimal automaton of all patterns: ``move[state * classes + byte_class[b]]`` is the next state times ``classes``.

    ``accept[state]`` has bit r set where a match of pattern r ends.  With
    ``search`` a match may begin anywhere (state 0 is then the state in which
    none has begun); else only at the first byte, and ``dead`` is the state that
    nothing leaves.
    """

    def __init__(self, patterns: list[tuple[str, bool]], search: bool):
        nfa = _Parser()
        ends, starts = {}, []
        for r, (pattern, fold) in enumerate(patterns):
            a, b = nfa.add(pattern, fold)
            starts.append(a)
            ends[b] = 1 << r
        closed: dict[int, frozenset] = {}

        def closure(state: int) -> frozenset:
            if state not in closed:
                seen, todo = {state}, [state]
                while todo:
                    for x in nfa.free[todo.pop()]:
                        if x not in seen:
                            seen.add(x)
                            todo.append(x)
                closed[state] = frozenset(s for s in seen if nfa.step[s] or s in ends)
            return closed[state]

        # bytes that no set tells apart are one class
        sets = list({s for moves in nfa.step for s, _ in moves})
        signature: dict[tuple, int] = {}
        self.byte_class = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)], np.int32)
        self.classes = len(signature)
        sample = {c: int(np.flatnonzero(self.byte_class == c)[0]) for c in range(self.classes)}
        by_class = {s: [c for c, b in sample.items() if b in s] for s in sets}

        first = frozenset().union(*(closure(s) for s in starts))
        index, order, rows = {first: 0}, [first], []
        for now in order:
            reach: dict[int, set] = defaultdict(set)
            for s in now:
                for allowed, to in nfa.step[s]:
                    for c in by_class[allowed]:
                        reach[c] |= closure(to)
            row = []
            for c in range(self.classes):
                nxt = frozenset(reach[c]) | (first if search else frozenset()) if c in reach else (first if search else frozenset())
                if nxt not in index:
                    index[nxt] = len(order)
                    order.append(nxt)
                row.append(index[nxt])
            rows.append(row)
        move = np.array(rows, np.int64)
        accept = np.array([sum({ends[s] for s in now if s in ends}) for now in order], np.int64)
        self._minimise(move, accept)

    def _minimise(self, move: np.ndarray, accept: np.ndarray) -> None:
        """Moore's refinement: states that no input tells apart are merged."""
        block = np.unique(accept, return_inverse=True)[1].reshape(-1)
        while True:
            new = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == block.max():
                break
            block = new
        # number the blocks by their first state, so that the start is 0
        firsts = np.sort(np.unique(block, return_index=True)[1])
        number = np.empty(len(firsts), np.int64)
        number[block[firsts]] = np.arange(len(firsts))
        self.states = len(firsts)
        self.move = (number[block[move[firsts]]] * self.classes).astype(np.int32).ravel()
        self.accept = accept[firsts]
        self_loop = (self.move.reshape(self.states, -1) == np.arange(self.states)[:, None] * self.classes).all(axis=1)
        dead = np.flatnonzero(self_loop & (self.accept == 0))
        self.dead = int(dead[0]) * self.classes if len(dead) else -1

    def run(self, data: np.ndarray, lanes: int = 2048) -> np.ndarray:
        """The state (times ``classes``) after each byte, from state 0, in one pass over the bytes.

        The buffer is cut into lanes that advance together.  Each lane begins in
        state 0; where the lane before ends in another state, its bytes are
        stepped on until both paths meet, after which they agree.
        """
        n = len(data)
        lanes = max(1, min(lanes, n // 64))
        length = -(-n // lanes)
        codes = np.zeros(lanes * length, np.int32)
        codes[:n] = self.byte_class[data]
        rows = np.ascontiguousarray(codes.reshape(lanes, length).T)
        out = np.empty((length, lanes), np.int32)
        now = np.zeros(lanes, np.int32)
        for i in range(length):
            now = self.move.take(now + rows[i])
            out[i] = now
        flat = np.ascontiguousarray(out.T).ravel()
        move = self.move
        for k in np.flatnonzero(flat[length - 1 :: length][: lanes - 1] != 0).tolist():
            i = (k + 1) * length
            state = int(flat[i - 1])
            while i < n:
                state = int(move[state + codes[i]])
                if flat[i] == state:
                    break
                flat[i] = state
                i += 1
        # a lane's end may have changed by the loop above; repeat until every seam agrees
        while True:
            seams = np.arange(1, lanes) * length
            seams = seams[seams < n]
            wrong = seams[move[flat[seams - 1] + codes[seams]] != flat[seams]]
            if not len(wrong):
                return flat[:n]
            for i in wrong.tolist():
                state = int(flat[i - 1])
                while i < n:
                    state = int(move[state + codes[i]])
                    if flat[i] == state:
                        break
                    flat[i] = state
                    i += 1

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1."""
        state, end = 0, -1
        for i in range(start, len(data)):
            state = int(self.move[state + self.byte_class[data[i]]])
            if state == self.dead:
                break
            if self.accept[state // self.classes]:
                end = i + 1
        return end

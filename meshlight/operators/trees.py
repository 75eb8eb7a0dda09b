"""A table function that walks the element tree of markup depth first."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, those whose content is no markup, those a new one of the same kind ends, and where that rule stops (fixed values).
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
RAW = frozenset(("script", "style"))
ENDS_ITSELF = frozenset(("p", "li", "td", "th", "tr", "dt", "dd", "option"))
HOLDS = frozenset(("html", "body", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "table", "select", "blockquote", "figure"))

_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_REST = re.compile(r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')|=)*+>""")
_ENDS = {"<!--": re.compile("-->"), **{k: re.compile(rf"</{k}\s*>", re.I) for k in RAW}}

Node = tuple[int, int, int, str, int, int, int]


def walk(text: str, kinds: frozenset[str]) -> Iterator[Node]:
    """``(node, parent, depth, kind, last, begin, finish)`` of the elements of ``kinds``, each as it is closed.

    Nodes are numbered from 1 in the order in which they open; ``parent`` is the
    nearest element of ``kinds`` around it, 0 for none; ``last`` is the largest
    number inside; ``begin`` and ``finish`` are code points.  A closing tag ends all
    that is open inside its element, and does nothing if there is none.  Only the
    open elements are held.
    """
    stack: list[tuple[str, int, int, int, int, int]] = []  # kind, node (0: not asked for), parent, depth, begin, place of the nearest that holds
    places: dict[str, list[int]] = {}  # where in the stack a kind is open
    n, at, endless = 0, 0, set()

    def close(down_to: int, finish: int) -> Iterator[Node]:
        while len(stack) > down_to:
            kind, node, parent, depth, begin, _ = stack.pop()
            places[kind].pop()
            if node:
                yield node, parent, depth, kind, n, begin, finish

    def around() -> tuple[int, int]:
        if not stack:
            return 0, 0
        _, node, parent, depth, _, _ = stack[-1]
        return (node, depth + 1) if node else (parent, depth)

    while m := _TAG.search(text, at):
        begin, at = m.span()
        kind = "<!--" if m[2] is None else m[2].lower()
        if m[2]:
            rest = _REST.match(text, at)
            if not rest:
                break  # the text ends inside a tag
            at = rest.end()
        if m[1]:
            if places.get(kind):
                yield from close(places[kind][-1], at)
            continue
        inside = kind in _ENDS and kind not in endless
        if inside:
            end = _ENDS[kind].search(text, at)
            if end:
                at = end.end()
            else:
                endless.add(kind)
                inside = False
        if kind == "<!--":
            continue
        if kind in ENDS_ITSELF and places.get(kind) and places[kind][-1] > stack[-1][5]:
            yield from close(places[kind][-1], begin)
        parent, depth = around()
        node = 0
        if kind in kinds:
            n += 1
            node = n
        if kind in VOID or inside:
            if node:
                yield node, parent, depth, kind, node, begin, at
        else:
            held = len(stack) if kind in HOLDS else stack[-1][5] if stack else -1
            places.setdefault(kind, []).append(len(stack))
            stack.append((kind, node, parent, depth, begin, held))
    yield from close(0, len(text))


@F.udtf(returnType="node int, parent int, depth int, kind string, last int, begin int, finish int")
class TreeWalk:
    """``walk`` as a table function of a text and the kinds, split at spaces; null text has no rows."""

    def eval(self, text: str, kinds: str):
        if text is not None:
            yield from walk(text, frozenset(kinds.split()))


def ast_visit(rows: DataFrame, text: str, kinds: str) -> DataFrame:
    """``rows`` without ``text`` beside each node of the tree of their text, by a lateral join.

    Texts without such elements, and null ones, have no row.
    """
    found = rows.lateralJoin(TreeWalk(F.col(text).outer(), F.lit(kinds)))
    return found.drop(text)

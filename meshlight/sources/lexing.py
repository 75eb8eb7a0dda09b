"""Comments and literals of source text blanked, with the states that each language needs."""

from __future__ import annotations

import re

#: What may open a comment or a literal, by language; group names say which.
_COMMON = r"(?P<line>//(?:\\\n|[^\n])*)|(?P<block>/\*)"
_QUOTED = r'(?P<string>"(?:\\.|[^"\\\n])*+(?:"|$|(?=\n)))'
_OPEN = {
    "rust": re.compile(_COMMON + r"""|(?P<raw>\b(?:b|c)?r(?P<hashes>#*)")|(?P<string>"(?:\\.|[^"\\])*+"?)|(?P<char>'(?:\\(?:u\{[^}']*\}|x..|.)|[^'\\\n])')""", re.S),
    "go": re.compile(_COMMON + r"""|(?P<tick>`[^`]*`?)|""" + _QUOTED + r"""|(?P<char>'(?:\\.[^'\n]*|[^'\\\n])')""", re.M | re.S),
    "c": re.compile(_COMMON + "|" + _QUOTED + r"""|(?P<char>(?<![0-9])'(?:\\.[^'\n]*|[^'\\\n]{1,4})')""", re.M | re.S),
    "cpp": re.compile(_COMMON + r"""|(?P<delimited>\bR"(?P<mark>[^()\\\s"]{0,16})\()|""" + _QUOTED + r"""|(?P<char>(?<![0-9])'(?:\\.[^'\n]*|[^'\\\n]{1,4})')""", re.M | re.S),
    "typescript": re.compile(_COMMON + "|" + _QUOTED + r"""|(?P<char>'(?:\\.|[^'\\\n])*+(?:'|$))|(?P<template>`)|(?P<slash>/)""", re.M | re.S),
}
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*")
#: After these words a slash begins a regular expression (fixed values).
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_NEST = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\.|`|\$\{|[{}]", re.S)
_SHOWN = re.compile(r"[^\n]")
_MAY_OPEN = re.compile("[\"'/`]")


def _nested_end(text: str, at: int) -> int:
    """Behind the ``*/`` that closes the comment whose first ``/*`` ends at ``at``; comments nest."""
    depth = 1
    for m in _NEST.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template_end(text: str, at: int) -> int:
    """Behind the back tick that closes the template opened before ``at``; values in it may hold templates."""
    inside = ["`"]  # a back tick for a template, a brace for what stands in one
    for m in _TEMPLATE.finditer(text, at):
        c = m[0]
        if inside[-1] == "`":
            if c == "`":
                inside.pop()
            elif c == "${":
                inside.append("{")
        elif c == "`":
            inside.append("`")
        elif c in ("{", "${"):
            inside.append("{")
        elif c == "}":
            inside.pop()
        if not inside:
            return m.end()
    return len(text)


def _opened(opener: re.Pattern, source: str, at: int) -> re.Match | None:
    """The next comment or literal, tried at quotes and slashes alone; a raw string begins before its quote."""
    for q in _MAY_OPEN.finditer(source, at):
        i = q.start()
        if i > at and source[i] == '"' and source[i - 1] in "#rR":
            return opener.search(source, at)
        if m := opener.match(source, i):
            return m
    return None


def masked(source: str, lang: str = "c") -> str:
    """The source with comments and the contents of literals blanked, line breaks and length kept.

    Block comments nest in Rust; raw strings, templates with templates in their
    values, and regular expressions are literals where the language has them.  A
    literal or comment that is not closed goes to the end of its line or of the text.
    """
    opener = _OPEN.get(lang, _OPEN["c"])
    out, at, before, plain = [], 0, "", 0
    while m := _opened(opener, source, at):
        begin, end = m.span()
        code = source[at:begin]
        if tail := code.rstrip():
            before = tail
        kind = m.lastgroup
        if kind == "block" and lang == "rust":
            end = _nested_end(source, end)
        elif kind == "block":
            close = source.find("*/", end)
            end = len(source) if close < 0 else close + 2
        elif kind == "raw":
            close = source.find('"' + m["hashes"], end)
            end = len(source) if close < 0 else close + 1 + len(m["hashes"])
        elif kind == "delimited":
            close = source.find(")" + m["mark"] + '"', end)
            end = len(source) if close < 0 else close + len(m["mark"]) + 2
        elif kind == "template":
            end = _template_end(source, end)
        elif kind == "slash":
            word = re.search(r"[\w$]+$", before[-24:])
            starts = not before or (word[0] in _BEFORE_REGEX if word else before[-1] not in ")]}\"")
            r = _REGEX.match(source, begin) if starts and begin >= plain else None
            if not r:  # a division; behind an expression that its line does not close all slashes of the line are
                if starts and begin >= plain:
                    close = source.find("\n", begin)
                    plain = len(source) if close < 0 else close
                out.append(source[at : begin + 1])
                at, before = begin + 1, "/"
                continue
            end = r.end()
        if kind not in ("line", "block"):
            before = '"'
        out += [code, _SHOWN.sub(" ", source[begin:end])]
        at = end
    out.append(source[at:])
    return "".join(out)

"""Main text of web pages by tree scoring.

The page is read into a tree; every paragraph passes points for its length and
its commas to its ancestors, and the points of a container are discounted by the
share of its text that is links.  The best container is kept, with siblings that
score or read alike, headings and paragraphs among them.  What is boilerplate by its
tag is left out, and block containers that are by their name; inside an article a
name for an id alone is not enough, as it may come from a heading.  A form or a
container with a name of boilerplate that may hold the article counts for less
instead, and is left out only where the better part lies outside it.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg select button canvas audio video xmp noembed noframes".split())
OPAQUE = frozenset("script style textarea title iframe xmp noembed noframes".split())  # their content is text up to the end tag
CHROME = frozenset("nav footer aside form menu dialog head".split()) | RAW
#: Start tags that end an open <p>.
ENDS_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}

JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|captcha|comments?|comment-?(?:list|section|area|form|body|thread)|consent|cookies?|cookie-?(?:bar|banner|notice)|disqus|footer|gdpr|"
    r"header|hidden|login|masthead|menu|modal|nav|navbar|navigation|navigator|newsletter|notice|pager|pagination|popup|promo\w*|related|remark|replies|reply|respond|rss|"
    r"share|sharing|shoutbox|sidebar\w*|side-?bar|signup|skip|social|sponsor\w*|subscribe|tags|toolbar|topbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Only these are judged by their class and id: no row, cell, heading, paragraph, list entry or inline element is.
NAMED = frozenset("address aside center details dialog dir div dl fieldset footer form header hgroup menu nav ol section table ul".split())
#: An id alone makes a container of an article boilerplate if it is one of these or the text is links: other ids come from headings.
SURE_ID = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|breadcrumbs?|comments?|comment-?(?:list|section|area|form|thread)|consent|cookies?|cookie-?(?:bar|banner|notice)|disqus|footer|gdpr|newsletter|pagination|respond|"
    r"share|sharing|sidebar\w*|side-?bar|social|subscribe)(?:$|[\s_-])",
    re.I,
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: A container with this share of the page's text is not boilerplate by its name alone; ``LOW`` is what its points count.
LARGE_SHARE, LOW = 0.5, 0.25
GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_LIST_SCOPE = frozenset("ul ol menu table".split())
_TABLE_SCOPE = frozenset(["table"])
# What a start tag closes, and what stops the search for it.
_CLOSES = {
    "li": (frozenset(["li"]), _LIST_SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), _TABLE_SCOPE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P_STOPS = frozenset("article aside blockquote body button dd div fieldset figure footer form header html li main nav section table td th".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "score", "own", "low", "plain", "holds", "within", "length", "edges", "commas", "linked", "chars")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.kids, self.score, self.own = tag, attrs, parent, [], 0.0, False
        self.low, self.plain, self.holds, self.within = False, 0, False, False
        self.length, self.edges, self.commas, self.linked, self.chars = 0, (False, False), 0, 0, 0


def parse(page: str) -> Node:
    """The tree of a page; kids are nodes and strings.  Any input gives a tree."""
    root = now = Node("#root")
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            now.kids.append(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if not m:
            now.kids.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            now.kids.append(page[at:lt])
        at = m.end()
        if m[1] is not None:
            now.kids.append(m[1].replace("&", "&amp;"))
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if closing:
            node = now
            while node is not root and node.tag != tag:
                if node.tag in ("table", "td", "th") and tag not in BLOCK:
                    break  # a stray inline end tag does not leave a cell
                node = node.parent
            if node is not root and node.tag == tag:
                now = node.parent
            elif tag == "p":
                now.kids.append(Node("p", "", now))
            continue
        if tag in ENDS_P:
            now = _close(now, frozenset(["p"]), _P_STOPS)
        if tag in _CLOSES:
            now = _close(now, *_CLOSES[tag])
        node = Node(tag, attrs, now)
        now.kids.append(node)
        if tag in OPAQUE:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag != "title" or end:
                at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            now = node
        elif tag not in VOID and tag in BLOCK:
            now = node  # a slash does not close an HTML element
    return root


def _close(now: Node, tags: frozenset, stops: frozenset) -> Node:
    node = now
    while node.parent is not None:
        if node.tag in tags:
            return node.parent
        if node.tag in stops:
            break
        node = node.parent
    return now


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _measure(root: Node) -> None:
    """Sets ``plain``, the length of the text below that is in no link and no boilerplate tag, and ``holds``, whether an article or main with such text is there."""
    for node in reversed(list(_walk(root))):
        if not (node.tag == "a" or node.tag in CHROME and node.tag != "form"):
            node.plain = sum(len(k.strip()) if isinstance(k, str) else k.plain for k in node.kids)
        node.holds = node.tag in ("article", "main") and node.plain > 0 or any(k.holds for k in node.kids if not isinstance(k, str))


def _sum(root: Node) -> None:
    """Sets, from the leaves up, what scoring asks of the text below a node.

    ``length`` is that of the text with white space turned into single blanks and
    trimmed, ``edges`` whether white space precedes and follows it, ``commas``
    their number, ``chars`` the characters of the strings and ``linked`` of those in links.
    """
    for node in reversed(list(_walk(root))):
        length, lead, trail = 0, False, False
        for k in node.kids:
            if isinstance(k, str):
                text = _SPACE.sub(" ", k)
                core = len(text.strip())
                before, after = text[:1] == " ", text[-1:] == " "
                node.commas += text.count(",") + text.count("，")
                node.chars += len(k.strip())
            else:
                core, (before, after) = k.length, k.edges
                node.commas += k.commas
                node.chars += k.chars
                node.linked += k.linked
            if not length:
                length, lead, trail = core, lead or before, after or not core and lead
            elif not core:
                trail = trail or before
            else:
                length, trail = length + core + (trail or before), after
        node.length, node.edges = length, (lead, trail)
        if node.tag == "a":
            node.linked = node.chars


def _may_hold_text(node: Node, page: int) -> bool:
    if node.tag not in BLOCK or not node.plain:
        return False
    a = _attributes(node.attrs)
    return node.holds or node.plain >= LARGE_SHARE * page or bool(GOOD.search(f"{a.get('class', '')} {a.get('id', '')}"))


def _strings(node: Node) -> list[str]:
    return [k for n in _walk(node) for k in n.kids if isinstance(k, str)]


def _is_section(node: Node, a: dict[str, str]) -> bool:
    """Whether a container of an article with a name of boilerplate for its id, and none for its class, is a part of the text."""
    if node.plain < 0.5 * sum(len(k.strip()) for k in _strings(node)):
        return False
    if not SURE_ID.search(a.get("id", "")):
        return True
    # "Comments" may be a section of the text: its id comes from its heading and no entries stand in it
    heading = next((n for n in _walk(node) if n.tag in _HEADINGS), None)
    slug = re.sub(r"\W+", "-", "".join(_strings(heading)).strip().lower()) if heading else None
    entries: dict[tuple[str, str], int] = {}
    for n in _walk(node):
        if n.tag in ("li", "div", "article", "section", "dd"):
            entries[n.tag, n.attrs] = entries.get((n.tag, n.attrs), 0) + 1
    return slug == a.get("id", "").lower() and max(entries.values(), default=0) < 2


def _is_junk(node: Node, page: int) -> bool:
    """Whether a node is boilerplate; one that may hold the article is not, and gets ``low``."""
    tag = node.tag
    if tag in CHROME and tag != "form":
        return True
    a = _attributes(node.attrs)
    if tag == "header" and not node.within:
        return True
    if not a and tag != "form" or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    named = tag in NAMED and bool(JUNK.search(a.get("class", "")) or JUNK.search(a.get("id", "")) and not (node.within and _is_section(node, a)))
    if not named and tag != "form":
        return False
    node.low = _may_hold_text(node, page)
    return not node.low


def _prune(node: Node, page: int) -> None:
    """Drops boilerplate below the node and marks nodes that hold text of their own."""
    kept = []
    for kid in node.kids:
        if isinstance(kid, str):
            node.own = node.own or not kid.isspace()
            kept.append(kid)
            continue
        kid.within = node.within or node.tag in ("article", "main")
        if not _is_junk(kid, page):
            kid.low = kid.low or node.low  # what is inside counts for less as well
            kept.append(kid)
    node.kids = kept


def _walk(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [k for k in reversed(node.kids) if not isinstance(k, str)]


_BASE = {"article": 25, "main": 25, "section": 4, "div": 5, "blockquote": 3, "pre": 3, "td": 3, "form": -3, "ul": -3, "ol": -3, "li": -3, "h1": -5, "h2": -5, "h3": -5, "th": -5}


def _passed(node: Node, points: float) -> None:
    """A whole share to the parent, a half to its parent, then a third of that for each further one."""
    share, level, up = points, 0, node.parent
    while up is not None and level < 5:
        up.score += share
        level += 1
        share = points / (2 if level == 1 else 3 * level)
        up = up.parent


#: What belongs to the best container if it stands beside it and is not links.
_BESIDE = frozenset(["p", "blockquote", "pre", "figure", "hgroup", *_HEADINGS])


def main_node(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    _measure(root)
    for node in _walk(root):
        _prune(node, root.plain)
    _sum(root)
    scored: list[Node] = []
    for node in _walk(root):
        if node.tag in ("p", "pre", "td", "blockquote", "li", "h1", "h2", "h3") or node.tag in ("div", "section", "article", "main") and node.own:
            if not node.length:
                continue
            share = 1 + node.commas + min(node.length / 100, 3)
            if node.tag in ("li", "h1", "h2", "h3"):
                share *= 0.25
            share *= (1 - min(1.0, node.linked / node.length)) * (LOW if node.low else 1)
            if node.tag in ("div", "section", "article", "main"):
                node.score += share
            _passed(node, share)
    best, best_score, finals = None, 0.0, {}
    for node in _walk(root):
        if node.score <= 0 or node.tag in ("#root", "html") or node.tag not in BLOCK:
            continue
        if not node.length:
            continue
        a = _attributes(node.attrs)
        name = f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}"
        extra = _BASE.get(node.tag, 0) + (15 if GOOD.search(name) else 0)
        total = (node.score + extra * (LOW if node.low and extra > 0 else 1)) * (1 - min(1.0, node.linked / node.length))
        finals[id(node)] = total
        if total > best_score:
            best, best_score = node, total
        scored.append(node)
    if best is None:
        body = next((n for n in _walk(root) if n.tag == "body"), root)
        return [body]
    # an enclosing article or main is the whole text, its best section a part of it
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main") and up.tag != best.tag:
            best = up
        up = up.parent
    if best.tag in ("p", "h1", "h2", "h3", "li", "td", "blockquote", "pre") and best.parent is not None and best.parent.tag != "#root":
        best = best.parent
    if best.parent is None:
        return [best]
    kept = []
    bar = max(10.0, best_score * 0.2)
    for kid in best.parent.kids:
        if isinstance(kid, str):
            continue
        if kid is best:
            kept.append(kid)
        elif best.tag in ("article", "main") and kid.tag != best.tag:
            continue
        elif finals.get(id(kid), 0.0) >= bar and kid.score >= 0.2 * best.score:
            kept.append(kid)
        elif kid.tag in _BESIDE and kid.length and kid.linked / kid.length < 0.25:
            kept.append(kid)  # title, lead and tail
    return kept or [best]


def without_low(nodes: list[Node]) -> list[Node]:
    """Leaves the ``low`` containers inside out, unless they hold more text than the rest."""
    inside = [n for node in nodes if not node.low for n in _walk(node) if n is not node and n.low and not n.parent.low]
    if inside and sum(n.length - n.linked for n in inside) < 0.5 * sum(n.length - n.linked for n in nodes):
        gone, homes = {id(n) for n in inside}, {id(n.parent): n.parent for n in inside}
        for home in homes.values():
            home.kids = [k for k in home.kids if id(k) not in gone]
    return nodes


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space turned into single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run)).replace("\xa0", " ")).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        at = todo.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            run.append(at)
        elif at.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(at.kids)
        elif at.tag == "br":
            run.append(" ")
        else:
            todo += reversed(at.kids)
    flush()
    return out


def extract(page: str | None) -> str:
    """Main text of a page; empty if there is none.  Null reads as empty."""
    if not page:
        return ""
    return "\n".join(blocks(without_low(main_node(parse(page)))))


def _run(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [extract(p) for p in batch.column("html").to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html)``.

    Each row is treated alone: repeats, ties and nulls in other columns change
    nothing; other columns are ignored.  Null html reads as empty and gives empty
    text; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return arrow_map(rows, _run, "page_id long, url string, text string, n_chars long")

"""Article text that must come through whole, whatever names its elements have, and what must stay out."""

import random

import pytest

from meshlight.llm import html

BODY = [f"Paragraph {i} of the story, which has commas, and is long enough to count as text of the page." for i in range(6)]
STORY = "".join(f"<p>{p}</p>" for p in BODY)
NAMES = ["ad", "header", "menu", "tags", "related", "related-work", "share", "sidebar", "comments", "footer", "notice", "nav", "hidden", "widget", "login", "skip", "promo", "x"]


@pytest.mark.parametrize(("markup", "text"), [
    ('<table><tr class="header"><th>Name</th><th>Size</th></tr><tr><td class="menu">a</td><td>1</td></tr></table>', "Name\nSize\na\n1"),
    ('<h2 id="related-work">Related work</h2>', "Related work"),
    ('<h2 id="tags" class="header">Tags</h2>', "Tags"),
    ('<section id="related-work"><h2>Related work</h2><p>Others did it, too.</p></section>', "Related work\nOthers did it, too."),
    ('<section id="comments"><h2>Comments</h2><p>A comment begins with a sign.</p></section>', "Comments\nA comment begins with a sign."),
    ('<p>Choose <span class="menu">File</span> and press <kbd class="tags">F1</kbd> now.</p>', "Choose File and press F1 now."),
    ("<p>The area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p>", "The area is x=2 here."),
    ("<p>See <object data=a.svg>the figure</object> here.</p>", "See the figure here."),
    ('<ul><li class="share">One entry, of a list</li><li class="ad">and another</li></ul>', "One entry, of a list\nand another"),
    ('<p class="notice">Mind the gap, please.</p>', "Mind the gap, please."),
])
def test_names_drop_no_part_of_an_article(markup, text):
    for page in (f"<body><article>{STORY}{markup}</article></body>", f"<body><main><div>{STORY}{markup}</div></main></body>"):
        assert html.extract(page).split("\n") == [*BODY, *text.split("\n")]


def test_title_lead_and_tail_beside_the_best_container():
    page = f"<h1>The title</h1><p>A short lead.</p><div>{STORY}</div><p>A short tail.</p>"
    want = ["The title", "A short lead.", *BODY, "A short tail."]
    assert html.extract(f"<body>{page}</body>").split("\n") == want
    assert html.extract(f"<body><nav><a href=/>Home</a></nav><div class=q>{page}<p><a href=/next>Next page</a></p></div><footer>Foot</footer></body>").split("\n") == want


def test_boilerplate_inside_an_article_stays_out():
    links = "".join(f'<li><a href="/{i}">Other story {i}</a></li>' for i in range(4))
    entries = "".join(f'<div class="entry"><b>User {i}</b><p>I think so, too, number {i}.</p></div>' for i in range(3))
    for junk in (f'<section id="related"><h2>Related</h2><ul>{links}</ul></section>', f'<section id="comments"><h2>Comments</h2>{entries}</section>',
                 f'<div class="comments">{entries}</div>', f'<div id="share">{links}</div>', "<nav>Up, down</nav>", "<aside>Some words, aside.</aside>", '<div class="ad">Buy it, now.</div>'):
        assert html.extract(f"<body><article>{STORY}{junk}</article></body>").split("\n") == BODY, junk


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    r = random.Random(seed)
    text: list[str] = []

    def words(n):
        return " ".join(r.choice(["one", "other", "thing,", "of", "many", "words"]) + str(r.randrange(999)) for _ in range(n))

    def name(inline):
        a = f' id="{r.choice(NAMES)}-{r.randrange(9)}"' if not inline and r.random() < 0.3 else ""
        return a + (f' class="{r.choice(NAMES)}"' if r.random() < 0.5 else "")

    def block():
        kind = r.choice(["p", "p", "p", "h2", "table", "list", "quote", "section"])
        if kind in ("p", "h2"):
            t = words(30 if kind == "p" else 4)
            text.append(t)
            head, _, rest = t.partition(" ")
            return f"<{kind}{name(False)}><span{name(True)}>{head}</span> {rest}</{kind}>"
        if kind == "section":
            return f'<section id="related-work"><h3>{add(words(3))}</h3><p>{add(words(25))}</p></section>'
        if kind == "quote":
            return f"<blockquote>{add(words(12))}</blockquote>"
        cell = ("td", "tr", "table") if kind == "table" else ("li", "", "ol")
        rows = []
        for _ in range(r.randrange(1, 4)):
            cells = "".join(f"<{cell[0]}{name(False)}>{add(words(3))}</{cell[0]}>" for _ in range(2))
            rows.append(f"<tr{name(False)}>{cells}</tr>" if cell[1] else cells)
        return f"<{cell[2]}>{''.join(rows)}</{cell[2]}>"

    def add(t):
        text.append(t)
        return t

    inside = "".join(block() for _ in range(r.randrange(6, 12))) + f"<p>{add(words(40))}</p>"
    links = "".join(f"<li><a href=/{i}>{words(2)}</a></li>" for i in range(5))
    before = r.choice([f"<nav><ul>{links}</ul></nav>", f'<div class="menu">{links}</div>', "<header>Site, name</header>"])
    after = r.choice(["<footer>All rights, kept</footer>", f'<div class="sidebar">{links}<p>Some, words</p></div>', f'<div class="comments"><div>{words(9)}</div><div>{words(9)}</div></div>', f"<form>{words(3)}<input></form>"])
    wrap = r.choice(["<article>{}</article>", '<div id="wrap"><article class="post">{}</article></div>', "<main><article>{}</article></main>"])
    assert html.extract(f"<html><body>{before}{wrap.format(inside)}{after}</body></html>").split("\n") == text

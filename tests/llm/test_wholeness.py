"""Work that must not be left out: cases that a shorter way would miss."""

import collections
import random
import time

import pytest

from meshlight.llm import decontaminate, html, minhash, substring


def _own(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_repeats_of_short_units_and_without_stops(spark):
    short = "\n".join(" ".join(_own(i, 3)) for i in range(17))  # 51 words, none of its lines is long
    plain = [" ".join(_own(100 + i, 51)) for i in range(40)]  # no stop inside, pasted into a line
    loud = "WORD!! " * 60
    rows = [(1, short), (2, f"Own words are here.\n{short}\nAnd more."), (3, loud), (4, short)]
    for i, p in enumerate(plain):
        rows += [(1000 + i, f"{' '.join(_own(200 + i, 30))} {p} {' '.join(_own(300 + i, 30))}"), (2000 + i, f"{' '.join(_own(400 + i, 7))} {p} {' '.join(_own(500 + i, 9))}")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    cut = {}
    for r in substring.repeated_runs(t).collect():
        cut.setdefault(r.doc_id, []).append(text[r.doc_id][r.start : r.end])
    assert cut[2] == [short] and cut[4] == [short]
    assert len(cut[3]) == 1 and cut[3][0].split() == ["WORD!!"] * 40
    assert all(cut[2000 + i] == [p] for i, p in enumerate(plain))
    assert set(cut) == {2, 3, 4} | {2000 + i for i in range(40)}
    left = {r.doc_id: r.text for r in substring.remove_repeats(t).collect()}
    assert left[1] == short and left[4] == "" and left[2] == "Own words are here.\n\nAnd more."


def test_blocks_keep_null_and_repeated_rows(spark):
    a, b = " ".join(_own(1, 15)), " ".join(_own(2, 12))
    rows = [(1, f"x {a} y {b}"), (1, f"x {a} y {b}"), (1, a), (None, f"{b} z"), (None, "nothing"), (None, None), (2, f"{a} {b}"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("7", a), ("8", b), ("9", a)], "item_id string, text string")

    def found(**kw):
        got = decontaminate.contamination(docs, bench, **kw).collect()
        return collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.hit))) for r in got)

    want = collections.Counter({
        (1, 29, 27, ("7", "8", "9"), ((1, 15), (17, 28))): 2, (1, 15, 15, ("7", "9"), ((0, 14),)): 1, (None, 13, 12, ("8",), ((0, 11),)): 1,
        (None, 1, 0, (), ()): 1, (None, 0, 0, (), ()): 1, (2, 27, 27, ("7", "8", "9"), ((0, 26),)): 1, (3, 0, 0, (), ()): 1,
    })
    assert found() == want and found(block_words=4) == want


def _longest(doc, items, window):
    """By brute force: hit words, and for each item the longest match, the first in the document and then in the item."""
    hit, best = set(), {}
    for name, item in items:
        n = min(window, len(item))
        for i in range(len(doc)):
            for j in range(len(item)):
                size = 0
                while i + size < len(doc) and j + size < len(item) and doc[i + size] == item[j + size]:
                    size += 1
                if n and size >= n:
                    hit |= set(range(i, i + size))
                    best[name] = min(best.get(name, (0, 0, 0)), (-size, i, j))
    return len(hit), sorted((name, -s, i, j) for name, (s, i, j) in best.items())


@pytest.mark.parametrize("window", [4, 10, 17, 24])
def test_longest_matches_by_brute_force(spark, window):
    # few words, so that suffixes share long beginnings
    r = random.Random(window)
    items = [(str(i), [r.choice("ab") for _ in range(r.randrange(60))]) for i in range(8)] + [("5", ["a"] * 30)]
    docs = []
    for i in range(25):
        doc = [r.choice("abc") for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            item = r.choice(items)[1]
            a = r.randrange(len(item) + 1)
            doc += item[a : a + r.randrange(50)] + [r.choice("abcd")]
        docs.append((None if i % 7 == 0 else i % 5, " ".join(doc)))
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id string, text string")
    want = collections.Counter()
    for d, text in docs:
        n, matches = _longest(text.split(), items, window)
        want[d, n, tuple(matches)] += 1
    for words in (20, 1_000_000):
        got = decontaminate.contamination(table, bench, window, words).collect()
        assert collections.Counter((r.doc_id, r.n_hit, tuple((m["item"], m.words, m["at"], m.item_at) for m in r.matches)) for r in got) == want
        left = decontaminate.decontaminate(table, bench, window, words).collect()
        assert collections.Counter(r.doc_id for r in left) == collections.Counter(d for d, n, _ in want.elements() if not n)


BODY = [f"Paragraph {i} of the story, which has commas, and is long enough to count as text of the page." for i in range(6)]
STORY = "".join(f"<p>{p}</p>" for p in BODY)


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "layout with-sidebar", "content no-comments", "post has-tags tags-news", "elementor-widget elementor-widget-text-editor"])
def test_wrappers_named_like_boilerplate_keep_the_article(name):
    for inner in (STORY, f"<div>{STORY}</div>", f"<article>{STORY}</article>"):
        assert html.extract(f'<body><div class="{name}">{inner}</div><div class="sidebar"><p>Other things, to see.</p></div></body>').split("\n") == BODY


def test_form_around_the_page_and_widgets():
    assert html.extract(f"<body><form action=x><div>{STORY}</div></form></body>").split("\n") == BODY
    assert html.extract(f"<body><form><div>{STORY}</div><form><p>Mail, please.</p></form></form></body>").split("\n")[: len(BODY)] == BODY
    widgets = "".join(f'<div class="elementor-widget elementor-widget-text-editor"><p>{p}</p></div>' for p in BODY)
    assert html.extract(f"<body><div>{widgets}</div></body>").split("\n") == BODY


def test_boilerplate_by_name_stays_out():
    junk = "<p>Something else to read, with a comma.</p>"
    for name in ("related-posts", "sidebar", "comments", "footer-text", "share"):
        assert html.extract(f'<body><article>{STORY}<div class="{name}">{junk}</div></article></body>').split("\n") == BODY
        assert html.extract(f'<body><div class="story">{STORY}</div><div class="{name}">{junk}</div></body>').split("\n") == BODY
    assert html.extract(f"<body><div>{STORY}</div><form>{junk}</form></body>").split("\n") == BODY
    many = "".join(f'<li><article class="comment-body">{junk * 2}</article></li>' for _ in range(3))
    assert html.extract(f'<body><article>{STORY}</article><ol class="comment-list">{many}</ol></body>').split("\n") == BODY


def test_near_copies_of_a_large_group_by_brute_force(spark, monkeypatch):
    # copies with 0 to 14 words changed, of which few reach 0.8, and chains of copies of copies
    r = random.Random(5)
    base = _own(900, 150)
    rows = []
    for i in range(240):
        w = list(rows[-1][1].split()) if i % 9 and i > 200 else list(base)
        for at in r.sample(range(150), r.randrange(15)):
            w[at] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, "same words again " * n) for i, n in enumerate((10, 11, 12, 20, 21, 40))]
    want = _classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small, block in ((32, 512), (8, 512), (8, 16)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
        assert got == want
    assert 20 < len(set(want.values())) < 200


def _classes(rows):
    bags = {d: collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for d, t in rows}
    root = {d: d for d in bags}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, x in bags.items():
        for b, y in bags.items():
            if a < b and sum((x & y).values()) >= 0.8 * sum((x | y).values()) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in bags}


def test_deep_pages_take_time_in_proportion(spark):
    def took(depth):
        page = "<body>" + "<div>some text, here" * depth + "</div>" * depth + "</body>"
        began = time.perf_counter()
        assert html.extract(page).count("some text, here") == depth
        return time.perf_counter() - began

    took(100)
    assert min(took(8000) for _ in range(3)) < 20 * max(0.01, min(took(1000) for _ in range(3)))


def test_every_repeat_of_a_line_goes_but_the_earliest(spark):
    licence = "Licensed under the terms, of which a copy is kept."
    rows = [(i, f"Own é text {i} of this file\n{licence if i % 2 else licence.upper()}\nand its end {i}") for i in range(200)]
    rows += [(500, f"{licence}\n{licence}"), (501, None), (502, ""), (503, "\n\n!!\n"), (None, licence), (500, f"{licence}\n{licence}")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in substring.repeated_lines(t, 5).collect():
        found[r.doc_id].append(dict((d, x) for d, x in rows)[r.doc_id][r.start : r.end])
    want = {i: [licence if i % 2 else licence.upper()] for i in range(1, 200)} | {500: [licence, licence]}
    assert found == want
    cut = {r.doc_id: r.text for r in substring.remove_repeats(t, line_words=5).collect() if r.doc_id is not None}
    assert cut[0] == rows[0][1] and cut[7] == "Own é text 7 of this file\n\nand its end 7" and cut[500] == "\n" and cut[501] is None
    assert substring.repeated_lines(t.limit(0)).isEmpty() and substring.repeated_lines(t, 11).isEmpty()
    twice = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1])], "doc_id long, text string")
    assert substring.repeated_lines(twice).isEmpty() and substring.repeated_runs(twice).isEmpty()


def test_rows_of_one_id_link_all_that_any_of_them_is_like(spark):
    a, b, c = (_own(i, 61) for i in (701, 702, 703))

    def near(w):
        return [*w[:30], "other", *w[31:]]

    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (5, near(c)), (5, c), (6, _own(9, 40)), (7, _own(10, 40)), (7, near(c)), (None, a), (None, near(a))]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    for table in (docs.coalesce(1), docs.repartition(7)):
        got = minhash.near_duplicates(table).collect()
        want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 4, None: None}
        assert sorted(str((r.doc_id, r.class_id)) for r in got) == sorted(str((d, want[d])) for d, _ in rows)
        assert all(r.keep == (r.doc_id is None or r.doc_id == r.class_id) for r in got)


def test_the_size_of_a_bucket_decides_nothing(spark, monkeypatch):
    # pairs close to the threshold, of which few agree in as many slots as they are alike
    r = random.Random(77)
    rows = []
    for i in range(30):
        base = _own(5000 + i, 120)
        for j in range(3):
            w = list(base)
            for at in r.sample(range(0, 120, 6), r.choice([2, 3, 4])):
                w[at] = f"x{r.randrange(10**6)}"
            rows.append((i * 10 + j, " ".join(w)))
    want = _classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (32, 1):
        monkeypatch.setattr(minhash, "SMALL", small)
        assert {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()} == want

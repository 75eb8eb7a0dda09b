"""The tree-walking table function: nesting by hand, odd markup, and time in proportion."""

import time

from meshlight.operators import trees as R


def shape(text, kinds="html body div p ul li b script a table tr td br h1"):
    return sorted((n, parent, depth, kind, last) for n, parent, depth, kind, last, _, _ in R.walk(text, frozenset(kinds.split())))


def test_parents_are_the_nearest_nodes_asked_for():
    text = "<html><body><div><i><p>a<br>b</i></div><!-- <div> --><p>c</body></html>"
    assert shape(text) == [(1, 0, 0, "html", 6), (2, 1, 1, "body", 6), (3, 2, 2, "div", 5), (4, 3, 3, "p", 5), (5, 4, 4, "br", 5), (6, 2, 2, "p", 6)]
    assert shape(text, "p") == [(1, 0, 0, "p", 1), (2, 0, 0, "p", 2)]
    spans = {n: text[a:b] for n, *_, a, b in R.walk(text, frozenset(["p", "br"]))}
    assert spans == {1: "<p>a<br>b</i>", 2: "<br>", 3: "<p>c</body>"} or spans[2] == "<br>"


def test_elements_that_end_themselves_stop_at_containers():
    assert shape("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [(1, 0, 0, "ul", 6), (2, 1, 1, "li", 5), (3, 2, 2, "ul", 5), (4, 3, 3, "li", 4), (5, 3, 3, "li", 5), (6, 1, 1, "li", 6)]
    assert [x[:3] for x in shape("<p><b>a<p>b")] == [(1, 0, 0), (2, 1, 1), (3, 0, 0)]
    assert [x[:3] for x in shape("<table><tr><td>1<td>2<tr><td>3</table>")] == [(1, 0, 0), (2, 1, 1), (3, 2, 2), (4, 2, 2), (5, 1, 1), (6, 5, 2)]


def test_odd_markup():
    assert shape("") == [] and shape("plain < text > only </p>") == [] and shape("<P CLASS='a>b'>x</p >") == [(1, 0, 0, "p", 1)]
    assert shape("<script>if (a < b) { x = '<p>' }</script><p>") == [(1, 0, 0, "script", 1), (2, 0, 0, "p", 2)]
    assert shape("<script><p>never closed") == [(1, 0, 0, "script", 2), (2, 1, 1, "p", 2)]
    assert shape("<!-- <p> never closed <b>") == [(1, 0, 0, "p", 2), (2, 1, 1, "b", 2)]
    assert shape("<p title=don't>x<b>") == [(1, 0, 0, "p", 2), (2, 1, 1, "b", 2)] and shape("<p a='>'><b c=\"d>") == [(1, 0, 0, "p", 2), (2, 1, 1, "b", 2)]
    assert shape("</div><div></p></div></div><p") == [(1, 0, 0, "div", 1)]


def test_long_and_deep_texts_take_time_in_proportion():
    kinds = frozenset(["div", "p"])

    def took(n):
        texts = ["<div>" * n, "<div><p>x" * n + "</div>" * n, "<script" * n, "<!--" * n, '<a b="' * n, "<script>" * n, "</p>" * n]
        began = time.perf_counter()
        assert sum(1 for t in texts for _ in R.walk(t, kinds)) >= 3 * n
        return time.perf_counter() - began

    took(2000)
    assert took(40_000) < 40 * max(0.02, took(4000))


def test_lateral_join_keeps_the_other_columns(spark):
    rows = [(1, "<p><b>x</b></p>", "u"), (2, None, "v"), (3, "no markup", "w"), (4, "<p>" * 3, None), (4, "<p>" * 3, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string")
    found = R.ast_visit(pages, "html", "p b")
    assert sorted((r.page_id, r.node, r.parent, r.kind) for r in found.collect()) == [(1, 1, 0, "p"), (1, 2, 1, "b")] + sorted([(4, i, 0, "p") for i in (1, 2, 3)] * 2)
    assert R.ast_visit(pages.limit(0), "html", "p").isEmpty() and "url" in found.columns

"""Python links to exports of any name where it calls them, and behind a dot only to names that say enough."""

from meshlight.operators import bridges as B
from meshlight.sources import extract as X

TEXTS = {
    "a.py": "def one():\n    return run(1)\n", "b.py": "def two():\n    return m.run(1)\n", "c.py": "import re\ndef three():\n    return re.search('x')\n", "d.py": "def four():\n    return search(1)\n",
    "e.py": "def five():\n    return m.word_count(1)\n", "f.py": "def six():\n    return m.n.word_count(1)\n", "g.py": "def word_count_py(x):\n    return x\n", "h.py": "def run():\n    return 1\n", "i.py": "def nine():\n    return other(1)\n",
}


def test_calls_of_common_names_are_links(spark):
    files = spark.createDataFrame([*TEXTS.items()], "path string, source string")
    exports = spark.createDataFrame([("r", "run"), ("s", "search"), ("w", "word_count"), ("n", None)], "id string, export string")
    kept = B.naming(files, exports)
    assert sorted(r.path for r in kept.collect()) == ["a.py", "b.py", "c.py", "d.py", "e.py", "f.py", "g.py"]
    nodes = X.extract(kept)
    names = {r.id: r.name for r in nodes.collect()}
    links = {(names[r.src], r.dst) for r in B.py_link_exports(nodes, X.sites(kept), exports).collect()}
    assert links == {("one", "r"), ("four", "s"), ("five", "w"), ("word_count_py", "w")}  # no ("one", "r") before, but ("three", "s") and ("six", "w")

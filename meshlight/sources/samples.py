"""A small source project that ships with the package, for extraction queries and tests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import save
from .extract import call_edges, extract, sites, spread

PROJECT = {
    "app/main.py": "from app import utils\nimport app.models as m\n\n\ndef run(x):\n    y = utils.clean(x)\n    return m.create(y)\n\n\ndef twice(x):\n    return run(run(x))\n",
    "app/utils.py": "def clean(x):\n    return strip(x)\n\n\ndef strip(x):\n    return x.strip()\n",
    "app/models.py": "class Model:\n    def save(self):\n        return check(self)\n\n\ndef check(m):\n    return m\n\n\ndef create(x):\n    return Model()\n",
    "lib/src/core.rs": "pub fn dispatch(x: u32) -> u32 {\n    // handle(0) in a comment\n    handle(x)\n}\n\npub struct Job { id: u32 }\n",
    "lib/src/handler.rs": "pub fn handle(x: u32) -> u32 {\n    let s = \"dispatch(1)\";\n    x + 1\n}\n",
    "web/api.ts": "export function fetchAll(url: string) {\n  return load(url);\n}\n\nexport const load = (url: string) => url;\n",
    "web/page.ts": "import { fetchAll as all } from './api';\n\nexport class Page {\n  show(url: string) {\n    return all(url);\n  }\n}\n",
    "srv/main.go": "package main\n\nimport \"proj/srv/db\"\n\nfunc Serve() {\n\tdb.Open()\n\thelp()\n}\n\nfunc help() {}\n",
    "srv/db/db.go": "package db\n\nfunc Open() {}\n\ntype Conn struct{}\n\nfunc (c *Conn) Close() {}\n",
    "app/dyn.py": "def go(obj):\n    obj.save()\n    return len(obj)\n\n\ndef len_of(obj):\n    \"\"\"run(obj)\"\"\"\n    return obj.clean()\n",
    "web/index.ts": "export { fetchAll } from './api';\nexport * from './page';\n",
    "web/ipc.ts": "export async function openIt(p: string) {\n  return invoke('open_project', { p });\n}\n",
    "srv/db/other_test.go": "package db\n\nfunc TestOpen() {\n\tOpen()\n}\n",
    "ffi/src/lib.rs": "#[pyfunction]\nfn word_count(s: &str) -> usize {\n    s.len()\n}\n\n#[pyfunction]\n#[pyo3(name = \"search_all\")]\nfn search(s: &str) -> usize {\n    0\n}\n\n#[tauri::command]\nfn open_project(path: String) {}\n",
    "ffi/bind.cpp": "int compute_all(int x) {\n  return add(x, x);\n}\n\nPYBIND11_MODULE(x, m) {\n  m.def(\"compute_all\", &compute_all);\n}\n",
    "ffi/use.py": "import ffi_mod\n\n\ndef main():\n    ffi_mod.word_count('a')\n    return compute_all(3)\n",
    "native/op.h": "int add(int a, int b);\n",
    "native/op.c": "#include \"op.h\"\nint add(int a, int b) {\n  return a + b;\n}\n\nint twice_of(int a) {\n  return add(a, a);\n}\n",
}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*PROJECT.items()], "path string, source string")


#: Names of the project that each document replaces by its own.
NAMES = (
    "run", "twice", "clean", "strip", "Model", "save", "check", "create", "go", "len_of", "main", "dispatch", "Job", "handle", "fetchAll", "load", "Page", "show",
    "Serve", "help", "Open", "Conn", "Close", "TestOpen", "openIt", "word_count", "search_all", "search", "open_project", "compute_all", "add", "twice_of",
)
#: The first short word of a document, in SQL.
WORD = "coalesce(nullif(regexp_extract(lower(text), '[a-z]{3,8}', 0), ''), 'x')"


def projects(docs: DataFrame) -> DataFrame:
    """``files(path, source)``: the project once for each of ``docs(doc_id, text)``, in a folder and with names of its own.

    The names end in the document's first short word and its id, so a name is one
    document's alone; null text gives the word ``x``.
    """
    return tagged(docs.select("doc_id", F.expr(WORD).alias("w")))


#: The project with a mark behind each of its names and for the prefix of its own imports.
_MARK, _HOME = "\x01", "\x02"
_MARKED = {path: re.sub(r"\b(" + "|".join(NAMES) + r")\b", rf"\1{_MARK}", source.replace("proj/", _HOME)) for path, source in PROJECT.items()}


def tagged(words: DataFrame) -> DataFrame:
    """``projects`` of ``words(doc_id, w)``; the files of a document lie together, dealt out over all cores."""
    tag = words.selectExpr("concat('d', doc_id) as home", "concat('_', w, '_', doc_id) as tag")
    pairs = F.create_map(*[F.lit(x) for pair in _MARKED.items() for x in pair])
    each = spread(tag, "home").select("home", "tag", F.explode(pairs).alias("path", "source"))
    named = F.replace(F.replace("source", F.lit(_MARK), F.col("tag")), F.lit(_HOME), F.concat("home", F.lit("/")))
    # A row of its own holds each text, so that conditions on paths come before it is made, and those on texts do not make it again.
    return each.select(F.concat_ws("/", "home", "path").alias("path"), F.explode(F.array(named)).alias("source"))


def python_project(files_: DataFrame, dealt: bool = False) -> DataFrame:
    """Call edges of the Python files by name."""
    return named_edges(files_.where("path like '%.py'"), dealt)


def named_edges(f: DataFrame, dealt: bool = False) -> DataFrame:
    """``(caller_file, caller, callee_file, callee)``."""
    nodes, calls = save(extract(f, dealt).where("parse_error is null").drop("source", "content_hash"), "nodes"), save(sites(f, dealt), "sites")  # read once, joined many times
    edges = call_edges(nodes, calls)
    a = nodes.select(F.col("id").alias("src"), F.col("file").alias("caller_file"), F.col("name").alias("caller"))
    b = nodes.select(F.col("id").alias("dst"), F.col("file").alias("callee_file"), F.col("name").alias("callee"))
    return edges.join(a, "src").join(b, "dst").select("caller_file", "caller", "callee_file", "callee")

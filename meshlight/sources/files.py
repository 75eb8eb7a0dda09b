"""File discovery, manifests, text tools and the scan of a workspace.

``files`` tables have ``path`` and ``source``; an inventory has ``path``, ``hash``,
``bytes`` and ``mtime``.  Reading goes through Spark, so any store that Spark
opens can be scanned.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from . import extract as X

# Files that mark a project, and the language each tells.
MARKERS = {"Cargo.toml": "rust", "pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "package.json": "typescript", "go.mod": "go", "CMakeLists.txt": "cpp", "vcpkg.json": "cpp", "conanfile.txt": "cpp"}
SCRIPT_LANGS, NATIVE_LANGS = ("python", "typescript"), ("rust", "c", "cpp")


def skip_patterns(ignore_text: str, configured: list[str] = ()) -> list[str]:
    """Directories of an ignore file (without comments and negations) and of the configuration."""
    lines = [x.strip().strip("/") for x in ignore_text.splitlines()]
    return [*dict.fromkeys([*(x for x in lines if x and x[0] not in "#!" and "*" not in x), *(c.strip("/") for c in configured)])]


def discover_paths(spark: SparkSession, root: str, skip: list[str] = (), ignore: bool = True) -> DataFrame:
    """``(path, source, hash, bytes, mtime, wave)`` of source files under a root, by wave and path.

    Contents are read by the scan and hashed on the JVM.
    """
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/?", "")
    text = F.decode("content", "UTF-8")
    rows = raw.select(path.alias("path"), text.alias("source"), F.xxhash64("content").alias("hash"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    rows = rows.where(P.ext_filter(F.col("path")))
    if ignore:
        rows = rows.where(~P.dir_prune(F.col("path"), list(skip)))
    return rows.withColumn("wave", P.priority_wave(F.col("path"))).orderBy("wave", "path")


def dual_stack_detect(files: DataFrame) -> DataFrame:
    """``(dir)``: directories that hold native and script sources."""
    langs = F.collect_set(lang_of(F.col("path")))
    both = F.arrays_overlap("l", F.array(*map(F.lit, SCRIPT_LANGS))) & F.arrays_overlap("l", F.array(*map(F.lit, NATIVE_LANGS)))
    return files.groupBy(P.module_key(F.col("path")).alias("dir")).agg(langs.alias("l")).where(both).select("dir")


def lang_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for ext, lang in X.LANGS.items():
        out = F.when(P.extension(path) == ext, lang).otherwise(out)
    return out


def dual_stack_boost(path: Column, native: bool, script: bool) -> Column:
    """Wave 0 for the peer side where both sides are there; otherwise nothing."""
    lang = lang_of(path)
    return F.when(F.lit(native and script) & lang.isin(*SCRIPT_LANGS, *NATIVE_LANGS), 0)


def scan_workspace(spark: SparkSession, root: str, skip: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes and inventory of a root: a lazy plan, parsed in waves by the order of the files."""
    found = discover_paths(spark, root, skip)
    return merge_outcomes(found, X.extract(found))


def merge_outcomes(files: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node table (one row for each id) and file table."""
    return parsed.where("parse_error is null").dropDuplicates(["id"]).drop("parse_error"), files.select("path", "hash", "bytes", "mtime")


def incremental_reparse(nodes: DataFrame, files: DataFrame, delta: DataFrame) -> DataFrame:
    """Nodes with changed and added files read again and deleted ones dropped."""
    dirty = delta.where("change <> 'same'").select(F.col("path").alias("file"))
    fresh = X.extract(files.join(delta.where("change in ('added', 'changed')").select("path"), "path", "left_semi")).where("parse_error is null")
    return nodes.join(dirty, "file", "left_anti").select(*nodes.columns).union(fresh.select(*nodes.columns))


def hydrate_source(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``source`` of each node read again from its file, by lines."""
    text = files.select(F.col("path").alias("file"), F.col("source").alias("text"))
    lines = F.slice(F.split("text", "\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    return nodes.drop("source").join(text, "file", "left").withColumn("source", F.array_join(lines, "\n")).drop("text")


def read_file_tool(files: DataFrame, path: str, first: int = 1, last: int = 400) -> DataFrame:
    """``(line, text)`` of a part of one file."""
    rows = files.where(F.col("path") == path).select(F.posexplode(F.split("source", "\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1).where(F.col("line").between(first, last))


def grep_tool(files: DataFrame, pattern: str, cap: int = 200) -> DataFrame:
    """``(path, line, text)`` of matching lines; the cap is the tool's page size."""
    rows = files.select("path", F.posexplode(F.split("source", "\n")).alias("line", "text")).where(F.col("text").rlike(pattern))
    return rows.withColumn("line", F.col("line") + 1).orderBy("path", "line").limit(cap)


def code_nodes_tool(nodes: DataFrame, kind: str | None = None, scope: str | None = None, cap: int = 100) -> DataFrame:
    rows = nodes if kind is None else nodes.where(F.col("kind") == kind)
    rows = rows if scope is None else rows.where(P.scope_dir(F.col("file"), scope))
    return rows.orderBy("file", "start_line", "id").limit(cap).select("id", "name", "file", "kind")


def guess_lang(names: list[str]) -> str:
    return next((lang for marker, lang in MARKERS.items() if marker in names), "unknown")


def project_list(files: DataFrame) -> DataFrame:
    """``(root, marker, lang)``: directories with a marker file, the first marker of each."""
    out = F.lit(None).cast("string")
    rank = F.lit(99)
    for i, (marker, lang) in reversed([*enumerate(MARKERS.items())]):
        hit = P.basename(F.col("path")) == marker
        out, rank = F.when(hit, lang).otherwise(out), F.when(hit, i).otherwise(rank)
    rows = files.select(P.module_key(F.col("path")).alias("root"), P.basename(F.col("path")).alias("marker"), out.alias("lang"), rank.alias("rank")).where("lang is not null")
    return rows.groupBy("root").agg(F.min_by("marker", "rank").alias("marker"), F.min_by("lang", "rank").alias("lang"))


def deps_sniff(manifests: dict[str, str]) -> list[str]:
    """``name@version`` of the direct dependencies in the first manifest that is there."""
    for name in MARKERS:
        text = manifests.get(name)
        if text is None:
            continue
        if name in ("package.json", "vcpkg.json"):
            data = json.loads(text)
            deps = data.get("dependencies", {})
            if isinstance(deps, list):
                return [d if isinstance(d, str) else f"{d['name']}@{d.get('version>=', '*')}" for d in deps]
            return [f"{k}@{v}" for k, v in deps.items()]
        if name == "go.mod":
            return [f"{a}@{b}" for a, b in re.findall(r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", text)]
        if name == "Cargo.toml":
            block = re.search(r"(?ms)^\[dependencies\]\s*\n(.*?)(?=^\[|\Z)", text)
            return [f"{a}@{b or c}" for a, b, c in re.findall(r'(?m)^([\w-]+)\s*=\s*(?:"([^"]*)"|\{[^}]*?version\s*=\s*"([^"]*)")', block[1] if block else "")]
        if name in ("requirements.txt", "conanfile.txt"):
            sep = "/" if name == "conanfile.txt" else "=="
            return [f"{a}@{b or '*'}" for a, b in re.findall(rf"(?m)^([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?(?:\s*(?:{sep}|[<>~!]=?)\s*([\w.*]+))?", text)]
        block = re.search(r"(?s)dependencies\s*=\s*\[(.*?)\]", text)
        return [f"{a}@{b or '*'}" for a, b in re.findall(r"[\"']([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?\s*(?:[=<>~!]=?\s*([\w.*]+))?", block[1] if block else "")]
    return []


def cargo_versions(lock: str) -> dict[str, str]:
    """Package -> version of a lock file."""
    return dict(re.findall(r'(?m)^name = "([^"]+)"\s*\nversion = "([^"]+)"', lock))


def crate_edges(lock: str) -> list[tuple[str, str]]:
    """(package, dependency) among the packages of a lock file that have no registry source."""
    blocks = re.split(r"(?m)^\[\[package\]\]\s*$", lock)
    local = {m[1]: b for b in blocks if (m := re.search(r'(?m)^name = "([^"]+)"', b)) and not re.search(r"(?m)^source =", b)}
    out = []
    for name, block in local.items():
        deps = re.search(r"(?s)dependencies = \[(.*?)\]", block)
        out += [(name, d) for d in re.findall(r'"([^" ]+)', deps[1] if deps else "") if d in local and d != name]
    return sorted(out)

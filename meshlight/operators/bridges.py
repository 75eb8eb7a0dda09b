"""Typed bridges between languages: native exports, IPC commands and name twins."""

from __future__ import annotations

import keyword
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import noise_block
from ..functions.text import call_target_kind, junk_name

# Names too common to link languages by.
COMMON_NAMES = ["main", "new", "get", "set", "run", "init", "open", "close", "read", "write", "update", "delete", "create", "test", "setup", "start", "stop", "load", "save", "build"]


# Names of methods of many Python objects, which say nothing of an export behind a dot.
METHOD_NAMES = (
    "search match find get set load open read write close format join split replace pop push keys items values copy update clear sort count index append extend remove insert type str int list dict len print "
    "range map filter zip any all min max sum id hash iter next call init new del enter exit repr bytes bool float name path data value text info debug error warn log run start stop main"
).split()


class IpcRule(NamedTuple):
    """A regex whose first group is the command in the caller's text, and where commands are defined."""

    pattern: str = r"""invoke(?:<[^>]*>)?\(\s*['"]([A-Za-z_]\w*)['"]"""
    caller_langs: tuple[str, ...] = ("typescript",)
    callee_langs: tuple[str, ...] = ("rust",)
    callee_attribute: str = r"#\[(?:\w+::)?command"


def worthy_name(name):
    """Distinctive enough to link by: long or compound, not common, no junk."""
    return ~junk_name(name) & ~F.lower(name).isin(*COMMON_NAMES) & ((F.octet_length(name) >= 6) | F.contains(name, F.lit("_")))


def _linkable(export):
    """Exports that Python definitions are linked to by name alone; calls are linked to all exports."""
    return worthy_name(export) | F.contains(export, F.lit("_"))


def _behind_dot(export):
    """Exports that a call of a module's attribute is linked to: long plain names that are no common method's."""
    return (F.octet_length(export) >= 6) & export.rlike(r"\A[A-Za-z0-9_]+\z") & ~export.isin(*METHOD_NAMES)


def naming(files: DataFrame, exports: DataFrame) -> DataFrame:
    """Python files that may call or define one of ``exports(id, export)``; no other gives rows of ``py_link_exports``.

    Those that hold the word of one, or of its twin, those that hold the word of one too
    common for twins other than behind ``def``, and those with letters that Python may
    read as others.  Words and exports meet by hash, which may keep a file too many.
    """
    plain = F.octet_length("source") == F.length("source")

    def holding(names: DataFrame, pattern: str, fit: Column) -> DataFrame:
        words = files.where(plain).select("path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(pattern), F.lit(0)))).alias("word"))
        table = names.select(F.xxhash64("export").alias("word")).distinct()
        return words.where(fit & ~F.col("word").isin(*keyword.kwlist)).select("path", F.xxhash64("word").alias("word")).join(table, "word", "left_semi").select("path")

    long = exports.where(_linkable(F.col("export"))).select("export")
    held = holding(long.union(long.select(F.concat("export", F.lit("_py")))), r"[A-Za-z_]\w*", (F.length("word") >= 6) | F.contains("word", F.lit("_")))
    common = exports.where(~_linkable(F.col("export"))).select("export")
    if not common.isEmpty():
        held = held.union(holding(common, r"(?<!\w)(?<!def )[A-Za-z_]\w*", F.lit(True)))
    return files.where(plain).join(held.distinct(), "path", "left_semi").union(files.where(~plain))


_EXPORT = r"#\[(?:pyfunction|pymethods|no_mangle|napi|wasm_bindgen|export_name|pyo3)"


def may_export(source: Column) -> Column:
    """Texts that hold an export attribute; no function of another file is one of ``rust_exports``."""
    return source.rlike(_EXPORT)


def may_call_ipc(source: Column) -> Column:
    """Texts that may hold a command's call by the rule of ``IpcRule()``."""
    return F.contains(source, F.lit("invoke"))


def may_define_ipc(source: Column) -> Column:
    """Texts that may hold a command's definition by the rule of ``IpcRule()``."""
    return source.rlike(IpcRule().callee_attribute)


def rust_exports(nodes: DataFrame, files: DataFrame | None = None, *keep: str) -> DataFrame:
    """``(id, export)`` and the columns ``keep`` of Rust functions with an export attribute above them; a ``name`` argument overrides.

    Nodes that have the column ``above`` of ``extract`` need no files.
    """
    f = nodes.where("lang = 'rust' and kind = 'function_item'")
    if "above" in nodes.columns:
        above = F.col("above")
    else:
        f = f.join(files.select(F.col("path").alias("file"), F.col("source").alias("text")), "file")
        above = F.array_join(F.slice(F.split("text", "\n"), F.greatest(F.col("start_line") - 4, F.lit(1)).cast("int"), F.least(F.col("start_line") - 1, F.lit(4)).cast("int")), "\n")
    attr = F.regexp_extract(above, rf"(?s)({_EXPORT}[^\]]*\](?:\s*#\[[^\]]*\])*)\s*$", 1)
    named = F.regexp_extract(attr, r"name\s*=\s*\"([^\"]+)\"", 1)
    return f.where(attr != "").select("id", F.when(named != "", named).otherwise(F.col("name")).alias("export"), *keep)


def may_be_bound(source: Column) -> Column:
    """C and C++ texts that may define a function; no other file has a target of ``pybind_exports``."""
    return F.contains(source, F.lit("{"))


def pybind_exports(nodes: DataFrame, files: DataFrame, *keep: str) -> DataFrame:
    """``(id, export)`` and the columns ``keep`` of nodes, from ``m.def("name", &target)`` of C++ files; the target's definition, or the enclosing file's."""
    files = files.where(F.contains("source", F.lit(".def(")))
    calls = files.where("path rlike '[.](cc|cpp|cxx|h|hpp)$'").select(F.col("path").alias("at"), F.explode(F.regexp_extract_all("source", F.lit(r"\.def\(\s*\"(\w+)\"\s*,\s*&?([\w:]+)"), F.lit(0))).alias("call"))
    calls = calls.select("at", F.regexp_extract("call", r"\"(\w+)\"", 1).alias("export"), F.element_at(F.split(F.regexp_extract("call", r",\s*&?([\w:]+)", 1), "::"), -1).alias("target"))
    defs = nodes.where("lang in ('c', 'cpp') and kind = 'function_definition'").select("id", F.col("name").alias("target"), "file", *(F.col(c).alias(f"_{c}") for c in keep))
    order = Window.partitionBy("at", "export").orderBy((F.col("file") == F.col("at")).desc(), "file", "id")
    return calls.join(defs, "target").withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "export", *(F.col(f"_{c}").alias(c) for c in keep))


def ffi_export_map(exports: DataFrame, *keep: str) -> DataFrame:
    """One target for each export name, the least id first, with its columns ``keep``."""
    if not keep:
        return exports.groupBy("export").agg(F.min("id").alias("id"))
    return exports.groupBy("export").agg(F.min(F.struct("id", *keep)).alias("b")).select("export", "b.*")


def py_link_exports(nodes: DataFrame, calls: DataFrame, exports: DataFrame) -> DataFrame:
    """``(src, dst, kind)``: Python functions that call an export, by its bare name or, if that says enough, as a module's attribute, and Python functions that are its twins by name, or by name and ``_py``."""
    from .names import enclosing_block

    table = ffi_export_map(exports).where("export is not null")
    py = nodes.where("lang = 'python'")
    sites = calls.where("lang = 'python'").where(F.col("receiver").isNull() | ((F.col("receiver") != "?") & _behind_dot(F.col("name"))))
    at = sites.select("file", "line", F.col("name").alias("export")).join(table.withColumnRenamed("id", "dst"), "export")
    called = enclosing_block(py, at, "dst").select(F.col("id").alias("src"), "dst")
    long = table.where(_linkable(F.col("export")))
    named = long.union(long.select(F.concat("export", F.lit("_py")), "id")).withColumnRenamed("id", "dst")
    twins = py.where(call_target_kind(F.col("kind"))).select(F.col("id").alias("src"), F.col("name").alias("export")).join(named, "export").select("src", "dst")
    return called.union(twins).distinct().withColumn("kind", F.lit("export"))


def ipc_edges(nodes: DataFrame, files: DataFrame, rules: tuple[IpcRule, ...] = (IpcRule(),)) -> DataFrame:
    """``(src, dst, kind)``: callers whose text names a command, one for each (file, command), production callers first."""
    out = None
    for rule in rules:
        callers = nodes.where(F.col("lang").isin(*rule.caller_langs)).withColumn("symbol", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(rule.pattern), F.lit(1)))))
        targets = nodes.where(F.col("lang").isin(*rule.callee_langs) & call_target_kind(F.col("kind"))).join(files.select(F.col("path").alias("file"), F.col("source").alias("text")), "file")
        above = F.array_join(F.slice(F.split("text", "\n"), F.greatest(F.col("start_line") - 3, F.lit(1)).cast("int"), F.least(F.col("start_line") - 1, F.lit(3)).cast("int")), "\n")
        targets = targets.where(above.rlike(rule.callee_attribute)).groupBy("name").agg(F.min("id").alias("dst")).withColumnRenamed("name", "symbol")
        order = Window.partitionBy("file", "dst").orderBy(noise_block(F.col("file")).cast("int"), (F.col("end_line") - F.col("start_line")), "id")
        rows = callers.join(targets, "symbol").withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("id").alias("src"), "dst", F.lit("ipc").alias("kind"))
        out = rows if out is None else out.union(rows)
    return out.distinct()


def twin_edges(nodes: DataFrame) -> DataFrame:
    """``(src, dst, kind)``: the first definitions of a worthy name in each two languages; ``twins`` scans texts instead."""
    defs = nodes.where(call_target_kind(F.col("kind")) & worthy_name(F.col("name")))
    one = defs.groupBy("name", "lang").agg(F.min("id").alias("id"))
    names = one.groupBy("name").count().where("count > 1").select("name")
    a = one.join(names, "name")
    b = a.select("name", F.col("lang").alias("lang2"), F.col("id").alias("dst"))
    return a.join(b, "name").where("lang < lang2").select(F.col("id").alias("src"), "dst", F.lit("twin").alias("kind"))


def native_exports(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, export)`` of Rust and C++."""
    return rust_exports(nodes, files).union(pybind_exports(nodes, files))


def interconnect_maps(nodes: DataFrame, files: DataFrame, calls: DataFrame, twins: bool = False, exports: DataFrame | None = None) -> DataFrame:
    """All derivations; twins are opt-in.  ``exports`` are those of ``native_exports`` if they are at hand."""
    exports = native_exports(nodes, files) if exports is None else exports
    out = py_link_exports(nodes, calls, exports).union(ipc_edges(nodes, files))
    return out.union(twin_edges(nodes)) if twins else out


def import_matches(path: str, spec: str) -> bool:
    """The directory is a suffix of the import path, by whole components."""
    return ("/" + spec.strip("/")).endswith("/" + re.sub(r"/?[^/]*$", "", path).strip("/"))

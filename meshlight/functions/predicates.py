"""Predicates of nodes: kinds, shells, hosts and families, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths as P
from . import text as T

# Fixed values.
COLLISION_WORDS = ["main", "new", "test", "run", "init", "setup", "default", "from", "into", "drop", "clone", "index", "build", "error", "result", "config", "options"]
ENTRY_FILES = ["main", "lib", "mod", "index", "app", "__init__", "__main__", "server", "cli"]
PRIMITIVES = ["int", "str", "bool", "float", "u8", "u32", "u64", "i32", "i64", "usize", "string", "vec", "option", "result", "list", "dict", "map", "set"]
BOILERPLATE = ["fmt", "eq", "hash", "cmp", "partial_cmp", "drop", "deref", "as_ref", "borrow", "default", "next", "__init__", "__repr__", "__str__", "__eq__", "toString", "valueOf"]
FAMILIES = {"rust": "rust", "python": "python", "typescript": "script", "javascript": "script", "svelte": "script", "go": "go", "c": "c_family", "cpp": "c_family", "c++": "c_family"}


def first_line(source: Column) -> Column:
    return F.element_at(F.split(F.ltrim(source), "\n"), 1)


def scope_symbol(name: Column, wanted: str) -> Column:
    """The exact name, or the leaf after the last ``::`` of either side."""
    leaf = T.symbol_leaf(wanted)
    return (name == wanted) | (F.element_at(F.split(name, "::"), -1) == leaf)


def testish_block(path: Column, name: Column, source: Column) -> Column:
    """Noise places, ``test_`` names, and one-line bodies that only call."""
    thin = (F.size(F.split(source, "\n")) <= 1) & source.rlike(r"^\s*[\w.:]+\([^)]*\)\s*;?\s*$")
    return P.noise_block(path) | F.startswith(F.lower(name), F.lit("test_")) | thin


def collision_junk(name: Column) -> Column:
    return T.junk_name(name) | F.lower(name).isin(*COLLISION_WORDS)


def arch_kind(kind: Column) -> Column:
    return F.lower(kind).rlike("struct|class|trait|interface|enum|impl|module|mod_item")


def entry_landmark(path: Column, name: Column) -> Column:
    """An entry file's main symbols, or a main anywhere in production code."""
    return ~P.noise_block(path) & ((F.lower(name) == "main") | (F.lower(P.stem(path)).isin(*ENTRY_FILES) & F.lower(name).isin("main", "run", "start", "app", "serve", "new")))


def entry_hint(path: Column, name: Column) -> Column:
    """100 for main, 20 for other symbols of an entry file, 15 for names that begin with run or start."""
    return F.when(F.lower(name) == "main", 100).when(F.lower(P.stem(path)).isin(*ENTRY_FILES), 20).when(F.lower(name).rlike("^(run|start)"), 15).otherwise(0)


def entry_mult(path: Column, name: Column) -> Column:
    """1, 8, 16 or 24 by how much of an entry a node is."""
    return F.when(entry_landmark(path, name) & (F.lower(name) == "main"), 24).when(entry_landmark(path, name), 16).when(F.lower(P.stem(path)).isin(*ENTRY_FILES), 8).otherwise(1)


def hub_primitive(name: Column, in_degree: Column, out_degree: Column, n_nodes: Column) -> Column:
    """Short or primitive names, and sinks that very many call."""
    return (F.octet_length(name) <= 2) | F.lower(name).isin(*PRIMITIVES) | ((in_degree > F.greatest(F.lit(10), n_nodes / 100)) & (out_degree <= 2))


def module_shell(kind: Column, source: Column) -> Column:
    return F.lower(kind).contains("mod") & source.rlike(r"^\s*(pub(\([^)]*\))?\s+)?mod\s+\w+\s*;\s*$")


def forward_shell(source: Column) -> Column:
    """A forward declaration or a thin alias."""
    return source.rlike(r"^\s*(template\s*<[^>]*>\s*)?(struct|class|enum)\s+\w+\s*;\s*$") | source.rlike(r"^\s*(using\s+\w+\s*=|typedef\s|(pub\s+)?type\s+\w+\s*=)[^{]*;?\s*$")


def ctor_like(name: Column, parent_name: Column) -> Column:
    return F.lower(name).isin("new", "constructor", "__init__", "init", "default") | F.startswith(name, F.lit("~")) | (name == parent_name)


def static_c(source: Column) -> Column:
    return F.startswith(first_line(source), F.lit("static"))


def decl_def_pair(kind_a: Column, kind_b: Column, same_name: Column, lang: Column) -> Column:
    kinds = F.array_sort(F.array(kind_a, kind_b))
    return same_name & lang.isin("c", "cpp") & (kinds == F.array(F.lit("function_declaration"), F.lit("function_definition")))


def homonym_type(name: Column, kind: Column, id_: Column, seed_name: Column, seed_id: Column) -> Column:
    return (name == seed_name) & (id_ != seed_id) & T.type_target_kind(kind)


def peripheral(path: Column, seed_path: Column, gap: int = 60) -> Column:
    """Far less of the application than the seed."""
    return P.app_path_priority(path) + gap < P.app_path_priority(seed_path)


def type_hub(kind: Column, source: Column) -> Column:
    return (T.role_tier(kind) == 100) & ~forward_shell(source)


def seed_ident(a: Column, b: str) -> Column:
    return F.lower(F.element_at(F.split(a, "::"), -1)) == T.normalize_seed(b).lower()


def edge_buildable(path: Column) -> Column:
    return P.ext_filter(path)


def junk_export_host(path: Column, source: Column) -> Column:
    return P.noise_block(path) | source.rlike(r"macro_rules!|#\[cfg\(test\)\]")


def neighbor_noise_name(name: Column) -> Column:
    return name.isin(*BOILERPLATE) | T.trace_noise_name(name)


def edge_family(lang: Column) -> Column:
    out = F.lit("other")
    for k, v in FAMILIES.items():
        out = F.when(F.lower(lang) == k, v).otherwise(out)
    return out


def lang_label(lang: Column) -> Column:
    """One spelling for each language."""
    names = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "golang": "go", "c++": "cpp", "cc": "cpp", "h": "c"}
    out = F.lower(lang)
    for k, v in names.items():
        out = F.when(F.lower(lang) == k, v).otherwise(out)
    return out


def file_has_edges(files, edge_files):
    """Rows of ``files(file)`` that are among ``edge_files(file)``, as whole path or as its end."""
    exact = files.join(edge_files, "file", "left_semi")
    base = edge_files.select(P.basename(F.col("file")).alias("b"), F.col("file").alias("e"))
    tail = files.join(edge_files, "file", "left_anti").withColumn("b", P.basename(F.col("file"))).join(base, "b").where(F.endswith("file", F.concat(F.lit("/"), "e")) | F.endswith("e", F.concat(F.lit("/"), "file")))
    return exact.union(tail.select(*files.columns).distinct())

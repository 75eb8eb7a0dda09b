"""Resolution of names to targets: maps, preferences, evidence and per-language call edges."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..sources import extract as X
from .names import enclosing_block, peer_callers
from .storage import save


def callers_with_peers(nodes: DataFrame, edges: DataFrame, seed: DataFrame) -> DataFrame:
    """``(id, peer)``: the seed's own callers and, marked, those of its name's other definitions."""
    own = edges.join(seed.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.lit(False).alias("peer"))
    return own.union(peer_callers(nodes, edges, seed).select("id", F.lit(True)))


def all_name_ids(nodes: DataFrame) -> DataFrame:
    """``(name, id)`` of call targets with names of two bytes or more."""
    return nodes.where(T.call_target_kind(F.col("kind")) & (F.octet_length("name") >= 2)).select("name", "id")


def unique_name_map(nodes: DataFrame) -> DataFrame:
    rows = all_name_ids(nodes).where(F.octet_length("name") >= 3)
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")


def preference(path, name):
    """Of ambiguous definitions: production 100, the application's path, a file named like it 120, not private 10."""
    return F.when(P.noise_block(path), 0).otherwise(100) + P.app_path_priority(path) + P.stem_match(path, name) + F.when(F.startswith(name, F.lit("_")), 0).otherwise(10)


py_pref = ts_pref = preference


def ambiguous_pref(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, id)``: the preferred call target of each of ``names(name)``."""
    rows = nodes.where(T.call_target_kind(F.col("kind"))).join(names.select("name").distinct(), "name")
    order = Window.partitionBy("name").orderBy(F.desc("p"), "file", "id")
    return rows.withColumn("p", preference(F.col("file"), F.col("name"))).withColumn("r", F.row_number().over(order)).where("r = 1").select("name", "id")


def global_name_map(nodes: DataFrame) -> DataFrame:
    """Unique names first, the preferred definition for the others."""
    one = unique_name_map(nodes)
    rest = all_name_ids(nodes).where(F.octet_length("name") >= 3).select("name").distinct().join(one, "name", "left_anti")
    return one.union(ambiguous_pref(nodes, rest))


GENERIC = ["new", "get", "set", "run", "len", "map", "push", "pop", "next", "open", "close", "read", "write", "init", "default", "from", "into"]


def resolve_target(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` of ``sites(src, file, name)``: the file's own definition, else the global one unless the name is generic, else the same for the last dotted part."""
    defs = all_name_ids(nodes).join(nodes.select("id", "file"), "id").withColumnRenamed("id", "dst")
    table = global_name_map(nodes).withColumnRenamed("id", "dst")
    rows = sites.select("src", "file", "name").distinct().withColumn("leaf", F.element_at(F.split("name", r"\.|::"), -1))
    rows = rows.withColumn("n", F.struct("src", "file", F.col("name").alias("called")))
    out = None
    for i, key in enumerate(("name", "leaf")):
        local = rows.join(defs.withColumnRenamed("name", key), ["file", key]).select("n", "src", "dst", F.lit(4 - 2 * i).alias("rank"))
        wide = rows.where(~F.col(key).isin(*GENERIC)).join(table.withColumnRenamed("name", key), key).select("n", "src", "dst", F.lit(3 - 2 * i).alias("rank"))
        out = local.union(wide) if out is None else out.union(local).union(wide)
    order = Window.partitionBy("n").orderBy(F.desc("rank"), "dst")
    return out.withColumn("r", F.row_number().over(order)).where("r = 1 and src <> dst").select("src", "dst").distinct()


def collect_call_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Call sites joined to the block around them, then to their targets."""
    at = enclosing_block(nodes, calls, "name")
    return resolve_target(at.select(F.col("id").alias("src"), "file", "name"), nodes)


def usage_edges(nodes: DataFrame) -> DataFrame:
    """``(src, dst)``: blocks that mention a type of their file by its whole name."""
    return usages(nodes).select("src", "dst").distinct()


def usages(nodes: DataFrame) -> DataFrame:
    """``(src, dst, file, name, word)``: the same with the block's name and the type's.

    A block meets the names of its file's types first, so that a row is made for each
    mention of one and not for each word.
    """
    types = nodes.where(T.type_target_kind(F.col("kind")) & (F.octet_length("name") >= 3)).select("file", F.col("name").alias("word"), F.col("id").alias("dst"))
    blocks = nodes.where(~T.type_target_kind(F.col("kind"))).select(F.col("id").alias("src"), "file", "name", "source").join(types.groupBy("file").agg(F.collect_set("word").alias("types")), "file")
    words = blocks.select("src", "file", "name", F.explode(F.array_intersect(F.regexp_extract_all("source", F.lit(r"[A-Za-z_]\w*"), F.lit(0)), "types")).alias("word"))
    return words.join(types, ["file", "word"]).select("src", "dst", "file", "name", "word").distinct()


def _calls_of(lang: tuple[str, ...]):
    def edges(nodes: DataFrame, sites: DataFrame) -> DataFrame:
        return X.call_edges(nodes.where(F.col("lang").isin(*lang)), sites.where(F.col("lang").isin(*lang)))

    return edges


py_call_edges, go_call_edges, rust_call_edges = _calls_of(("python",)), _calls_of(("go",)), _calls_of(("rust",))
ts_call_edges, c_call_edges, cpp_call_edges = _calls_of(("typescript",)), _calls_of(("c",)), _calls_of(("cpp", "c"))
ts_import_edges = ts_call_edges


def lang_dispatch(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """Call and usage edges of all languages."""
    return X.call_edges(nodes, sites).union(usage_edges(nodes)).distinct()


def ts_reexport(exports: DataFrame, most: int = 8) -> DataFrame:
    """``(file, name, origin)`` of re-exports followed to where the name is defined.

    ``exports(file, name, target)``: target is null for a definition, else the
    file it comes from; ``*`` stands for all names.  Named beats star; a name
    that stars bring from two origins, or a cycle, resolves to nothing.
    """
    found = exports.where("target is null and name <> '*'").select("file", "name", F.col("file").alias("origin"), F.lit(True).alias("named"))
    for _ in range(most):
        at = found.select(F.col("file").alias("target"), "name", "origin")
        named = exports.where("target is not null and name <> '*'").join(at, ["target", "name"]).select("file", "name", "origin", F.lit(True).alias("named"))
        star = exports.where("target is not null and name = '*'").select("file", "target").join(at, "target").where("name <> 'default'").select("file", "name", "origin", F.lit(False).alias("named"))
        rows = found.union(named).union(star).distinct()
        best = rows.withColumn("top", F.max("named").over(Window.partitionBy("file", "name"))).where("named = top").drop("top")
        found = best.groupBy("file", "name", "named").agg(F.min("origin").alias("origin"), F.countDistinct("origin").alias("n")).where("n = 1").select("file", "name", "origin", "named")
        found = save(found, "reexport")  # else the plan would treble in every round
    return found.select("file", "name", "origin")


def enclosing_callable(nodes: DataFrame, sites: DataFrame, *of: str) -> DataFrame:
    return enclosing_block(nodes.where(T.call_target_kind(F.col("kind"))), sites, of=of)


def ast_ancestor(nodes: DataFrame, ids: DataFrame, most: int = 64) -> DataFrame:
    """``(id, ancestor, depth)`` along parent_id; a chain ends after ``most`` parents, as one that meets itself would go on."""
    parent = nodes.where("parent_id is not null").select(F.col("id").alias("at"), "parent_id")
    now = ids.select("id", F.col("id").alias("at"))
    out = None
    for depth in range(1, most + 1):
        # Written, or each round would walk all rounds before it again.
        now = save(now.join(parent, "at").select("id", F.col("parent_id").alias("at")), "ancestors")
        step = now.select("id", F.col("at").alias("ancestor"), F.lit(depth).alias("depth"))
        out = step if out is None else out.union(step)
        if now.isEmpty():
            break
    return out


def module_hints(label: str) -> list[str]:
    """Files that a module label may stand for."""
    p = label.replace("::", "/").replace(".", "/").strip("/")
    return [f"{p}.{e}" for e in ("rs", "py", "ts", "tsx", "js", "go", "c", "h", "cc", "cpp", "hpp")] + [f"{p}/{f}" for f in ("mod.rs", "lib.rs", "__init__.py", "index.ts", "index.js", "index.tsx")]


def in_module(file: Column, label: str) -> Column:
    """Files that a module label may stand for."""
    hints = module_hints(label)
    # One search for all hints, and only in paths that hold what they share.
    shared = os.path.commonprefix(hints)
    return F.contains(file, F.lit(shared)) & file.rlike(r"(?:\A|/)(?:" + "|".join(map(re.escape, hints)) + r")\z")


def _parts(label: str) -> list[str]:
    return [x for x in label.replace("::", "/").replace(".", "/").split("/") if x] or [""]


def in_module_folder(file: Column, label: str) -> Column:
    """Files below a folder of the module's name."""
    folder = "/".join(_parts(label)) + "/"
    return (F.startswith(file, F.lit(folder)) | F.contains(file, F.lit("/" + folder))) if folder != "/" else F.lit(False)


def module_kind(kind: Column) -> Column:
    k = F.lower(kind)
    return F.contains(k, F.lit("mod_item")) | F.contains(k, F.lit("namespace")) | (k == "module")


def may_hold_module(path: Column, source: Column, label: str) -> Column:
    """Files that may have nodes of ``module_interior``: by their place, or as one may be a block of the module's name."""
    block = X.of_langs(path, *MODULE_LANGS) & F.contains(source, F.lit(_parts(label)[-1])) & source.rlike(r"\b(?:mod|module|namespace)\b")
    return in_module(path, label) | in_module_folder(path, label) | block


#: Languages that ``extract`` finds module blocks in.
MODULE_LANGS = [lang for lang, rules in X.RULES.items() if any("mod_item" in kind or "namespace" in kind or kind == "module" for kind, _ in rules)]


def module_interior(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes of the files that a module label may stand for, of those in a folder of its name, and of those under a module block of its name, without that block.

    A block of the name stands for the label if it lies inside of the module that the rest of the label names.
    """
    nodes = save(nodes, "modules")
    parts = _parts(label)
    blocks = nodes.where(module_kind(F.col("kind")) & F.col("name").isin(parts)).select("id", "name")
    above = ast_ancestor(nodes, nodes.where("parent_id is not null").select("id")).join(blocks.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    inside = None
    for n, name in enumerate(parts, 1):
        own = blocks.where(F.col("name") == name).select("id")
        if inside is not None:
            own = own.join(inside, "id", "left_semi")
        upto = "/".join(parts[:n])
        under = above.where(F.col("name") == name).join(own.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
        inside = nodes.where(in_module(F.col("file"), upto) | in_module_folder(F.col("file"), upto)).select("id").union(under)
    fit = nodes.where((F.col("name") != "") & (T.role_tier(F.col("kind")) > 0))
    return fit.join(inside, "id", "left_semi").join(own, "id", "left_anti")


def may_define(files: DataFrame, name: str) -> DataFrame:
    """Files with all definitions of a name and all that is around them: those that hold it, or letters that Python may read as others."""
    return files.where(F.contains("source", F.lit(name)) | (F.octet_length("source") > F.length("source")))


def qualify_evidence(nodes: DataFrame, parent: str, leaf: str) -> DataFrame:
    """``(id, points)`` of ``leaf`` definitions by what ties them to ``parent``: ancestor 200, file stem 180, directory 160, module file 150, text 100, any 80."""
    rows = nodes.where(F.col("name") == leaf)
    above = ast_ancestor(nodes, rows.select("id")).join(nodes.select(F.col("id").alias("ancestor"), F.col("name").alias("an")), "ancestor").where(F.col("an") == parent).select("id").distinct().withColumn("a", F.lit(1))
    low = parent.lower()
    f = F.lower("file")
    points = (
        F.when(F.col("a") == 1, 200).when(P.stem(f) == low, 180).when(F.array_contains(P.dirs(f), low), 160)
        .when(F.endswith(f, F.lit(f"{low}/mod.rs")) | F.endswith(f, F.lit(f"{low}/__init__.py")), 150).when(T.word_boundary_ascii(F.col("source"), parent), 100).otherwise(80)
    )
    return rows.join(above, "id", "left").select("id", points.alias("points"))


def qualify_match(nodes: DataFrame, parent: str, leaf: str) -> DataFrame:
    return qualify_evidence(nodes, parent, leaf).where("points >= 100")


def seed_qualified(nodes: DataFrame, query: str) -> DataFrame:
    """``(id)`` of ``parent::leaf``: the best evidence, then the least id."""
    parent, _, leaf = query.rpartition("::")
    return qualify_match(nodes, parent.rsplit("::", 1)[-1], leaf).orderBy(F.desc("points"), "id").limit(1).select("id")


def seed_bridges(bridges: DataFrame, seed: DataFrame) -> DataFrame:
    """``(id, direction, kind)`` of the seed's typed bridges."""
    out = bridges.join(seed.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.lit("out").alias("direction"), "kind")
    into = bridges.join(seed.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.lit("in").alias("direction"), "kind")
    return out.union(into)


typed_bridges = seed_bridges


def detect_full_files(files: DataFrame, prompt: str) -> DataFrame:
    """Known files whose path the prompt names."""
    return files.where(F.contains(F.lit(prompt), F.col("path")))


def cite_fill(rows: DataFrame, nodes: DataFrame, top: int = 3, lines: int = 6) -> DataFrame:
    """``cite``: the first lines of the source of the ``top`` rows by place."""
    text = nodes.select("id", F.array_join(F.slice(F.split("source", "\n"), 1, lines), "\n").alias("text"))
    return rows.join(text, "id", "left").withColumn("cite", F.when(F.col("place") <= top, F.col("text"))).drop("text")


def loc_fallback_gate(nodes: DataFrame, name: str) -> bool:
    """Exactly one callable definition and file of the name."""
    r = nodes.where((F.col("name") == name) & T.call_target_kind(F.col("kind"))).agg(F.count("*"), F.countDistinct("file")).first()
    return tuple(r) == (1, 1)


def token_in_graph(nodes: DataFrame, token: str) -> bool:
    strong = T.strong_token(token)
    return not nodes.where(T.name_hit(F.col("name"), F.lit(token), strong) | T.path_hit(F.col("file"), F.lit(token), strong)).isEmpty()


def exact_in_graph(nodes: DataFrame, name: str) -> bool:
    return not nodes.where(F.col("name") == name).isEmpty()

"""Names: the index, collisions, homonyms, peers and enclosing blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import app_path_priority, noise_block
from ..functions.text import call_target_kind, junk_name, role_tier


def name_locations(nodes: DataFrame, cap: int = 16) -> DataFrame:
    """``(name, place, id, file, start_line)``: the first ``cap`` places of each name by file, line and id."""
    order = Window.partitionBy("name").orderBy("file", "start_line", "id")
    return nodes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("name", "place", "id", "file", "start_line")


def name_lookup(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def files_for_name(nodes: DataFrame, name: str) -> DataFrame:
    return name_lookup(nodes, name).select("file").distinct()


def unique_names(nodes: DataFrame) -> DataFrame:
    """Names of three bytes or more with exactly one call target."""
    fit = nodes.where(call_target_kind(F.col("kind")) & (F.octet_length("name") >= 3))
    return fit.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


def name_collisions(nodes: DataFrame, least_files: int = 3, cap: int = 50) -> DataFrame:
    """Names defined in ``least_files`` files or more, by files, definitions and name."""
    fit = nodes.where((role_tier(F.col("kind")) >= 50) & ~junk_name(F.col("name")))
    out = fit.groupBy("name").agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_defs"), F.countDistinct("kind").alias("n_kinds"))
    return out.where(F.col("n_files") >= least_files).orderBy(F.desc("n_files"), F.desc("n_defs"), "name").limit(cap)


def name_index_audit(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Nodes that ``index(name, id)`` misses, index rows without a node, and ids under another name."""
    n, i = nodes.select("id", F.col("name").alias("n")), index.select("id", F.col("name").alias("m"))
    return n.join(i, "id", "full_outer").agg(
        F.sum(F.col("m").isNull().cast("long")).alias("missing"), F.sum(F.col("n").isNull().cast("long")).alias("orphan"), F.sum((F.col("n") != F.col("m")).cast("long")).alias("mismatch")
    )


def pick_homonym(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row per name: production first, then tier, path priority, fan-in, the file and the id."""
    rows = nodes.join(degrees.select("id", "in_degree"), "id")
    key = F.struct(
        (~noise_block(F.col("file"))).cast("int").alias("a"), role_tier(F.col("kind")).alias("b"), app_path_priority(F.col("file")).alias("c"), F.col("in_degree").alias("d")
    )
    order = Window.partitionBy("name").orderBy(F.desc("k"), "file", "id")
    return rows.withColumn("k", key).withColumn("r", F.row_number().over(order)).where("r = 1").select("name", "id", "file", "in_degree")


def filter_seeds(rows: DataFrame) -> DataFrame:
    """Relative retains per name: each rule applies only while a better row remains."""
    w = Window.partitionBy("name")
    rows = rows.withColumn("t", role_tier(F.col("kind"))).withColumn("noise", noise_block(F.col("file")))
    for least in (50, 90):
        rows = rows.withColumn("any", F.max((F.col("t") >= least).cast("int")).over(w)).where((F.col("any") == 0) | (F.col("t") >= least))
    rows = rows.withColumn("any", F.max((~F.col("noise")).cast("int")).over(w)).where((F.col("any") == 0) | ~F.col("noise"))
    return rows.drop("t", "noise", "any")


def peer_callers(nodes: DataFrame, edges: DataFrame, seed: DataFrame) -> DataFrame:
    """Callers of other call targets that share the name of ``seed(id)`` in another file, less its own callers."""
    own = nodes.join(seed.select("id"), "id").select(F.col("id").alias("seed"), "name", F.col("file").alias("own_file"))
    peers = nodes.where(call_target_kind(F.col("kind"))).join(own, "name").where("id <> seed and file <> own_file").select("seed", "id")
    reached = edges.join(peers.withColumnRenamed("id", "dst"), "dst").select("seed", F.col("src").alias("id")).distinct()
    direct = edges.join(own.select(F.col("seed").alias("dst")), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("id"))
    return reached.join(direct, ["seed", "id"], "left_anti")


def enclosing_block(blocks: DataFrame, sites: DataFrame, *keep: str, width: int = 64, of: tuple[str, ...] = ()) -> DataFrame:
    """Each ``sites(file, line)`` row, with the columns ``keep``, and the smallest ``blocks(id, file, start_line, end_line)`` span around it, with its columns ``of``.

    A range join by bins: a span is listed in every bin of ``width`` lines it
    touches, a site in one, so rows meet by equal (file, bin).
    """
    binned = blocks.select(
        "id", "file", "start_line", "end_line", *of, F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))).alias("bin")
    )
    at = sites.select("file", "line", *keep, F.floor(F.col("line") / width).alias("bin"))
    inside = at.join(binned, ["file", "bin"]).where("line between start_line and end_line")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("id").alias("id"), *of))
    return inside.groupBy("file", "line", *keep).agg(best.alias("b")).select("file", "line", *keep, F.col("b.id").alias("id"), *(F.col(f"b.{c}").alias(c) for c in of))


def type_nested(blocks: DataFrame, width: int = 64) -> DataFrame:
    """``(type_id, id)``: blocks strictly inside a type's lines in its file."""
    types = blocks.where(role_tier(F.col("kind")) == 100)
    binned = types.select(F.col("id").alias("type_id"), "file", F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))).alias("bin"))
    at = blocks.withColumn("bin", F.floor(F.col("start_line") / width))
    return binned.join(at, ["file", "bin"]).where("start_line >= a and end_line <= b and id <> type_id and (start_line > a or end_line < b)").select("type_id", "id")


def c_decl_own(decl_file: Column) -> Column:
    """What a prototype's file alone adds to its score."""
    return F.when(decl_file.rlike(r"\.(h|hh|hpp)$"), 40).otherwise(0) - F.when(noise_block(decl_file), 50).otherwise(0)


def c_decl_score(def_file: Column, decl_file: Column, static: Column, included: Column) -> Column:
    """Stem 100, header 40, same directory 30, include 20, test -50, static -80."""
    from ..functions.paths import module_key, stem

    return (
        F.when(stem(def_file) == stem(decl_file), 100).otherwise(0) + F.when(module_key(def_file) == module_key(decl_file), 30).otherwise(0) + F.when(included, 20).otherwise(0)
        - F.when(static, 80).otherwise(0) + c_decl_own(decl_file)
    )


def c_decl_def(nodes: DataFrame) -> DataFrame:
    """``(src, dst)``: each C definition with its best prototype of the same name; static ones in their file only.

    What a definition adds to a prototype's score is an equal stem and an equal
    directory, so its best prototype is the best of all of its name, of those with
    its stem, with its directory, or with both: a row for each, however many there are.
    """
    from ..functions.paths import module_key, stem

    c = nodes.where(F.col("lang").isin("c", "cpp"))
    static = F.ltrim(F.element_at(F.split("source", "\n"), 1)).startswith("static")
    defs = c.where("kind = 'function_definition'").select(F.col("id").alias("src"), "name", F.col("file").alias("f1"), static.alias("static"))
    decls = c.where("kind = 'function_declaration'").select(F.col("id").alias("dst"), "name", F.col("file").alias("f2"))
    decls = decls.groupBy("name", "f2").agg(F.min("dst").alias("dst"))

    def shared(file: str) -> Column:
        s, m = stem(F.col(file)), module_key(F.col(file))
        keys = F.array(F.lit(""), F.concat(F.lit("s:"), s), F.concat(F.lit("m:"), m), F.concat(F.lit("b:"), m, F.lit("/"), s))
        return F.explode(F.array_compact(keys)).alias("shared")

    # Of prototypes that a definition has as much in common with, the order is that of their own points.
    best = F.min(F.struct((-c_decl_own(F.col("f2"))).alias("s"), "f2", "dst")).alias("b")
    bests = decls.select("name", "f2", "dst", shared("f2")).groupBy("name", "shared").agg(best).select("name", "shared", "b.f2", "b.dst")
    places = defs.where("not static").select("name", "f1").distinct()
    met = places.select("name", "f1", shared("f1")).join(bests, ["name", "shared"])
    met = met.withColumn("s", c_decl_score(F.col("f1"), F.col("f2"), F.lit(False), F.lit(False))).where("s > 0")
    chosen = met.groupBy("name", "f1").agg(F.min(F.struct((-F.col("s")).alias("s"), "f2", "dst")).alias("b"))
    free = defs.where("not static").join(chosen, (defs.name == chosen.name) & defs.f1.eqNullSafe(chosen.f1)).select("src", "b.dst")
    held = defs.where("static is null or static").join(decls.withColumnRenamed("f2", "f1"), ["name", "f1"]).select("src", "dst")
    return free.union(held)

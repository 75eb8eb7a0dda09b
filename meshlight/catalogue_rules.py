"""Rules of paths, names, kinds and ranks as registered queries, each with the rule in SQL.

The rules run over ``code_nodes``, a definition for every document, whose places,
names and kinds reach all branches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import predicates as R
from .functions import text as T
from .operators import graph as G
from .operators import names as N
from .operators import resolution as V
from .plans import analytics as A
from .plans import ranking as K
from .sources.views import cte, load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_WITH = cte("code_nodes")


# Fixed values, written out here so that the SQL does not follow the rules that it is to check.
_W_SOURCES = "rs py ts tsx js jsx mjs svelte go c h cc cpp cxx hpp hh".split()
_W_VENDOR = "vendor vendored _vendor _click third_party third-party external deps ext node_modules site-packages".split()
_W_NOISE = "tests test testutil testing testdata __tests__ docs docs_src doc tutorials tutorial guides examples fixtures benches".split()
_W_INFRA = "node_modules target .git .cache __pycache__".split()
_W_JUNK = "if else for while loop match return let unknown anonymous block self super crate".split()
_W_TRACE = "new get set len map iter into from clone default unwrap expect collect push pop insert remove print println format str string vec some none ok err".split()
_W_ENTRY = "main lib mod index app __init__ __main__ server cli".split()
_W_COLLISION = "main new test run init setup default from into drop clone index build error result config options".split()
_W_PRIMITIVE = "int str bool float u8 u32 u64 i32 i64 usize string vec option result list dict map set".split()
_W_BOILERPLATE = "fmt eq hash cmp partial_cmp drop deref as_ref borrow default next __init__ __repr__ __str__ __eq__ toString valueOf".split()
_W_VERBS = "run do call exec handle process init main test apply update".split()


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def rule(name: str, column: Callable[[], Column], sql: str) -> None:
    """``(id, value)``: the rule of every node."""

    def run(spark, sf_dir):
        return load(spark, sf_dir, "code_nodes").select("id", column().alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"{_WITH} SELECT id, {sql} AS value FROM code_nodes"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def nodes_of(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "code_nodes")


def file_() -> Column:
    return F.col("file")


def name_() -> Column:
    return F.col("name")


def kind_() -> Column:
    return F.col("kind")


# ---------------------------------------------------------------- the rules in SQL

_BASE = "split_part(file, '/', -1)"
_STEM = rf"regexp_replace({_BASE}, '\.[^.]*$', '')"
_EXT = rf"lower(regexp_extract({_BASE}, '\.([^.]+)$', 1))"
_DIRS = "list_slice(string_split(file, '/'), 1, -2)"
_LOW_DIRS = "list_slice(string_split(lower(file), '/'), 1, -2)"
_SOURCE = f"({_EXT} IN ({_listed(_W_SOURCES)}))"
_VENDORED = f"list_has_any({_LOW_DIRS}, [{_listed(_W_VENDOR)}])"
_NOISE_FILE = (
    rf"(starts_with(lower({_BASE}), 'test_') OR regexp_matches(lower({_BASE}), '_tests?\.[^.]+$') OR regexp_matches(lower({_BASE}), '\.(test|spec)\.[^.]+$') OR lower({_BASE}) IN ('conftest.py', 'tests.rs', 'test.rs') OR "
    + " OR ".join(f"ends_with(lower({_BASE}), '{x}')" for x in P.NOISE_FILES) + ")"
)
_NOISE = f"(list_has_any({_LOW_DIRS}, [{_listed([*_W_NOISE, *_W_VENDOR])}]) OR {_NOISE_FILE})"
_PRIORITY = (
    f"(CASE WHEN {_VENDORED} THEN 20 WHEN {_NOISE} THEN 10 WHEN starts_with(file, 'src/') THEN 200 WHEN starts_with(file, 'lib/') THEN 199 WHEN starts_with(file, 'app/') THEN 198 WHEN starts_with(file, 'core/') THEN 197"
    " WHEN regexp_matches(file, '^(crates|packages|pkg)/[^/]+/src/') THEN 150 WHEN starts_with(file, 'tools/') THEN 100 WHEN starts_with(file, 'scripts/') THEN 99 ELSE 50 END)"
)
_STEM_MATCH = f"(CASE WHEN lower({_STEM}) = lower(name) OR ends_with(lower({_STEM}), '_' || lower(name)) OR starts_with(lower({_STEM}), lower(name) || '_') THEN 120 ELSE 0 END)"
_TIER = "(CASE " + " ".join(
    "WHEN " + " OR ".join([f"contains(lower(kind), '{x}')" for x in words] + (["lower(kind) = 'call'"] if tier == 10 else ["lower(kind) = 'module'"] if tier == 30 else [])) + f" THEN {tier}" for tier, words in T.TIERS
) + " ELSE 20 END)"
_CALLABLE = "(regexp_matches(lower(kind), 'function|method|arrow') AND NOT regexp_matches(lower(kind), 'call|impl|type|struct|class|enum|trait|interface'))"
_TYPE = "(" + " OR ".join(f"contains(lower(kind), '{x}')" for x in T.TYPE_KINDS) + ")"
_JUNK = f"(length(regexp_replace(name, '[^\\pL\\pN]', '', 'g')) < 3 OR lower(name) IN ({_listed(_W_JUNK)}))"
_TRACE_NOISE = f"(strlen(name) < 3 OR lower(name) IN ({_listed(_W_TRACE)}))"
_ENTRY_FILE = f"(lower({_STEM}) IN ({_listed(_W_ENTRY)}))"
_LANDMARK = f"(NOT {_NOISE} AND (lower(name) = 'main' OR {_ENTRY_FILE} AND lower(name) IN ('main', 'run', 'start', 'app', 'serve', 'new')))"
_ENTRY_HINT = f"(CASE WHEN lower(name) = 'main' THEN 100 WHEN {_ENTRY_FILE} THEN 20 WHEN regexp_matches(lower(name), '^(run|start)') THEN 15 ELSE 0 END)"
_ISLAND = "array_to_string(list_slice(string_split(file, '/'), 1, 2), '/')"
_MODULE = "regexp_replace(file, '/[^/]*$', '')"
_FORWARD = r"(regexp_matches(source, '^\s*(template\s*<[^>]*>\s*)?(struct|class|enum)\s+\w+\s*;\s*$') OR regexp_matches(source, '^\s*(using\s+\w+\s*=|typedef\s|(pub\s+)?type\s+\w+\s*=)[^{]*;?\s*$'))"

# ---------------------------------------------------------------- paths and scopes

rule("normalize_path", lambda: P.normalize_path(F.concat(F.lit("C:\\x\\.//"), file_())), r"'x/./' || file")
rule("ext_filter", lambda: P.ext_filter(file_()), _SOURCE)
rule("dir_prune", lambda: P.dir_prune(file_(), ["scripts"]), f"list_has_any({_LOW_DIRS}, [{_listed([*_W_INFRA, *_W_VENDOR, 'scripts'])}])")
rule("priority_wave", lambda: P.priority_wave(file_()), "CASE WHEN regexp_matches('/' || lower(file), '/(tests?|docs?|examples|benches|fixtures)/') THEN 3 WHEN regexp_matches('/' || lower(file), '/src/') THEN 0 WHEN regexp_matches('/' || lower(file), '/(lib|pkg|crates|packages)/') THEN 1 ELSE 2 END")
rule("path_plan_priority", lambda: P.path_plan_priority(file_(), ["src/core", "src"], ["docs", "vendor"]), "CASE WHEN starts_with(file, 'docs') THEN 200 WHEN starts_with(file, 'vendor') THEN 201 WHEN starts_with(file, 'src/core') THEN 0 WHEN starts_with(file, 'src') THEN 1 ELSE 100 END")
rule("scope_facet", lambda: P.scope_facet(file_()), f"array_to_string(list_slice({_DIRS}, 1, 2), '/') || '/'")
rule("scope_file", lambda: P.scope_file(file_(), "a/src/lib.py") | P.scope_file(file_(), "main.rs"), f"file = 'a/src/lib.py' OR ends_with(file, '/a/src/lib.py') OR {_BASE} = 'main.rs'")
rule("scope_ignore", lambda: P.scope_ignore(file_(), "src") | P.scope_ignore(file_(), "s/guid"), "list_contains(string_split(file, '/'), 'src') OR contains(file, 's/guid')")
rule("scope_in_neighbor", lambda: P.scope_in_neighbor(file_(), "src"), "starts_with(file, 'src') OR contains(file, '/src') OR ends_with(file, 'src')")
rule("vendored", lambda: P.vendored(file_()), _VENDORED)
rule("noise_filename", lambda: P.noise_filename(file_()), _NOISE_FILE)
rule("noise_block", lambda: P.noise_block(file_()), _NOISE)
rule("testish_neighbor", lambda: P.testish_neighbor(file_()), rf"{_NOISE} OR regexp_matches(lower(file), '(^|/)tests?(/|$)|_test\.|\.test\.|\.spec\.')")
rule("cluster_of", lambda: P.cluster_of(F.col("lang"), file_()), "CASE lang WHEN 'rust' THEN 'rust' WHEN 'python' THEN 'python' WHEN 'typescript' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'c' THEN 'c_cpp' WHEN 'cpp' THEN 'c_cpp' ELSE 'other' END")
rule("app_path_priority", lambda: P.app_path_priority(file_()), _PRIORITY)
rule("basename_match", lambda: P.basename_match(file_(), name_()), f"lower({_STEM}) = lower(name)")
rule("stem_match", lambda: P.stem_match(file_(), name_()), _STEM_MATCH)
rule("module_kw", lambda: T.module_kw(P.module_key(file_()), F.lit("src")), f"CASE WHEN contains(lower({_MODULE}), 'src') THEN 13 + CASE WHEN contains(split_part(lower({_MODULE}), '/', -1), 'src') THEN 8 ELSE 0 END ELSE 0 END")
rule("path_hit", lambda: T.path_hit(file_(), F.lit("core"), False), r"list_contains(string_split_regex(lower(file), '[/\\.-]'), 'core')")

# ---------------------------------------------------------------- names and kinds

rule("scope_symbol", lambda: R.scope_symbol(name_(), "b::open"), "name = 'b::open' OR split_part(name, '::', -1) = 'open'")
rule("seed_ident", lambda: R.seed_ident(name_(), "x::Open()"), "lower(split_part(name, '::', -1)) = 'open'")
rule("collision_junk", lambda: R.collision_junk(name_()), f"{_JUNK} OR lower(name) IN ({_listed(_W_COLLISION)})")
rule("entry_landmark", lambda: R.entry_landmark(file_(), name_()), _LANDMARK)
rule("entry_hint", lambda: R.entry_hint(file_(), name_()), _ENTRY_HINT)
rule("entry_mult", lambda: R.entry_mult(file_(), name_()), f"CASE WHEN {_LANDMARK} AND lower(name) = 'main' THEN 24 WHEN {_LANDMARK} THEN 16 WHEN {_ENTRY_FILE} THEN 8 ELSE 1 END")
rule("arch_kind", lambda: R.arch_kind(kind_()), "regexp_matches(lower(kind), 'struct|class|trait|interface|enum|impl|module|mod_item')")
rule("hub_primitive", lambda: R.hub_primitive(name_(), F.col("in_degree"), F.col("out_degree"), F.lit(2000)), f"strlen(name) <= 2 OR lower(name) IN ({_listed(_W_PRIMITIVE)}) OR (in_degree > 20 AND out_degree <= 2)")
rule("module_shell", lambda: R.module_shell(kind_(), F.col("source")), r"contains(lower(kind), 'mod') AND regexp_matches(source, '^\s*(pub(\([^)]*\))?\s+)?mod\s+\w+\s*;\s*$')")
rule("forward_shell", lambda: R.forward_shell(F.col("source")), _FORWARD)
rule("ctor_like", lambda: R.ctor_like(name_(), F.lit("Parser")), "lower(name) IN ('new', 'constructor', '__init__', 'init', 'default') OR starts_with(name, '~') OR name = 'Parser'")
rule("static_c", lambda: R.static_c(F.col("source")), "starts_with(ltrim(source), 'static')")
rule("decl_def_pair", lambda: R.decl_def_pair(kind_(), F.lit("function_definition"), name_() == "parse_item", F.col("lang")), "name = 'parse_item' AND lang IN ('c', 'cpp') AND kind = 'function_declaration'")
rule("homonym_type", lambda: R.homonym_type(name_(), kind_(), F.col("id"), F.lit("Parser"), F.lit("n:4")), f"name = 'Parser' AND id <> 'n:4' AND {_TYPE}")
rule("peripheral", lambda: R.peripheral(file_(), F.lit("src/main.rs")), f"{_PRIORITY} + 60 < 200")
rule("type_hub", lambda: R.type_hub(kind_(), F.col("source")), f"{_TIER} = 100 AND NOT {_FORWARD}")
rule("edge_buildable", lambda: R.edge_buildable(file_()), _SOURCE)
rule("junk_export_host", lambda: R.junk_export_host(file_(), F.col("source")), f"{_NOISE} OR contains(source, 'macro_rules!') OR contains(source, '#[cfg(test)]')")
rule("neighbor_noise_name", lambda: R.neighbor_noise_name(name_()), f"name IN ({_listed(_W_BOILERPLATE)}) OR {_TRACE_NOISE}")
rule("edge_family", lambda: R.edge_family(F.col("lang")), "CASE lang WHEN 'rust' THEN 'rust' WHEN 'python' THEN 'python' WHEN 'typescript' THEN 'script' WHEN 'go' THEN 'go' WHEN 'c' THEN 'c_family' WHEN 'cpp' THEN 'c_family' ELSE 'other' END")
rule("lang_label", lambda: R.lang_label(P.extension(file_())), f"CASE {_EXT} WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'h' THEN 'c' ELSE {_EXT} END")
rule("testish_block", lambda: R.testish_block(file_(), name_(), F.col("source")), rf"{_NOISE} OR starts_with(lower(name), 'test_') OR regexp_matches(source, '^\s*[\w.:]+\([^)]*\)\s*;?\s*$')")
rule("call_target_kind", lambda: T.call_target_kind(kind_()), _CALLABLE)
rule("type_target_kind", lambda: T.type_target_kind(kind_()), _TYPE)
rule("role_tiers", lambda: T.role_tier(kind_()), _TIER)
rule("weak_penalty", lambda: T.weak_penalty(name_(), P.noise_block(file_())), f"CASE WHEN {_NOISE} THEN 100 WHEN lower(name) IN ({_listed(_W_VERBS)}) THEN 40 ELSE 0 END")
rule("structural_mult", lambda: T.structural_mult(kind_(), F.col("in_degree")), f"CAST(CASE WHEN {_TIER} = 0 THEN 0 WHEN {_TYPE} THEN 1.5 WHEN {_CALLABLE} THEN 1 WHEN in_degree = 0 THEN 0.1 ELSE 0.5 END AS DOUBLE)")
rule("coverage", lambda: A.coverage(F.col("in_degree") - 3, F.col("out_degree") == 1, F.col("k") % 2), "k % 2 > 0 AND in_degree - 3 = 0 AND NOT out_degree = 1")

_NAME_SCORE = (
    "(CASE WHEN lower(name) = 'parse' THEN 100500 WHEN ends_with(lower(name), '_parse') THEN 840 WHEN ends_with(lower(name), 'parse') THEN 525 WHEN starts_with(lower(name), 'parse') THEN 470"
    " WHEN list_contains(string_split_regex(lower(name), '[_:]'), 'parse') THEN 420 WHEN contains(lower(name), 'parse') THEN 160 ELSE 0 END)"
)
_PATH_SCORE = r"(CASE WHEN list_contains(string_split_regex(lower(file), '[/\\.-]'), 'parse') THEN 90 WHEN contains(lower(file), 'parse') THEN 30 ELSE 0 END)"
rule("block_score", lambda: T.block_score(name_(), file_(), F.lit("parse")), f"CAST({_NAME_SCORE} + 0.5 * {_PATH_SCORE} AS DOUBLE)")

# ---------------------------------------------------------------- ladders

rule("homonym_score", lambda: K.homonym_score(file_(), kind_(), name_()), f"{_PRIORITY} + {_TIER} + {_STEM_MATCH}")
rule("hub_priority", lambda: K.hub_priority(F.col("in_degree"), file_(), name_()), f"CAST(in_degree AS DOUBLE) * CAST(CASE WHEN {_LANDMARK} THEN 2 WHEN {_NOISE} THEN 0.1 ELSE 1 END AS DOUBLE)")
rule("module_rank", lambda: K.module_rank(kind_(), file_(), name_(), "Parser", F.col("in_degree") > 50, F.col("out_degree") > 1), f"{_TIER} * 1000 + CASE WHEN lower(name) = 'parser' THEN 500 ELSE 0 END + {_STEM_MATCH} + CASE WHEN in_degree > 50 THEN 50 ELSE 0 END + CASE WHEN out_degree > 1 THEN 10 ELSE 0 END")
rule("ipc_rank", lambda: K.ipc_rank(file_(), F.col("end_line") - F.col("start_line")), f"CASE WHEN {_NOISE} THEN 0 ELSE 100 END + {_PRIORITY} - least(end_line - start_line, 90)")
rule("preference", lambda: V.preference(file_(), name_()), f"CASE WHEN {_NOISE} THEN 0 ELSE 100 END + {_PRIORITY} + {_STEM_MATCH} + CASE WHEN starts_with(name, '_') THEN 0 ELSE 10 END")
rule("c_decl_score", lambda: N.c_decl_score(F.lit("src/parser.c"), file_(), F.col("out_degree") == 1, F.col("out_degree") == 2), rf"CASE WHEN {_STEM} = 'parser' THEN 100 ELSE 0 END + CASE WHEN regexp_matches(file, '\.(h|hh|hpp)$') THEN 40 ELSE 0 END + CASE WHEN {_MODULE} = 'src' THEN 30 ELSE 0 END + CASE WHEN out_degree = 2 THEN 20 ELSE 0 END - CASE WHEN {_NOISE} THEN 50 ELSE 0 END - CASE WHEN out_degree = 1 THEN 80 ELSE 0 END")


@query(f"{_WITH} SELECT id, CASE WHEN {_NOISE} THEN 'noise' WHEN file = 'src/main.rs' THEN 'same_file' ELSE 'external' END AS bucket FROM code_nodes")
def neighbor_buckets(spark, sf_dir):
    return K.neighbor_buckets(nodes_of(spark, sf_dir), "src/main.rs").select("id", "bucket")


@query(f"{_WITH} SELECT id FROM code_nodes ORDER BY (id = 'n:4') DESC, {_NOISE}, {_PRIORITY} DESC, {_ENTRY_HINT} DESC, in_degree DESC, file, start_line, id LIMIT 16")
def locations_rank(spark, sf_dir):
    return K.locations_rank(nodes_of(spark, sf_dir).withColumn("score", F.col("in_degree")), "n:4").select("id")


@query(f"{_WITH} SELECT id FROM code_nodes ORDER BY {_LANDMARK} DESC, (NOT starts_with(name, '_')) DESC, {_PRIORITY} + {_TIER} + {_STEM_MATCH} DESC, file, id LIMIT 1")
def seed_pick(spark, sf_dir):
    return K.seed_pick(nodes_of(spark, sf_dir)).select("id")


@query(f"""{_WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY in_degree DESC, id) AS r FROM code_nodes), t AS (SELECT * FROM r WHERE r = 1 ORDER BY in_degree DESC, name LIMIT 10)
SELECT id, greatest(CAST(in_degree AS DOUBLE), CAST(out_degree AS DOUBLE) * CAST(CASE WHEN {_LANDMARK} THEN 2 WHEN {_NOISE} THEN 0.1 ELSE 1 END AS DOUBLE)) AS score FROM t""")
def hub_scored(spark, sf_dir):
    rows = nodes_of(spark, sf_dir).withColumn("score", F.col("in_degree").cast("double")).withColumn("degree", F.col("out_degree"))
    return K.hub_scored(rows, 10).select("id", "score")


@query(f"{_WITH}, r AS (SELECT id, row_number() OVER (PARTITION BY file, name ORDER BY CASE WHEN {_NOISE} THEN 0 ELSE 100 END + {_PRIORITY} - least(end_line - start_line, 90) DESC, id) AS r FROM code_nodes) SELECT id FROM r WHERE r = 1")
def ipc_dedup(spark, sf_dir):
    rows = nodes_of(spark, sf_dir).select("id", "file", F.col("name").alias("callee"), (F.col("end_line") - F.col("start_line")).alias("span"))
    return K.ipc_dedup(rows).select("id")


@query(f"""{_WITH}, a AS (SELECT *, {_TIER} AS t, {_NOISE} AS noise FROM code_nodes), b AS (SELECT *, max(t) OVER (PARTITION BY name) AS m FROM a), c AS (SELECT * FROM b WHERE t >= CASE WHEN m >= 90 THEN 90 WHEN m >= 50 THEN 50 ELSE -1 END),
d AS (SELECT *, bool_or(NOT noise) OVER (PARTITION BY name) AS clean FROM c) SELECT id FROM d WHERE NOT clean OR NOT noise""")
def filter_seeds(spark, sf_dir):
    return N.filter_seeds(nodes_of(spark, sf_dir)).select("id")


# ---------------------------------------------------------------- sets of nodes


@query(cte("docs_nodes") + " SELECT name, min(id) AS id FROM docs_nodes WHERE kind = 'function_item' AND strlen(name) >= 3 GROUP BY name HAVING count(*) = 1")
def unique_name_map(spark, sf_dir):
    return V.unique_name_map(load(spark, sf_dir, "docs_nodes"))


@query(f"""{_WITH}, r AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN {_NOISE} THEN 0 ELSE 100 END + {_PRIORITY} + {_STEM_MATCH} + CASE WHEN starts_with(name, '_') THEN 0 ELSE 10 END DESC, file, id) AS r
 FROM code_nodes WHERE {_CALLABLE}) SELECT name, id FROM r WHERE r = 1""")
def ambiguous_pref(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return V.ambiguous_pref(nodes, nodes.select("name"))


@query(f"{_WITH} SELECT id FROM code_nodes WHERE name = 'Parser'")
def name_lookup(spark, sf_dir):
    return N.name_lookup(nodes_of(spark, sf_dir), "Parser").select("id")


@query(f"{_WITH} SELECT DISTINCT file FROM code_nodes WHERE name = 'Parser'")
def files_for_name(spark, sf_dir):
    return N.files_for_name(nodes_of(spark, sf_dir), "Parser")


@query(f"{_WITH} SELECT DISTINCT file FROM code_nodes WHERE {_TIER} >= 50 AND NOT {_NOISE}")
def serious_files(spark, sf_dir):
    return A.serious_files(nodes_of(spark, sf_dir))


@query(f"{_WITH} SELECT DISTINCT file FROM code_nodes WHERE {_TIER} <> 10 AND NOT {_NOISE}")
def collision_files(spark, sf_dir):
    return A.collision_files(nodes_of(spark, sf_dir))


@query(f"{_WITH} SELECT id FROM code_nodes WHERE {_TIER} >= 50 AND NOT {_NOISE}")
def collapse_serious(spark, sf_dir):
    return K.collapse_serious(nodes_of(spark, sf_dir)).select("id")


@query(f"{_WITH} SELECT id FROM code_nodes WHERE {_TIER} <> 10 AND NOT {_NOISE}")
def collapse_alts(spark, sf_dir):
    return K.collapse_alts(nodes_of(spark, sf_dir)).select("id")


@query(f"{_WITH} SELECT DISTINCT file FROM code_nodes WHERE {_TIER} >= 50 AND NOT {_NOISE}")
def pin_locations(spark, sf_dir):
    return K.pin_locations(nodes_of(spark, sf_dir))


@query(f"{_WITH} SELECT id FROM code_nodes WHERE name NOT IN ('open', 'get') AND NOT ends_with(name, '::open') AND NOT ends_with(name, '::get')")
def exclude(spark, sf_dir):
    return K.exclude(nodes_of(spark, sf_dir), ["open", " get ", "open"]).select("id")


@query(f"{_WITH} SELECT id FROM code_nodes WHERE NOT {_NOISE} ORDER BY file, name, id LIMIT 8")
def peer_rows(spark, sf_dir):
    return K.peer_rows(nodes_of(spark, sf_dir)).select("id")


@query(f"""{_WITH}, h AS (SELECT DISTINCT name, {_BASE} AS b FROM code_nodes WHERE k % 3 = 0) SELECT id FROM code_nodes c WHERE k % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.name = c.name AND h.b = {_BASE})""")
def peers_dedupe(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return K.peers_dedupe(nodes.where("k % 3 <> 0"), nodes.where("k % 3 = 0")).select("id")


@query(cte("span_nodes") + """, t AS (SELECT id AS type_id, file, start_line AS a, end_line AS b FROM span_nodes WHERE kind = 'struct_item')
SELECT type_id, id FROM span_nodes c JOIN t USING (file) WHERE start_line >= a AND end_line <= b AND id <> type_id AND (start_line > a OR end_line < b)""")
def type_nested(spark, sf_dir):
    return N.type_nested(load(spark, sf_dir, "span_nodes"))


@query(cte("c_nodes") + f""", d AS (SELECT id AS src, name, file AS f1, starts_with(ltrim(source), 'static') AS static FROM c_nodes WHERE kind = 'function_definition'),
e AS (SELECT id AS dst, name, file, kind FROM c_nodes WHERE kind = 'function_declaration'),
s AS (SELECT src, dst, file, static, CASE WHEN {_STEM} = regexp_replace(split_part(f1, '/', -1), '\\.[^.]*$', '') THEN 100 ELSE 0 END + CASE WHEN regexp_matches(file, '\\.(h|hh|hpp)$') THEN 40 ELSE 0 END
 + CASE WHEN {_MODULE} = regexp_replace(f1, '/[^/]*$', '') THEN 30 ELSE 0 END - CASE WHEN {_NOISE} THEN 50 ELSE 0 END - CASE WHEN static THEN 80 ELSE 0 END AS score FROM d JOIN e USING (name) WHERE NOT static OR f1 = file),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, file, dst) AS r FROM s WHERE score > 0 OR static) SELECT src, dst FROM r WHERE r = 1""")
def c_decl_def(spark, sf_dir):
    return N.c_decl_def(load(spark, sf_dir, "c_nodes"))


# ---------------------------------------------------------------- files


@query(f"{_WITH} SELECT DISTINCT file AS path FROM code_nodes WHERE {_SOURCE}")
def edgeable_inventory(spark, sf_dir):
    return K.edgeable_inventory(nodes_of(spark, sf_dir).select(F.col("file").alias("path")).distinct())


@query(f"{_WITH} SELECT DISTINCT file AS path FROM code_nodes WHERE {_SOURCE} EXCEPT SELECT file FROM code_nodes WHERE k % 5 = 0 OR k % 7 = 0")
def open_files(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    edges = nodes.where("k % 5 = 0").select(F.col("id").alias("src"), F.col("id").alias("dst")).union(nodes.where("k % 7 = 0").select("id", "id"))
    return K.open_files(nodes.select(F.col("file").alias("path")).distinct(), nodes, edges)


@query(f"{_WITH} SELECT count(DISTINCT file) AS n_files FROM code_nodes WHERE starts_with(file, 'src/')")
def scope_files_count(spark, sf_dir):
    return K.scope_files_count(nodes_of(spark, sf_dir).select(F.col("file").alias("path")).distinct(), "src/")


@query(f"{_WITH} SELECT DISTINCT lang FROM code_nodes")
def lang_presence(spark, sf_dir):
    return A.lang_presence(nodes_of(spark, sf_dir))


@query(f"""{_WITH}, f AS (SELECT DISTINCT file, len({_DIRS}) AS d FROM code_nodes), s AS (SELECT CAST(count(*) FILTER (d = 0) AS BIGINT) AS root_files, CAST(count(*) FILTER (d > 0) AS BIGINT) AS nested_files, count(DISTINCT split_part(file, '/', 1)) AS top_dirs FROM f)
SELECT *, CASE WHEN nested_files = 0 THEN 'flat' WHEN top_dirs = 1 THEN 'single' WHEN top_dirs >= 8 THEN 'monorepo' ELSE 'layered' END AS shape FROM s""")
def repo_shape(spark, sf_dir):
    return A.repo_shape(nodes_of(spark, sf_dir).select("file").distinct())


@query(f"{_WITH} SELECT DISTINCT split_part(file, '/', 1) AS dir FROM code_nodes WHERE split_part(file, '/', 1) NOT IN ({_listed(_W_NOISE)}) ORDER BY dir LIMIT 40")
def toc_dirs(spark, sf_dir):
    return A.toc_dirs(nodes_of(spark, sf_dir))


@query(f"{_WITH} SELECT array_to_string(list_slice({_DIRS}, 1, 2), '/') AS dir, count(DISTINCT file) AS n_files FROM code_nodes GROUP BY 1 ORDER BY n_files DESC, dir LIMIT 40")
def file_tree2(spark, sf_dir):
    return P.file_tree2(nodes_of(spark, sf_dir))


@query(f"{_WITH}, e AS (SELECT DISTINCT file FROM code_nodes WHERE k % 3 = 0) SELECT DISTINCT c.file FROM code_nodes c JOIN e ON c.file = e.file OR ends_with(c.file, '/' || e.file) OR ends_with(e.file, '/' || c.file)")
def file_has_edges(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return R.file_has_edges(nodes.select("file").distinct(), nodes.where("k % 3 = 0").select("file").distinct())


# ---------------------------------------------------------------- edges and bridges

_TRADE = cte("trade_nodes", "trade_edges", "trade_bridges")
_ASIA = "(SELECT id FROM trade_nodes WHERE cluster = 'ASIA')"


def _asia(spark, sf_dir):
    return load(spark, sf_dir, "trade_nodes").where("cluster = 'ASIA'").select("id")


@query(f"{_TRADE} SELECT src, dst, kind FROM trade_bridges WHERE src IN {_ASIA}")
def bridge_children(spark, sf_dir):
    return G.bridge_children(load(spark, sf_dir, "trade_bridges"), _asia(spark, sf_dir))


@query(f"{_TRADE} SELECT src, dst, kind FROM trade_bridges WHERE dst IN {_ASIA}")
def bridge_callers(spark, sf_dir):
    return G.bridge_callers(load(spark, sf_dir, "trade_bridges"), _asia(spark, sf_dir))


@query(f"{_TRADE} SELECT src, dst FROM trade_edges WHERE src NOT IN {_ASIA}")
def clear_outbound(spark, sf_dir):
    return G.clear_outbound(load(spark, sf_dir, "trade_edges"), _asia(spark, sf_dir))


@query(f"{_TRADE} SELECT count(*) AS n_bridges FROM trade_bridges")
def total_bridges(spark, sf_dir):
    return K.total_bridges(load(spark, sf_dir, "trade_bridges"))


@query(f"{_TRADE} SELECT src, dst, CASE kind WHEN 'export' THEN 3 WHEN 'ipc' THEN 2 ELSE 1 END AS rank FROM trade_bridges")
def bridge_rank(spark, sf_dir):
    return load(spark, sf_dir, "trade_bridges").select("src", "dst", G.bridge_rank(F.col("kind")).alias("rank"))


@query(f"{_TRADE} SELECT src, dst FROM trade_edges")
def normalize_adjacency(spark, sf_dir):
    edges = load(spark, sf_dir, "trade_edges")
    return G.normalize_adjacency(edges.union(edges), load(spark, sf_dir, "trade_bridges"))[0]


@query(f"{_TRADE} SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM trade_edges UNION ALL SELECT src, dst FROM trade_bridges) x GROUP BY ALL")
def add_edges(spark, sf_dir):
    every = K.add_edges(load(spark, sf_dir, "trade_edges"), load(spark, sf_dir, "trade_bridges").select("src", "dst"))
    return every.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"{_TRADE} SELECT kind, count(*) AS n FROM (SELECT 'call' AS kind FROM trade_edges UNION ALL SELECT 'call' FROM trade_bridges WHERE kind = 'twin' UNION ALL SELECT kind FROM trade_bridges UNION ALL SELECT kind FROM trade_bridges WHERE kind <> 'twin') x GROUP BY kind")
def apply_maps(spark, sf_dir):
    bridges = load(spark, sf_dir, "trade_bridges")
    derived = bridges.withColumn("kind", F.when(F.col("kind") == "twin", "call").otherwise(F.col("kind")))
    e, b = K.apply_maps(load(spark, sf_dir, "trade_edges"), bridges, derived)
    return e.select(F.lit("call").alias("kind")).union(b.select("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""{_WITH}, o AS (SELECT file, name, kind, min(id) AS old_id FROM code_nodes WHERE k % 2 = 0 GROUP BY ALL)
SELECT coalesce(old_id, 'new:' || id) AS id, c.file, c.name FROM code_nodes c LEFT JOIN o ON c.file = o.file AND c.name = o.name AND c.kind = o.kind""")
def overlay_file(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return G.overlay_file(nodes.where("k % 2 = 0"), nodes.withColumn("id", F.concat(F.lit("new:"), "id"))).select("id", "file", "name")


@query(f"{_TRADE} SELECT CAST(count(*) FILTER (kind = 'export') AS BIGINT) AS direct, CAST(count(*) FILTER (kind <> 'export') AS BIGINT) AS transitive, CAST(count(*) FILTER (kind = 'twin') AS BIGINT) AS shown, CAST(count(*) FILTER (kind <> 'twin') AS BIGINT) AS omitted FROM trade_bridges")
def edge_census(spark, sf_dir):
    rows = load(spark, sf_dir, "trade_bridges").withColumn("hop", F.when(F.col("kind") == "export", 1).otherwise(2))
    return K.edge_census(rows, rows.where("kind = 'twin'"))


@query(cte("docs_nodes") + " SELECT DISTINCT lang AS side, name FROM docs_nodes WHERE doc_id % 2 = 0 EXCEPT SELECT lang, name FROM docs_nodes WHERE doc_id % 2 = 1")
def diff_shots(spark, sf_dir):
    shots = load(spark, sf_dir, "docs_nodes").withColumn("side", F.col("lang"))
    return A.diff_shots(shots.where("doc_id % 2 = 0"), shots.where("doc_id % 2 = 1"))


# ---------------------------------------------------------------- prompt rules over the names


_PASCAL = "regexp_matches(name, '^[A-Z][a-z0-9]{2,}$')"
_CODE = rf"(length(name) >= 2 AND (regexp_matches(name, '[/\\._]') OR contains(name, '::') OR {_PASCAL} OR regexp_matches(name, '[a-z].*[A-Z]') OR regexp_matches(name, '^[A-Z0-9]{{4,}}$')))"
rule("pascal", lambda: T.pascal_col(name_()), _PASCAL)
rule("code_shaped", lambda: T.code_shaped_col(name_()), _CODE)
rule("junk_symbol", lambda: T.junk_symbol_col(name_()), f"length(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) < 3 OR lower(name) IN ({_listed(_W_JUNK)})")
rule("strong_token", lambda: T.strong_token_col(name_()), f"length(name) >= 3 AND NOT (length(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) < 3 OR lower(name) IN ({_listed(_W_JUNK)})) AND ({_CODE} OR length(name) >= 6)")
rule("token_priority", lambda: T.token_priority_col(name_()).cast("long"), f"CAST(CASE WHEN {_CODE} THEN 100 ELSE 0 END + CASE WHEN contains(name, '::') OR contains(name, '/') THEN 50 ELSE 0 END + CASE WHEN contains(name, '_') THEN 20 ELSE 0 END + CASE WHEN length(name) >= 8 THEN 10 ELSE 0 END AS BIGINT)")
rule("split_camel", lambda: F.array_join(T.split_camel_col(name_()), "|"), "regexp_replace(name, '([a-z:])([A-Z])', '\\1|\\2', 'g')")
rule("normalize_seed", lambda: T.normalize_seed_col(F.concat(F.lit("`"), name_(), F.lit("()`"))), "split_part(name, '::', -1)")
rule("symbol_leaf", lambda: T.symbol_leaf_col(name_()), "split_part(name, '::', -1)")
rule("sanitize_symbol", lambda: T.sanitize_symbol_col(file_()), "regexp_replace(file, '[^A-Za-z0-9_-]', '_', 'g')")
rule(
    "symbol_like", lambda: T.symbol_like_col(F.concat(name_(), F.when(F.col("k") % 3 == 0, ".x").when(F.col("k") % 3 == 1, "-y").otherwise(""))),
    r"regexp_matches(concat(name, CASE k % 3 WHEN 0 THEN '.x' WHEN 1 THEN '-y' ELSE '' END), '^[A-Za-z_][A-Za-z0-9_]*((::|\.)[A-Za-z_][A-Za-z0-9_]*)*$')",
)
rule("scope_file_src", lambda: P.scope_file_src_col(file_()), _SOURCE)
rule("scope_sanitize", lambda: P.scope_sanitize_col(F.concat(F.lit("./a/..//"), file_())), "file")
rule("recency_text", lambda: T.recency_text_col(F.col("k") * 997), "CASE WHEN k * 997 < 60 THEN 'just now' WHEN k * 997 < 3600 THEN concat(k * 997 // 60, ' mins ago') WHEN k * 997 < 86400 THEN concat(k * 997 // 3600, ' hours ago') ELSE concat(k * 997 // 86400, ' days ago') END")

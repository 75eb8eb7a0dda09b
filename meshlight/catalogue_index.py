"""The name index as registered queries, each against a scan in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from .operators import nameindex as N
from .operators import trees as R
from .operators import twins as X
from .operators.storage import new_path
from .sources.views import cte, load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _index(spark, sf_dir):
    """An index of all names, and the names themselves."""
    nodes = load(spark, sf_dir, "name_nodes")
    return N.build_name_index(nodes, new_path(spark, "names"), buckets=16), nodes


# Every twentieth name whole, without case, its last word, and four letters from within.
_ASKED = """
    SELECT name AS q FROM name_nodes WHERE k % 20 = 0 UNION SELECT lower(name) FROM name_nodes WHERE k % 20 = 0
    UNION SELECT split_part(name, ' ', -1) FROM name_nodes WHERE k % 20 = 0 UNION SELECT substring(name, 2, 4) FROM name_nodes WHERE k % 20 = 0
    UNION SELECT concat(substring(name, 2, 2), 'q') FROM name_nodes WHERE k % 20 = 0 UNION SELECT substring(name, 1, 1) FROM name_nodes WHERE k % 20 = 0"""
_Q = f", q AS (SELECT DISTINCT trim(q) AS q FROM ({_ASKED}) WHERE trim(q) <> '')"


def _asked(spark, nodes):
    return spark.sql(_ASKED.replace("name_nodes", "{nodes}"), nodes=nodes)


@query(cte("name_nodes") + " SELECT name, file, start_line, id, row_number() OVER (PARTITION BY name ORDER BY file, start_line, id) AS place FROM name_nodes WHERE name <> ''")
def name_index(spark, sf_dir):
    index, _ = _index(spark, sf_dir)
    places = index.table("places").drop("bucket")
    # The order inside a name is the one in which the rows lie; it is numbered here to compare it.
    return places.selectExpr("name", "file", "start_line", "id", "cast(row_number() over (partition by name order by file, start_line, id) as bigint) as place")


@query(cte("name_nodes") + _Q + """,
t AS (SELECT name, count(*) AS n, max(weight) AS weight, arg_min(id, {'less': -weight, 'id': id}) AS best FROM name_nodes WHERE name <> '' GROUP BY name),
p AS (SELECT q, t.*, name = q AS same, lower(name) = lower(q) AS folded, CASE WHEN starts_with(lower(name), lower(q)) THEN 230 ELSE 80 END + weight AS points
      FROM q JOIN t ON contains(lower(name), lower(q))),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY same DESC, folded DESC, CASE WHEN folded THEN weight ELSE points END DESC, name) AS r FROM p)
SELECT q.q, CAST(coalesce(sum(CASE WHEN same THEN n ELSE 0 END), 0) AS BIGINT) AS n_exact, CAST(coalesce(sum(folded::INT), 0) AS BIGINT) AS n_folded, count(o.q) AS n_holding,
       max(CASE WHEN r = 1 THEN name END) AS best, max(CASE WHEN r = 1 THEN best END) AS best_id FROM q LEFT JOIN o ON o.q = q.q GROUP BY q.q""")
def fuzzy_best(spark, sf_dir):
    index, nodes = _index(spark, sf_dir)
    return N.fuzzy_best(index, _asked(spark, nodes))


@query(cte("name_nodes") + _Q + " SELECT q, q IN (SELECT name FROM name_nodes WHERE name IS NOT NULL) AS exact FROM q")
def exact_in_graph(spark, sf_dir):
    index, nodes = _index(spark, sf_dir)
    return N.exact_in_graph(index, _asked(spark, nodes))


# The words of every twentieth document, split at white space.
_JUNK = "(length(regexp_replace(trim({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')) < 3 OR lower(trim({x})) IN ('if', 'else', 'for', 'while', 'loop', 'match', 'return', 'let', 'unknown', 'anonymous', 'block', 'self', 'super', 'crate'))"
_STRONG = f"""(strlen(q) >= 3 AND NOT {_JUNK.format(x='q')} AND (strlen(q) >= 6 OR regexp_matches(q, '[/\\\\._]') OR contains(q, '::')
    OR regexp_matches(q, '^\\p{{Lu}}[\\p{{Ll}}0-9]*$') OR regexp_matches(q, '(?s)\\p{{Ll}}.*\\p{{Lu}}') OR (strlen(q) >= 4 AND regexp_matches(q, '^[\\p{{Lu}}0-9]+$'))))"""


@query(cte("name_nodes") + f""",
q AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS q FROM documents WHERE doc_id % 20 = 0),
t AS (SELECT q, lower(q) AS t, {_STRONG} AS strong FROM q WHERE strlen(lower(q)) >= 2),
n AS (SELECT DISTINCT name, lower(name) AS n, {_JUNK.format(x='name')} AS junk FROM name_nodes WHERE name <> ''),
f AS (SELECT DISTINCT lower(file) AS f FROM name_nodes WHERE name <> '' AND NOT {_JUNK.format(x='name')}),
a AS (SELECT DISTINCT q FROM t JOIN n ON name = q OR NOT junk AND (n = t
  OR NOT strong AND strlen(t) >= 3 AND list_contains(regexp_split_to_array(n, '[_:-]'), t)
  OR strong AND (strlen(t) >= 3 AND (ends_with(n, concat('_', t)) OR starts_with(n, t)) OR strlen(t) >= 4 AND ends_with(n, t)
                 OR list_contains(regexp_split_to_array(n, '[_:]'), t) OR strlen(t) >= 5 AND contains(n, t)))),
b AS (SELECT DISTINCT q FROM t JOIN f ON strlen(t) >= 3 AND (list_contains(regexp_split_to_array(f, '[/\\\\.\\-]'), t) OR strong AND strlen(t) >= 5 AND contains(f, t)))
SELECT q, q IN (SELECT q FROM a UNION SELECT q FROM b) AS hit FROM t""")
def token_in_graph(spark, sf_dir):
    index, _ = _index(spark, sf_dir)
    words = load(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))).alias("q"))
    return N.token_in_graph(index, words)


# ---------------------------------------------------------------- trees

_KINDS = "html head title body nav ul li article h1 p div b br script style footer form a"
_MARKUP = r"""(?i)<!--(?:.|\n)*?-->|<script(?:[^>"a-z'][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)?>(?:.|\n)*?</script\s*>|<style(?:[^>"a-z'][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)?>(?:.|\n)*?</style\s*>|</?[a-z][a-z0-9]*(?:[^>"']|"[^"]*"|'[^']*')*>"""


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"""WITH RECURSIVE
t AS (SELECT page_id, regexp_extract_all(html, '{_MARKUP.replace("'", "''")}') AS m FROM pages),
k AS MATERIALIZED (
  SELECT page_id, i, lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS kind, x LIKE '</%' AS ends
  FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY j) AS i, m[j] AS x FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS j FROM t) WHERE m[j] NOT LIKE '<!--%')),
w AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(k VARCHAR, n INTEGER)[]) AS s, 0 AS n, '' AS kind, 0 AS parent, 0 AS depth, false AS made FROM pages
  UNION ALL
  SELECT page_id, i, CASE WHEN ends OR leaf THEN s ELSE list_append(s, {{'k': kind, 'n': CASE WHEN asked THEN n + 1 ELSE 0 END}}) END, CASE WHEN asked THEN n + 1 ELSE n END, kind,
         coalesce(list_filter(s, lambda e: e.n > 0)[-1].n, 0), CAST(len(list_filter(s, lambda e: e.n > 0)) AS INTEGER), asked
  FROM (
    SELECT page_id, i, n, kind, ends, NOT ends AND list_contains(string_split('{_KINDS}', ' '), kind) AS asked,
           kind IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr', 'script', 'style') AS leaf,
           CASE WHEN same > 0 AND (ends OR itself AND same > coalesce(holds, 0)) THEN s[1:same - 1] ELSE s END AS s
    FROM (
      SELECT w.page_id, k.i, w.n, k.kind, k.ends, w.s, kind_in(k.kind) AS itself,
             list_max(list_transform(range(1, len(w.s) + 1), lambda j: CASE WHEN w.s[j].k = k.kind THEN j ELSE 0 END)) AS same,
             list_max(list_transform(range(1, len(w.s) + 1), lambda j: CASE WHEN holds_in(w.s[j].k) THEN j ELSE 0 END)) AS holds
      FROM w JOIN k ON k.page_id = w.page_id AND k.i = w.i + 1) x) y),
r AS (SELECT page_id, n AS node, parent, depth, kind FROM w WHERE made)
SELECT page_id, node, parent, depth, kind, CAST(coalesce(lead_.next, top) - 1 AS INTEGER) AS last
FROM r JOIN (SELECT page_id, max(node) + 1 AS top FROM r GROUP BY page_id) USING (page_id)
LEFT JOIN (SELECT a.page_id, a.node, min(b.node) AS next FROM r AS a JOIN r AS b ON b.page_id = a.page_id AND b.node > a.node AND b.depth <= a.depth GROUP BY ALL) AS lead_ USING (page_id, node)"""
    .replace("kind_in(k.kind)", f"k.kind IN ({_names(['p', 'li', 'td', 'th', 'tr', 'dt', 'dd', 'option'])})")
    .replace("holds_in(w.s[j].k)", f"w.s[j].k IN ({_names(['html', 'body', 'div', 'article', 'section', 'main', 'aside', 'nav', 'header', 'footer', 'form', 'ul', 'ol', 'dl', 'table', 'select', 'blockquote', 'figure'])})"))
def ast_visit(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    return R.ast_visit(pages, "html", _KINDS).select("page_id", "node", "parent", "depth", "kind", "last")


# ---------------------------------------------------------------- twins

# The second word of each document, or the second and third, is a name; its source is its language.
_NAMED = "SELECT concat('d:', CAST(doc_id AS STRING)) AS id, CASE WHEN doc_id % 2 = 0 THEN split_part(text, ' ', 2) ELSE concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) END AS name, concat(source, CASE WHEN doc_id % 3 = 0 THEN '/src/' ELSE '/' END, CAST(doc_id AS STRING)) AS file, 'struct_item' AS kind, source AS lang, 0 AS begin, length(text) AS finish, text FROM {documents}"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The span of each line, without a window over the lines of a text."""
    for batch in batches:
        found: tuple[list, ...] = ([], [], [], [], [])
        for id_, file, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            begin = 0
            for n, line in enumerate(text.split("\n")):
                for column, v in zip(found, (f"{id_}:{n}" if id_ is not None else None, file, lang, begin, begin + len(line)), strict=True):
                    column.append(v)
                begin += len(line) + 1
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string() if k < 3 else pa.int32()) for k, f in enumerate(found)], ["id", "file", "lang", "begin", "finish"])


def _doc_blocks(spark, sf_dir):
    """Documents, and each of their lines as a function; spans in code points."""
    docs = spark.sql(_NAMED, documents=load(spark, sf_dir, "documents"))
    lines = docs.where("text is not null").select("id", "file", "lang", "text").mapInArrow(_lines, "id string, file string, lang string, begin int, finish int")
    lines = lines.withColumns({"name": F.lit("line"), "kind": F.lit("function_item")})
    return docs.drop("text").union(lines.select(*docs.drop("text").columns)), docs.select("file", F.col("text").alias("source"))


@query(f"""WITH d AS MATERIALIZED ({_NAMED.format(documents='documents')}),
s AS (SELECT *, CASE WHEN contains(file, '/src/') THEN 25 ELSE 0 END + least(strlen(name), 40) AS score FROM d
  WHERE (strlen(name) >= 6 OR contains(name, '_')) AND length(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3 AND regexp_matches(name, '[\\p{{L}}\\p{{N}}_]')
    AND lower(name) NOT IN ('if', 'else', 'for', 'while', 'loop', 'match', 'return', 'let', 'unknown', 'anonymous', 'block', 'self', 'super', 'crate', 'main', 'new', 'get', 'set', 'run', 'init', 'open', 'close', 'read', 'write', 'update', 'delete', 'create', 'test', 'setup', 'start', 'stop', 'load', 'save', 'build')),
t AS MATERIALIZED (SELECT name, arg_min(id, {{'s': -score, 'id': id}}) AS dst, arg_min(lang, {{'s': -score, 'id': id}}) AS dst_lang FROM s GROUP BY name),
l AS MATERIALIZED (SELECT id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM d),
h AS (SELECT concat(l.id, ':', n) AS src, dst, len(list_filter(range(1, length(line) + 1), lambda p: substr(line, p, length(t.name)) = t.name
          AND NOT regexp_matches(substr(concat(' ', line), p, 1), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(substr(line, p + length(t.name), 1), '[\\p{{L}}\\p{{N}}_]'))) AS k
      FROM l JOIN t ON l.lang <> t.dst_lang AND contains(l.line, t.name)),
x AS (SELECT d.id AS src, dst, len(list_filter(range(1, length(d.text) + 1), lambda p: substr(d.text, p, length(t.name)) = t.name
          AND NOT regexp_matches(substr(concat(' ', d.text), p, 1), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(substr(d.text, p + length(t.name), 1), '[\\p{{L}}\\p{{N}}_]'))) AS k
      FROM d JOIN t ON d.lang <> t.dst_lang AND contains(t.name, chr(10)) AND contains(d.text, t.name))
SELECT src, dst, CAST(sum(k) AS BIGINT) AS n FROM (SELECT * FROM h WHERE k > 0 UNION ALL SELECT * FROM x WHERE k > 0) GROUP BY src, dst""")
def twin_edges(spark, sf_dir):
    return X.text_twins(*_doc_blocks(spark, sf_dir))

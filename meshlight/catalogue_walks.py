"""Walks, circles and budgets over whole graphs as registered queries, each with the rule in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import budget as B
from .plans import export as X
from .plans import sampling as M
from .plans import selection as S
from .plans import spine as W
from .sources.views import cte, load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _orders(spark, sf_dir):
    return load(spark, sf_dir, "order_nodes"), load(spark, sf_dir, "order_edges")


# The callers of each order that are no tests, types or empty names, best first; the names here are those of the view.
_CALLS = cte("order_nodes", "order_edges").replace("WITH ", "WITH RECURSIVE ", 1) + """,
u AS (SELECT id AS src, name, score, CASE WHEN name LIKE 'handle%' THEN 3 WHEN name = 'main' THEN 2 WHEN name LIKE 'try%' THEN 1 ELSE 0 END AS rank
      FROM order_nodes WHERE file NOT LIKE '%tests/%' AND name <> 'collect' AND kind <> 'struct_item'),
c AS (SELECT src, dst, name, score, rank FROM order_edges JOIN u USING (src) WHERE dst IN (SELECT id FROM order_nodes)),
fan AS (SELECT dst AS id, count(*) AS fan, count(*) FILTER (WHERE src <> dst) AS others FROM c GROUP BY dst),
l AS (SELECT dst AS id, any_value(f.fan) AS fan, list({'up': coalesce(g.fan, 0), 'id': src} ORDER BY coalesce(g.fan, 0), rank DESC, score DESC, name, src) AS callers
      FROM c JOIN fan f ON f.id = dst LEFT JOIN fan g ON g.id = src WHERE src <> dst AND f.others <= 5 GROUP BY dst)"""


@query(_CALLS + """,
w AS (
  SELECT id AS seed, 0 AS step, id, CAST(0 AS BIGINT) AS up, [id] AS met FROM order_nodes WHERE kind <> 'struct_item'
  UNION ALL
  SELECT seed, step + 1, b.id, b.up, list_append(met, b.id) FROM (
    SELECT w.seed, w.step, w.met, list_filter(l.callers, lambda x: NOT list_contains(w.met, x.id))[1] AS b FROM w JOIN l ON l.id = w.id WHERE step < 4 AND (step = 0 OR up <= 5)) x
  WHERE b IS NOT NULL)
SELECT seed, step, id FROM w WHERE step > 0""")
def spine_step(spark, sf_dir):
    return W.spines(*_orders(spark, sf_dir))


@query(_CALLS + """,
b AS (SELECT id, callers[1].id AS t FROM l WHERE fan <= 5),
w AS (SELECT id AS seed, id, 0 AS hops, [id] AS met FROM order_nodes
      UNION ALL SELECT seed, b.t, hops + 1, list_append(met, b.t) FROM w JOIN b ON b.id = w.id WHERE NOT list_contains(met, b.t)),
e AS (SELECT seed, arg_max(id, hops) AS entry, max(hops) AS hops FROM w GROUP BY seed)
SELECT seed AS id, CASE WHEN b.id IS NULL THEN entry END AS entry, CAST(CASE WHEN b.id IS NULL THEN hops END AS BIGINT) AS hops FROM e LEFT JOIN b ON b.id = entry""")
def spine_entries(spark, sf_dir):
    return W.entries(*_orders(spark, sf_dir))


# ---------------------------------------------------------------- budgets

_BUDGET = 30_000
_HEADS = "array_to_string(list_transform(string_split_regex(regexp_replace(source, '\\r?\\n$', ''), '\\r?\\n')[1:4], lambda x: regexp_replace(string_split(x, '{')[1], '^\\s+|\\s+$', '', 'g')), chr(10))"


def _blocks(spark, sf_dir):
    text = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    docs = load(spark, sf_dir, "docs_nodes").join(text, "doc_id")
    return docs.select("id", "name", "kind", "file", F.col("doc_id").alias("start_line"), (F.col("doc_id") + 9).alias("end_line"), (F.col("size") % 97).cast("double").alias("score"), "source")


@query(cte("docs_nodes").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
b AS (SELECT id, name, kind, file, d.doc_id, size % 97 AS score, d.text AS source, row_number() OVER (ORDER BY size % 97 DESC, id) - 1 AS i FROM docs_nodes JOIN documents d USING (doc_id)),
p AS (SELECT *, CASE WHEN i < 7 OR score > 70 THEN 0 ELSE 1 END AS want FROM b),
c AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY CASE WHEN i < 2 THEN 0 ELSE want END, score DESC, id) AS n,
        CASE WHEN want = 0 THEN length(concat('### ', name, ' [score: ', score, '.0]', chr(10), 'File: ', file, ':', doc_id, '-', doc_id + 9, chr(10), '```', chr(10), source, chr(10), '```', chr(10), chr(10))) ELSE 999999999 END AS c0,
        length(concat('### ', name, ' (signature)', chr(10), 'File: ', file, ':', doc_id, chr(10), {_HEADS}, chr(10), '```', chr(10), chr(10))) AS c1,
        length(concat('- ', name, ' (', kind, ')', chr(10))) AS c2 FROM p),
w AS (SELECT CAST(0 AS BIGINT) AS n, '' AS id, CAST({_BUDGET} AS BIGINT) AS b, '' AS fidelity, CAST(0 AS BIGINT) AS cost
      UNION ALL
      SELECT n, id, b - cost, fidelity, cost FROM (
        SELECT c.n, c.id, w.b, CASE WHEN c0 <= w.b THEN 'full' WHEN c1 <= w.b THEN 'signature' WHEN c2 <= w.b THEN 'minimal' ELSE 'omitted' END AS fidelity,
               CASE WHEN c0 <= w.b THEN c0 WHEN c1 <= w.b THEN c1 WHEN c2 <= w.b THEN c2 ELSE 0 END AS cost FROM w JOIN c ON c.n = w.n + 1) x)
SELECT id, fidelity, cost FROM w WHERE n > 0""")
def render_budget(spark, sf_dir):
    return B.render_budget(B.block_costs(_blocks(spark, sf_dir), "implementation"), _BUDGET)


_CAP = 120


_CUT = """
t{i} AS (SELECT doc_id, text, list_max(list_filter(range(0, {i} + 1), lambda k: strlen(left(text, k)) <= {i})) AS k FROM documents),
c{i} AS (SELECT doc_id, CASE WHEN strlen(text) <= {i} THEN text WHEN contains(left(text, k), chr(10)) THEN regexp_extract(left(text, k), '(?s)^(.*)\\n', 1) ELSE left(text, k) END AS cut FROM t{i})"""


@query("WITH" + _CUT.format(i=4 * _CAP) + "," + _CUT.format(i=2 * _CAP) + f"""
SELECT doc_id, CASE WHEN length(a.cut) <= {_CAP} THEN a.cut ELSE b.cut END AS text FROM c{4 * _CAP} AS a JOIN c{2 * _CAP} AS b USING (doc_id)""")
def truncate_tokens(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", B.truncate_tokens(F.col("text"), _CAP).alias("text"))


# ---------------------------------------------------------------- retrieval

_SCORE = """CASE WHEN lower(name) = '{t}' THEN 100000 + 100 * greatest(length('{t}'), 3) WHEN ends_with(lower(name), '_{t}') THEN 800 + 8 * length('{t}') WHEN ends_with(lower(name), '{t}') THEN 500 + 5 * length('{t}')
 WHEN starts_with(lower(name), '{t}') THEN 450 + 4 * length('{t}') WHEN list_contains(string_split_regex(lower(name), '[_:]'), '{t}') THEN 400 + 4 * length('{t}') WHEN length('{t}') >= 5 AND contains(lower(name), '{t}') THEN 150 + 2 * length('{t}') ELSE 0 END
 + 0.5 * CASE WHEN list_contains(string_split_regex(lower(file), '[/\\\\.-]'), '{t}') THEN 80 + 2 * length('{t}') WHEN length('{t}') >= 5 AND contains(lower(file), '{t}') THEN 25 + length('{t}') ELSE 0 END"""
_KEYWORD = "CASE WHEN contains(lower(module), '{t}') THEN 10 + length('{t}') + CASE WHEN contains(split_part(lower(module), '/', -1), '{t}') THEN 8 ELSE 0 END ELSE 0 END"
_TOKENS = ["widget", "brand#3"]


@query(cte("trade_nodes", "trade_edges") + f""",
n AS (SELECT *, {" + ".join(_SCORE.format(t=t) for t in _TOKENS)} AS text_score, regexp_replace(file, '/[^/]*$', '') AS key FROM trade_nodes),
m AS (SELECT module FROM (SELECT DISTINCT key AS module FROM n) WHERE {" + ".join(_KEYWORD.format(t=t) for t in _TOKENS)} > 0
      ORDER BY {" + ".join(_KEYWORD.format(t=t) for t in _TOKENS)} DESC, module LIMIT 32),
s AS (SELECT id FROM n WHERE text_score > 0 AND (SELECT count(*) FROM m WHERE file = module OR starts_with(file, concat(module, '/')) OR key = module) > 0 ORDER BY text_score DESC, id LIMIT 12),
h AS (SELECT id FROM s UNION SELECT dst FROM trade_edges WHERE src IN (SELECT id FROM s) UNION SELECT src FROM trade_edges WHERE dst IN (SELECT id FROM s))
SELECT id, CAST(text_score AS DOUBLE) AS text_score FROM h JOIN n USING (id)""")
def retrieve_subgraph(spark, sf_dir):
    nodes, edges = load(spark, sf_dir, "trade_nodes"), load(spark, sf_dir, "trade_edges")
    return S.retrieve_with_hops(nodes, edges, _TOKENS, top=12, hops=1)


# ---------------------------------------------------------------- sampling

# Documents without a label, numbered by id; the generator one step at a time.
_LEFT = cte("docs_nodes").replace("WITH ", "WITH RECURSIVE ", 1) + """,
e AS MATERIALIZED (SELECT id, size, row_number() OVER (ORDER BY id) - 1 AS idx FROM docs_nodes WHERE kind <> 'call_expression' AND doc_id NOT IN (SELECT doc_id FROM labels)),
s AS (SELECT CAST((CAST((SELECT count(*) FROM labels) AS UHUGEINT) * 11400714819323198485 + 6) % 18446744073709551616 AS UHUGEINT) AS x),
g AS (SELECT CAST(-1 AS BIGINT) AS i, x, CAST(0 AS UHUGEINT) AS draw FROM s
      UNION ALL SELECT i + 1, (x * 6364136223846793005 + 1) % 18446744073709551616, ((x * 6364136223846793005 + 1) % 18446744073709551616) >> 33 FROM g WHERE i < (SELECT 2 * count(*) FROM e))"""


def _left(spark, sf_dir):
    nodes = load(spark, sf_dir, "docs_nodes").where("kind <> 'call_expression'")
    labels = load(spark, sf_dir, "labels")
    done = labels.select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("quality") == 1, "open").otherwise("rejected").alias("pole"))
    return nodes, nodes.join(done.select("id"), "id", "left_anti"), done


@query(_LEFT + " SELECT id, idx, CAST(a.draw AS BIGINT) AS draw0, CAST(b.draw AS BIGINT) AS draw1 FROM e JOIN g AS a ON a.i = 2 * idx JOIN g AS b ON b.i = 2 * idx + 1")
def card_draws(spark, sf_dir):
    _, left, done = _left(spark, sf_dir)
    return M.with_draws(X.dense_index(left), M.first_state(done.count(), "query"), 2)


@query(_LEFT + """,
w AS (SELECT CAST(0 AS BIGINT) AS place, (SELECT list(id ORDER BY id) FROM e) AS ids, '' AS id
      UNION ALL
      SELECT place + 1, list_concat(list_concat(ids[1:pos], CASE WHEN pos + 1 < len(ids) THEN [ids[-1]] ELSE [] END), ids[pos + 2:len(ids) - 1]), ids[pos + 1]
      FROM (SELECT w.*, CAST(g.draw % len(ids) AS BIGINT) AS pos FROM w JOIN g ON g.i = 2 * w.place + 1 WHERE w.place < 40) x)
SELECT w.id, CAST(place AS INTEGER) AS place FROM w WHERE place > 0""")
def next_cards(spark, sf_dir):
    _, left, done = _left(spark, sf_dir)
    return M.walk_sample(left.select("id"), M.first_state(done.count(), "query"), 40)


@query(_LEFT + """ SELECT id, CAST(row_number() OVER (ORDER BY w, id) AS INTEGER) AS place, name, file FROM (
  SELECT e.id, n.name, n.file, -ln((CAST(draw AS DOUBLE) + 0.5) / 2147483648.0) / (e.size % 50 + 1) AS w FROM e JOIN g ON g.i = e.idx JOIN docs_nodes AS n ON n.id = e.id ORDER BY w, e.id LIMIT 40)""")
def card_batch(spark, sf_dir):
    nodes, _, done = _left(spark, sf_dir)
    return M.card_batch(nodes, done, "query", 40, nodes.select("id", (F.col("size") % 50).alias("degree")))

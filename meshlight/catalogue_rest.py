"""Tools, walks and blends that no other module registers, each with the rule in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _FULL, _GNN, _PART, busiest, saved_trade
from .operators import graph as G
from .operators import resolution as V
from .plans import harvest as H
from .plans import neural as NN
from .plans import ranking as K
from .plans import selection as S
from .sources import files as O
from .sources.views import cte, load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- callers and walks


@query(_PART + """, own AS (SELECT s.id AS seed, n.name, n.file FROM seed s JOIN trade_nodes n USING (id)),
peers AS (SELECT o.seed, n.id FROM trade_nodes n JOIN own o ON n.name = o.name WHERE n.id <> o.seed AND n.file <> o.file AND n.kind LIKE '%method%')
SELECT src AS id, false AS peer FROM trade_edges WHERE dst IN (SELECT id FROM seed)
UNION ALL SELECT DISTINCT e.src, true FROM trade_edges e JOIN peers p ON e.dst = p.id WHERE NOT EXISTS (SELECT 1 FROM trade_edges x WHERE x.dst = p.seed AND x.src = e.src)""")
def callers_with_peers(spark, sf_dir):
    nodes, edges = saved_trade(spark, sf_dir)
    return V.callers_with_peers(nodes, edges, busiest(nodes, edges, "part", "callers"))


@query(_PART + """, h1 AS (SELECT src AS id FROM trade_edges WHERE dst IN (SELECT id FROM seed) UNION SELECT dst FROM trade_edges WHERE src IN (SELECT id FROM seed)),
h2 AS (SELECT src AS id FROM trade_edges WHERE dst IN (SELECT id FROM h1) UNION SELECT dst FROM trade_edges WHERE src IN (SELECT id FROM h1)),
r AS (SELECT id, 0 AS hop FROM seed UNION ALL SELECT id, 1 FROM h1 WHERE id NOT IN (SELECT id FROM seed) UNION ALL SELECT id, 2 FROM h2 WHERE id NOT IN (SELECT id FROM h1) AND id NOT IN (SELECT id FROM seed))
SELECT id, hop FROM r ORDER BY hop, CASE WHEN id IN (SELECT dst FROM trade_edges) THEN 0 ELSE 1 END, id LIMIT 160""")
def collect_bfs(spark, sf_dir):
    nodes, edges = saved_trade(spark, sf_dir)
    return K.collect_bfs(edges, busiest(nodes, edges, "part", "callers"), 2, 80)


@query(cte("trade_edges", "flow_edges") + " SELECT src, count(*) AS n FROM (SELECT src, dst FROM trade_edges UNION ALL SELECT src, dst FROM flow_edges) x GROUP BY src")
def merge_wave(spark, sf_dir):
    graph = {"edges": load(spark, sf_dir, "trade_edges"), "nodes": load(spark, sf_dir, "trade_nodes")}
    merged = K.merge_wave(graph, {"edges": load(spark, sf_dir, "flow_edges")})
    return merged["edges"].groupBy("src").agg(F.count("*").alias("n"))


@query(cte("trade_bridges") + " SELECT kind, count(*) AS n FROM (SELECT kind FROM trade_bridges UNION ALL SELECT 'export' FROM trade_bridges WHERE kind = 'twin') x GROUP BY kind")
def add_bridges(spark, sf_dir):
    b = load(spark, sf_dir, "trade_bridges")
    more = b.where("kind = 'twin'").withColumn("kind", F.lit("export"))
    return K.add_bridges(b, more).groupBy("kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tools


@query("""SELECT n + 1 AS line, lines[n + 1] AS text FROM (SELECT string_split(text, chr(10)) AS lines, unnest(range(len(string_split(text, chr(10))))) AS n
FROM documents WHERE doc_id = (SELECT arg_max(doc_id, {'n': len(string_split(text, chr(10))), 'd': -doc_id}) FROM documents WHERE text IS NOT NULL)) x WHERE n BETWEEN 1 AND 149""")
def read_file_tool(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    lines = F.struct(F.size(F.split("text", "\n")).alias("n"), (-F.col("doc_id")).alias("d"))
    longest = docs.where("text is not null").agg(F.max_by("doc_id", lines)).first()[0]
    files = docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("source"))
    return O.read_file_tool(files, f"d/{longest}", 2, 150).withColumn("line", F.col("line").cast("long"))


@query(cte("trade_nodes") + " SELECT id, name, file, kind FROM trade_nodes WHERE kind = 'struct_item' AND starts_with(file, 'ASIA/') ORDER BY file, start_line, id LIMIT 100")
def code_nodes_tool(spark, sf_dir):
    return O.code_nodes_tool(load(spark, sf_dir, "trade_nodes"), "struct_item", "ASIA")


@query("SELECT doc_id AS id, doc_id % 5 AS place, CASE WHEN doc_id % 5 <= 3 THEN array_to_string(string_split(text, chr(10))[1:6], chr(10)) END AS cite FROM documents")
def cite_fill(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source"))
    return V.cite_fill(docs.select("id", (F.col("id") % 5).alias("place")), docs)


@query("SELECT conv_id, turn, length(trim(note, ' ')) < 12 OR lower(trim(note, ' ')) IN ('todo', 'n/a', 'none', 'important function', 'helper function') AS stub FROM (SELECT conv_id, turn, left(text, CAST(conv_id % 30 AS INTEGER)) AS note FROM conversations) x")
def stub_note(spark, sf_dir):
    notes = load(spark, sf_dir, "conversations").withColumn("note", F.substring(F.col("text"), F.lit(1), (F.col("conv_id") % 30).cast("int")))
    return notes.select("conv_id", "turn", H.stub_note(F.col("note")).alias("stub"))


# ---------------------------------------------------------------- ranks and blends


@query(_FULL + " SELECT id, CAST(length(name) AS DOUBLE) * (1 + degree) AS score FROM deg")
def rank_selection(spark, sf_dir):
    nodes, edges = saved_trade(spark, sf_dir)
    rows = G.degrees(nodes, edges).join(nodes.select("id", "name"), "id").select("id", F.length("name").cast("double").alias("text_score"), F.col("degree").alias("heuristic"))
    return S.rank_selection(rows).select("id", "score")


@query(_FULL + """, r AS (SELECT id, degree, row_number() OVER (PARTITION BY file ORDER BY degree DESC, id) AS a, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) AS b FROM deg)
SELECT id, round(CAST(degree AS DOUBLE) * CASE WHEN a > 1 OR b > 1 THEN CAST(0.15 AS DOUBLE) ELSE 1 END, 6) AS score FROM r""")
def diversity(spark, sf_dir):
    nodes, edges = saved_trade(spark, sf_dir)
    rows = nodes.select("id", "file", "kind").join(G.degrees(nodes, edges).select("id", F.col("degree").cast("double").alias("score")), "id")
    return NN.diversity(rows).select("id", F.round("score", 6).alias("score"))


_RAW = _GNN.replace("round(sum(", "(sum(").replace("), 6) AS score", ")) AS score")


@query(f"WITH g AS ({_RAW}) SELECT vec_id AS id, round(CAST(0.9 AS DOUBLE) * (vec_id % 7) + CAST(0.1 AS DOUBLE) * coalesce(g.score, 0), 6) AS score FROM embeddings LEFT JOIN g ON g.id = vec_id WHERE vec_id % 3 <> 0")
def neural_apply(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("x"))
    texts = v.where("id % 3 <> 0").select("id", (F.col("id") % 7).cast("double").alias("text_score"))
    return NN.neural_apply(v, load(spark, sf_dir, "vector_edges"), texts).select("id", F.round("score", 6).alias("score"))

"""Changes, labels and packing as registered queries, each with the rule in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue_rules import _CALLABLE, _NOISE, _TYPE, _WITH, nodes_of
from .operators.edits import edit_regions
from .operators.storage import new_path
from .plans import harvest as H
from .plans import ranking as K
from .sources.views import cte, load
from .streaming import changes as C
from .streaming import lifecycle as L
from .streaming.batches import run_to_end, settled_batches

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- changes


def _changes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "modify").otherwise(F.col("event_type"))
    return e.select("event_id", kind.alias("kind"), F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("u/"), F.col("user_id").cast("string"))).alias("path"), "ts")


@query("SELECT event_id FROM events WHERE event_type IN ('signup', 'error', 'click') AND user_id % 9 <> 0")
def absorb(spark, sf_dir):
    return C.absorb(_changes(spark, sf_dir)).select("event_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM k GROUP BY user_id, n""")
def settle(spark, sf_dir):
    rows = C.settle(load(spark, sf_dir, "events"), "user_id", "ts")
    return rows.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n_events")


_FLOW = cte("code_nodes") + ", changed AS (SELECT DISTINCT file FROM code_nodes WHERE k % 11 = 0), links AS (SELECT a.id AS src, b.id AS dst FROM code_nodes a JOIN code_nodes b ON b.k = a.k + 1)"


def _links(nodes):
    b = nodes.select(F.col("id").alias("dst"), (F.col("k") - 1).alias("k"))
    return nodes.select(F.col("id").alias("src"), "k").join(b, "k").select("src", "dst")


def _updated(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    changed = nodes.where("k % 11 = 0").select("file").distinct()
    # of the changed files every third definition is gone
    parsed = nodes.join(changed, "file", "left_semi").where("k % 3 <> 0").withColumn("id", F.concat(F.lit("new:"), "id")).select(*nodes.columns)
    return C.update_batch(nodes, _links(nodes), parsed, changed)


_OLD = ", o AS (SELECT file, name, kind, min(id) AS old_id FROM code_nodes WHERE file IN (SELECT file FROM changed) GROUP BY ALL), fresh AS (SELECT coalesce(old_id, 'new:' || id) AS id, c.file FROM code_nodes c LEFT JOIN o ON c.file = o.file AND c.name = o.name AND c.kind = o.kind WHERE c.file IN (SELECT file FROM changed) AND k % 3 <> 0)"


@query(_FLOW + _OLD + " SELECT id, file FROM code_nodes WHERE file NOT IN (SELECT file FROM changed) UNION ALL SELECT id, file FROM fresh")
def update_batch(spark, sf_dir):
    return _updated(spark, sf_dir)[0].select("id", "file")


@query(_FLOW + _OLD + ", gone AS (SELECT id FROM code_nodes WHERE file IN (SELECT file FROM changed) EXCEPT SELECT id FROM fresh) SELECT src, dst FROM links WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def update_batch_edges(spark, sf_dir):
    return _updated(spark, sf_dir)[1]


@query(_FLOW + " SELECT file FROM changed UNION SELECT n.file FROM links JOIN code_nodes n ON links.src = n.id WHERE dst IN (SELECT id FROM code_nodes WHERE file IN (SELECT file FROM changed))")
def update_batch_cone(spark, sf_dir):
    return _updated(spark, sf_dir)[2]


@query(_FLOW + " SELECT src, dst FROM links WHERE src NOT IN (SELECT id FROM code_nodes WHERE file = 'src/main.rs') UNION ALL SELECT id, 'n:0' FROM code_nodes WHERE file = 'src/main.rs'")
def recollect(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    fresh = nodes.where("file = 'src/main.rs'").select(F.col("id").alias("src"), F.lit("n:0").alias("dst"))
    return L.recollect(_links(nodes), nodes, "src/main.rs", fresh)


@query(f"{_WITH} SELECT DISTINCT file AS path FROM code_nodes WHERE k % 10 = 0 ORDER BY path LIMIT 64")
def ensure_call_graph(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return L.ensure_call_graph(nodes.select(F.col("file").alias("path")).distinct(), nodes.where("k % 10 = 0").select(F.col("file").alias("path")))


# ---------------------------------------------------------------- labels


def _emitted(spark, sf_dir):
    n = nodes_of(spark, sf_dir)
    return n.select("id", F.when(F.col("k") % 7 != 0, F.col("k") % 13 / 10).alias("score"), F.when(F.col("k") % 5 != 0, F.concat(F.lit("  "), F.col("name"), F.lit(" "), F.when(F.col("k") % 2 == 0, "is called by many parts ").otherwise(""))).alias("note"))


_EMITTED = _WITH + """, raw AS (SELECT id, CASE WHEN k % 7 <> 0 THEN k % 13 / 10.0 END AS score, CASE WHEN k % 5 <> 0 THEN concat('  ', name, ' ', CASE WHEN k % 2 = 0 THEN 'is called by many parts ' ELSE '' END) END AS note FROM code_nodes),
emitted AS (SELECT id, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(trim(note), '') AS note, CASE WHEN coalesce(score, 0) >= 0.5 THEN 'critical' ELSE 'rejected' END AS pole FROM raw)"""


@query(f"{_WITH} SELECT id FROM code_nodes WHERE {_CALLABLE} OR {_TYPE}")
def labelable(spark, sf_dir):
    return H.labelable(nodes_of(spark, sf_dir)).select("id")


@query(_EMITTED + " SELECT id, score, note, pole FROM emitted")
def emit_sanitize(spark, sf_dir):
    return H.emit_sanitize(_emitted(spark, sf_dir))


@query(_EMITTED + " SELECT CASE WHEN score < 0 OR score > 1 THEN 'range' WHEN pole = 'critical' AND length(note) < 12 THEN 'stub' ELSE 'ok' END AS issue, count(*) AS n FROM emitted GROUP BY 1")
def emit_validate(spark, sf_dir):
    return H.emit_validate(H.emit_sanitize(_emitted(spark, sf_dir)))


@query(_EMITTED + " SELECT id, pole FROM (SELECT *, row_number() OVER (PARTITION BY pole ORDER BY score DESC, id) AS r FROM emitted) x WHERE r <= 30")
def emit_caps(spark, sf_dir):
    return H.emit_caps(H.emit_sanitize(_emitted(spark, sf_dir)), 30).select("id", "pole")


@query(_FLOW + """, t AS (SELECT src AS card, 'calls' AS relation, dst AS id FROM links UNION SELECT dst, 'called_by', src FROM links)
SELECT card, relation, CAST(place AS INTEGER) AS place, id, name FROM (SELECT t.*, n.name, row_number() OVER (PARTITION BY card, relation ORDER BY n.name, t.id) AS place FROM t JOIN code_nodes n ON t.id = n.id) x WHERE place <= 6""")
def card(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return H.card(nodes, _links(nodes), nodes.select("id"))


# ---------------------------------------------------------------- packing

_PLACED = _WITH + ", placed AS (SELECT *, 'caller' AS side, 1 + k % 2 AS hop, k AS place FROM code_nodes WHERE k % 3 = 0 UNION ALL SELECT *, 'callee', 1 + k % 2, k FROM code_nodes WHERE k % 3 = 1)"


def _placed(spark, sf_dir):
    n = nodes_of(spark, sf_dir).where("k % 3 < 2")
    return n.select("*", F.when(F.col("k") % 3 == 0, "caller").otherwise("callee").alias("side"), (1 + F.col("k") % 2).alias("hop"), F.col("k").alias("place"))


@query(_PLACED + " SELECT id, side, CAST(row_number() OVER (PARTITION BY side ORDER BY (name IN ('run', 'fmt') AND side = 'caller' AND hop = 1) DESC, place, id) AS INTEGER) AS place FROM placed")
def focus_inject(spark, sf_dir):
    return K.focus_inject(_placed(spark, sf_dir), ["run", "fmt"]).select("id", "side", "place")


@query(_PLACED + " SELECT id FROM placed WHERE place > 100")
def sample_offset(spark, sf_dir):
    return K.sample_offset(_placed(spark, sf_dir), 100).select("id")


@query(_WITH + """, s AS (SELECT id, name, CAST(in_degree AS DOUBLE) / 40 AS t, CAST(out_degree AS DOUBLE) AS n FROM code_nodes)
SELECT id, round(CASE WHEN lower(name) = 'parser' THEN greatest(CASE WHEN n <> 0 THEN CAST(0.9 AS DOUBLE) * t + CAST(0.1 AS DOUBLE) * n ELSE t END, t) WHEN n <> 0 THEN CAST(0.9 AS DOUBLE) * t + CAST(0.1 AS DOUBLE) * n ELSE t END, 6) AS score FROM s WHERE t > 1.5 OR n <> 0""")
def rank_full(spark, sf_dir):
    rows = nodes_of(spark, sf_dir).select("id", "name", (F.col("in_degree").cast("double") / 40).alias("text_score"), F.lit(0.0).alias("heuristic"), F.col("out_degree").cast("double").alias("neural"))
    return K.rank_full(rows, ["Parser"]).select("id", F.round("score", 6).alias("score"))


@query(f"{_WITH} SELECT id FROM code_nodes ORDER BY (starts_with(file, 'src') OR contains(file, '/src') OR ends_with(file, 'src')) DESC, {_NOISE}, in_degree DESC, name, id LIMIT 40")
def sort_pack(spark, sf_dir):
    return K.sort_pack(nodes_of(spark, sf_dir).withColumn("score", F.col("in_degree")), "src/").limit(40).select("id")


# ---------------------------------------------------------------- settled batches

_HOUR = 3_600_000


@query(f"""WITH RECURSIVE e AS MATERIALIZED (
  SELECT key, ms, path, row_number() OVER (PARTITION BY key ORDER BY ms, path) AS i
  FROM (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms, concat(event_type, props) AS path FROM events)),
m AS (SELECT max(ms) - {_HOUR} AS mark FROM e),
w AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, 0 AS phase, CAST(0 AS BIGINT) AS ends, CAST([] AS VARCHAR[]) AS waiting, 0 AS place, CAST(NULL AS BIGINT) AS fired, CAST([] AS VARCHAR[]) AS gone FROM e
  UNION ALL
  SELECT key, CASE WHEN over THEN i ELSE i + 1 END, CASE WHEN NOT over THEN greatest(phase, 1) WHEN phase = 1 THEN 2 WHEN len(waiting) > 0 THEN 1 ELSE 0 END,
         CASE WHEN NOT over THEN ms + CASE WHEN phase = 2 THEN {9 * _HOUR} ELSE {6 * _HOUR} END WHEN phase = 1 THEN ends + {9 * _HOUR} ELSE ends + {6 * _HOUR} END,
         CASE WHEN NOT over THEN list_distinct(list_append(waiting, path)) WHEN phase = 1 THEN list_sort(waiting)[4:] ELSE waiting END,
         CASE WHEN over AND phase = 1 THEN place + 1 ELSE place END, CASE WHEN over AND phase = 1 THEN ends END, CASE WHEN over AND phase = 1 THEN list_sort(waiting)[1:3] ELSE [] END
  FROM (SELECT w.*, e.ms, e.path, phase > 0 AND ends <= least(coalesce(e.ms, mark), mark) AS over FROM w CROSS JOIN m LEFT JOIN e ON e.key = w.key AND e.i = w.i + 1
        WHERE (phase > 0 AND ends <= least(coalesce(e.ms, mark), mark)) OR e.ms <= mark) x)
SELECT key, make_timestamp(fired * 1000) AS fired, place - 1 AS place, array_to_string(gone, '|') AS paths, len(waiting) AS waiting FROM w WHERE fired IS NOT NULL""")
def watch_batches(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a stream takes a folder or a pattern
    changes = stream.select(F.col("user_id").cast("string").alias("key"), "ts", F.concat("event_type", "props").alias("path"))
    found = run_to_end(settled_batches(changes, "1 hour", 6 * _HOUR, 9 * _HOUR, 3), new_path(spark, "batches"))
    fired = F.timestamp_millis("fired_ms").cast("timestamp_ntz").alias("fired")
    return found.select("key", fired, "place", F.array_join("paths", "|").alias("paths"), F.col("waiting").cast("long").alias("waiting"))


# ---------------------------------------------------------------- edits

def _longest(most: str, side: str) -> str:
    """The largest number of characters, ``most`` at most, in which ``o`` and ``w`` agree on a side; powers of two downwards."""
    steps = "list_concat([0], list_reverse(list_transform(range(0, 24), lambda i: CAST(2 ** i AS BIGINT))))"
    return f"CAST(list_reduce({steps}, lambda n, q: CASE WHEN n + q <= {most} AND {side}(o, n + q) = {side}(w, n + q) THEN n + q ELSE n END) AS BIGINT)"


@query(f"""WITH f AS (SELECT source, arg_min(text, doc_id) AS o FROM documents WHERE text IS NOT NULL GROUP BY source),
d AS (SELECT doc_id, o, text AS w FROM documents JOIN f ON documents.source IS NOT DISTINCT FROM f.source),
p AS (SELECT doc_id, o, w, {_longest("least(length(o), length(w))", "left")} AS k FROM d),
s AS (SELECT *, {_longest("least(length(o), length(w)) - k", "right")} AS j FROM p),
e AS (SELECT doc_id, left(o, k) AS a, left(o, length(o) - j) AS b, left(w, length(w) - j) AS c FROM s)
SELECT doc_id, strlen(a) AS start, strlen(b) AS old_end, strlen(c) AS new_end,
       length(a) - length(replace(a, chr(10), '')) AS start_row, length(string_split(a, chr(10))[-1]) AS start_column,
       length(b) - length(replace(b, chr(10), '')) AS old_end_row, length(string_split(b, chr(10))[-1]) AS old_end_column,
       length(c) - length(replace(c, chr(10), '')) AS new_end_row, length(string_split(c, chr(10))[-1]) AS new_end_column FROM e""")
def edit_region(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("new"))
    first = docs.where("new is not null").groupBy("source").agg(F.min_by("new", "doc_id").alias("old"), F.lit(1).alias("one")).withColumnRenamed("source", "s")
    pairs = docs.join(first, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "old", "new")
    return edit_regions(pairs)

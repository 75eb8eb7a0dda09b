"""Graph views of the fixture tables.

The SQL texts run unchanged on Spark and on the oracle: ``{name}`` stands for a
table.  ``load`` turns one into a DataFrame; ``cte`` into a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # Customers, suppliers and parts; a file is a place or a catalogue shelf.
    "trade_nodes": """
        SELECT concat('c:', CAST(c_custkey AS STRING)) AS id, c_name AS name, concat(r_name, '/', n_name, '/', c_mktsegment) AS file,
               'function_item' AS kind, 'customer' AS lang, r_name AS cluster, c_custkey AS start_line, c_custkey + 10 AS end_line
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT concat('s:', CAST(s_suppkey AS STRING)), concat('s', CAST(s_suppkey AS STRING)), concat(r_name, '/', n_name, '/suppliers'),
               'struct_item', 'supplier', r_name, s_suppkey, s_suppkey + 10
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT concat('p:', CAST(p_partkey AS STRING)), p_name, concat('catalog/', p_brand, '/', p_type),
               'method_definition', 'part', 'catalog', p_partkey, p_partkey + 10 FROM {part}""",
    "trade_edges": """
        SELECT DISTINCT concat('c:', CAST(o_custkey AS STRING)) AS src, concat('s:', CAST(l_suppkey AS STRING)) AS dst
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
        UNION ALL
        SELECT DISTINCT concat('s:', CAST(l_suppkey AS STRING)), concat('p:', CAST(l_partkey AS STRING)) FROM {lineitem}""",
    # Typed by distance: another region, another nation, or the same nation.
    "trade_bridges": """
        SELECT DISTINCT concat('c:', CAST(o_custkey AS STRING)) AS src, concat('s:', CAST(l_suppkey AS STRING)) AS dst,
               CASE WHEN a.n_regionkey <> b.n_regionkey THEN 'export' WHEN a.n_nationkey <> b.n_nationkey THEN 'ipc' ELSE 'twin' END AS kind
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} a ON c_nationkey = a.n_nationkey JOIN {nation} b ON s_nationkey = b.n_nationkey""",
    # From the type of each event of a user to that of the next.
    "flow_edges": """
        SELECT DISTINCT src, dst FROM (
          SELECT concat(CAST(user_id AS STRING), ':', event_type) AS src,
                 concat(CAST(user_id AS STRING), ':', lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS dst,
                 lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) x WHERE nxt IS NOT NULL""",
    # A definition for each document: places, names and kinds of a repository, by remainders of its id.
    "code_nodes": """
        SELECT id, concat(dir, '/', stem, '.', ext) AS file, name, kind, source, start_line, start_line + span AS end_line, in_degree, out_degree, k,
               CASE ext WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'txt' THEN '' ELSE 'typescript' END AS lang
        FROM (SELECT concat('n:', CAST(doc_id AS STRING)) AS id, doc_id AS k,
          split_part('src,src/core,tests,docs/guide,examples/app,node_modules/pkg,vendor/x,crates/a/src,lib,app,tools,scripts,third_party/z,pkg/b/src,benches,Core/Net', ',', CAST(doc_id % 16 + 1 AS INT)) AS dir,
          split_part('main,lib,index,test_a,a_test,util,app,server,conftest,mod,x.spec,parser,config', ',', CAST(doc_id % 13 + 1 AS INT)) AS stem,
          split_part('rs,py,ts,go,c,h,cpp,js,txt,svelte,tsx', ',', CAST(doc_id % 11 + 1 AS INT)) AS ext,
          split_part('main,run,new,get,Parser,parse_item,test_x,fmt,u8,x,HTTPServer,getValue,init,startAll,_hidden,toString,config,a::open,Result', ',', CAST(doc_id % 19 + 1 AS INT)) AS name,
          split_part('function_item,struct_item,method_definition,class_declaration,mod_item,enum_item,function_declaration,impl_item,variable_declarator,call_expression,if_statement,trait_item,type_alias,function_definition,unknown', ',', CAST(doc_id % 15 + 1 AS INT)) AS kind,
          split_part('mod x;,struct A;,static int f(),fn a() b(),  call(x);,type A = B;,macro_rules! m,class B int c;', ',', CAST(doc_id % 8 + 1 AS INT)) AS source,
          doc_id % 40 * 7 AS start_line, doc_id % 5 * 9 AS span, doc_id % 120 AS in_degree, doc_id % 4 AS out_degree FROM {documents}) x""",
    # Parts by the number of their suppliers, documents by their first word.
    "name_nodes": """
        SELECT concat('p:', CAST(p_partkey AS STRING)) AS id, p_name AS name, concat('catalog/', p_brand, '/', p_type) AS file, p_partkey AS start_line,
               coalesce(n, 0) AS weight, p_partkey AS k
        FROM {part} LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM {lineitem} GROUP BY l_partkey) s ON l_partkey = p_partkey
        UNION ALL
        SELECT concat('d:', CAST(doc_id AS STRING)), split_part(text, ' ', 1), concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.txt'), doc_id % 97,
               n_chars % 89, doc_id FROM {documents}""",
    # Orders as functions: a few are tests, types or have names that say nothing.
    "order_nodes": """
        SELECT concat('o:', CAST(o_orderkey AS STRING)) AS id, concat(CASE o_orderstatus WHEN 'O' THEN 'src/' WHEN 'F' THEN 'lib/core/' ELSE 'app/' END,
                 CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'tests/' ELSE '' END, CAST(o_custkey AS STRING), '.rs') AS file,
               CASE o_orderpriority WHEN '1-URGENT' THEN concat('handle_', CAST(o_custkey AS STRING)) WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'main' ELSE 'try_open' END
                 WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'collect' ELSE concat('load_', CAST(o_custkey AS STRING)) END ELSE concat('step_', CAST(o_custkey AS STRING)) END AS name,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN 'struct_item' WHEN o_orderstatus = 'P' THEN 'method_definition' ELSE 'function_item' END AS kind,
               floor(o_totalprice / 10000) AS score FROM {orders}""",
    # Callers of an order: the order of half its key, those named by its customer and status, and six for each urgent one.
    "order_edges": """
        SELECT DISTINCT concat('o:', CAST(a AS STRING)) AS src, concat('o:', CAST(k AS STRING)) AS dst FROM (
          SELECT CAST(floor(o_orderkey / 2) AS BIGINT) AS a, o_orderkey AS k FROM {orders}
          UNION ALL SELECT o_custkey, o_orderkey FROM {orders} WHERE o_custkey % 3 <> 0
          UNION ALL SELECT o_orderkey + 1, o_orderkey FROM {orders} WHERE o_orderstatus = 'F'
          UNION ALL SELECT o_orderkey + j, o_orderkey FROM {orders}, (SELECT 3 AS j UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 11 UNION ALL SELECT 12 UNION ALL SELECT 14) s WHERE o_orderpriority = '1-URGENT') x""",
    # Suppliers as types of their nation's file, its customers as functions.
    "span_nodes": """
        SELECT concat('s:', CAST(s_suppkey AS STRING)) AS id, concat('n', CAST(s_nationkey AS STRING)) AS file, 'struct_item' AS kind, s_suppkey * 40 AS start_line, s_suppkey * 40 + 100 AS end_line FROM {supplier}
        UNION ALL
        SELECT concat('c:', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 'function_item', c_custkey * 3, c_custkey * 3 + c_custkey % 7 FROM {customer}""",
    # Parts as C definitions, and prototypes of the same names in other files and folders.
    "c_nodes": """
        SELECT concat('c:', CAST(p_partkey AS STRING)) AS id, concat('fn_', CAST(p_partkey % 211 AS STRING)) AS name, 'c' AS lang,
               concat(CASE p_partkey % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'include' ELSE 'tests' END, '/m', CAST(p_size % 5 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.c' ELSE '.h' END) AS file,
               CASE WHEN p_partkey % 2 = 0 THEN 'function_definition' WHEN p_partkey % 7 = 0 THEN 'struct_specifier' ELSE 'function_declaration' END AS kind,
               CASE WHEN p_partkey % 5 = 0 THEN 'static int f(void)' ELSE 'int f(void)' END AS source FROM {part}""",
    "docs_nodes": """
        SELECT concat('d:', CAST(doc_id AS STRING)) AS id, split_part(text, ' ', 1) AS name, concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') AS file,
               CASE WHEN n_chars > 2000 THEN 'struct_item' WHEN n_chars > 500 THEN 'function_item' ELSE 'call_expression' END AS kind,
               lang, md5(lower(trim(text))) AS content_hash, n_chars AS size, doc_id FROM {documents}""",
    "docs_edges": """
        SELECT src, dst FROM (SELECT concat('d:', CAST(doc_id AS STRING)) AS src,
          concat('d:', CAST(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS STRING)) AS dst,
          lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM {documents}) x WHERE nxt IS NOT NULL""",
    "pages_nodes": """
        SELECT concat('g:', CAST(page_id AS STRING)) AS id, split_part(split_part(url, '?', 1), '#', 1) AS file, url, page_id FROM {pages}""",
    "vector_edges": """
        SELECT src, dst FROM (SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst FROM {embeddings}) x WHERE dst IS NOT NULL""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a plain table, as a DataFrame; tables are read by column as the view needs them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def cte(*names: str) -> str:
    """``WITH a AS (...), ...`` of views over the bare table names."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)

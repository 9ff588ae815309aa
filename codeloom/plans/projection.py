"""The driver's tables seen as a code graph, so that every query can be held against SQL. Its text runs in both engines, but for the edges, which Spark gets by another of equal rows."""

from __future__ import annotations

FILES = """
SELECT doc_id AS file_id,
  (CASE WHEN doc_id % 10 = 3 THEN 'tests/' WHEN doc_id % 10 = 5 THEN 'src/__tests__/' WHEN doc_id % 20 = 7 THEN 'src/Tests/' WHEN doc_id % 10 = 7 THEN 'src/TESTS/' ELSE 'src/' END)
  || source || '/doc_' || CAST(doc_id AS STRING)
  || (CASE WHEN doc_id % 20 = 1 THEN '_test.go' WHEN doc_id % 10 = 1 THEN '_latest.go' WHEN doc_id % 10 = 2 THEN '.test.ts' ELSE '.txt' END) AS path,
  lang, n_chars AS size, source IN ('src0', 'src1') AS vendor
FROM documents
"""

CALLS = """
SELECT 'crm.Customer_' || CAST(o_custkey AS STRING) || '.order_' || CAST(l_orderkey AS STRING) || '()' AS from_fqn, 'calls' AS kind,
  CASE WHEN l_suppkey % 3 = 0 THEN 'geo.' || n_name || '.supply()' ELSE 'sup.Supplier_' || CAST(l_suppkey AS STRING) || '.supply()' END AS to_fqn,
  l_returnflag <> 'N' AS resolved,
  (CASE WHEN l_orderkey % 97 < 9 THEN 'tests/' ELSE 'src/' END) || 'o' || CAST(l_orderkey % 97 AS STRING) || '.php' AS file,
  CAST(l_linenumber AS INT) AS line, l_returnflag AS flag, l_orderkey AS okey, l_partkey AS pkey, o_custkey AS ckey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""

EDGES = f"""
WITH g_calls AS ({CALLS})
SELECT from_fqn, kind, to_fqn, resolved, file, line, 'ast' AS source FROM g_calls
UNION ALL SELECT DISTINCT from_fqn, 'instantiates', 'cat.Part_' || CAST(pkey AS STRING), true, 'src/o' || CAST(okey % 97 AS STRING) || '.php', line, 'ast' FROM g_calls
UNION ALL SELECT 'crm.Customer_' || CAST(o_custkey AS STRING) || '.main()', 'calls', 'crm.Customer_' || CAST(o_custkey AS STRING) || '.order_' || CAST(o_orderkey AS STRING) || '()', true, 'src/customer.php', CAST(o_custkey AS INT), 'ast' FROM orders
UNION ALL SELECT 'geo.' || n_name || '.boot()', 'calls', 'crm.Customer_' || CAST(c_custkey AS STRING) || '.main()', false, 'src/nation.php', n_nationkey, 'ast' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'crm.Customer_' || CAST(c_custkey AS STRING), 'extends', 'geo.' || n_name, true, 'src/customer.php', CAST(c_custkey AS INT), 'ast' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'sup.Supplier_' || CAST(s_suppkey AS STRING), 'implements', 'geo.' || n_name, true, 'src/supplier.php', CAST(s_suppkey AS INT), 'ast' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'geo.' || n_name, 'extends', 'geo.' || r_name, true, 'src/nation.php', n_nationkey, 'ast' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT from_fqn, kind, to_fqn, resolved, file, line, CASE WHEN okey % 2 = 0 THEN 'phpstan' ELSE 'go-types' END FROM g_calls WHERE flag = 'R'
"""

#: EDGES as Spark runs it: rows equal to those of the text above, with lineitem read twice and not three times, and no string shuffled. Calls and their
#: layers are one pass. Tests of to_fqn reach suppliers and tests of from_fqn orders before the joins. Equal instantiations have the same order
#: and meet where the join puts that order; only those of an order without customer, which differ by no more than its file, are dealt anew.
#: PARTS stands where lines go to their orders; load() may fill in how many parts they take.
PARTS = "/*parts*/"
_SPARK_CALLS = f"""
WITH t AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT {PARTS} l_orderkey, l_linenumber, l_returnflag, s_suppkey, n_name FROM lineitem JOIN t ON l_suppkey = s_suppkey),
c AS (
SELECT 'crm.Customer_' || CAST(o_custkey AS STRING) || '.order_' || CAST(o_orderkey AS STRING) || '()' AS from_fqn,
  CASE WHEN s_suppkey % 3 = 0 THEN 'geo.' || n_name || '.supply()' ELSE 'sup.Supplier_' || CAST(s_suppkey AS STRING) || '.supply()' END AS to_fqn,
  l_returnflag <> 'N' AS resolved,
  (CASE WHEN l_orderkey % 97 < 9 THEN 'tests/' ELSE 'src/' END) || 'o' || CAST(l_orderkey % 97 AS STRING) || '.php' AS file,
  CAST(l_linenumber AS INT) AS line,
  CASE WHEN l_returnflag = 'R' THEN array('ast', CASE WHEN l_orderkey % 2 = 0 THEN 'phpstan' ELSE 'go-types' END) ELSE array('ast') END AS sources
FROM a JOIN orders ON l_orderkey = o_orderkey
)"""
SPARK_EDGES = f"""{_SPARK_CALLS},
b AS (SELECT {PARTS} l_orderkey, l_partkey, CAST(l_linenumber AS INT) AS line FROM lineitem LEFT SEMI JOIN t ON l_suppkey = s_suppkey),
i AS (SELECT DISTINCT l_orderkey, o_orderkey, o_custkey, l_partkey, line FROM b JOIN orders ON l_orderkey = o_orderkey),
j AS (
SELECT 'crm.Customer_' || CAST(o_custkey AS STRING) || '.order_' || CAST(o_orderkey AS STRING) || '()' AS from_fqn, 'cat.Part_' || CAST(l_partkey AS STRING) AS to_fqn,
  'src/o' || CAST(l_orderkey % 97 AS STRING) || '.php' AS file, line
FROM i WHERE o_custkey IS NOT NULL
UNION ALL SELECT DISTINCT CAST(NULL AS STRING), 'cat.Part_' || CAST(l_partkey AS STRING), 'src/o' || CAST(l_orderkey % 97 AS STRING) || '.php', line FROM i WHERE o_custkey IS NULL
)
SELECT from_fqn, 'calls' AS kind, to_fqn, resolved, file, line, source FROM c LATERAL VIEW explode(sources) AS source
UNION ALL SELECT from_fqn, 'instantiates', to_fqn, true, file, line, 'ast' FROM j
""" + EDGES[EDGES.index("UNION ALL SELECT 'crm.Customer_'") : EDGES.index("UNION ALL SELECT from_fqn, kind, to_fqn, resolved, file, line, CASE")]

#: The edges of layers alone, as Spark runs them: only the lines that are in one go anywhere.
SPARK_LAYERS = _SPARK_CALLS.replace("JOIN t ON l_suppkey = s_suppkey", "JOIN t ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'") + " SELECT from_fqn, 'calls' AS kind, to_fqn, resolved, file, line, sources[1] AS source FROM c"

SYMBOLS = """
WITH n AS (SELECT count(*) AS files FROM documents), s AS (
SELECT 0 AS t, r_regionkey AS k, 'interface' AS kind, r_name AS name, 'geo.' || r_name AS fqn, '' AS container, '' AS doc FROM region
UNION ALL SELECT 1, n_nationkey, 'class', n_name, 'geo.' || n_name, '', '' FROM nation
UNION ALL SELECT 2, s_suppkey, 'class', 'Supplier_' || CAST(s_suppkey AS STRING), 'sup.Supplier_' || CAST(s_suppkey AS STRING), '', s_name FROM supplier
UNION ALL SELECT 3, s_suppkey, 'method', 'supply', 'sup.Supplier_' || CAST(s_suppkey AS STRING) || '.supply()', 'sup.Supplier_' || CAST(s_suppkey AS STRING), '' FROM supplier
UNION ALL SELECT 4, c_custkey, 'class', 'Customer_' || CAST(c_custkey AS STRING), 'crm.Customer_' || CAST(c_custkey AS STRING), '', c_mktsegment FROM customer
UNION ALL SELECT 5, c_custkey, 'method', 'main', 'crm.Customer_' || CAST(c_custkey AS STRING) || '.main()', 'crm.Customer_' || CAST(c_custkey AS STRING), '' FROM customer
UNION ALL SELECT 6, o_orderkey, 'method', 'order_' || CAST(o_orderkey AS STRING), 'crm.Customer_' || CAST(o_custkey AS STRING) || '.order_' || CAST(o_orderkey AS STRING) || '()', 'crm.Customer_' || CAST(o_custkey AS STRING), o_orderpriority FROM orders
UNION ALL SELECT 7, p_partkey, 'trait', 'Part_' || CAST(p_partkey AS STRING), 'cat.Part_' || CAST(p_partkey AS STRING), '', p_name FROM part
)
SELECT CAST(t AS BIGINT) * 1000000000000 + k AS row, CAST(k % files AS BIGINT) AS file_id, kind, name, fqn, container, doc, CAST(k % 100 + 1 AS INT) AS start_line, CAST(k % 100 + 3 AS INT) AS end_line, name || '()' AS signature
FROM s CROSS JOIN n
"""

CYCLIC = """
SELECT 'evt.' || event_type AS src, 'evt.' || nxt AS dst, 'calls' AS kind
FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) e WHERE nxt IS NOT NULL
"""

PREVIOUS = "SELECT file_id, path, size, file_id + CASE WHEN file_id % 10 IN (6, 8) THEN 1 ELSE 0 END AS mtime_ns, CASE WHEN file_id % 10 = 6 THEN 'x' || path ELSE path END AS hash FROM g_files WHERE file_id % 10 <> 4"
CURRENT = "SELECT file_id, path, size, file_id AS mtime_ns, path AS hash FROM g_files WHERE file_id % 10 <> 9"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
VIEWS = {"g_files": FILES, "g_edges": SPARK_EDGES, "g_layers": SPARK_LAYERS, "g_symbols": SYMBOLS, "g_cyclic": CYCLIC}


#: Lines that one part meets its orders with, where all edges are asked for.
LINES = 1 << 18


def parts(spark, sf_dir):
    """In how many parts all lines go to their orders, so that one's memory doesn't grow with the input; None, for Spark to decide, where they are no more than tasks at once."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // LINES
    return n if n > spark.sparkContext.defaultParallelism else None


def load(spark, sf_dir, *names, parts=None):
    """The named views as DataFrames; only the tables they name are read. Lines go to their orders in so many parts, if given."""
    import re

    out = []
    for name in names:
        text = VIEWS[name].replace(PARTS, f"/*+ REPARTITION({parts}, l_orderkey) */" if parts else "")
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        out.append(spark.sql(text, **used))
    return out if len(out) > 1 else out[0]

"""Every query of the graph engine over the projected tables, with the DuckDB SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates, scalars
from ..operators import enrich, fts, graph, incremental, lookup, methods
from .fixpoint import checkpointed, closure
from .projection import CURRENT, EDGES, FILES, PREVIOUS, SYMBOLS, CYCLIC, load, parts

QUERIES: dict = {}
ORACLE_SQL: dict = {}

SUPPLY, SUPPLIER, PART = "sup.Supplier_2.supply()", "sup.Supplier_2", "cat.Part_7"
_HIER = "('extends', 'implements', 'uses_trait')"
_CALL = "('calls', 'instantiates')"
_COLS = "from_fqn, kind, to_fqn, file, line, resolved, source"
_PLACE = "resolved DESC, file, line, from_fqn, kind, to_fqn, source"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def with_views(body, *views, recursive=False):
    own = {"g_files": FILES, "g_edges": EDGES, "g_symbols": SYMBOLS, "g_cyclic": CYCLIC}
    heads = [f"{v} AS MATERIALIZED ({own[v]})" for v in views]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(heads) + body


def deduped(inner, order=_PLACE):
    return f"SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY from_fqn, kind, to_fqn, file, line ORDER BY {order}) AS n FROM ({inner})) WHERE n = 1"


def _edge_page(where, limit, order=_PLACE):
    return with_views(" " + deduped(f"SELECT * FROM g_edges WHERE {where} ORDER BY {order} LIMIT {limit}", order), "g_edges")


_EXCLUDED = "(file ILIKE 'tests/%' OR file ILIKE '%/tests/%' OR file ILIKE '%/Tests/%' OR file ILIKE '%/__tests__/%' OR file ILIKE '%_test.go' OR file ILIKE '%.test.ts' OR file ILIKE '%.test.tsx')"


@query("g01_references", _edge_page(f"to_fqn = '{PART}'", 500))
def g01(spark, d):
    return graph.references(load(spark, d, "g_edges"), PART, 500)


@query("g01_references_filtered", _edge_page(f"to_fqn = '{SUPPLY}' AND lower(file) LIKE 'src/%' AND NOT {_EXCLUDED}", 200))
def g01f(spark, d):
    return graph.references(load(spark, d, "g_edges"), SUPPLY, 200, "SRC/", True)


@query("g02_callers_plain", _edge_page(f"to_fqn = '{PART}' AND kind IN {_CALL}", 25))
def g02(spark, d):
    return graph.callers(load(spark, d, "g_edges"), PART, 25)


_UP = f"up AS (SELECT '{SUPPLIER}' AS n UNION SELECT to_fqn FROM up JOIN g_edges ON from_fqn = n AND kind IN {_HIER})"
_DOWN = f"down AS (SELECT '{SUPPLIER}' AS n UNION SELECT from_fqn FROM down JOIN g_edges ON to_fqn = n AND kind IN {_HIER})"
_WIDE = f"(to_fqn = '{SUPPLY}') DESC, {_PLACE}"


@query(
    "g03_callers_widened",
    with_views(
        f", {_UP}, {_DOWN}, hit AS (SELECT from_fqn, kind, to_fqn, file, line, resolved AND to_fqn = '{SUPPLY}' AS resolved, source FROM g_edges WHERE kind = 'calls' AND to_fqn IN (SELECT n || '.supply()' FROM up UNION SELECT n || '.supply()' FROM down)) "
        + deduped("SELECT * FROM hit", _WIDE) + f" ORDER BY {_WIDE} LIMIT 500", "g_edges", recursive=True),
)
def g03(spark, d):
    return graph.callers(load(spark, d, "g_edges"), SUPPLY, 500)


@query("g04_callees", _edge_page(f"from_fqn = 'crm.Customer_7.main()' AND kind IN {_CALL}", 50, "resolved DESC, line, file, from_fqn, kind, to_fqn, source"))
def g04(spark, d):
    return graph.callees(load(spark, d, "g_edges"), "crm.Customer_7.main()")


def _levels(start, src, dst, name):
    """Nodes with the round they are first met in and the least kind of it."""
    return f""", r AS (SELECT CAST('{start}' AS VARCHAR) AS node, 0 AS depth UNION SELECT {dst}, depth + 1 FROM r JOIN g_edges ON {src} = node AND kind IN {_HIER} WHERE depth < 6),
    m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
    SELECT x.node AS node, min(e.kind) AS kind, x.depth AS depth FROM m x JOIN g_edges e ON e.{dst} = x.node AND e.kind IN {_HIER} JOIN m y ON e.{src} = y.node AND y.depth = x.depth - 1 WHERE x.depth > 0 GROUP BY x.node, x.depth"""


@query("g06_ancestors", with_views(_levels(SUPPLIER, "from_fqn", "to_fqn", "up"), "g_edges", recursive=True))
def g06a(spark, d):
    return graph.relatives(load(spark, d, "g_edges"), SUPPLIER, True)


@query("g06_descendants", with_views(_levels("geo.ASIA", "to_fqn", "from_fqn", "down"), "g_edges", recursive=True))
def g06d(spark, d):
    return graph.relatives(load(spark, d, "g_edges"), "geo.ASIA", False)


@query("g07_family", with_views(f", {_UP}, {_DOWN} SELECT n AS node FROM up UNION SELECT n FROM down", "g_edges", recursive=True))
def g07(spark, d):
    return graph.family(load(spark, d, "g_edges"), SUPPLIER)


@query("g08_hierarchy", with_views(f", up AS (SELECT 'geo.NATION_3' AS n, '' AS k UNION SELECT to_fqn, kind FROM up JOIN g_edges ON from_fqn = n AND kind IN {_HIER}), down AS (SELECT 'geo.NATION_3' AS n, '' AS k UNION SELECT from_fqn, kind FROM down JOIN g_edges ON to_fqn = n AND kind IN {_HIER}) SELECT 'ancestor' AS direction, n AS fqn, min(k) AS kind FROM up WHERE k <> '' GROUP BY n UNION ALL SELECT 'descendant', n, min(k) FROM down WHERE k <> '' GROUP BY n", "g_edges", recursive=True))
def g08(spark, d):
    return graph.hierarchy(load(spark, d, "g_edges"), "geo.NATION_3")


_T3 = "(starts_with(file, 'tests/') OR contains(file, '/tests/') OR contains(file, '/Tests/') OR contains(file, '/__tests__/') OR ends_with(file, '_test.go') OR contains(file, '.test.'))"
_WALK = f""", c AS MATERIALIZED (SELECT from_fqn, to_fqn, file, min(line) AS line, {_T3} AS test FROM g_edges WHERE kind IN {_CALL} AND from_fqn <> '' GROUP BY from_fqn, to_fqn, file),
  w AS (SELECT CAST('{SUPPLY}' AS VARCHAR) AS node, 0 AS depth UNION SELECT from_fqn, depth + 1 FROM w JOIN c ON to_fqn = node AND NOT test WHERE depth < 3),
  m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)"""


@query("g09_impact", with_views(_WALK + " SELECT m.depth AS depth, m.node AS fqn, min(struct_pack(file := c.file, line := c.line)).file AS file, min(struct_pack(file := c.file, line := c.line)).line AS line FROM m JOIN c ON c.from_fqn = m.node AND NOT test JOIN m p ON p.node = c.to_fqn AND p.depth = m.depth - 1 WHERE m.depth > 0 GROUP BY m.depth, m.node", "g_edges", recursive=True))
def g09(spark, d):
    return graph.impact(load(spark, d, "g_edges"), SUPPLY, 3, None)[0]


@query("g09_impact_tests", with_views(_WALK + " SELECT DISTINCT file FROM c JOIN m ON to_fqn = node WHERE test AND depth < 3", "g_edges", recursive=True))
def g09t(spark, d):
    return graph.impact(load(spark, d, "g_edges"), SUPPLY, 3, None)[1]


_T4 = "(file ILIKE 'tests/%' OR file ILIKE '%/tests/%' OR file ILIKE '%/Tests/%' OR file ILIKE '%/__tests__/%' OR file ILIKE '%_test.go' OR file ILIKE '%.test.%')"


@query("g10_tests_referencing", with_views(f" SELECT DISTINCT file FROM g_edges WHERE to_fqn IN ('{SUPPLY}', '{SUPPLIER}') AND {_T4} ORDER BY file LIMIT 20", "g_edges"))
def g10(spark, d):
    return graph.tests_referencing(load(spark, d, "g_edges"), [SUPPLY, SUPPLIER])


@query("g11_reference_count", with_views(f" SELECT count(*) AS n FROM g_edges WHERE to_fqn = '{SUPPLY}'", "g_edges"))
def g11(spark, d):
    return graph.reference_count(load(spark, d, "g_edges"), SUPPLY)


@query("g13_all_reference_counts", with_views(" SELECT to_fqn, count(*) AS n FROM g_edges GROUP BY to_fqn", "g_edges"))
def g13(spark, d):
    return graph.reference_counts(load(spark, d, "g_edges"))


@query("g14_implements_division_whole", "WITH h AS (SELECT DISTINCT 'T' || o_custkey AS owner, 'm' || l_partkey AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey), i AS (SELECT DISTINCT 'I' || (p_partkey - p_partkey % (1 + p_size % 3)) AS owner, 'm' || p_partkey AS name FROM part), s AS (SELECT owner, count(*) AS n FROM i GROUP BY owner) SELECT h.owner AS from_fqn, i.owner AS to_fqn FROM h JOIN i USING (name) JOIN s ON s.owner = i.owner GROUP BY h.owner, i.owner, s.n HAVING count(*) = s.n")
def g14_whole(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    types = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("T"), "o_custkey").alias("owner"), F.concat(F.lit("m"), "l_partkey").alias("name"), F.lit("()").alias("signature"))
    faces = read("part").select(F.concat(F.lit("I"), F.col("p_partkey") - F.col("p_partkey") % (1 + F.col("p_size") % 3)).alias("owner"), F.concat(F.lit("m"), "p_partkey").alias("name"), F.lit("()").alias("signature"))
    return methods.implementations(types, faces)


@query("g_cyclic_reach", with_views(", r AS (SELECT CAST('evt.click' AS VARCHAR) AS node UNION SELECT dst FROM r JOIN g_cyclic ON src = node) SELECT node FROM r WHERE node <> 'evt.click'", "g_cyclic", recursive=True))
def g_cyclic(spark, d):
    start = spark.range(1).select(F.lit("evt.click").alias("node"))
    return closure(load(spark, d, "g_cyclic").distinct(), start).select("node")


@query("a01_stats", with_views(" SELECT (SELECT count(*) FROM g_files) AS files, (SELECT count(*) FROM g_symbols) AS symbols", "g_files", "g_symbols"))
def a01(spark, d):
    return lookup.stats(*load(spark, d, "g_files", "g_symbols"))


@query("a02_by_source", with_views(" SELECT source, count(*) AS n FROM g_edges WHERE source <> 'ast' GROUP BY source", "g_edges"))
def a02(spark, d):
    return lookup.source_counts(load(spark, d, "g_edges").where("source <> 'ast'"))


@query("a03_by_lang", with_views(" SELECT lang, count(*) AS n FROM g_files WHERE NOT vendor GROUP BY lang", "g_files"))
def a03(spark, d):
    return lookup.language_counts(load(spark, d, "g_files"))


@query("a10_dedupe", with_views(" " + deduped("SELECT * FROM g_edges"), "g_edges"))
def a10(spark, d):
    n = parts(spark, d)
    return graph.dedupe(load(spark, d, "g_edges", parts=n), graph.by_place(), n and 2 * n).select(*graph.EDGE_COLUMNS)


@query("u01_all_edges", with_views(f" SELECT {_COLS} FROM (SELECT from_fqn, kind, to_fqn, resolved, path AS file, line, 'ast' AS source FROM g_edges JOIN g_files ON line = file_id WHERE source = 'ast' UNION ALL SELECT from_fqn, kind, to_fqn, true, file, line, source FROM g_edges WHERE source <> 'ast')", "g_edges", "g_files"))
def u01(spark, d):
    edges, files, layers = load(spark, d, "g_edges", "g_files", "g_layers", parts=parts(spark, d))
    own = edges.where("source = 'ast'").select(F.col("line").cast("long").alias("file_id"), "from_fqn", "kind", "to_fqn", "resolved", "line")
    often = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").cast("int").cast("long").alias("file_id"))
    return graph.all_edges(own, files, layers.drop("resolved"), often)


_SPLIT = """translate(array_to_string(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i > 1 AND (
    (regexp_matches(s[i-1], '[a-z0-9]') AND regexp_matches(s[i], '[A-Z]')) OR (i < len(s) AND regexp_matches(s[i-1], '[A-Z]') AND regexp_matches(s[i], '[A-Z]') AND regexp_matches(s[i+1], '[a-z]'))
    OR (regexp_matches(s[i-1], '[^0-9]') AND regexp_matches(s[i], '[0-9]'))) THEN ' ' || s[i] ELSE s[i] END), ''), '_-ABCDEFGHIJKLMNOPQRSTUVWXYZ', '  abcdefghijklmnopqrstuvwxyz')"""
_NAMES = "SELECT DISTINCT s FROM (SELECT c_name AS s FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand || 'HTTPServer_v2' FROM part)"


def _names(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    part = read("part")
    return read("customer").select(F.col("c_name").alias("s")).union(read("supplier").select("s_name")).union(part.select("p_name")).union(part.select(F.concat("p_brand", F.lit("HTTPServer_v2")))).distinct()


@query("m01_split_words", f"SELECT s, {_SPLIT} AS words FROM ({_NAMES})")
def m01(spark, d):
    return _names(spark, d).select("s", scalars.split_words(F.col("s")).alias("words"))


@query("m02_doc_summary", "SELECT doc_id, coalesce(list_filter(list_transform(string_split('/** ' || text, chr(10)), lambda l: trim(trim(trim(l, ' ' || chr(9) || chr(13)), '/*'), ' ' || chr(9) || chr(13))), lambda l: l <> '' AND NOT starts_with(l, '@'))[1], '') AS summary FROM documents")
def m02(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", scalars.doc_summary(F.concat(F.lit("/** "), "text")).alias("summary"))


_FQNS = "SELECT DISTINCT to_fqn AS fqn FROM g_edges UNION SELECT replace(to_fqn, '.supply', '::$supply') FROM g_edges UNION SELECT replace(to_fqn, '.', '#') FROM g_edges UNION SELECT replace(to_fqn, '.', chr(92)) FROM g_edges"


def _fqns(spark, d):
    e = load(spark, d, "g_edges").select(F.col("to_fqn").alias("fqn")).distinct()
    return e.union(e.select(F.replace("fqn", F.lit(".supply"), F.lit("::$supply")))).union(e.select(F.replace("fqn", F.lit("."), F.lit("#")))).union(e.select(F.replace("fqn", F.lit("."), F.lit("\\")))).distinct()


@query("m04_short_name", with_views(f" SELECT fqn, regexp_replace(regexp_replace(regexp_replace(fqn, '\\(\\)$', ''), '^.*[\\\\./:#]', ''), '^\\$', '') AS name FROM ({_FQNS})", "g_edges"))
def m04(spark, d):
    return _fqns(spark, d).select("fqn", scalars.short_name(F.col("fqn")).alias("name"))


@query("m06_method_split", with_views(f" SELECT fqn, CASE WHEN contains(fqn, '::') THEN split_part(fqn, '::', 1) WHEN ends_with(fqn, '()') AND contains(fqn, '.') THEN regexp_extract(fqn, '^(.*)\\.[^.]*$', 1) END AS class, CASE WHEN contains(fqn, '::') THEN substr(fqn, strpos(fqn, '::') + 2) WHEN ends_with(fqn, '()') AND contains(fqn, '.') THEN regexp_extract(fqn, '\\.([^.]*)$', 1) END AS member FROM ({_FQNS})", "g_edges"))
def m06(spark, d):
    split = scalars.method_split(F.col("fqn"))
    return _fqns(spark, d).select("fqn", split["class"].alias("class"), split["member"].alias("member"))


@query("m12_module_path", with_views(" SELECT path, regexp_replace(regexp_replace(path, '(\\.d\\.ts|\\.ts|\\.tsx|\\.js|\\.jsx|\\.mjs|\\.cjs)$', ''), '/index$', '') AS module FROM g_files", "g_files"))
def m12(spark, d):
    return load(spark, d, "g_files").select("path", scalars.module_path(F.col("path")).alias("module"))


@query("m15_candidates", "SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_position(c, c[i]) = i THEN c[i] END), lambda x: x IS NOT NULL), ',') AS names FROM (SELECT doc_id, list_filter(list_slice(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'), 1, 60), lambda x: regexp_matches(x, '[A-Z_]')) AS c FROM documents)")
def m15(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.array_join(scalars.identifier_candidates(F.col("text")), ",").alias("names"))


@query("m16_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def m16(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.sha256_hex(F.col("text")).alias("hash"))


@query("f_test_paths", with_views(f" SELECT file_id, (file ILIKE 'tests/%' OR file ILIKE '%/tests/%') AS t1, {_EXCLUDED} AS t2, {_T3} AS t3, {_T4} AS t4 FROM (SELECT file_id, path AS file FROM g_files)", "g_files"))
def f_test_paths(spark, d):
    p = F.col("path")
    return load(spark, d, "g_files").select("file_id", predicates.is_test_rank(p).alias("t1"), predicates.is_test_excluded(p).alias("t2"), predicates.is_test_impact(p).alias("t3"), predicates.is_test_referencing(p).alias("t4"))


@query("s04_vendor", "SELECT x AS path, list_has_any(string_split(x, '/'), ['vendor', 'node_modules']) AS vendor FROM (SELECT DISTINCT replace(source, 'src0', 'a/vendor/b') || '/' || lang AS x FROM documents)")
def s04(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.replace("source", F.lit("src0"), F.lit("a/vendor/b")), F.lit("/"), "lang").alias("path")).distinct()
    return docs.select("path", predicates.in_vendor(F.col("path")).alias("vendor"))


_HIT = "fqn, kind, path, start_line, end_line, signature, doc, vendor"
_SYM = "SELECT s.*, path, vendor FROM g_symbols s JOIN g_files f ON f.file_id = s.file_id"


def _hit_sql(where, order, limit):
    return with_views(f" SELECT {_HIT} FROM ({_SYM}) WHERE {where} ORDER BY {order} LIMIT {limit}", "g_symbols", "g_files")


@query("l02_symbol", _hit_sql(f"fqn = '{SUPPLIER}'", "path, start_line", 20))
def l02(spark, d):
    return lookup.exact(*load(spark, d, "g_symbols", "g_files"), SUPPLIER)


@query("l03_suffix_lookup", _hit_sql("name = 'supply' AND (lower(fqn) LIKE '%.supply' OR lower(fqn) LIKE '%.supply()' OR lower(fqn) LIKE '%/supply()' OR lower(fqn) LIKE '%#supply()')", "vendor, fqn, path, start_line", 20))
def l03(spark, d):
    return lookup.by_suffix(*load(spark, d, "g_symbols", "g_files"), "supply")


@query("l04_members", _hit_sql("container = 'crm.Customer_7'", "start_line, fqn, path", 500))
def l04(spark, d):
    return lookup.members(*load(spark, d, "g_symbols", "g_files"), "crm.Customer_7")


@query("l06_outline", _hit_sql("path = (SELECT path FROM g_files WHERE file_id = 9)", "start_line, fqn", 1000))
def l06(spark, d):
    symbols, files = load(spark, d, "g_symbols", "g_files")
    # file 9 has neither a special prefix nor suffix; its path follows from its source
    path = files.where("file_id = 9").first()["path"]
    return lookup.outline(symbols, files, path)


@query("l07_by_names", _hit_sql("name IN ('supply', 'main', 'Part_3') AND NOT vendor AND NOT (path ILIKE 'tests/%' OR path ILIKE '%/tests/%')", "kind IN ('class', 'interface', 'trait', 'enum') DESC, fqn, path, start_line", 50))
def l07(spark, d):
    return lookup.by_names(*load(spark, d, "g_symbols", "g_files"), ["supply", "main", "Part_3"])


def _contents(spark, d):
    files = load(spark, d, "g_files")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return files, files.select("file_id", "path").join(docs, "file_id").select("path", "content")


def _code_sql(match, prefix, limit):
    own = f"AND lower(path) LIKE '{prefix}%'" if prefix else ""
    return with_views(f""", l AS (SELECT path, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM g_files JOIN documents ON doc_id = file_id WHERE NOT vendor {own})
      SELECT path AS file, CAST(line AS INT) AS line, CASE WHEN len(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS text FROM (SELECT path, line, trim(raw, ' ' || chr(9) || chr(13)) AS t FROM l WHERE {match}) ORDER BY file, line LIMIT {limit + 1}""", "g_files")  # fmt: skip


@query("l08_search_literal", _code_sql("contains(lower(raw), 'the and')", "src/", 200))
def l08(spark, d):
    return lookup.search_code(*_contents(spark, d), "The AND", path_prefix="src/", limit=200)


@query("l08_search_regex", _code_sql("regexp_matches(raw, 'Licen[sc]ed? +under|token = ')", "", 500))
def l08r(spark, d):
    return lookup.search_code(*_contents(spark, d), r"Licen[sc]ed? +under|token = ", True, limit=500)


@query("o12_project_paths", with_views(" SELECT path FROM g_files WHERE NOT vendor AND lower(path) LIKE 'src/tests/%'", "g_files"))
def o12(spark, d):
    return lookup.project_paths(load(spark, d, "g_files"), "src/tests/")


_TOKENS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
_POSTINGS = f""", p AS MATERIALIZED (SELECT row, col, CAST(pos AS INT) AS pos, token FROM (SELECT row, col, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (
  SELECT row, 'name' AS col, {_TOKENS.format('name')} AS t FROM g_symbols UNION ALL SELECT row, 'fqn', {_TOKENS.format('fqn')} FROM g_symbols
  UNION ALL SELECT row, 'doc', {_TOKENS.format('doc')} FROM g_symbols UNION ALL SELECT row, 'words', {_TOKENS.format('w')} FROM (SELECT row, {_SPLIT} AS w FROM (SELECT row, name AS s FROM g_symbols)))))"""


def _indexed(spark, d):
    symbols, files = load(spark, d, "g_symbols", "g_files")
    return symbols.withColumn("words", scalars.split_words(F.col("name"))), files


@query("x02_postings", with_views(_POSTINGS + " SELECT row, col, token, pos FROM p", "g_symbols"))
def x02(spark, d):
    return fts.postings(_indexed(spark, d)[0])


_MATCH = ", a AS (SELECT row, count(*) AS f FROM p WHERE starts_with(token, 'bl') GROUP BY row), b AS (SELECT x.row, count(*) AS f FROM p x JOIN p y ON x.row = y.row AND x.col = y.col AND y.pos = x.pos + 1 WHERE x.token = 'part' AND starts_with(y.token, '1') GROUP BY x.row)"


@query("x04_fts_match", with_views(_POSTINGS + _MATCH + " SELECT a.row FROM a JOIN b USING (row)", "g_symbols"))
def x04(spark, d):
    symbols, _ = _indexed(spark, d)
    return fts.ranked(fts.postings(symbols, sized=True), "bl part_1", fts.lengths(symbols)).select("row")


_SCORE = """, z AS (SELECT row, count(*) AS d FROM p GROUP BY row), st AS (SELECT (SELECT count(*) FROM g_symbols) AS n, (SELECT count(*) FROM p) / (SELECT count(*) FROM g_symbols) AS av),
 ia AS (SELECT CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END AS i FROM st, (SELECT count(*) AS c FROM a)),
 ib AS (SELECT CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END AS i FROM st, (SELECT count(*) AS c FROM b))
 SELECT row, round(0.0 - ia.i * a.f * 2.2 / (a.f + 1.2 * (1 - 0.75 + 0.75 * d / av)) - ib.i * b.f * 2.2 / (b.f + 1.2 * (1 - 0.75 + 0.75 * d / av)), 9) AS score FROM a JOIN b USING (row) JOIN z USING (row), st, ia, ib"""


@query("x05_bm25", with_views(_POSTINGS + _MATCH + _SCORE, "g_symbols"))
def x05(spark, d):
    symbols, _ = _indexed(spark, d)
    return fts.ranked(fts.postings(symbols, sized=True), "bl part_1", fts.lengths(symbols)).select("row", F.round("score", 9).alias("score"))


@query("l01_search_symbols", with_views(_POSTINGS + ", a AS (SELECT DISTINCT row FROM p WHERE starts_with(token, 'supplier')) SELECT row, fqn, kind FROM a JOIN g_symbols USING (row) WHERE kind = 'method'", "g_symbols"))
def l01(spark, d):
    symbols, files = _indexed(spark, d)
    return fts.search(symbols, files, "supplier", kind="method", limit=None)[0].select("row", "fqn", "kind")


_STATUS = "CASE WHEN c.path IS NULL THEN 'removed' WHEN k.path IS NULL THEN 'new' WHEN c.size = k.size AND c.mtime_ns = k.mtime_ns THEN 'unchanged' WHEN c.hash = k.hash THEN 'touched' ELSE 'changed' END"


def _snapshots(spark, d):
    files = load(spark, d, "g_files")
    return spark.sql(PREVIOUS.replace("g_files", "{g}"), g=files), spark.sql(CURRENT.replace("g_files", "{g}"), g=files)


@query("j07_diff", with_views(f", k AS ({PREVIOUS}), c AS ({CURRENT}) SELECT coalesce(c.path, k.path) AS path, {_STATUS} AS status FROM k FULL JOIN c ON k.path = c.path", "g_files"))
def j07(spark, d):
    return incremental.diff(*_snapshots(spark, d))


@query("a13_run_statistics", with_views(f", k AS ({PREVIOUS}), c AS ({CURRENT}) SELECT {_STATUS} AS status, count(*) AS n FROM k FULL JOIN c ON k.path = c.path GROUP BY 1", "g_files"))
def a13(spark, d):
    return incremental.run_statistics(incremental.diff(*_snapshots(spark, d)))


@query("k01_next_snapshot", with_views(f", k AS ({PREVIOUS}), c AS ({CURRENT}) SELECT coalesce(c.path, k.path) AS path, c.size AS size, c.mtime_ns AS mtime_ns FROM k FULL JOIN c ON k.path = c.path WHERE c.path IS NOT NULL", "g_files"))
def k01(spark, d):
    known, current = _snapshots(spark, d)
    statuses = incremental.diff(known, current)
    fresh = current.join(statuses.where("status IN ('new', 'changed')"), "path", "left_semi").select(*known.columns)
    empty = spark.createDataFrame([], "file_id long")
    tables = {"files": known, **{t: empty for t in incremental.OWNED}}
    return incremental.next_snapshot(tables, statuses, current, {"files": fresh, **{t: empty for t in incremental.OWNED}})["files"].select("path", "size", "mtime_ns")


_REPORTED = "SELECT CASE WHEN file_id % 4 = 0 THEN '/proj/' || path WHEN file_id % 4 = 1 THEN '/app/mnt/' || path WHEN file_id % 4 = 2 THEN path ELSE '/' || path END AS p FROM g_files UNION ALL SELECT '/nowhere/x.php' UNION ALL SELECT ''"


@query("j08_normalize_path", with_views(f""", r AS (SELECT DISTINCT p, string_split(regexp_replace(p, '^/', ''), '/') AS parts FROM ({_REPORTED})), t AS (
  SELECT p, 0 AS o, CASE WHEN starts_with(p, '/proj/') THEN substr(p, 7) ELSE p END AS s FROM r UNION ALL SELECT p, i, array_to_string(list_slice(parts, i, len(parts)), '/') FROM (SELECT p, parts, unnest(range(2, len(parts) + 1)) AS i FROM r)),
  f AS (SELECT p, min_by(s, o) AS s FROM t JOIN g_files ON path = s GROUP BY p) SELECT r.p AS p, coalesce(f.s, r.p) AS path FROM r LEFT JOIN f ON f.p = r.p""", "g_files"))  # fmt: skip
def j08(spark, d):
    files = load(spark, d, "g_files")
    return enrich.normalize_paths(spark.sql(_REPORTED.replace("g_files", "{g}"), g=files), files, "/proj")


@query("j09_longest_prefix", with_views(""", m(root, module) AS (VALUES ('src', 'm.src'), ('src/src1', 'm.one'), ('tests', 'm.tests'), ('src/__tests__', 'm.unit')), x AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM g_files)
  SELECT path, coalesce(max_by(module || substr(dir, len(root) + 1), len(root)), any_value(dir)) AS package FROM x LEFT JOIN m ON dir = root OR starts_with(dir, root || '/') GROUP BY path""", "g_files"))  # fmt: skip
def j09(spark, d):
    from ..functions.paths import package_path

    modules = {"src": "m.src", "src/src1": "m.one", "tests": "m.tests", "src/__tests__": "m.unit"}
    return load(spark, d, "g_files").select("path", package_path(F.col("path"), modules).alias("package"))


@query("s13_analyser_json", "WITH m AS (SELECT doc_id, json_object('from', 'a' || doc_id, 'kind', 'calls', 'to', 'b' || (doc_id % 7), 'line', doc_id % 50) AS e FROM documents) SELECT 'a' || doc_id AS \"from\", 'calls' AS kind, 'b' || (doc_id % 7) AS \"to\", 'f' || doc_id || '.php' AS file, CAST(doc_id % 50 AS INT) AS line FROM documents WHERE doc_id % 3 <> 0")
def s13(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    edge = F.to_json(F.struct(F.concat(F.lit("a"), "doc_id").alias("from"), F.lit("calls").alias("kind"), F.concat(F.lit("b"), F.col("doc_id") % 7).alias("to"), (F.col("doc_id") % 50).cast("int").alias("line")))
    message = F.struct(edge.alias("message"), F.lit(3).alias("line"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise("edge").alias("identifier"))
    broken = F.struct(F.lit("no json").alias("message"), F.lit(4).alias("line"), F.lit("edge").alias("identifier"))
    report = F.to_json(F.struct(F.create_map(F.concat(F.lit("f"), "doc_id", F.lit(".php")), F.struct(F.array(message, broken).alias("messages"))).alias("files")))
    return enrich.analyser_edges(docs.select(report.alias("value")), "edge").select("from", "kind", "to", "file", "line")


@query("a12_import_dedupe", with_views(""" SELECT 'layer' AS source, from_fqn, kind, to_fqn, file, line FROM (SELECT *, row_number() OVER (PARTITION BY from_fqn, kind, to_fqn, file ORDER BY line, source) AS n FROM g_edges WHERE from_fqn <> '' OR to_fqn <> '') WHERE n = 1""", "g_edges"))
def a12(spark, d):
    edges = load(spark, d, "g_edges").selectExpr("struct(line, source) AS n", "from_fqn AS `from`", "kind", "to_fqn AS `to`", "file", "line")
    files = checkpointed(edges.select("file").distinct())
    return enrich.import_edges(edges, files.select(F.col("file").alias("path")), "/proj", "layer", files.select(F.col("file").alias("p")))


@query("k04_replace_source", with_views(" SELECT source, count(*) AS n FROM (SELECT source FROM g_edges WHERE source = 'go-types' UNION ALL SELECT 'phpstan' FROM (SELECT * FROM g_edges WHERE source = 'ast' AND kind = 'extends')) GROUP BY source", "g_edges"))
def k04(spark, d):
    edges = load(spark, d, "g_edges")
    fresh = edges.where("source = 'ast' AND kind = 'extends'").withColumn("source", F.lit("phpstan"))
    return lookup.source_counts(enrich.replace_source(edges.where("source <> 'ast'"), "phpstan", fresh))


@query("m03_doc_summary_left", "SELECT doc_id, coalesce(list_filter(list_transform(string_split('/* ' || text || '*/', chr(10)), lambda l: trim(regexp_replace(trim(l, ' ' || chr(9) || chr(13)), '^[/*]+', ''), ' ' || chr(9) || chr(13))), lambda l: l <> '' AND NOT starts_with(l, '@'))[1], '') AS summary FROM documents")
def m03(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", scalars.doc_summary(F.concat(F.lit("/* "), "text", F.lit("*/")), both_ends=False).alias("summary"))


@query("m09_snippet", "SELECT doc_id, CASE WHEN len(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)")
def m09(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.snippet(F.col("text")).alias("snippet"))


@query("m10_signature", "SELECT doc_id, CASE WHEN len(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS signature FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents)")
def m10(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.signature(F.col("text")).alias("signature"))


@query(
    "l05_source_window",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x, CAST(len(string_split(text, chr(10))) AS INT) AS n FROM documents)
    SELECT doc_id, CASE WHEN 3 <= n THEN array_to_string(list_slice(x, 3, least(n, 6)), chr(10)) || CASE WHEN n > 6 THEN chr(10) || '// … truncated at line 6 — call again with sourceOffset=5 …' ELSE '' END END AS source FROM l""",
)
def l05(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", scalars.source_window(F.col("text"), F.lit(2), F.size(F.split("text", "\n")), 1, 4).alias("source"))


@query("a08_distinct_sources", with_views(" SELECT DISTINCT source FROM g_edges WHERE source <> 'ast'", "g_edges"))
def a08(spark, d):
    return load(spark, d, "g_edges").where("source <> 'ast'").select("source").distinct()


@query("k05_meta_upsert", "SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS value FROM documents")
def k05(spark, d):
    meta = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("k"), "doc_id").alias("key"), F.col("lang").alias("value"), "doc_id")
    updates = meta.where("doc_id % 3 = 0").select("key", F.lit("new").alias("value"))
    return incremental.upsert_meta(meta.select("key", "value"), updates)


@query("g05_hierarchy_step", with_views(f" SELECT DISTINCT from_fqn AS src, to_fqn AS dst, kind FROM g_edges WHERE kind IN {_HIER}", "g_edges"))
def g05(spark, d):
    return graph.hierarchy_steps(load(spark, d, "g_edges"), True)


@query("f15_proper_edges", with_views(" SELECT source, count(*) AS n FROM g_edges WHERE to_fqn <> '' AND to_fqn <> from_fqn GROUP BY source", "g_edges"))
def f15(spark, d):
    edges = load(spark, d, "g_edges")
    return edges.where(predicates.proper_edge(F.col("from_fqn"), F.col("to_fqn"))).groupBy("source").agg(F.count("*").alias("n"))


@query("a11_extraction_dedupe", with_views(" SELECT file, from_fqn, kind, to_fqn, resolved, min(line) AS line FROM g_edges WHERE source = 'ast' GROUP BY ALL", "g_edges"))
def a11(spark, d):
    n = parts(spark, d)
    return graph.once_a_file(load(spark, d, "g_edges", parts=n).where("source = 'ast'"), n and 2 * n)


@query("j10_outline_relations", with_views(f" SELECT s.fqn AS fqn, coalesce(string_agg(e.kind || ' ' || e.to_fqn, ', ' ORDER BY e.kind || ' ' || e.to_fqn), '') AS relations FROM g_symbols s LEFT JOIN (SELECT DISTINCT from_fqn, kind, to_fqn FROM g_edges WHERE kind IN {_HIER}) e ON e.from_fqn = s.fqn WHERE s.kind = 'class' GROUP BY s.fqn", "g_symbols", "g_edges"))
def j10(spark, d):
    return graph.outline_relations(*load(spark, d, "g_symbols", "g_edges"))

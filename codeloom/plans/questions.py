"""Queries on orders, pages, caps and fallbacks of the graph engine's questions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fts, graph, incremental, lookup
from .projection import load
from .queries import _CALL, _MATCH, _POSTINGS, _SCORE, _SYM, _T3, _T4, _indexed, SUPPLY, with_views

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name, sql):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_FOUND = _MATCH + _SCORE.replace(" SELECT row, round(0.0", ", r AS (SELECT row, round(0.0").replace(", 9) AS score", ", 12) AS score") + ")"
_RANK = "CASE WHEN path ILIKE 'tests/%' OR path ILIKE '%/tests/%' THEN 1 ELSE 0 END"


@query("l01_search_page", with_views(f"{_POSTINGS}{_FOUND} SELECT s.row AS row, fqn, kind, path, round(score, 9) AS score FROM r JOIN g_symbols s ON s.row = r.row JOIN g_files f ON f.file_id = s.file_id ORDER BY vendor, {_RANK}, r.score, s.row LIMIT 20 OFFSET 5", "g_symbols", "g_files"))
def l01_page(spark, d):
    symbols, files = _indexed(spark, d)
    return fts.search(symbols, files, "bl part_1", limit=20, offset=5)[0].withColumn("score", F.round("score", 9))


@query("l01_search_order", with_views(f"{_POSTINGS}{_FOUND} SELECT s.row AS row, row_number() OVER (ORDER BY vendor, {_RANK}, r.score, s.row) AS place FROM r JOIN g_symbols s ON s.row = r.row JOIN g_files f ON f.file_id = s.file_id ORDER BY place LIMIT 50", "g_symbols", "g_files"))
def l01_order(spark, d):
    symbols, files = _indexed(spark, d)
    page = fts.search(symbols, files, "bl part_1", limit=50)[0].select("row").collect()  # a page of 50: the order of its rows is the answer
    return spark.createDataFrame([(r["row"], i + 1) for i, r in enumerate(page)], "row long, place long")


@query("a04_total", with_views(_POSTINGS + _MATCH + " SELECT count(*) AS n FROM a JOIN b USING (row)", "g_symbols"))
def a04(spark, d):
    symbols, files = _indexed(spark, d)
    return spark.range(1).select(F.lit(fts.search(symbols, files, "bl part_1", limit=1)[1]).cast("long").alias("n"))


def _resolved(name):
    tails = [sep + name + end for end in ("", "()") for sep in ("chr(92)", ".", "/", "#")]
    ends = " OR ".join(f"ends_with(lower(fqn), {'chr(92) || ' + repr(t[7:].lower()) if t.startswith('chr(92)') else repr(t.lower())})" for t in tails)
    return f"coalesce((SELECT min(fqn) FROM g_symbols WHERE fqn = '{name}'), (SELECT fqn FROM ({_SYM}) WHERE name = '{name}' AND ({ends}) ORDER BY vendor, fqn, path, start_line LIMIT 1), '{name}')"


NAMES = ("sup.Supplier_2", "Supplier_2", "supply", "Nowhere_1")


@query("g12_resolve_names", with_views(" " + " UNION ALL ".join(f"SELECT '{n}' AS name, {_resolved(n)} AS fqn" for n in NAMES), "g_symbols", "g_files"))
def g12(spark, d):
    symbols, files = load(spark, d, "g_symbols", "g_files")
    return spark.createDataFrame([(n, lookup.resolve(symbols, files, n)) for n in NAMES], "name string, fqn string")


_MUTED = "SELECT from_fqn, CASE WHEN starts_with(file, 'tests/') THEN 'references_type' ELSE kind END AS kind, to_fqn, file, line FROM g_edges"


@query("g13_impact_fallback", with_views(f" SELECT DISTINCT file FROM ({_MUTED}) WHERE to_fqn IN ('{SUPPLY}', 'sup.Supplier_2') AND {_T4} ORDER BY file LIMIT 20", "g_edges"))
def g13(spark, d):
    """No call comes from a test here, so the tests that refer to the symbol or its class are given."""
    edges = load(spark, d, "g_edges").withColumn("kind", F.when(F.col("file").startswith("tests/"), "references_type").otherwise(F.col("kind")))
    return graph.affected_tests(edges, SUPPLY, graph.impact(edges, SUPPLY, 2, 10)[1])[0]


_LEVEL = "SELECT from_fqn AS node, min(struct_pack(file := file, line := line)) AS spot FROM c JOIN {0} ON to_fqn = {0}.node WHERE NOT test AND from_fqn NOT IN ({1}) GROUP BY from_fqn"
_CAPPED = f""", c AS MATERIALIZED (SELECT from_fqn, to_fqn, file, min(line) AS line, {_T3} AS test FROM g_edges WHERE kind IN {_CALL} AND from_fqn <> '' GROUP BY from_fqn, to_fqn, file),
  l0 AS MATERIALIZED (SELECT '{SUPPLY}' AS node), m1 AS MATERIALIZED ({_LEVEL.format('l0', 'SELECT node FROM l0')}), l1 AS MATERIALIZED (SELECT * FROM m1 ORDER BY node LIMIT 7),
  m2 AS MATERIALIZED ({_LEVEL.format('l1', 'SELECT node FROM l0 UNION ALL SELECT node FROM m1')}), l2 AS MATERIALIZED (SELECT * FROM m2 ORDER BY node LIMIT 7),
  m3 AS MATERIALIZED ({_LEVEL.format('l2', 'SELECT node FROM l0 UNION ALL SELECT node FROM m1 UNION ALL SELECT node FROM m2')}), l3 AS MATERIALIZED (SELECT * FROM m3 ORDER BY node LIMIT 7)"""


@query("o10_impact_levels", with_views(_CAPPED + " SELECT CAST(d AS INT) AS depth, node AS fqn, spot.file AS file, spot.line AS line FROM (SELECT 1 AS d, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3)", "g_edges"))
def o10(spark, d):
    return graph.impact(load(spark, d, "g_edges"), SUPPLY, 3, 7)[0]


@query("k03_removed_files", with_views(" SELECT row, fqn FROM g_symbols WHERE file_id NOT IN (SELECT file_id FROM g_files WHERE file_id % 10 = 9)", "g_symbols", "g_files"))
def k03(spark, d):
    """The snapshot after a run that finds some files gone: their symbols go with them."""
    symbols, files = load(spark, d, "g_symbols", "g_files")
    known = files.select("file_id", "path", "size", F.lit(1).cast("long").alias("mtime_ns"), F.lit("").alias("hash"))
    here = known.where("file_id % 10 <> 9").drop("file_id")
    others = dict.fromkeys(incremental.OWNED, spark.createDataFrame([], "file_id long"))
    after = incremental.next_snapshot(others | {"files": known, "symbols": symbols}, incremental.diff(known, here), here, others | {"files": known.limit(0), "symbols": symbols.limit(0)})
    return after["symbols"].select("row", "fqn")


@query("f16_bare_edges", with_views(" SELECT 'layer' AS source, f AS from_fqn, kind, t AS to_fqn, file, min(line) AS line FROM (SELECT CASE WHEN line % 3 = 0 THEN '' ELSE from_fqn END AS f, CASE WHEN line % 2 = 0 THEN '' ELSE to_fqn END AS t, kind, file, line FROM g_edges WHERE source <> 'ast') WHERE f <> '' OR t <> '' GROUP BY ALL", "g_edges"))
def f16(spark, d):
    """Of edges with an end missing those with the other one stay; those without both go."""
    from ..operators import enrich

    edges = load(spark, d, "g_edges").where("source <> 'ast'")
    raw = edges.select(F.col("line").alias("n"), F.expr("CASE WHEN line % 3 <> 0 THEN from_fqn END AS `from`"), "kind", F.expr("CASE WHEN line % 2 = 0 THEN '' ELSE to_fqn END AS `to`"), "file", "line")
    return enrich.import_edges(raw, edges.select(F.col("file").alias("path")), "/proj", "layer")


@query("f12_callers_outside_files", with_views(f" SELECT DISTINCT from_fqn AS fqn FROM (SELECT CASE WHEN line % 2 = 0 THEN '' ELSE from_fqn END AS from_fqn, kind, to_fqn, file FROM g_edges) WHERE from_fqn <> '' AND to_fqn = '{SUPPLY}' AND kind IN {_CALL} AND NOT {_T3}", "g_edges"))
def f12(spark, d):
    """Calls at a file's top level have no caller and are left out of the impact."""
    edges = load(spark, d, "g_edges").withColumn("from_fqn", F.expr("CASE WHEN line % 2 = 0 THEN '' ELSE from_fqn END"))
    return graph.impact(edges, SUPPLY, 1, None)[0].select("fqn")

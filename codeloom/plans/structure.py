"""Queries on closures kept as tables, method sets, indexed code search and stored counts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Graph
from ..functions import paths
from ..functions.scalars import member_separator
from ..operators import graph, incremental, labels, lookup, methods, trigrams
from .projection import load
from .queries import _HIER, _PLACE, SUPPLIER, SUPPLY, _code_sql, _contents, _levels, deduped, with_views

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name, sql):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


# Code search by trigrams


_RUNS = "(?s)..."


@query("l08_trigram_postings", with_views(f""", t AS (SELECT path, lower(text) AS s FROM g_files JOIN documents ON doc_id = file_id)
  SELECT * FROM (SELECT DISTINCT path, unnest(regexp_extract_all(s, '{_RUNS}') || regexp_extract_all(s[2:], '{_RUNS}') || regexp_extract_all(s[3:], '{_RUNS}')) AS gram FROM t) WHERE regexp_full_match(gram, '(?s)[\\x00-\\x7f]*')""", "g_files"))  # fmt: skip
def l08_postings(spark, d):
    return trigrams.postings(_contents(spark, d)[1])


@query("l08_indexed_literal", _code_sql("contains(lower(raw), 'the and')", "src/", 200))
def l08_literal(spark, d):
    files, contents = _contents(spark, d)
    return lookup.search_code(files, contents, "The AND", path_prefix="src/", limit=200, index=trigrams.postings(contents))


@query("l08_indexed_regex", _code_sql("regexp_matches(raw, 'Licen[sc]ed? +under|token = ')", "", 500))
def l08_regex(spark, d):
    files, contents = _contents(spark, d)
    return lookup.search_code(files, contents, r"Licen[sc]ed? +under|token = ", True, limit=500, index=trigrams.postings(contents))


_ALL = lambda *grams: "(" + " AND ".join(f"contains(s, '{g}')" for g in grams) + ")"


@query("l08_candidates", with_views(f""", t AS (SELECT path, lower(text) AS s FROM g_files JOIN documents ON doc_id = file_id)
  SELECT path FROM t WHERE {_ALL('cen', 'ens', 'ice', 'lic', 'nse', 'sed')} OR {_ALL('tok', 'oke', 'ken', 'en ', 'n =', ' = ')}""", "g_files"))  # fmt: skip
def l08_candidates(spark, d):
    """What the pattern requires, told as plain tests of the same texts."""
    return trigrams.candidates(trigrams.postings(_contents(spark, d)[1]), trigrams.required("Licensed +by|token = ", True))


# Ancestors as a table

_STEPS = f"s AS MATERIALIZED (SELECT DISTINCT from_fqn AS src, to_fqn AS dst FROM g_edges WHERE kind IN {_HIER})"
_ANCESTORS = "l AS (SELECT node, ancestor, min(depth) AS depth FROM r GROUP BY node, ancestor)"


def _walk(steps):
    return f"r AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM {steps} UNION SELECT node, dst, depth + 1 FROM r JOIN {steps} ON src = ancestor WHERE depth < 9)"


@query("g06_all_ancestors", with_views(f", {_STEPS}, {_walk('s')}, {_ANCESTORS} SELECT node, ancestor, depth FROM l", "g_edges", recursive=True))
def g06_all(spark, d):
    return labels.ancestors(graph.hierarchy_steps(load(spark, d, "g_edges"), True)).select("node", "ancestor", "depth")


@query("g07_all_families", with_views(f", {_STEPS}, {_walk('s')}, p AS (SELECT DISTINCT node, ancestor FROM r) SELECT node, ancestor AS relative FROM p UNION SELECT ancestor, node FROM p UNION SELECT node, node FROM p UNION SELECT ancestor, ancestor FROM p", "g_edges", recursive=True))
def g07_all(spark, d):
    return labels.families(labels.ancestors(graph.hierarchy_steps(load(spark, d, "g_edges"), True)))


_LATER = """n AS MATERIALIZED (SELECT src, dst FROM s WHERE NOT (starts_with(src, 'sup.') AND hash_of(src) % 5 = 0) AND src <> 'geo.FRANCE'
  UNION SELECT src, 'geo.FRANCE' FROM s WHERE starts_with(src, 'crm.') AND hash_of(src) % 7 = 0 UNION SELECT 'geo.FRANCE', 'geo.GERMANY' UNION SELECT 'geo.AFRICA', 'geo.ASIA')"""


def _later(steps):
    """The steps after an edit: some suppliers and a nation lose theirs, some customers and a nation get one more, and a region gets a parent."""
    number = F.regexp_extract("src", "([0-9]+)$", 1).try_cast("long")
    kept = steps.where(~F.coalesce(F.col("src").startswith("sup.") & (number % 5 == 0), F.lit(False)) & (F.col("src") != "geo.FRANCE"))
    more = steps.where(F.col("src").startswith("crm.") & (number % 7 == 0)).select("src", F.lit("geo.FRANCE").alias("dst"), F.lit("extends").alias("kind"))
    own = steps.sparkSession.createDataFrame([("geo.FRANCE", "geo.GERMANY", "extends"), ("geo.AFRICA", "geo.ASIA", "extends")], "src string, dst string, kind string")
    return kept.unionByName(more).unionByName(own).distinct()


@query("g08_labels_after_edit", with_views(f", {_STEPS}, {_LATER}, {_walk('n')}, {_ANCESTORS} SELECT node, ancestor, depth FROM l".replace("hash_of(src)", "TRY_CAST(regexp_extract(src, '([0-9]+)$', 1) AS BIGINT)"), "g_edges", recursive=True))
def g08_edit(spark, d):
    """Labels kept up by what an edit changes equal those made anew."""
    steps = graph.hierarchy_steps(load(spark, d, "g_edges"), True)
    return labels.changed(labels.ancestors(steps), steps, _later(steps))[0].select("node", "ancestor", "depth")


_DECLARED = """d AS MATERIALIZED (SELECT 'sup.Supplier_' || s_suppkey AS owner FROM supplier WHERE s_suppkey % 2 = 1 UNION SELECT 'geo.' || n_name FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT 'geo.' || r_name FROM region WHERE r_regionkey % 2 = 0)"""


def _declared(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    own = read("supplier").where("s_suppkey % 2 = 1").select(F.concat(F.lit("sup.Supplier_"), "s_suppkey").alias("owner"))
    own = own.union(read("nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("geo."), "n_name"))).union(read("region").where("r_regionkey % 2 = 0").select(F.concat(F.lit("geo."), "r_name")))
    return own.select("owner", F.lit("supply()").alias("member"))


@query("g15_resolved_calls", with_views(f", {_STEPS}, {_walk('s')}, {_ANCESTORS}, {_DECLARED}, c AS (SELECT from_fqn, to_fqn, file, line, source, regexp_extract(to_fqn, '^(.*)\\.supply\\(\\)$', 1) AS owner FROM g_edges WHERE kind = 'calls'), " + """
  o AS (SELECT DISTINCT owner FROM c WHERE owner <> ''), a AS (SELECT o.owner, o.owner AS at, 0 AS depth FROM o UNION ALL SELECT o.owner, ancestor, depth FROM o JOIN l ON node = o.owner),
  b AS (SELECT a.owner, min(struct_pack(depth := depth, at := a.at)) AS n FROM a JOIN d ON d.owner = a.at GROUP BY a.owner)
  SELECT from_fqn, to_fqn, file, line, source, n.at || '.supply()' AS target FROM c LEFT JOIN b ON b.owner = c.owner""", "g_edges", recursive=True))  # fmt: skip
def g15(spark, d):
    """Every call with the declaration it means: suppliers, nations and regions declare supply() by turns, so some calls go up one step, some two, some nowhere."""
    edges = load(spark, d, "g_edges")
    calls = edges.where("kind = 'calls'").select("from_fqn", "to_fqn", "file", "line", "source", F.regexp_extract("to_fqn", r"^(.*)\.([^.]*)$", 1).alias("owner"), F.regexp_extract("to_fqn", r"\.([^.]*)$", 1).alias("member"), F.lit(member_separator("a.b()")).alias("separator"))
    found = labels.resolved_calls(calls, labels.ancestors(graph.hierarchy_steps(edges, True)), _declared(spark, d))
    return found.select("from_fqn", "to_fqn", "file", "line", "source", "target")


# Method sets

_METHODS = """e AS MATERIALIZED (
    SELECT 'T' || c_custkey AS owner, 'N' || c_nationkey AS part, c_custkey % 2 = 0 AS pointer FROM customer
    UNION ALL SELECT 'T' || c_custkey, 'G' || c_custkey % 7, c_custkey % 3 = 0 FROM customer
    UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey % 2 = 0 FROM nation
    UNION ALL SELECT 'G' || n_nationkey, 'R' || n_nationkey % 5, false FROM nation WHERE n_nationkey < 7),
  h AS MATERIALIZED (
    SELECT owner, name, CASE WHEN min(k) % 11 > 0 THEN '(' || min(k) % 4 || ')' END AS signature, min(k) % 3 = 0 AS pointer FROM (
      SELECT 'T' || o_custkey AS owner, 'm' || l_partkey % 40 AS name, l_partkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1
      UNION ALL SELECT 'N' || s_nationkey, 'm' || s_suppkey % 40, s_suppkey FROM supplier
      UNION ALL SELECT 'G' || p_size % 7, 'm' || p_partkey % 60, p_partkey FROM part WHERE p_size < 14
      UNION ALL SELECT 'R' || p_partkey % 5, 'm' || p_partkey % 80, p_partkey FROM part) GROUP BY owner, name)"""
_REACH = """r AS (SELECT DISTINCT owner, owner AS part, 0 AS depth, false AS ind FROM (SELECT owner FROM e UNION ALL SELECT part FROM e UNION ALL SELECT owner FROM h)
    UNION ALL SELECT r.owner, e.part, depth + 1, ind OR pointer FROM r JOIN e ON e.owner = r.part),
  q AS (SELECT owner, part, depth, count(*) AS paths, bool_or(ind) AS ind FROM r GROUP BY owner, part, depth QUALIFY depth = min(depth) OVER (PARTITION BY owner, part)),
  w AS (SELECT q.owner, name, depth, sum(paths) AS n, min(signature) AS signature, bool_or(pointer) AS pointer, bool_or(ind) AS ind FROM q JOIN h ON h.owner = q.part GROUP BY q.owner, name, depth QUALIFY depth = min(depth) OVER (PARTITION BY q.owner, name)),
  ms AS MATERIALIZED (SELECT owner, name, signature, NOT pointer OR ind AS value, depth FROM w WHERE n = 1 AND signature IS NOT NULL)"""


def _declarations(spark, d):
    """Types that embed others, some twice or by a pointer, and what each declares; a null signature is a field."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    named = lambda letter, key: F.concat(F.lit(letter), key)
    customer, nation, part = read("customer"), read("nation"), read("part")
    c, n, p = F.col("c_custkey"), F.col("n_nationkey"), F.col("p_partkey")
    embeds = customer.select(named("T", c).alias("owner"), named("N", F.col("c_nationkey")).alias("part"), (c % 2 == 0).alias("pointer"))
    embeds = embeds.union(customer.select(named("T", c), named("G", c % 7), c % 3 == 0)).union(nation.select(named("N", n), named("R", F.col("n_regionkey")), n % 2 == 0))
    embeds = embeds.union(nation.where(n < 7).select(named("G", n), named("R", n % 5), F.lit(False)))
    lines = read("lineitem").where("l_linenumber = 1").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = lines.select(named("T", F.col("o_custkey")).alias("owner"), named("m", F.col("l_partkey") % 40).alias("name"), F.col("l_partkey").alias("k"))
    own = own.union(read("supplier").select(named("N", F.col("s_nationkey")), named("m", F.col("s_suppkey") % 40), "s_suppkey"))
    own = own.union(part.where("p_size < 14").select(named("G", F.col("p_size") % 7), named("m", p % 60), p)).union(part.select(named("R", p % 5), named("m", p % 80), p))
    k = F.min("k")
    signature = F.when(k % 11 > 0, F.concat(F.lit("("), k % 4, F.lit(")")))
    return own.groupBy("owner", "name").agg(signature.alias("signature"), (k % 3 == 0).alias("pointer")), embeds


@query("g14_method_sets", f"WITH RECURSIVE {_METHODS}, {_REACH} SELECT owner, name, signature, value, depth FROM ms")
def g14_sets(spark, d):
    return methods.method_sets(*_declarations(spark, d))


_FACES = """f AS MATERIALIZED (SELECT DISTINCT 'I' || p_partkey // 4 AS owner, 'm' || p_partkey % 80 AS name, '(' || p_partkey % 4 || ')' AS signature FROM part WHERE p_size < 40),
  fe AS MATERIALIZED (SELECT DISTINCT 'I' || p_partkey // 4 AS owner, 'I' || p_partkey // 12 AS part FROM part WHERE p_partkey % 3 = 0 AND p_partkey // 4 <> p_partkey // 12)"""


def _interfaces(spark, d):
    """Interfaces of a few methods, some of which embed another."""
    part = spark.read.parquet(f"{d}/part.parquet")
    face = lambda n: F.concat(F.lit("I"), F.floor(F.col("p_partkey") / n))
    declared = part.where("p_size < 40").select(face(4).alias("owner"), F.concat(F.lit("m"), F.col("p_partkey") % 80).alias("name"), F.concat(F.lit("("), F.col("p_partkey") % 4, F.lit(")")).alias("signature")).distinct()
    return declared, part.where("p_partkey % 3 = 0").select(face(4).alias("owner"), face(12).alias("part")).where("owner <> part").distinct()


@query("g14_structural_implements", f"""WITH RECURSIVE {_METHODS}, {_REACH}, {_FACES},
  fr AS (SELECT DISTINCT owner, owner AS part FROM (SELECT owner FROM f UNION ALL SELECT owner FROM fe) UNION SELECT fr.owner, fe.part FROM fr JOIN fe ON fe.owner = fr.part),
  i AS MATERIALIZED (SELECT DISTINCT fr.owner, name, signature FROM fr JOIN f ON f.owner = fr.part), z AS (SELECT owner, count(*) AS size FROM i GROUP BY owner)
  SELECT ms.owner AS from_fqn, i.owner AS to_fqn FROM ms JOIN i ON i.name = ms.name AND i.signature = ms.signature JOIN z ON z.owner = i.owner GROUP BY ms.owner, i.owner, size HAVING count(*) = size""")  # fmt: skip
def g14_implements(spark, d):
    return methods.implementations(methods.method_sets(*_declarations(spark, d)), methods.interface_sets(*_interfaces(spark, d)))


# Module roots as a table


@query("j09_many_roots", """WITH p AS (SELECT 'a' || o_custkey % 50 || '/b' || o_custkey || '/c/o' || o_orderkey || '.go' AS path, o_custkey AS c FROM orders),
  r AS (SELECT 'a' || c_custkey % 50 || '/b' || c_custkey AS root, 'mod/' || c_custkey AS module FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'a' || c_custkey % 50, 'top/' || c_custkey % 50 FROM customer WHERE c_custkey % 50 < 25)
  SELECT path, coalesce(m.module || '/c', t.module || '/b' || c || '/c', regexp_replace(path, '/[^/]*$', '')) AS package FROM p LEFT JOIN r m ON m.root = 'a' || c % 50 || '/b' || c LEFT JOIN r t ON t.root = 'a' || c % 50""")  # fmt: skip
def j09_many(spark, d):
    """As many roots as a third of the customers, within one another."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    path = F.concat(F.lit("a"), F.col("o_custkey") % 50, F.lit("/b"), "o_custkey", F.lit("/c/o"), "o_orderkey", F.lit(".go"))
    c = F.col("c_custkey")
    inner = read("customer").where(c % 3 == 0).select(F.concat(F.lit("a"), c % 50, F.lit("/b"), c).alias("root"), F.concat(F.lit("mod/"), c).alias("module"))
    outer = read("customer").where(c % 50 < 25).select(F.concat(F.lit("a"), c % 50), F.concat(F.lit("top/"), c % 50))
    return paths.package_paths(read("orders").select(path.alias("path")), inner.union(outer))


for _name, _fqn, _up in (("g06_labelled_ancestors", SUPPLIER, True), ("g06_labelled_descendants", "geo.ASIA", False)):
    QUERIES[_name] = lambda spark, d, f=_fqn, up=_up: graph.relatives(e := load(spark, d, "g_edges"), f, up, labels=labels.ancestors(graph.hierarchy_steps(e, True)))
    ORACLE_SQL[_name] = with_views(_levels(_fqn, *(("from_fqn", "to_fqn", "up") if _up else ("to_fqn", "from_fqn", "down"))), "g_edges", recursive=True)


# Stored counts

_AFTER = "SELECT to_fqn, kind, source FROM g_edges WHERE file <> 'src/o5.php' UNION ALL SELECT 'cat.Part_' || p_partkey, 'references', 'ast' FROM part WHERE p_partkey % 10 = 0"


def _edited(spark, d):
    """Edges before, those of a file that goes, and those of a file that comes."""
    edges = load(spark, d, "g_edges").select("to_fqn", "kind", "source", "file")
    part = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 10 = 0")
    fresh = part.select(F.concat(F.lit("cat.Part_"), "p_partkey").alias("to_fqn"), F.lit("references").alias("kind"), F.lit("ast").alias("source"))
    return edges, edges.where("file = 'src/o5.php'"), fresh


@query("g13_counts_after_run", with_views(f" SELECT to_fqn, count(*) AS n FROM ({_AFTER}) GROUP BY to_fqn", "g_edges"))
def g13_after(spark, d):
    edges, gone, fresh = _edited(spark, d)
    return incremental.folded(graph.reference_counts(edges), gone, fresh, "to_fqn")


@query("a02_counts_after_run", with_views(f" SELECT source, kind, count(*) AS n FROM ({_AFTER}) GROUP BY source, kind", "g_edges"))
def a02_after(spark, d):
    edges, gone, fresh = _edited(spark, d)
    return incremental.folded(edges.groupBy("source", "kind").agg(F.count("*").alias("n")), gone, fresh, "source", "kind")


# Answers of the questions' interface


def _graph(spark, d):
    """The questions over the given tables: edges as they are, and layers counted from them."""
    files, symbols, edges = load(spark, d, "g_files", "g_symbols", "g_edges")
    own = edges.where("source = 'ast'").select(F.col("line").cast("long").alias("file_id"), "from_fqn", "kind", "to_fqn", "resolved", "line")
    g = Graph({"files": files, "symbols": symbols, "edges": own, "ext_edges": edges.where("source <> 'ast'").select("source", "from_fqn", "kind", "to_fqn", "file", "line")})
    g.edges = edges
    return g


@query("l10_status", with_views(""" SELECT 'files' AS what, count(*) AS n FROM g_files UNION ALL SELECT 'symbols', count(*) FROM g_symbols UNION ALL SELECT 'language ' || lang, count(*) FROM g_files WHERE NOT vendor GROUP BY lang
  UNION ALL SELECT 'layer ' || source, count(*) FROM g_edges WHERE source <> 'ast' GROUP BY source""", "g_files", "g_symbols", "g_edges"))  # fmt: skip
def l10(spark, d):
    found = _graph(spark, d).status()
    rows = [("files", found["files"]), ("symbols", found["symbols"]), *((f"language {k}", n) for k, n in found["languages"].items()), *((f"layer {k}", n) for k, n in found["layers"].items())]
    return spark.createDataFrame(rows, "what string, n long")


_LIMITS = {0: 50, -3: 50, 7: 7, 500: 500, 501: 500}


@query("o13_clamped_pages", with_views(" " + " UNION ALL ".join(f"SELECT {asked} AS asked, count(*) AS n FROM ({deduped(f'SELECT * FROM g_edges WHERE to_fqn = {chr(39)}{SUPPLY}{chr(39)} ORDER BY {_PLACE} LIMIT {meant}')})" for asked, meant in _LIMITS.items()), "g_edges"))
def o13(spark, d):
    g = _graph(spark, d)
    return spark.createDataFrame([(asked, len(g.find_references(SUPPLY, asked)["edges"])) for asked in _LIMITS], "asked int, n long")


_MAIN = "crm.Customer_7.main()"


@query("l09_explore", with_views(f""" SELECT 'caller' AS part, from_fqn AS name FROM ({deduped(f"SELECT from_fqn, kind, to_fqn, file, line, resolved, source FROM g_edges WHERE kind = 'calls' AND to_fqn IN (SELECT x || '.main()' FROM (SELECT 'crm.Customer_7' AS x UNION SELECT to_fqn FROM g_edges WHERE from_fqn = 'crm.Customer_7' AND kind IN {_HIER}))")})
  UNION ALL SELECT 'callee', to_fqn FROM ({deduped(f"SELECT * FROM g_edges WHERE from_fqn = '{_MAIN}' AND kind IN ('calls', 'instantiates') ORDER BY resolved DESC, line, file, from_fqn, kind, to_fqn, source LIMIT 15")})
  UNION ALL SELECT 'declaration', fqn FROM g_symbols WHERE fqn = '{_MAIN}' UNION ALL SELECT 'references ' || count(*), '{_MAIN}' FROM g_edges WHERE to_fqn = '{_MAIN}'""", "g_edges", "g_symbols"))  # fmt: skip
def l09(spark, d):
    found = _graph(spark, d).explore(_MAIN, skip_source=True)
    rows = [("caller", e["from_fqn"]) for e in found["callers"]] + [("callee", e["to_fqn"]) for e in found["callees"]] + [("declaration", h["fqn"]) for h in found["declarations"]]
    return spark.createDataFrame([*rows, (f"references {found['references']}", _MAIN)], "part string, name string")

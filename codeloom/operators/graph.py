"""Graph queries over the union of edge layers: edges(from_fqn, kind, to_fqn, file, line, resolved, source)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.predicates import edge_filter, is_test_impact, is_test_referencing
from ..functions.scalars import member_separator, method_split_of
from ..plans.fixpoint import checkpointed, closure
from ..schema import CALL_KINDS, EDGE_COLUMNS, HIERARCHY_KINDS
from .labels import relatives as labelled

EDGE_KEY = ("from_fqn", "kind", "to_fqn", "file", "line")
ANCESTOR_CAP, DESCENDANT_CAP = 200, 2000
#: Names of a frontier, or ids of files, that go to the edges as a list.
FEW = 1000


def all_edges(edges, files, ext_edges, often=None):
    """Edges of source files and of enrichment layers as one; the latter are exact by definition.

    often(file_id): ids that may hold a large share of the edges. If they are few, their files are broadcast and only other files' edges are dealt.
    """
    files = files.select("file_id", F.col("path").alias("file"))
    ids = [] if often is None else [r[0] for r in often.select("file_id").where("file_id IS NOT NULL").distinct().limit(FEW + 1).collect()]
    if ids and len(ids) <= FEW:
        named = F.col("file_id").isin(ids)
        own = edges.where(named).join(F.broadcast(files.where(named)), "file_id").unionByName(edges.where(~named).join(files.where(~named), "file_id"))
    else:
        own = edges.join(files, "file_id")
    return own.withColumn("source", F.lit("ast")).select(*EDGE_COLUMNS).unionByName(ext_edges.withColumn("resolved", F.lit(True)).select(*EDGE_COLUMNS))


def _ordered(*first):
    """first, then every other column, so that ties are settled."""
    return [*first, "from_fqn", "kind", "to_fqn", "source"]


def by_place():
    return _ordered(F.desc("resolved"), "file", "line")


def _dealt(edges, parts, keys):
    return edges.repartition(parts, *keys) if parts else edges


def dedupe(edges, order, parts=None):
    """Of edges equal in all but resolved and source the first in order; in so many parts, if given."""
    edges = _dealt(edges, parts, EDGE_KEY)
    w = Window.partitionBy(*EDGE_KEY).orderBy(*order)
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def once_a_file(edges, parts=None):
    """Edges equal in all but the line once for each file, at the first line; in so many parts, if given."""
    keys = ("file", "from_fqn", "kind", "to_fqn", "resolved")
    return _dealt(edges, parts, keys).groupBy(*keys).agg(F.min("line").alias("line"))


def _page(edges, order, limit):
    """Limit, then dedupe: a page can be short."""
    return dedupe(edges.orderBy(*order).limit(limit), order).orderBy(*order).select(*EDGE_COLUMNS)


def references(edges, fqn, limit=50, path_prefix="", exclude_tests=False):
    """Edges of any kind into a symbol."""
    return _page(edge_filter(edges.where(F.col("to_fqn") == fqn), path_prefix, exclude_tests), by_place(), limit)


def callees(edges, fqn, limit=50):
    """Calls and instantiations out of a symbol."""
    found = edges.where((F.col("from_fqn") == fqn) & F.col("kind").isin(*CALL_KINDS))
    return _page(found, _ordered(F.desc("resolved"), "line", "file"), limit)


def hierarchy_steps(edges, up):
    """src, dst, kind of one step to ancestors or to descendants."""
    src, dst = ("from_fqn", "to_fqn") if up else ("to_fqn", "from_fqn")
    return edges.where(F.col("kind").isin(*HIERARCHY_KINDS)).select(F.col(src).alias("src"), F.col(dst).alias("dst"), "kind").distinct()


def relatives(edges, fqn, up, cap=None, labels=None):
    """node, kind, depth of ancestors or descendants; kind is the linking one. With labels, the table of all ancestors, that is a filter; else a walk."""
    cap = cap or (ANCESTOR_CAP if up else DESCENDANT_CAP)
    if labels is not None:
        return labelled(labels, fqn, up, cap)
    start = edges.sparkSession.range(1).select(F.lit(fqn).alias("node"))
    return closure(hierarchy_steps(edges, up), start, cap)


def family(edges, fqn, labels=None):
    """node: the class, its ancestors and its descendants; no siblings."""
    own = edges.sparkSession.range(1).select(F.lit(fqn).alias("node"))
    return own.unionByName(relatives(edges, fqn, True, labels=labels).select("node")).unionByName(relatives(edges, fqn, False, labels=labels).select("node")).distinct()


def hierarchy(edges, fqn, labels=None):
    """direction, fqn, kind of ancestors and descendants, in order."""
    up = relatives(edges, fqn, True, labels=labels).select(F.lit("ancestor").alias("direction"), F.col("node").alias("fqn"), "kind")
    down = relatives(edges, fqn, False, labels=labels).select(F.lit("descendant").alias("direction"), F.col("node").alias("fqn"), "kind")
    return up.unionByName(down).orderBy("direction", "fqn")


def outline_relations(symbols, edges):
    """fqn, relations: every class with the kinds and names of what it extends, implements or uses, sorted, as an outline tells them."""
    relations = hierarchy_steps(edges, True).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", "dst"))), ", ").alias("relations"))
    classes = symbols.where("kind = 'class'").select("fqn").distinct()
    return classes.join(relations, F.col("fqn") == F.col("src"), "left").select("fqn", F.coalesce("relations", F.lit("")).alias("relations"))


def callers(edges, fqn, limit=50, path_prefix="", exclude_tests=False, labels=None):
    """Calls into a callable. For a member also calls recorded on relatives of its class, marked unresolved."""
    split = method_split_of(fqn)
    if split is None:
        found = edges.where((F.col("to_fqn") == fqn) & F.col("kind").isin(*CALL_KINDS))
        return _page(edge_filter(found, path_prefix, exclude_tests), by_place(), limit)
    owner, member = split
    targets = family(edges, owner, labels).select(F.concat("node", F.lit(member_separator(fqn) + member)).alias("to_fqn"))
    found = edge_filter(edges.where(F.col("kind") == "calls"), path_prefix, exclude_tests).join(targets, "to_fqn", "left_semi")
    found = found.withColumn("resolved", F.col("resolved") & (F.col("to_fqn") == fqn))
    order = [F.desc(F.col("to_fqn") == fqn), *by_place()]
    return dedupe(found, order).orderBy(*order).limit(limit).select(*EDGE_COLUMNS)


def reference_count(edges, fqn):
    return edges.where(F.col("to_fqn") == fqn).agg(F.count("*").alias("n"))


def reference_counts(edges):
    """to_fqn, n: how often each symbol is referred to."""
    return edges.groupBy("to_fqn").agg(F.count("*").alias("n"))


def tests_referencing(edges, fqns, limit=20):
    """file: test files with any edge into one of the symbols."""
    found = edges.where(F.col("to_fqn").isin(*fqns) & is_test_referencing(F.col("file")))
    return found.select("file").distinct().orderBy("file").limit(limit)


def impact(edges, fqn, depth=3, per_level=25, hold=True):
    """(callers(depth, fqn, file, line), tests(file), whether a level was cut).

    Walks call edges backwards level by level. Callers in test files are listed by file and not walked on. A level keeps
    its first per_level callers by name; the others count as met and aren't walked on either. None keeps all.

    A frontier of at most FEW names is pushed down to the edges as a list, which a store sorted by target answers from the row groups that hold
    them, and no edge is shuffled but those found; a larger one is joined. hold keeps the calls for the next level, for edges that are dear to make anew.
    """
    spark = edges.sparkSession
    calls = edges.where(F.col("kind").isin(*CALL_KINDS) & (F.col("from_fqn") != "")).select("from_fqn", "to_fqn", "file", "line")
    calls = calls.persist() if hold else calls
    seen, names = spark.createDataFrame([(fqn,)], "node string"), [fqn]
    levels, tests, cut = [], [], False
    frontier = seen
    for level in range(1, depth + 1):
        into = calls.where(F.col("to_fqn").isin(*names)) if names is not None else calls.join(frontier.select(F.col("node").alias("to_fqn")), "to_fqn", "left_semi")
        # one written table a level: a node's first place outside tests, and the test files that call into the level
        found = into.withColumn("test", is_test_impact(F.col("file"))).groupBy(F.col("from_fqn").alias("node"))
        found = found.agg(F.min(F.when(~F.col("test"), F.struct("file", "line"))).alias("at"), F.collect_set(F.when(F.col("test"), F.col("file"))).alias("tests"))
        met = checkpointed(found.join(seen.withColumn("old", F.lit(True)), "node", "left"))
        tests.append(met.select(F.explode("tests").alias("file")))
        new = met.where("at IS NOT NULL AND old IS NULL").select("node", "at")
        n = new.count()
        if not n:
            break
        cut |= per_level is not None and n > per_level
        frontier = new if per_level is None else new.orderBy("node").limit(per_level)
        few = n if per_level is None else min(n, per_level)
        names = [r["node"] for r in frontier.select("node").collect()] if few <= FEW else None
        seen = seen.unionByName(new.select("node"))
        levels.append(frontier.select(F.lit(level).alias("depth"), F.col("node").alias("fqn"), F.col("at.file").alias("file"), F.col("at.line").alias("line")))
    if hold:
        calls.unpersist()
    empty = spark.createDataFrame([], "depth int, fqn string, file string, line int")
    out = empty
    for part in levels:
        out = out.unionByName(part)
    files = spark.createDataFrame([], "file string")
    for part in tests:
        files = files.unionByName(part)
    return out.orderBy("depth", "fqn"), files.distinct().orderBy("file"), cut


def affected_tests(edges, fqn, called_from, limit=20):
    """(file, note) for an impact answer: the test files that call into it, or else those that refer to the symbol or its class."""
    if called_from.limit(1).count():
        return called_from, ""
    split = method_split_of(fqn)
    found = tests_referencing(edges, [fqn, *([split[0]] if split else [])], limit)
    return found, "no call comes from a test; these tests refer to the symbol or its class"

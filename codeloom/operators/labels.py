"""Ancestors of all classes as a table, kept up by what changes; families, widening and call resolution are joins with it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed

#: depth is the least number of steps up; of the ways that long, first is the least kind of the first step and last that of the last.
LABEL = ("node", "ancestor", "depth", "first", "last")
#: Steps up that the table holds, a power of two. What lies beyond is met by as many hops of that many steps as it takes, so the table grows with
#: the number of classes and not with the square of a long chain.
REACH = 32


def _steps(steps):
    return steps.select("src", "dst", "kind").distinct()


def _least(rows):
    """Of rows of LABEL one for each pair: its least depth, and the least kinds at that depth."""
    both = rows.groupBy("node", "ancestor").agg(F.min(F.struct("depth", "first")).alias("f"), F.min(F.struct("depth", "last")).alias("l"))
    return both.select("node", "ancestor", "f.depth", "f.first", "l.last")


def _joined(lower, upper):
    """Ways that go on from the ends of lower by those of upper."""
    above = upper.select(F.col("node").alias("at"), F.col("ancestor").alias("top"), F.col("depth").alias("more"), F.col("last").alias("end"))
    found = lower.select("node", F.col("ancestor").alias("at"), "depth", "first").join(above, "at")
    return _least(found.select("node", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"), "first", F.col("end").alias("last")))


def _doubled(steps, clean=None):
    """LABEL of the classes that steps start from. Each round doubles the depth up to which all is known; clean has the labels of other classes."""
    known = checkpointed(_least(steps.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), F.lit(1).alias("depth"), F.col("kind").alias("first"), F.col("kind").alias("last"))))
    depth = 1
    while depth < REACH:
        upper = known if clean is None else known.unionByName(clean.where(F.col("depth") <= depth))
        found = checkpointed(_joined(known.where(F.col("depth") == depth), upper).join(known, ["node", "ancestor"], "left_anti").select(*LABEL))
        if found.isEmpty():
            break
        known, depth = known.unionByName(found), 2 * depth
    return known


def ancestors(steps):
    """LABEL: every class with every ancestor up to REACH steps over steps(src, dst, kind).

    Pairs that are known end the search, so cycles do; a class is not its own ancestor but through a cycle.
    """
    return _doubled(_steps(steps))


def changed(labels, before, after):
    """(the labels after the steps change from before to after, the classes that were labelled anew).

    Only classes that have a changed step, or such an ancestor, can have other labels. Theirs are made anew, and what lies above a
    class that no change reaches is read from its labels. The others' stay as they are.
    """
    before, after = _steps(before), _steps(after)
    touched = checkpointed(before.exceptAll(after).unionAll(after.exceptAll(before)).select(F.col("src").alias("node")).distinct())
    if touched.isEmpty():
        return labels, touched
    below = labels.join(touched.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").select("node")
    dirty = checkpointed(touched.unionAll(below).distinct())
    clean = labels.join(dirty, "node", "left_anti").select(*LABEL)
    fresh = _doubled(after.join(dirty.withColumnRenamed("node", "src"), "src", "left_semi"), clean)
    return checkpointed(clean.unionByName(fresh)), dirty


def complete(labels, of=None):
    """LABEL with all ancestors, however far, of all classes or of those of(node) names: hops of REACH steps until one finds nothing."""
    seen = labels if of is None else labels.join(of.select("node").distinct(), "node", "left_semi")
    seen = frontier = seen.select(*LABEL)
    far = REACH
    while True:
        frontier = frontier.where(F.col("depth") == far)
        if frontier.isEmpty():
            return seen
        frontier = checkpointed(_joined(frontier, labels).join(seen, ["node", "ancestor"], "left_anti").select(*LABEL))
        seen, far = seen.unionByName(frontier), far + REACH


def relatives(labels, fqn, up, cap=None):
    """node, kind, depth of a class's ancestors or descendants by a filter of the labels; kind is the linking one, the least of several.

    Depths are taken whole, until cap are met.
    """
    own, other, kind = ("node", "ancestor", "last") if up else ("ancestor", "node", "first")
    turned = labels.select(F.col(own).alias("start"), F.col(other).alias("node"), F.col(kind).alias("kind"), "depth")
    seen = frontier = turned.where(F.col("start") == fqn).select("node", "kind", "depth")
    far = REACH
    while True:
        frontier = frontier.where(F.col("depth") == far)
        if frontier.isEmpty() or (cap is not None and seen.where(F.col("node") != fqn).limit(cap).count() >= cap):
            break
        found = turned.join(frontier.select(F.col("node").alias("start")), "start").groupBy("node").agg(F.min(F.struct((F.col("depth") + far).alias("depth"), "kind")).alias("s"))
        frontier = checkpointed(found.join(seen, "node", "left_anti").select("node", "s.kind", "s.depth"))
        seen, far = seen.unionByName(frontier), far + REACH
    found = seen.where(F.col("node") != fqn)
    if cap is None:
        return found
    nearer = found.groupBy("depth").agg(F.count("*").alias("n"))
    nearer = nearer.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each depth
    return found.join(nearer.where(F.col("before") < cap).select("depth"), "depth", "left_semi").select("node", "kind", "depth")


def families(labels):
    """node, relative: every class that has relatives, with itself, its ancestors and its descendants."""
    labels = complete(labels)
    pairs = labels.select("node", F.col("ancestor").alias("relative"))
    back = labels.select(F.col("ancestor").alias("node"), F.col("node").alias("relative"))
    both = pairs.unionAll(back)
    return both.unionAll(both.select("node", F.col("node").alias("relative"))).distinct()


def resolved_calls(calls, labels, declared):
    """calls with target: the full name of the member that a call means, declared by the class it names or by its nearest ancestor; null if none does.

    calls has owner, member and separator beside its own columns; declared is owner, member. Of ancestors equally near the one that
    comes first by name counts. Only distinct pairs of class and member are looked up, so a member called everywhere is one pair.
    """
    asked = calls.select("owner", "member").distinct()
    own = asked.select("owner", "member", F.col("owner").alias("at"), F.lit(0).alias("depth"))
    above = asked.join(complete(labels, asked.select(F.col("owner").alias("node"))).select(F.col("node").alias("owner"), F.col("ancestor").alias("at"), "depth"), "owner").select("owner", "member", "at", "depth")
    known = declared.select(F.col("owner").alias("at"), "member").distinct()
    nearest = own.unionByName(above).join(known, ["at", "member"]).groupBy("owner", "member").agg(F.min(F.struct("depth", "at")).alias("n"))
    found = calls.join(nearest, ["owner", "member"], "left")
    return found.withColumn("target", F.concat("n.at", "separator", "member")).drop("n")

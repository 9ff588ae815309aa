"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import forget, scratch


def components(spark, edges):
    """(node, root) for each node of edges(a, b); root is the smallest node of its component.

    Every round is joins and min-aggregates with map-side combine, so a hub with any share of the
    edges is pre-aggregated and its join is left to the skew join. Nothing is collected but a count
    and a checksum. Null ends and loops are dropped; no edges give no rows.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch(spark, e, "cc")
    state = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch(spark, small, "cc")
        forget(spark, e)
        now = state(after)
        e = after
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

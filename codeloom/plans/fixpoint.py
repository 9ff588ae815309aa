"""Breadth-first fixpoints: a driver loop of joins, each round written down so that lineage stays short."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import functions as F


def checkpointed(df):
    """df cut from its lineage, in the folder the cluster names in spark.checkpoint.dir; a local one only where the master is local."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^]-]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or "file://" + os.path.join(tempfile.gettempdir(), "codeloom-checkpoints"))
    return df.checkpoint()


def closure(steps, start, cap=None, max_rounds=None):
    """node, kind, depth of what is reached from start(node) over steps(src, dst, kind); start itself is left out.

    A node keeps the round it is first met in, and of several kinds in that round the least. The walk ends with
    an empty round, after max_rounds, or once cap nodes are met; the cap is looked at between rounds, so the last
    one may go beyond it. Rounds are equi-joins on the frontier: Spark broadcasts a small one by its measured size
    and shuffles a large one.
    """
    seen = checkpointed(start.select("node", F.lit(None).cast("string").alias("kind"), F.lit(0).alias("depth")).distinct())
    frontier, depth, met = seen, 0, 0
    steps = steps.persist()  # every round joins them; what a round finds is written down, so they can go in the end
    while (max_rounds is None or depth < max_rounds) and (cap is None or met < cap):
        depth += 1
        found = steps.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("kind").alias("kind"))
        frontier = checkpointed(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        n = frontier.count()
        if not n:
            break
        met += n
        seen = seen.unionByName(frontier)
    steps.unpersist()
    return seen.where("depth > 0")

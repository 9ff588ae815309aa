"""Incremental maintenance by snapshots: compare, re-extract what changed, carry the rest over."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Tables that hang on a file.
OWNED = ("symbols", "imports", "edges", "postings", "lengths", "trigrams")


def diff(known, current, force=False):
    """path, status of every file of either side: new, changed, touched, unchanged, removed.

    known and current have path, size, mtime_ns, hash; equal size and mtime pass for unchanged without
    looking at the hash (force looks at none and calls it changed).
    """
    k = known.select(F.col("path"), *[F.col(c).alias(f"k_{c}") for c in ("size", "mtime_ns", "hash")], F.lit(True).alias("known"))
    c = current.dropDuplicates(["path"]).select("path", "size", "mtime_ns", "hash", F.lit(True).alias("here"))
    same_stat = (F.col("size") == F.col("k_size")) & (F.col("mtime_ns") == F.col("k_mtime_ns"))
    status = F.when(F.col("here").isNull(), "removed").when(F.col("known").isNull(), "new")
    if force:
        status = status.otherwise("changed")
    else:
        status = status.when(same_stat, "unchanged").when(F.col("hash") == F.col("k_hash"), "touched").otherwise("changed")
    return k.join(c, "path", "full_outer").select("path", status.alias("status"))


def run_statistics(statuses):
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def next_snapshot(tables, statuses, current, fresh):
    """The tables after a run: rows of removed and changed files go, fresh ones come, touched files get their new stat.

    tables and fresh are dicts of DataFrames with file_id; current has path, size, mtime_ns. Rows of unchanged
    files are carried over as they are. Nothing is updated in place: write the result to a new folder.
    """
    gone = statuses.where(F.col("status").isin("removed", "changed")).select("path")
    files = tables["files"].join(gone, "path", "left_anti")
    touched = statuses.where("status = 'touched'").join(current.select("path", F.col("size").alias("n_size"), F.col("mtime_ns").alias("n_mtime")), "path").select("path", "n_size", "n_mtime")
    files = files.join(touched, "path", "left").withColumns({"size": F.coalesce("n_size", "size"), "mtime_ns": F.coalesce("n_mtime", "mtime_ns")}).drop("n_size", "n_mtime")
    dropped = tables["files"].join(gone, "path", "left_semi").select("file_id")
    out = {"files": files.select(*tables["files"].columns).unionByName(fresh["files"])}
    for name in OWNED:
        out[name] = tables[name].join(dropped, "file_id", "left_anti").unionByName(fresh[name])
    return out


def file_id(path):
    """An id that needs no counter."""
    return F.xxhash64(path)


def upsert_meta(meta, updates):
    """Key-value rows, the updates winning."""
    return meta.join(updates, "key", "left_anti").unionByName(updates)


def folded(counts, gone, fresh, *keys):
    """Stored counts(*keys, n) after a run: rows that went count down and those that came count up; what is left with none goes.

    Rows gone and fresh are those of the run's files only, so no other row is counted anew.
    """
    signed = gone.select(*keys, F.lit(-1).cast("long").alias("n")).unionAll(fresh.select(*keys, F.lit(1).cast("long").alias("n")))
    return counts.select(*keys, "n").unionAll(signed).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")

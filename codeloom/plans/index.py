"""An index run: tree to tables, all of it or only what changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract.run import extract, tables
from ..operators import enrich, fts, graph, incremental, labels, trigrams
from ..schema import TABLES
from ..sources import layers, tree
from ..sources.store import Superseded, bucket_of
from .fixpoint import checkpointed

#: Times a run begins anew because another one was faster.
TRIES = 5


def run(store, root, settings=None, force=False):
    """Bring a store up to date with a tree; counts of files by status.

    Sizes and times are compared first; only files that differ there are read and hashed, and only
    those whose hash differs are parsed. The rest of the tables is carried over. The new snapshot becomes current when whole; if
    another run's became current meanwhile, this one compares anew.
    """
    for _ in range(TRIES):
        try:
            return _run(store, root, settings or tree.config(), force)
        except Superseded as e:
            lost = e
    raise lost


def _run(store, root, settings, force):
    spark = store.spark
    since = (store.pointers() or [0])[-1]
    files = tree.walk(spark, root, settings)
    found = files.where("NOT module").drop("module")
    before = store.read("files")
    if not force:
        out = _differences(found, before)
        if not set(out) - {"unchanged"}:
            return out
    stat = found.select("path", "size", "mtime_ns")
    same = before.select("path", "size", "mtime_ns", F.col("hash").alias("known_hash"))
    unread = stat.join(same, ["path", "size", "mtime_ns"]) if not force else stat.limit(0).withColumn("known_hash", F.lit(""))
    read = checkpointed(tree.hashed(found.join(unread, "path", "left_anti")))
    current = unread.select("path", "size", "mtime_ns", F.col("known_hash").alias("hash")).unionByName(read.select("path", "size", "mtime_ns", "hash"))
    statuses = checkpointed(incremental.diff(before, current, force))
    out = {r["status"]: r["n"] for r in incremental.run_statistics(statuses).collect()}
    if set(out) - {"unchanged"}:
        fold(store, statuses, current, read.join(statuses.where("status IN ('new', 'changed')"), "path", "left_semi"), tree.modules(files), since)
    return out


def _differences(found, before):
    """Files by whether they stand as known, in one pass of counts; enough to end a run that finds none else."""
    sides = found.select("path", "size", "mtime_ns", F.lit(1).alias("n")).unionAll(before.select("path", "size", "mtime_ns", F.lit(2).alias("n")))
    counts = sides.groupBy("path", "size", "mtime_ns").agg(F.sum("n").alias("n")).groupBy((F.col("n") == 3).alias("same")).count()
    return {"unchanged" if r["same"] else "differing": r["count"] for r in counts.collect()}


def fold(store, statuses, current, fresh, modules=None, since=None):
    """Fold what differs into a store: statuses(path, status), current(path, size, mtime_ns), and the new and changed files as fresh(path, content, hash, ...).

    Only the buckets of files that differ are read and written; the others go over to the new snapshot as they are.
    """
    ids = statuses.where("status <> 'unchanged'").select(bucket_of(incremental.file_id(F.col("path"))).alias("b")).distinct()
    buckets = {r["b"] for r in ids.collect()}
    known = store.tables(buckets)
    index = extract(fresh, modules).cache()
    symbols, imports, edges = tables(index)
    files = fresh.join(index.select("path", "lang", "has_errors"), "path").select(
        incremental.file_id(F.col("path")).alias("file_id"), "path", "lang", "hash", "size", "mtime_ns", "vendor", "has_errors", F.unix_timestamp(F.current_timestamp()).alias("indexed_at")
    )
    own = fresh.where("NOT vendor").select(incremental.file_id(F.col("path")).alias("file_id"), F.col("content").cast("string").alias("content"))
    rows = {"files": files, "symbols": symbols, "imports": imports, "edges": edges, "postings": fts.stored(symbols), "lengths": fts.lengths(symbols), "trigrams": trigrams.postings(own, ("file_id",))}
    rows = {k: v.select(*[f.name for f in known[k].schema]) for k, v in rows.items()}
    after = incremental.next_snapshot(known, statuses, current, rows)
    others = store.read("edges").where(~bucket_of(F.col("file_id")).isin(*buckets))
    edges = others.unionByName(after["edges"])
    store.write(after | {"ancestors": lambda: _labels(store, edges, known["ext_edges"])}, buckets, since)
    index.unpersist()


def _labels(store, edges, ext_edges):
    """The table of ancestors for these edges and layers: the stored one, changed where they differ from the stored edges."""
    both = lambda own, layers: graph.hierarchy_steps(own.select("from_fqn", "kind", "to_fqn").unionAll(layers.select("from_fqn", "kind", "to_fqn")), True)
    after = checkpointed(both(edges, ext_edges))
    if not store.pointers():
        return labels.ancestors(after)
    return labels.changed(store.read("ancestors"), both(store.read("edges"), store.read("ext_edges")), after)[0]


def import_layers(store, root, folder):
    """Re-import the enrichment layers of a folder: a layer whose file is gone goes, the others are replaced. Layers imported into an empty index aren't noted, so they are tried again."""
    spark = store.spark
    known = store.tables()
    found = layers.discover(spark, folder).collect()
    noted = {r["key"]: r["value"] for r in known["meta"].where("key LIKE 'enrich_mtime:%'").collect()}
    ext = enrich.keep_sources(known["ext_edges"], [r["source"] for r in found])
    meta = known["meta"].where("key NOT LIKE 'enrich_mtime:%'")
    empty = not known["files"].limit(1).count()
    updates = []
    for r in found:
        stamp = str(r["mtime"])
        if noted.get(f"enrich_mtime:{r['source']}") != stamp:
            rows = enrich.import_edges(layers.read_layer(spark, r["path"]), known["files"].select("path"), root, r["source"])
            ext = enrich.replace_source(ext, r["source"], rows)
        if not empty:
            updates.append((f"enrich_mtime:{r['source']}", stamp))
    if updates:
        meta = incremental.upsert_meta(meta, spark.createDataFrame(updates, TABLES["meta"]))
    store.write({"ext_edges": ext, "meta": meta, "ancestors": _labels(store, known["edges"], ext)})
    return [r["source"] for r in found]

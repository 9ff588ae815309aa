"""Continuous refresh: changed files are folded into the tables, whichever order and batches they come in."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.index import fold

#: What is known of a path: the time and hash of the newest row so far; a removed file has the empty hash.
STATE = "mtime_ns long, hash string"
NEWEST = "path string, content string, vendor boolean, size long, mtime_ns long, hash string, status string"


def newest(key, batches, state):
    """The row of a path that supersedes what is known of it, if one does; equal content at a later time is touched, and null content removed.

    Rows are in order of time, of equal times a removal first and then by hash, so that any order of arrival ends with the same.
    """
    known = state.get if state.exists else None
    best = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            text = row.content if isinstance(row.content, str) else None
            found = (int(row.mtime_ns), "" if text is None else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
            if best is None or found > best[0]:
                best = (found, row, text)
    if best is None or (known is not None and best[0] <= tuple(known)):
        return
    (mtime, digest), row, text = best
    state.update((mtime, digest))
    was = known[1] if known is not None else ""
    if not digest and not was:
        return
    status = "removed" if not digest else "touched" if digest == was else "changed"
    content = text if status == "changed" else None
    yield pd.DataFrame({"path": [key[0]], "content": [content], "vendor": [bool(row.vendor)], "size": [int(row.size)], "mtime_ns": [mtime], "hash": [digest], "status": [status]})


def superseding(stream):
    """Of stream(path, content, vendor, size, mtime_ns) the rows that change something, by a state of a time and a hash for each path."""
    rows = stream.select("path", "content", F.coalesce("vendor", F.lit(False)).alias("vendor"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("mtime_ns", F.lit(0)).cast("long").alias("mtime_ns"))
    return rows.where("path IS NOT NULL").groupBy("path").applyInPandasWithState(newest, NEWEST, STATE, "update", GroupStateTimeout.NoTimeout)


def refresh(stream, store, checkpoint, modules=None, once=False):
    """Start a query that folds stream(path, content, vendor, size, mtime_ns) into a store, a batch at a time.

    Of each path the latest row counts, also if an older one comes in a later batch; null content removes the file, and an older
    row doesn't bring it back. Equal content isn't written anew. A batch that is tried again after a failure replaces the same
    rows, so it changes nothing twice.
    """

    def take(batch, _):
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                fold(store, batch.select("path", "status"), batch, batch.where("status = 'changed'"), modules)
        finally:
            batch.unpersist()

    writer = superseding(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""What the operators share: reading, Arrow text batches, scratch tables, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa

#: Text bytes that a vectorised step handles at once (some 60 bytes of arrays each); a longer document is a piece of its own.
PIECE_BYTES = 1 << 19


def table(spark, sf_dir, name):
    """A table of the data set, by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark):
    """Arrow batches of bounded size for the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark):
    """The cluster's shared folder; a local one is made only where none is configured and the master is local."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]-]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'codeloom-checkpoints')}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def scratch(spark, df, name):
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark, *paths):
    """Delete scratch tables that nothing will read again."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in paths:
        for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)


#: What a Python worker keeps between tasks, to be cleared when it turns to another operator.
_kept: list = []
_owner = [""]


def trim():
    """Freed memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def turn_to(operator):
    """Called by each operator's tasks: a reused worker lets go of what it kept for another operator."""
    if _owner[0] != operator:
        _owner[0] = operator
        for tables in _kept:
            tables.clear()
        trim()


def worker(operator):
    """A decorator for what mapInArrow runs: turns to the operator, and hands memory back when the task ends, so that an idle worker holds little."""

    def around(run):
        @functools.wraps(run)
        def task(batches):
            turn_to(operator)
            try:
                yield from run(batches)
            finally:
                trim()

        return task

    return around


def utf8(column):
    """(bytes as uint8 array, offsets of n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch, name, limit=PIECE_BYTES):
    """Slices of a batch with at most limit bytes of text each, or one row."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def lower_ascii(data):
    """A-Z lowered, byte by byte."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
WORD_INVERSE = pow(WORD_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_kept.append(_powers)


def powers(base, n):
    """base ** i modulo 2 ** 64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x):
    """A bijection that spreads the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def word_spans(data, offsets, member):
    """Starts, ends and document of maximal runs of bytes for which member[byte]; runs don't cross documents."""
    inside = member[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, doc


def word_hashes(data, starts, ends):
    """A 64-bit hash of each word's bytes, wherever it stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts])


def window_hashes(words, k):
    """A hash of each run of k consecutive word hashes; entry i is of words i .. i + k - 1."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(WORD_BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(WORD_INVERSE, n + 1)[: n - k + 1] + np.uint64(k))


def carried(docs):
    """docs with every column under a name of ours beside its text, the names, and how to get the columns back.

    So a filter can add columns whatever the table's own are called.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    at = docs.columns.index("text")
    renamed = renamed.withColumn("text", renamed[names[at]])
    own = docs.columns
    return renamed, names, lambda df: df.select(*[df[n].alias(c) for n, c in zip(names, own, strict=True)])

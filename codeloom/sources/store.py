"""Snapshots of the graph's tables as Parquet, in buckets of files: a run writes the buckets it touches and names the others anew."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..schema import TABLES

COLUMNS = {name: [c.split()[0] for c in columns.split(",")] for name, columns in TABLES.items()}

#: Buckets of the tables that hang on a file, by its id.
BUCKETS = 64
#: Seconds after which a folder that no kept snapshot uses is taken for left over; younger ones may be another writer's.
LEFT_OVER = 3600
#: What a bucket's rows are sorted by, so that readers skip row groups.
ORDER = {"edges": "to_fqn", "ext_edges": "to_fqn", "symbols": "name", "postings": "token", "lengths": "file_id", "ancestors": "ancestor", "trigrams": "gram", "files": "path", "imports": "alias", "meta": "key"}


def bucket_of(file_id):
    return F.pmod(file_id, F.lit(BUCKETS)).cast("int")


class Superseded(RuntimeError):
    """Another writer made a snapshot current since this one was begun."""


class Store:
    """A folder of snapshots; of the numbered pointers AT-1, AT-2 .. the highest names the one that readers see. A failed write leaves the last one current.

    A snapshot's manifest says for each table in which folder each bucket lies, so unchanged buckets are shared by
    snapshots. Tables without a file (layers, meta) are one bucket. A snapshot of an older layout counts as none.
    """

    def __init__(self, spark, root):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def pointers(self):
        """The numbers of the pointers, rising."""
        path = self.fs_path(self.root)
        names = [f.getPath().getName() for f in self.fs.listStatus(path)] if self.fs.exists(path) else []
        return sorted(int(n[3:]) for n in names if n.startswith("AT-") and n[3:].isdigit())

    def current(self):
        found = self.pointers()
        return self.text(f"AT-{found[-1]}") if found else None

    def text(self, path):
        """A small file's text."""
        stream = self.fs.open(self.fs_path(f"{self.root}/{path}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def manifest(self, name):
        """{table: {bucket: folder}} of a snapshot; nothing of none."""
        found = {} if name is None else json.loads(self.text(f"{name}/MANIFEST"))
        return found if set(found) >= set(TABLES) else {t: {} for t in TABLES}

    def read(self, name, buckets=None):
        """A table of the current snapshot, all of it or some buckets."""
        return self._read(self.manifest(self.current()), name, buckets)

    def _read(self, manifest, name, buckets=None):
        found = manifest[name]
        paths = [f"{self.root}/{at}" for b, at in sorted(found.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def tables(self, buckets=None):
        """All tables; those that hang on a file of some buckets only, if these are named."""
        manifest = self.manifest(self.current())
        return {name: self._read(manifest, name, buckets if "file_id" in TABLES[name] else None) for name in TABLES}

    def write(self, tables, buckets=None, since=None):
        """A new snapshot from tables by name; those left out stay as they are. If buckets are named, the rows given are those of these buckets, and the others stay.

        A table may be given as a function that makes it, which then runs beside the writing of the others.
        since is the number of the pointer that the rows were made from, the last one if left out; if another has been set by then, nothing changes and Superseded is raised.
        """
        last = (self.pointers() or [0])[-1] if since is None else since
        before = self.text(f"AT-{last}") if last else None
        manifest, name = self.manifest(before), f"s-{uuid.uuid4().hex}"

        def put(table):
            """Write one table; the folders of its buckets."""
            df, owned, at = tables[table], "file_id" in TABLES[table], f"{name}/{table}"
            df = df() if callable(df) else df
            df = df.select(*COLUMNS[table]).withColumn("bucket", bucket_of(F.col("file_id")) if owned else F.lit(0))
            if owned:
                df = df.repartition("bucket")  # without a number, so small buckets are gathered in few tasks
            df.sortWithinPartitions("bucket", ORDER[table]).write.partitionBy("bucket").parquet(f"{self.root}/{at}")
            kept = {b: p for b, p in manifest[table].items() if owned and buckets is not None and int(b) not in buckets}
            new = [f.getPath().getName() for f in self.fs.listStatus(self.fs_path(f"{self.root}/{at}"))]
            return kept | {n.removeprefix("bucket="): f"{at}/{n}" for n in new if n.startswith("bucket=")}

        with ThreadPoolExecutor(len(tables)) as pool:  # tables don't wait for one another
            manifest |= dict(zip(tables, pool.map(inheritable_thread_target(self.spark)(put), tables), strict=True))
        self.put(f"{name}/MANIFEST", json.dumps(manifest))
        self.point(name, last + 1)
        self.sweep({name, before}, last)
        return name

    def put(self, path, text):
        out = self.fs.create(self.fs_path(f"{self.root}/{path}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    def drop(self):
        """Delete the store with all its snapshots."""
        self.fs.delete(self.fs_path(self.root), True)

    def point(self, name, number):
        """Make a snapshot current: its name is written aside and moved to the next pointer, which fails if that exists. So of two writers one wins, and readers see either."""
        self.put(f"NEXT-{name}", name)
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        none = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs_path(f"{self.root}/NEXT-{name}"), self.fs_path(f"{self.root}/AT-{number}"), none)
        except Py4JJavaError:
            if not self.fs.exists(self.fs_path(f"{self.root}/AT-{number}")):
                raise
            for left in (f"NEXT-{name}", name):
                self.fs.delete(self.fs_path(f"{self.root}/{left}"), True)
            raise Superseded(f"another run made {self.current()} current") from None

    def sweep(self, kept, last=0):
        """Delete pointers before the last, and folders that neither the current snapshot nor the one before uses, which readers may still be at, and that have been left for long."""
        used = {name for name in kept if name}
        for name in list(used):
            used |= {at.split("/")[0] for found in self.manifest(name).values() for at in found.values()}
        for number in self.pointers():
            if number < last:
                self.fs.delete(self.fs_path(f"{self.root}/AT-{number}"), False)
        for found in self.fs.listStatus(self.fs_path(self.root)):
            own = found.getPath().getName()
            if own.startswith("s-") and own not in used and found.getModificationTime() / 1000 < time.time() - LEFT_OVER:
                self.fs.delete(found.getPath(), True)

"""Enrichment files: JSON lines with one edge each, one file a layer."""

from __future__ import annotations

from pyspark.sql import functions as F

EDGE = "`from` string, kind string, `to` string, file string, line int"
LONGEST = 1 << 20
NAME = r"enrich\.([^/]*)\.jsonl$"


def read_layer(spark, path):
    """n, from, kind, to, file, line in input order; a bad line, or one of more than LONGEST bytes, is an error, blank ones are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select(F.when(F.octet_length("value") > LONGEST, F.raise_error(F.lit(f"a line of more than {LONGEST} bytes"))).otherwise(F.col("value")).alias("value"))
    rows = lines.select(F.monotonically_increasing_id().alias("n"), F.from_json("value", EDGE, {"mode": "FAILFAST"}).alias("e"))
    return rows.select("n", "e.*")


def discover(spark, folder):
    """source, path, mtime of the layers in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "enrich.*.jsonl").load(folder)
    return found.select(F.regexp_extract("path", NAME, 1).alias("source"), "path", F.col("modificationTime").alias("mtime"))


def write_layer(edges, path):
    """The edges as one layer file of JSON lines; the format is one file, so one task writes it."""
    spark, parts = edges.sparkSession, f"{path}.parts"
    edges.select(F.col("from_fqn").alias("from"), "kind", F.col("to_fqn").alias("to"), "file", "line").coalesce(1).write.mode("overwrite").json(parts)
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(where(path), True)
    written = [f.getPath() for f in fs.listStatus(where(parts)) if f.getPath().getName().startswith("part-")]
    if written:
        fs.rename(written[0], where(path))
    else:
        fs.create(where(path)).close()
    fs.delete(where(parts), True)

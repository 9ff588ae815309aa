"""Enrichment layers: import, path normalisation, replacement by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed
from .spread import joined

#: Reported files whose paths are broadcast; those of more are joined.
FEW = 100_000


def normalize_paths(reported, indexed, root):
    """reported(p) with path: root-relative if indexed; else itself if indexed; else its longest indexed suffix after the first component; else unchanged."""
    base = root.rstrip("/") + "/"
    own = reported.select("p").distinct()
    clean = F.regexp_replace("p", r"^/", "")
    parts = F.split(clean, "/")
    options = F.array(F.struct(F.lit(0).alias("o"), F.when(F.col("p").startswith(base), F.substring(F.col("p"), F.lit(len(base) + 1), F.length("p"))).otherwise(F.col("p")).alias("s")), F.struct(F.lit(1).alias("o"), F.col("p").alias("s")))
    suffixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(i.alias("o"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("s"))))
    tried = own.select("p", F.explode(F.concat(options, F.coalesce(suffixes, F.array().cast("array<struct<o:int,s:string>>")))).alias("t")).select("p", "t.o", "t.s")
    found = tried.join(indexed.select(F.col("path").alias("s")).distinct(), "s").groupBy("p").agg(F.min_by("s", "o").alias("found"))
    return own.join(found, "p", "left").select("p", F.when(F.col("p") == "", "").otherwise(F.coalesce("found", "p")).alias("path"))


def import_edges(raw, indexed, root, source, reported=None):
    """Rows of an enrichment layer from raw(n, from, kind, to, file, line): n is the input order.

    Edges without both ends go; of equal ones (line aside) the first stays. A file may hold any share of them, so its edges meet its path in many parts.
    reported(p), if the files that raw names are known (others may be among them), saves a pass over it.
    """
    raw = raw.fillna({"from": "", "kind": "", "to": "", "file": "", "line": 0}).where((F.col("from") != "") | (F.col("to") != ""))
    raw = raw.withColumnRenamed("file", "p")
    paths = checkpointed(normalize_paths(raw if reported is None else reported.fillna({"p": ""}), indexed, root))
    named = raw.join(F.broadcast(paths), "p") if paths.count() <= FEW else joined(raw, paths, ["p"], ["from", "to"])
    first = named.groupBy("from", "kind", "to", "path").agg(F.min_by("line", "n").alias("line"))
    return first.select(F.lit(source).alias("source"), F.col("from").alias("from_fqn"), "kind", F.col("to").alias("to_fqn"), F.col("path").alias("file"), F.col("line").cast("int").alias("line"))


def replace_source(ext_edges, source, rows):
    """One layer replaced, the others kept."""
    return ext_edges.where(F.col("source") != source).unionByName(rows)


def keep_sources(ext_edges, present):
    """Layers whose file is still there."""
    return ext_edges.where(F.col("source").isin(*present)) if present else ext_edges.where("false")


ANALYSER = "files map<string, struct<messages: array<struct<message: string, line: int, identifier: string>>>>"
MESSAGE = "`from` string, kind string, `to` string, file string, line int"


def analyser_edges(reports, identifier):
    """Edges in a static analyser's JSON: reports(value); messages of one identifier hold an edge as JSON, bad ones are dropped."""
    files = reports.select(F.from_json("value", ANALYSER).alias("r")).select(F.explode("r.files").alias("path", "f"))
    messages = files.select("path", F.posexplode("f.messages").alias("n", "m")).where(F.col("m.identifier") == identifier)
    edges = messages.select("path", "n", F.col("m.line").alias("at"), F.from_json("m.message", MESSAGE).alias("e"))
    edges = edges.where("e IS NOT NULL AND (e.`from` IS NOT NULL OR e.`to` IS NOT NULL)")
    return edges.select(F.col("n"), F.col("e.from").alias("from"), F.col("e.kind").alias("kind"), F.col("e.to").alias("to"), F.coalesce("e.file", "path").alias("file"), F.coalesce("e.line", "at").alias("line"))

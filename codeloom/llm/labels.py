"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F


def fold(modulus):
    """crc32 of doc_id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def sample(docs, labels, label, condition, rows_per_class):
    """([(doc_id, 0 or 1)], docs(doc_id, text) of these): of each class the rows_per_class labels first by hash of doc_id where condition holds.

    The number of rows is bounded, and nothing else: texts of any length belong to it, whole. Labels are chosen before any text
    is read, and the few chosen are broadcast, so no other text is shuffled. Of repeated documents the least text counts; labels
    without a document, of null or of other values are dropped; conflicting labels of one doc_id are all kept.
    """
    spark = docs.sparkSession
    chosen = []
    for y in (0, 1):
        rows = labels.where(F.col("doc_id").isNotNull() & (F.col(label) == y) & condition).select("doc_id").distinct()
        chosen += [(r[0], y) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class).collect()]
    ids = spark.createDataFrame(sorted({(i,) for i, _ in chosen}), "doc_id long")
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    return chosen, rows.groupBy("doc_id").agg(F.min("text").alias("text"))

"""Joins on keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Parts that the rows of each key are dealt over.
WAYS = 32


def joined(many, few, on, by):
    """The inner join of many with few, for keys that many repeats without bound and few hardly: a key's rows of many go to WAYS parts by the columns by, few's to each of them."""
    dealt = many.withColumn("__way", F.pmod(F.xxhash64(*by), F.lit(WAYS)).cast("int"))
    each = few.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    return dealt.join(each, [*on, "__way"]).drop("__way")

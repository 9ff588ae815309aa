"""Filter interaction audit: what each filter removes in every order, by depth-first execution of the trie of permutations."""

from __future__ import annotations

import itertools
import math
import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import functions as F

from .common import scratch, shared_dir, table, tune

#: A document group of more than one in so many rows is met by a broadcast of at most that many groups.
HOT_SHARE = 1000


def repeated(docs):
    """docs(__row, doc_id, digest) with __row and whether a smaller doc_id has the same digest; a null doc_id comes after all others.

    Digests and ids alone are shuffled. A group that holds more than a thousandth of the rows, of which there can't be more than
    a thousand, is broadcast, so its rows stay where they are; the other groups are joined.
    """
    groups = docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    groups = scratch(docs.sparkSession, groups, "audit-groups")
    total = docs.count()
    hot = groups.where(F.col("n") * HOT_SHARE > total).select("digest", "least")
    late = (F.col("least") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("least").isNotNull())
    of_hot = docs.join(F.broadcast(hot), "digest").select("__row", late.alias("again"))
    rest = docs.join(F.broadcast(hot), "digest", "left_anti")
    return of_hot.unionAll(rest.join(groups.where(F.col("n") * HOT_SHARE <= total).select("digest", "least"), "digest").select("__row", late.alias("again")))


def flagged(docs, labels, conditions, duplicate=None, part="source"):
    """part, good, toxic and a boolean column for each filter, true where a row fails it: a row for each document, in the shared folder.

    conditions maps names to columns over docs(text) with null as empty; duplicate names the filter that repeated texts fail.
    Texts are read once; what follows carries flags, ids and digests only.
    """
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    names = [*conditions, *([duplicate] if duplicate else [])]
    digest = [F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")] if duplicate else []
    rows = texts.select("doc_id", "part", *[c.alias(f"fails_{n}") for n, c in conditions.items()], *digest)
    rows = scratch(spark, rows.withColumn("__row", F.monotonically_increasing_id()), "audit-rows")
    if duplicate:
        again = repeated(rows.select("__row", "doc_id", "digest")).where("again").select("__row", F.lit(True).alias(f"fails_{duplicate}"))
        rows = rows.drop("digest").join(again, "__row", "left").fillna({f"fails_{duplicate}": False})
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).where("good OR toxic")
    rows = rows.join(marks, "doc_id", "left").fillna({"good": False, "toxic": False})
    return scratch(spark, rows.select("part", "good", "toxic", *[f"fails_{n}" for n in names]), "audit-flags")


class Trie:
    """The permutations of some filters as a trie whose prefixes of the same filters share one state.

    A state is the DataFrame of rows that none of its filters removed, persisted while its own continuations run. walk() goes depth
    first: on the first visit of a state one job counts, by part, its rows and what each filter not yet applied removes of them, which are
    its outgoing edges; a prefix that reaches the state again finds it counted. At most one state for each depth is held.
    Each part has a row that no filter removes and that counts for nothing, so a part of which nothing is left is counted too.
    """

    def __init__(self, rows, names):
        self.names = list(names)
        none = {c: F.lit(False) for c in rows.columns if c != "part"}
        self.rows = rows.withColumn("counts", F.lit(True)).unionByName(rows.select("part").distinct().withColumns(none | {"counts": F.lit(False)}))
        self.counted: set = set()
        self.root = f"{shared_dir(rows.sparkSession)}/audit-states-{uuid.uuid4().hex}"

    def walk(self):
        """part, applied (the state's filters as bits), n, and for each filter its removed_, good_ and toxic_ counts there (0 where applied before)."""
        self._visit(0, self.rows)
        counts = "".join(f", {c}_{n} long" for n in self.names for c in ("removed", "good", "toxic"))
        return self.rows.sparkSession.read.schema(f"part string, n long{counts}, applied int").parquet(self.root)

    def _visit(self, state, rows):
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._count(state, rows)
            self.counted.add(state)
            for bit, name in enumerate(self.names):
                after = state | 1 << bit
                if not state >> bit & 1 and after not in self.counted:
                    self._visit(after, rows.where(~F.col(f"fails_{name}")))
        finally:
            rows.unpersist()

    def _count(self, state, rows):
        found = [F.count_if("counts").alias("n")]
        for name in self.names:
            for what, also in (("removed", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
                found.append(F.count_if(F.col(f"fails_{name}") & also).alias(f"{what}_{name}"))
        rows.groupBy("part").agg(*found).write.parquet(f"{self.root}/applied={state}")


def audit(docs, labels, conditions, duplicate=None, part="source"):
    """What each step of each order of the filters keeps and removes, a row for each part, order and step; zeros included.

    part is a document's value of that column, null as the empty string. kept and removed are counts after and at the step;
    redundant those failing its filter that went earlier; unique_fails those failing no other; good_lost and toxic_lost the
    removed of which some label row has quality or toxic 1; shapley the filter's removed summed over all orders.

    Null and empty texts count as empty, which fails as the conditions say; repeated rows count each, and rows with one doc_id aren't
    each other's copies; a null doc_id has no labels and is a copy of any text that an id has; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    names = [*conditions, *([duplicate] if duplicate else [])]
    rows = flagged(docs, labels, conditions, duplicate, part)
    states = Trie(rows, names).walk()
    only = {n: F.col(f"fails_{n}") & ~reduce(lambda a, b: a | b, [F.col(f"fails_{m}") for m in names if m != n], F.lit(False)) for n in names}
    alone = rows.groupBy("part").agg(*[F.count_if(only[n]).alias(f"unique_{n}") for n in names])
    whole = states.where("applied = 0").select("part", *[F.col(f"removed_{n}").alias(f"fails_{n}") for n in names])
    orders = math.factorial(len(names))
    weight = {s: math.factorial(s) * math.factorial(len(names) - 1 - s) for s in range(len(names))}
    size = F.bit_count("applied")
    share = reduce(lambda a, b: F.when(size == b[0], b[1]).otherwise(a), weight.items(), F.lit(0))
    shapley = states.groupBy("part").agg(*[F.sum(F.col(f"removed_{n}") * share).alias(f"shapley_{n}") for n in names])
    edges = states.join(whole, "part").join(alone, "part").join(shapley, "part")
    each = F.array(*[
        F.struct(F.lit(1 << b).alias("bit"), *[F.col(f"{c}_{n}").alias(c) for c in ("removed", "good", "toxic", "fails", "unique", "shapley")])
        for b, n in enumerate(names)
    ])
    edges = edges.select("part", "applied", "n", F.explode(each).alias("e"))
    steps = [
        ("".join(names[b] for b in order), k + 1, sum(1 << b for b in order[:k]), 1 << order[k])
        for order in itertools.permutations(range(len(names)))
        for k in range(len(names))
    ]
    assert len(steps) == orders * len(names)
    steps = spark.createDataFrame(steps, "filter_order string, step int, applied int, bit int")
    joined = edges.withColumn("bit", F.col("e.bit")).join(F.broadcast(steps), ["applied", "bit"])
    return joined.select(
        "part", "filter_order", "step",
        (F.col("n") - F.col("e.removed")).alias("kept"), F.col("e.removed").alias("removed"), (F.col("e.fails") - F.col("e.removed")).alias("redundant"),
        F.col("e.unique").alias("unique_fails"), F.col("e.good").alias("good_lost"), F.col("e.toxic").alias("toxic_lost"), F.col("e.shapley").alias("shapley"),
    )


def word_array(text):
    """The maximal runs of characters that aren't blanks."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _conditions():
    words = word_array(F.col("text"))
    upper = F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * upper.cast("long") > 5 * F.char_length("text").cast("long"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def op12_filter_audit(spark, sf_dir):
    """Five filters in all 120 orders: under 50 words, few distinct words, many capitals, signs, and repeated texts."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _conditions(), duplicate="E")


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM words GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(least < words.doc_id, words.doc_id IS NULL AND least IS NOT NULL)::INT AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words JOIN least USING (text) LEFT JOIN marks ON marks.doc_id = words.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, fails),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

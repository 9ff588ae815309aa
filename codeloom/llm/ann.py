"""Approximate nearest neighbours by collision counting over sorted projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import table, tune, worker

K = 20
#: Projections, and the share of them in which a vector must collide to be a candidate.
PROJECTIONS, THRESHOLD = 128, 0.85
#: First half-width of the windows, for vectors of length 1, and its growth before and after some vector collides nearly often enough.
WIDTH, FAST, SLOW = 0.05, 1.5, 1.06
#: The search ends when a vector as near as the k-th best would be a candidate but for so many standard deviations of its collisions.
DEVIATIONS = 2.2
#: Rows of a block that are searched for to fit the first width to it: most searches then end after one pass over the arrays.
PROBES = 8
#: Rows of a block at most, on average: how rows are dealt follows from their number alone, and not from how Spark is set.
BLOCK_ROWS = 1 << 13


def reach():
    """Half-width at which a vector at distance 1 collides often enough, but for DEVIATIONS: a window of w holds its projection with chance erf(w / sqrt 2)."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        enough = PROJECTIONS * p - DEVIATIONS * math.sqrt(PROJECTIONS * p * (1 - p)) >= math.ceil(THRESHOLD * PROJECTIONS)
        low, high = (low, p) if enough else (p, high)
    chance, low, high = high, 0.0, 10.0
    for _ in range(60):
        w = (low + high) / 2
        low, high = (low, w) if math.erf(w / math.sqrt(2)) >= chance else (w, high)
    return high


def unit(v):
    """Rows of length 1, computed so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


class Index:
    """Sorted arrays of single projections of a block's vectors, lengthened so that the largest inner product is the least distance."""

    def __init__(self, ids, vectors, seed=11):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        n, dim = self.vectors.shape
        scaled = self.vectors / np.abs(self.vectors).max()
        square = (scaled**2).sum(axis=1)
        longest = square.max()
        longer = np.concatenate([scaled, np.sqrt(np.maximum(longest - square, 0))[:, None]], axis=1) / np.sqrt(longest)
        self.lines = np.random.default_rng(seed).standard_normal((dim + 1, PROJECTIONS))
        self.longer = longer
        points = longer @ self.lines
        #: All sorted arrays as one, each moved beyond the last by a step: one search finds a place in each.
        step = 4 * np.abs(points).max() + 64
        self.base = np.arange(PROJECTIONS) * step
        self.order = np.argsort(points, axis=0, kind="stable").T.ravel()
        self.sorted = (np.sort(points, axis=0).T + self.base[:, None]).ravel()
        self.edge, self.reach, self.width = np.arange(PROJECTIONS + 1) * n, reach(), WIDTH
        probes = [self.search(self.vectors[i], self.ids[i], K)[2] for i in range(0, n, max(1, n // PROBES))]
        self.width = float(np.quantile(probes, 0.9))

    def search(self, query, own, k):
        """(ids, scores, last width) of the k best verified candidates, best first, ties to the smaller id; own is no candidate.

        The windows around the query's projections widen (virtual rehashing: no array is built anew), always from
        the block's first width, so a query's result doesn't depend on others. What collides in enough of them is verified. The
        widest window that is needed follows from the distance of the k-th best so far: a vector as near collides in each
        window with a known chance. At the latest the windows hold all rows.
        """
        n, need = len(self.ids), math.ceil(THRESHOLD * PROJECTIONS)
        q = query.astype(np.float64)
        centre = unit(q)
        line = centre @ self.lines[:-1] + self.base
        fresh = self.ids != own
        met, near = np.zeros(0, np.int64), np.zeros(0)
        low = high = counts = None
        width = self.width
        while True:
            a, b = np.searchsorted(self.sorted, np.concatenate([line - width, line + width])).reshape(2, -1)
            a, b = np.maximum(a, self.edge[:-1]), np.minimum(b, self.edge[1:])
            whole = int((b - a).sum()) == n * PROJECTIONS
            if counts is not None:
                counts += self.tally([*a, *high], [*low, *b])
            elif 2 * int((b - a).sum()) <= n * PROJECTIONS:
                counts = self.tally(a, b)
            else:  # fewer rows lie outside the windows
                counts = PROJECTIONS - self.tally([*self.edge[:-1], *b], [*a, *self.edge[1:]])
            low, high = a, b
            found = np.flatnonzero((counts >= need) & fresh)
            fresh[found] = False
            met = np.concatenate([met, found])
            near = np.concatenate([near, 2 - 2 * (self.longer[found, :-1] @ centre)])
            wanted = np.inf
            if len(met) >= k:
                wanted = self.reach * math.sqrt(max(np.partition(near, k - 1)[k - 1], 0))
            if whole or width >= wanted:
                break
            width = min(width * (SLOW if counts.max() >= 0.8 * need else FAST), wanted)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = self.vectors[met] @ q
        best = np.lexsort((self.ids[met], -scores))
        ids, scores = self.ids[met][best], scores[best]
        _, first = np.unique(ids, return_index=True)  # a repeated id counts once, by its best row
        first.sort()
        return ids[first][:k], scores[first][:k], width

    def tally(self, begin, end):
        """How often each row stands in some parts of the sorted arrays."""
        return np.bincount(np.concatenate([self.order[x:y] for x, y in zip(begin, end, strict=True)]), minlength=len(self.ids))


def usable(column):
    """Vectors with components, all finite numbers, not all zero."""
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & ok & F.exists(column, lambda x: x != 0)


def nearest(vectors, queries, k=K, block_rows=BLOCK_ROWS):
    """query_id, rank, vec_id, score: for each row of queries(vec_id, embedding) the k largest inner products found among vectors(vec_id, embedding).

    Rows are dealt into blocks by a hash of vec_id; every block indexes all its rows, and every query goes to
    every block (a stated query set against all rows), streaming past the index, so a task holds one block.
    Null ids, and vectors that are null, empty, zero or hold null or non-finite components, take no part; vectors of
    another length than the query's are no candidates; a repeated vec_id counts once, by its best row, and is one query, by
    the least of its vectors; ties go to the smaller vec_id, and a sum that isn't a number (of components beyond 1e154) comes last;
    fewer candidates than k give all; other columns are ignored.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    dealt = dealt.unionByName(asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding"))
    dealt = dealt.repartitionById(blocks, "block").sortWithinPartitions("kind", "vec_id")

    @worker("ann")
    def search(batches):
        held: dict = {}
        indexes: dict | None = None
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            split = int(np.searchsorted(kind, 1))
            for i in range(split):
                v = values[offsets[i] : offsets[i + 1]]
                own = held.setdefault(len(v), ([], []))
                own[0].append(ids[i])
                own[1].append(v)
            if split == len(kind):
                continue
            if indexes is None:
                indexes = {d: Index(np.array(a, np.int64), np.stack(v)) for d, (a, v) in held.items()}
                held = {}
            out: list = [[], [], []]
            for i in range(split, len(kind)):
                q = values[offsets[i] : offsets[i + 1]]
                if len(q) in indexes:
                    found, scores, _ = indexes[len(q)].search(q, ids[i], k)
                    for column, value in zip(out, (np.full(len(found), ids[i]), found, scores), strict=True):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))

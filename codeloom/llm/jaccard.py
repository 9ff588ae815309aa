"""N-gram Jaccard join: a blocked sparse product of documents by word n-grams, cut by size-derived bounds.

Documents with equal n-gram sets are one class. Two classes can only reach the threshold if their
prefixes (the first n - ceil(t n) + 1 n-grams in one global order) share an n-gram, so only prefix entries
of the incidence matrix are multiplied. The order puts frequent n-grams last; which those are is
counted over all n-grams of all documents, and any choice gives the same links.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import carried, forget, lower_ascii, mix, pieces, scratch, table, tune, utf8, window_hashes, word_hashes, word_spans, worker
from .graph import components

SHINGLE = 5
#: The threshold as a fraction, so that bounds are exact.
NUMER, DENOM = 4, 5
#: N-grams counted before a task hands on what it has; and frequent n-grams that are broadcast at most.
FLUSH, HOT_KEYS, LEAST_HOT = 1 << 21, 1 << 20, 16
#: Prefix entries that a task packs at once.
PACK = 1 << 19
BITMAP_BITS = 24
#: Turns in which a class is compared with a few others, before all pairs that are left; and how many.
TURNS, PIVOTS = 3, 4
_WORD_BYTES = np.ones(256, bool)
_WORD_BYTES[[32, 9, 10, 11, 12, 13]] = False


def sets_of(column):
    """(sorted distinct n-gram hashes of all texts in a row, offsets of n + 1)."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    starts, ends, doc = word_spans(data, offsets, _WORD_BYTES)
    words = word_hashes(data, starts, ends)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    five = window_hashes(words, SHINGLE)
    out, sizes = [], np.zeros(n_docs, np.int64)
    for i in np.flatnonzero(count):
        a, n = first[i], count[i]
        h = np.unique(five[a : a + n - SHINGLE + 1]) if n >= SHINGLE else window_hashes(words[a : a + n], int(n))
        out.append(h)
        sizes[i] = len(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes, offsets):
    """A 64-bit name of each set; 0 for an empty one."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x5BD1E9955BD1E995)), out=sums[1:])
    n = np.diff(offsets)
    sig = mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, np.where(sig == 0, np.uint64(1), sig), np.uint64(0))


def prefix_size(n):
    return n - (NUMER * n + DENOM - 1) // DENOM + 1


def _text_batches(batches, at):
    for whole in batches:
        yield from pieces(whole, whole.schema.names[at])


def _meta(docs):
    """row columns, n and sig of each document."""
    fields = docs.select("doc_id").schema.fields[0].dataType.simpleString()

    @worker("jaccard")
    def run(batches):
        for batch in _text_batches(batches, 1):
            h, o = sets_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(o)), pa.array(signatures(h, o).view(np.int64))], names=["doc_id", "n", "sig"])

    return docs.select("doc_id", docs["text"].alias("__text")).mapInArrow(run, f"doc_id {fields}, n long, sig long")


def _pack(keys):
    """Sorted integers as their differences, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps = steps.astype(np.uint32) if not len(steps) or steps.max() < 1 << 32 else steps
    return bytes([steps.itemsize]) + zlib.compress(steps.view(np.uint8).reshape(-1, steps.itemsize).T.tobytes(), 1)


def _unpack(blob):
    width = blob[0]
    raw = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint32 if width == 4 else np.uint64).ravel(), dtype=np.uint64)


def _deal(bucket, n):
    """Begin and end of each of n buckets in a sorted array."""
    edges = np.searchsorted(bucket, np.arange(n + 1))
    return [(b, edges[b], edges[b + 1]) for b in range(n) if edges[b] < edges[b + 1]]


def _fresh(h, o, seen):
    """Indices of the documents of a piece whose set this task hasn't met."""
    sig = signatures(h, o)
    out = []
    for i in np.flatnonzero(np.diff(o)):
        s = int(sig[i])
        if s not in seen:
            if len(seen) > 1 << 20:
                seen.clear()
            seen.add(s)
            out.append(i)
    return sig, np.array(out, np.int64)


def _frequent(docs, parts, key_bits):
    """Keys (first key_bits of a hash) of frequent n-grams, as a sorted array of bounded size: counts over all n-grams.

    Copies met by one task count once. The least count is doubled until the keys fit HOT_KEYS.
    """
    shift = np.uint64(64 - key_bits)

    @worker("jaccard")
    def count(batches):
        seen: set = set()
        held, size = [], 0

        def flush():
            keys = np.sort(np.concatenate(held))
            bucket = (keys.astype(np.float64) * (parts / 2.0**key_bits)).astype(np.int64).clip(0, parts - 1)
            dealt = _deal(bucket, parts)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in dealt], pa.int32()), pa.array([_pack(keys[x:y]) for _, x, y in dealt], pa.binary())], names=["bucket", "keys"])

        for batch in _text_batches(batches, 0):
            h, o = sets_of(batch.column(0))
            _, fresh = _fresh(h, o, seen)
            if len(fresh):
                own = np.concatenate([h[o[i] : o[i + 1]] for i in fresh]) >> shift
                held.append(own)
                size += len(own)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    @worker("jaccard")
    def gather(batches):
        held = []
        for batch in batches:
            held += map(_unpack, batch.column(1).to_pylist())
        if held:
            keys = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts = np.diff(np.r_[at, len(keys)])
            hot = counts >= LEAST_HOT
            yield pa.RecordBatch.from_arrays([pa.array(keys[at][hot].astype(np.int64)), pa.array(counts[hot])], names=["k", "n"])

    spark = docs.sparkSession
    blobs = docs.select(docs["text"].alias("__text")).mapInArrow(count, "bucket int, keys binary")
    found = scratch(spark, blobs.repartitionById(parts, "bucket").mapInArrow(gather, "k long, n long"), "frequent")
    levels = {r["l"]: r["c"] for r in found.groupBy(F.floor(F.log2("n")).alias("l")).agg(F.count("*").alias("c")).collect()}
    least = int(np.log2(LEAST_HOT))
    while sum(c for lvl, c in levels.items() if lvl >= least) > HOT_KEYS:
        least += 1
    keys = np.array([r["k"] for r in found.where(F.col("n") >= 2**least).select("k").toLocalIterator()], np.int64).astype(np.uint64)
    forget(spark, found)
    return np.sort(keys)


def _shared(docs, parts, hot, key_bits):
    """Entries (h, sig, n, pos) of prefix n-grams that more than one class has; of frequent ones all."""
    spark = docs.sparkSession
    shift = np.uint64(64 - key_bits)
    table_of_hot = spark.sparkContext.broadcast(hot)

    def order(h, frequent):
        return np.concatenate([h[~frequent], h[frequent]])

    @worker("jaccard")
    def deal(batches):
        hot = table_of_hot.value
        quick = np.zeros(1 << 22, bool)
        quick[(hot >> np.uint64(key_bits - 22)).astype(np.int64)] = True
        seen: set = set()
        held, size = [], 0

        def flush():
            h, sig, n, pos, cold = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = np.where(cold, (h.astype(np.float64) * (parts / 2.0**64)).astype(np.int64).clip(0, parts - 1), (mix(h ^ sig) % np.uint64(parts)).astype(np.int64))
            o = np.argsort(bucket, kind="stable")
            h, sig, n, pos, cold, bucket = h[o], sig[o], n[o], pos[o], cold[o], bucket[o]
            rows = {"bucket": [], "h": [], "doc": [], "sig": [], "n": [], "pos": [], "cold": []}
            for b, x, y in _deal(bucket, parts):
                names, at, doc = np.unique(sig[x:y], return_index=True, return_inverse=True)
                rows["bucket"].append(b)
                rows["h"].append(h[x:y].tobytes())
                rows["doc"].append(doc.astype(np.uint32).tobytes())
                rows["sig"].append(names.tobytes())
                rows["n"].append(n[x:y][at].astype(np.uint32).tobytes())
                rows["pos"].append(pos[x:y].astype(np.uint32).tobytes())
                rows["cold"].append(np.packbits(cold[x:y]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32())] + [pa.array(rows[k], pa.binary()) for k in list(rows)[1:]], names=list(rows))

        for batch in _text_batches(batches, 0):
            h, o = sets_of(batch.column(0))
            sig, fresh = _fresh(h, o, seen)
            keys = h >> shift
            maybe = np.flatnonzero(quick[(h >> np.uint64(42)).astype(np.int64)])
            frequent = np.zeros(len(h), bool)
            if len(hot) and len(maybe):
                at = np.minimum(np.searchsorted(hot, keys[maybe]), len(hot) - 1)
                frequent[maybe] = hot[at] == keys[maybe]
            for i in fresh:
                own, flag = h[o[i] : o[i + 1]], frequent[o[i] : o[i + 1]]
                p = prefix_size(len(own))
                cold = int((~flag).sum())
                first = order(own, flag)[:p]
                held.append((first, np.full(p, sig[i]), np.full(p, len(own)), np.arange(p), np.arange(p) < cold))
                size += p
            if size >= PACK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    @worker("jaccard")
    def gather(batches):
        held = []
        for batch in batches:
            for h, doc, sig, n, pos, cold in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                h, doc, pos = np.frombuffer(h, np.uint64), np.frombuffer(doc, np.uint32), np.frombuffer(pos, np.uint32)
                sig, n = np.frombuffer(sig, np.uint64)[doc], np.frombuffer(n, np.uint32)[doc]
                cold = np.unpackbits(np.frombuffer(cold, np.uint8), count=len(h)).astype(bool)
                if not cold.all():
                    yield entries(h[~cold], sig[~cold], n[~cold], pos[~cold])
                held.append((h[cold], sig[cold], n[cold], pos[cold]))
        if held:
            h, sig, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.lexsort((sig, h))
            h, sig, n, pos = h[o], sig[o], n[o], pos[o]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
            h, sig, n, pos = h[new], sig[new], n[new], pos[new]
            same = np.zeros(len(h) + 1, bool)
            same[1:-1] = h[1:] == h[:-1]
            keep = same[1:] | same[:-1]
            for i in range(0, len(h), 1 << 18):
                k = keep[i : i + (1 << 18)]
                yield entries(*(x[i : i + (1 << 18)][k] for x in (h, sig, n, pos)))

    def entries(h, sig, n, pos):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sig.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))], names=["h", "sig", "n", "pos"])

    blobs = docs.select(docs["text"].alias("__text")).mapInArrow(deal, "bucket int, h binary, doc binary, sig binary, n binary, pos binary, cold binary")
    return blobs.repartitionById(parts, "bucket").mapInArrow(gather, "h long, sig long, n int, pos int")


def _bound(a, b):
    """Least overlap of sets of sizes a and b that reaches the threshold."""
    return f"CAST(ceil({NUMER} * CAST({a} + {b} AS DOUBLE) / {NUMER + DENOM}) AS INT)"


def _prefix(n):
    return f"({n} - CAST(ceil({NUMER} * CAST({n} AS DOUBLE) / {DENOM}) AS INT) + 1)"


#: Of a pair that shares entries x and y: sizes near enough, and, if this n-gram is the first they share, enough n-grams left.
NEAR = f"{NUMER} * greatest(x.n, y.n) <= {DENOM} * least(x.n, y.n)"
#: Of a pair with c common prefix n-grams: enough of them for the rest to reach the bound.
ENOUGH = f"c + greatest(nx - {_prefix('nx')}, ny - {_prefix('ny')}) >= {_bound('nx', 'ny')}"

#: Prefix n-grams that a pair of these sizes has in common at least if it links: the rest of neither set can make up for fewer.
LEAST_COMMON = f"greatest({_bound('x.n', 'y.n')} - greatest(x.n - {_prefix('x.n')}, y.n - {_prefix('y.n')}), 1)"


def _stars(named, pivots_each, turn):
    """For each class up to pivots_each pairs (a, b, lower, upper): with the classes it shares most prefix n-grams with, among a few of each
    n-gram's least component; lower and upper are the components of a and b. Turns take different ones, of those that share the most:
    what few edits set apart links to those that have none. In the first turn components are classes, in the order of what they share."""
    shares = (-F.col("m")).alias("s")
    if turn:
        pick = [F.min(F.struct("root", shares, F.xxhash64("sig", F.lit(turn * 16 + k)).alias("k"), "sig", "n")).alias(f"p{k}") for k in range(pivots_each)]
    else:
        pick = [F.min(F.struct(shares, "sig", "n", "root")).alias("p0")]
    pivots = named.groupBy("h").agg(*pick, F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("h", F.array_distinct(F.array(*[F.struct(F.col(f"p{k}.sig").alias("a"), F.col(f"p{k}.n").alias("nx"), F.col(f"p{k}.root").alias("lower")) for k in range(pivots_each)])).alias("p"))
    pairs = named.join(pivots, "h").where("root <> p[0].lower").select("sig", "n", "root", F.explode("p").alias("p")).select("sig", "n", "root", "p.*")
    pairs = pairs.where(f"{NUMER} * greatest(n, nx) <= {DENOM} * least(n, nx)")
    pairs = pairs.groupBy("a", F.col("sig").alias("b")).agg(F.count("*").alias("c"), F.first("nx").alias("nx"), F.first("n").alias("ny"), F.first("lower").alias("lower"), F.first("root").alias("upper")).where(ENOUGH)
    best = pairs.groupBy("b").agg(F.slice(F.sort_array(F.collect_set(F.struct("c", "a", "lower", "upper")), asc=False), 1, pivots_each).alias("m"))
    return best.select("b", F.explode("m").alias("m")).select("m.a", "b", "m.lower", "m.upper")


def _jumped(spark, parents):
    """node, root from node, up with up < node: each node's last ancestor, in rounds that double the reach."""
    now = scratch(spark, parents, "up")
    while True:
        p, q = now.alias("p"), now.alias("q")
        after = scratch(spark, p.join(q, F.expr("p.up = q.node"), "left").select("p.node", F.coalesce("q.up", "p.up").alias("up"), F.col("q.up").isNotNull().alias("moved")), "up")
        moved = after.where("moved").limit(1).count()
        forget(spark, now)
        now = after.select("node", "up")
        if not moved:
            return now.select("node", F.col("up").alias("root"))


def _rooted(entries, roots):
    """Prefix entries with the component of their class."""
    return entries.join(roots, entries["sig"] == roots["node"], "left").select("h", "sig", "n", "pos", "m", F.coalesce("root", "sig").alias("root"))


def _mixed(spark, named):
    """Entries of n-grams that different components share."""
    mixed = named.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    return scratch(spark, named.join(mixed, "h", "left_semi"), "mixed")


def _crossing(named):
    """Pairs of classes in different components that can still link, from the n-grams that different components share.

    A pair needs at least LEAST_COMMON of them. So of x's m shared n-grams, in the one order, one of the first m - LEAST_COMMON + 1
    is common, and of y's likewise: a pair is met at those few only, and not at each n-gram it shares.
    """
    own = Window.partitionBy("sig")
    ranked = named.drop("m").withColumns({"r": F.row_number().over(own.orderBy("pos", "h")), "m": F.count("*").over(own)})
    x, y = ranked.alias("x"), ranked.alias("y")
    meet = f"x.h = y.h AND x.sig < y.sig AND x.root <> y.root AND {NEAR} AND x.r <= x.m - {LEAST_COMMON} + 1 AND y.r <= y.m - {LEAST_COMMON} + 1"
    return x.join(y, F.expr(meet)).groupBy(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).agg(F.first("x.root").alias("lower"), F.first("y.root").alias("upper"))


def _linked(docs, classes, pairs):
    """The pairs (a, b) that reach the threshold, by their whole sets; each class' set is read from one document, that of classes(sig, id)."""
    spark = docs.sparkSession
    pairs = scratch(spark, pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    readers = classes.join(wanted, "sig", "left_semi")
    bits = readers.select(F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS)).alias("bit"))
    # the readers' bits in words of 64: of one size, however many there are
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("v")).collect()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for w, v in words:
        bitmap[w] = v
    shared = spark.sparkContext.broadcast(bitmap)

    @worker("jaccard")
    def read(batches):
        for batch in _text_batches(batches, 1):
            bit = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (shared.value[bit >> 6] >> (bit & 63)) & 1 == 1
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            h, o = sets_of(batch.column(1))
            sig = signatures(h, o).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array([h[o[i] : o[i + 1]].tobytes() for i in range(len(sig))], pa.binary())], names=["sig", "s"])

    sets = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS)).alias("bit"), F.col("text").alias("__text")).mapInArrow(read, "sig long, s binary")
    sets = sets.join(wanted, "sig", "left_semi").dropDuplicates(["sig"])
    sets = scratch(spark, sets, "sets")

    @worker("jaccard")
    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))  # neither has a hash twice
                overlap = int((both[1:] == both[:-1]).sum())
                keep.append(DENOM * overlap >= NUMER * (len(x) + len(y) - overlap))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], names=["a", "b", "lower", "upper"])

    one = pairs.join(sets.select(F.col("sig").alias("b"), F.col("s").alias("y")), "b").join(sets.select(F.col("sig").alias("a"), F.col("s").alias("x")), "a")
    links = scratch(spark, one.select("a", "b", "lower", "upper", "x", "y").mapInArrow(judge, "a long, b long, lower long, upper long"), "links")
    forget(spark, pairs, sets)
    return links


def near_duplicates(docs):
    """doc_id, n_shingles and component_id of each row of docs(doc_id, text): components of the links of Jaccard 0.8 or more.

    Words are runs of anything but ASCII white space, A-Z lowered; a text of fewer than five words is
    one n-gram. Null, empty and wordless texts have no n-grams, link with nothing and are their own component.
    Equal sets are one class and link; repeated rows stay rows. A null doc_id gets the smallest doc_id of its component,
    or null. No documents give no rows; other columns are ignored. N-grams are compared by 64-bit hashes.

    No link is lost: in a few turns each class is compared with a few others, by how many n-grams they share; then, of the n-grams
    still shared by different components, every pair that the bounds leave is compared. Members of one
    component aren't compared again, so a group of near copies costs about its size and not its square.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meta = scratch(spark, _meta(docs), "sets-meta")
    # a row for each class, counted before it is shuffled: copies of one text never meet in a join
    classes = scratch(spark, meta.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("id")), "classes")
    total = meta.agg(F.sum("n")).first()[0] or 0
    key_bits = min(60, max(32, int(total).bit_length() + 4))
    entries = _shared(docs, parts, _frequent(docs, parts, key_bits), key_bits).dropDuplicates(["h", "sig"])
    entries = scratch(spark, entries.withColumn("m", F.count("*").over(Window.partitionBy("sig"))), "entries")
    roots = spark.createDataFrame([], "node long, root long")
    for turn in range(TURNS):
        named = _mixed(spark, _rooted(entries, roots))
        links = _linked(docs, classes, _stars(named, PIVOTS if turn else 1, turn))
        up = _jumped(spark, links.groupBy(F.col("upper").alias("node")).agg(F.min("lower").alias("up")))
        moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        before, roots = roots, scratch(spark, moved.unionByName(up.join(roots.select("node"), "node", "left_anti")), "roots")
        forget(spark, named, links, up, before)
    before, last = roots, _mixed(spark, _rooted(entries, roots))
    more = components(spark, _linked(docs, classes, _crossing(last)).select(F.col("lower").alias("a"), F.col("upper").alias("b")))
    more = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(more, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    roots = moved.unionByName(more.join(roots, more["root"] == roots["node"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root")))
    named = classes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "id", F.coalesce("root", "sig").alias("root"))
    named = scratch(spark, named, "named")
    forget(spark, classes, entries, last, before)
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select("sig", "component_id")
    out = meta.join(named, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs):
    """docs without near duplicates: of each component the row with its smallest doc_id stays.

    Rows without a doc_id come after all others, by a hash of their text (their keys are drawn from 2^61 numbers above 2^62). Of
    rows that repeat a doc_id and text one stays. Columns may have any names. The large side of the join is shuffled once
    and never sorted.
    """
    renamed, names, back = carried(docs)
    own = names[docs.columns.index("doc_id")]
    last = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    keyed = renamed.withColumn("key", F.coalesce(F.col(own).cast("long"), last))
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"))
    kept = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n"))
    once = keyed.join(kept.where("n = 1").select("key").hint("shuffle_hash"), "key", "left_semi")
    more = keyed.join(kept.where("n > 1").select("key").hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key", "text"])
    return back(once.unionByName(more))


def op10_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, p, p + 4), ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

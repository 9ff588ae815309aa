"""Suffix-array dedup: repeated 100-byte strings found by a distributed, common-prefix-aware merge sort.

Every 100-byte string has one anchor: the 32-byte gram in it of least hash, the leftmost of equals. It depends on
the string alone, so equal strings have equal anchors at equal offsets. Only suffixes at anchors are
sorted, about one in 35: front-coded sorted runs are exchanged by anchor, a loser tree merges them without comparing
known prefixes again, and the common prefixes of neighbours, with the bytes before the anchor, tell for each
start an anchor stands for whether its string starts earlier.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

from .common import BASE, INVERSE, _BYTE_VALUES, mix, pieces, powers, table, tune, utf8, worker
from .jaccard import _deal, _pack, _unpack

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM  # bytes before an anchor that its strings can hold
#: Starts that are looked at together; anchors that a task holds before it hands on a run; bits of the filter.
CHUNK, FLUSH, FILTER_BITS = 1 << 19, 1 << 17, 28
#: Grams that a run or a bucket names as its most frequent, occurrences from which one is split, and the offsets by which it is.
NAMED, HOT, RANGES = 64, 256, ((0, 17), (18, 34), (35, 51), (52, SPAN))
#: Bytes of documents a bucket, unless that makes fewer than the shuffle partitions or more than the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 16


def anchors(data, first, last):
    """Anchors of the starts first <= p < last whose 100 bytes lie in data: gram hash, place, least and largest start."""
    n = min(last, len(data) - LENGTH + 1) - first
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    part = data[first : first + n + LENGTH - 1]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[part] * powers(BASE, len(part)), out=sums[1:])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(INVERSE, len(part) + 1)[: len(part) - GRAM + 1])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = SPAN + 1
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    at = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[begin[1:], n] - 1
    place = at[begin]
    return h[place], place + first, begin + first, end + first


def text_anchors(data, offsets):
    """Anchors of all texts of a piece, with the text each is of; places count from data's begin. Long pieces go by chunks."""
    out = []
    for c in range(0, max(len(data), 1), CHUNK):
        h, place, low, high = anchors(data, c, min(c + CHUNK, len(data)))
        if not len(h):
            continue
        doc = np.searchsorted(offsets, low, "right") - 1
        # a run of starts may reach over a text's last whole string, or into the next text: cut it by text
        last = np.searchsorted(offsets, high, "right") - 1
        for d in range(int(np.max(last - doc)) + 1):
            own = doc + d
            ok = own <= last
            o = np.minimum(own, len(offsets) - 2)
            a, b = np.maximum(low, offsets[o]), np.minimum(high, offsets[o + 1] - LENGTH)
            ok &= (a <= b) & (place >= a) & (place + GRAM <= offsets[o + 1])
            out.append((h[ok], place[ok], a[ok], b[ok], own[ok]))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _columns(docs):
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return docs.select(key.alias("doc"), F.xxhash64("text").alias("th"), F.col("text").alias("__text"))


def _repeated(docs, parts):
    """A bit table of fixed size of the anchor grams that occur twice: no such gram is missed. And some of the most frequent grams,
    of bounded number (NAMED a bucket): which ones are named changes how work is dealt, never what is found.
    """

    @worker("suffixes")
    def count(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keys = (h >> np.uint64(8)) << np.uint64(1) | (n > 1).astype(np.uint64)
            bucket = (h.astype(np.float64) * (parts / 2.0**64)).astype(np.int64).clip(0, parts - 1)
            dealt = _deal(bucket, parts)
            top = np.zeros(len(h), bool)
            top[np.argsort(-n, kind="stable")[:NAMED]] = True
            top &= n > 1
            hot = [np.stack([h[x:y][top[x:y]], n[x:y][top[x:y]].astype(np.uint64)]).tobytes() for _, x, y in dealt]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in dealt], pa.int32()), pa.array([_pack(keys[x:y]) for _, x, y in dealt], pa.binary()), pa.array(hot, pa.binary())], names=["bucket", "keys", "hot"])

        for whole in batches:
            for batch in pieces(whole, "__text", CHUNK):
                h = text_anchors(*utf8(batch.column(0)))[0]
                held.append(h)
                size += len(h)
                if size >= 1 << 21:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    @worker("suffixes")
    def gather(batches):
        held, hot = [], []
        for batch in batches:
            held += map(_unpack, batch.column(1).to_pylist())
            hot += [np.frombuffer(x, np.uint64).reshape(2, -1) for x in batch.column(2).to_pylist()]
        if held:
            named, n = _summed(np.concatenate(hot, axis=1))
            named = named[np.argsort(-n, kind="stable")[:NAMED]][np.sort(-n, kind="stable")[:NAMED] <= -HOT]
            keys = np.sort(np.concatenate(held))
            gram, many = keys >> np.uint64(1), (keys & np.uint64(1)).astype(bool)
            same = np.r_[False, gram[1:] == gram[:-1]]
            gram = gram[same | np.r_[same[1:], False] | many]
            bits = np.unique(gram >> np.uint64(56 - FILTER_BITS)).astype(np.int64)
            first = int(bits[0]) >> 3 if len(bits) else 0
            flags = np.zeros(((int(bits[-1]) >> 3) - first + 1) * 8 if len(bits) else 0, np.uint8)
            flags[bits - first * 8] = 1
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary()), pa.array([named.tobytes()], pa.binary())], names=["first", "bits", "hot"])

    blobs = docs.select("__text").mapInArrow(count, "bucket int, keys binary, hot binary").repartitionById(parts, "bucket")
    out, hot = np.zeros(1 << (FILTER_BITS - 3), np.uint8), [np.zeros(0, np.uint64)]
    for first, blob, named in blobs.mapInArrow(gather, "first int, bits binary, hot binary").toLocalIterator():
        own = np.frombuffer(zlib.decompress(blob), np.uint8)
        out[first : first + len(own)] |= own
        hot.append(np.frombuffer(named, np.uint64))
    return out, np.sort(np.concatenate(hot))


def _summed(counted):
    """Distinct keys and the sums of their counts."""
    keys, at = np.unique(counted[0], return_inverse=True)
    return keys, np.bincount(at, counted[1].astype(float), len(keys)).astype(np.int64)


def common_prefix(a, b, known):
    """Length of the common prefix of two suffixes, of which known bytes are known to be equal."""
    x = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return LENGTH if not x else LENGTH - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of 100-byte suffixes with the common prefixes of neighbours.

    Each loser keeps how much it shares with the suffix that beat it; the next winner is found by those
    lengths, and bytes are compared only from where both stop being known.
    """

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        size = 1
        while size < max(2, len(runs)):
            size *= 2
        self.size = size
        self.nodes: list = [None] * size
        entrants = [self.take(i) if i < len(runs) else None for i in range(size)]
        level = entrants
        base = size // 2
        while len(level) > 1:
            up = []
            for i in range(0, len(level), 2):
                win, lose = self.play(level[i], level[i + 1])
                self.nodes[base + i // 2] = lose
                up.append(win)
            level, base = up, base // 2
        self.winner = level[0]

    def take(self, i):
        """[shared with the winner before it, suffix, value, run]."""
        found = next(self.runs[i], None)
        return None if found is None else [found[0], found[1], found[2], i]

    @staticmethod
    def play(a, b):
        """(winner, loser); both share their lengths with the same earlier winner."""
        if a is None:
            return b, a
        if b is None:
            return a, b
        if a[0] > b[0]:
            return a, b
        if b[0] > a[0]:
            return b, a
        shared = common_prefix(a[1], b[1], a[0])
        if shared == LENGTH or a[1][shared] <= b[1][shared]:
            b[0] = shared
            return a, b
        a[0] = shared
        return b, a

    def merge(self):
        """(shared with the one before, value) in order."""
        nodes, play = self.nodes, self.play
        while self.winner is not None:
            shared, _, value, run = self.winner
            yield shared, value
            entrant = self.take(run)
            at = (self.size + run) // 2
            while at:
                entrant, nodes[at] = play(entrant, nodes[at])
                at //= 2
            self.winner = entrant


def _front_coded(rows):
    """Sorted 100-byte rows as lengths shared with the row before, and the rest of each."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return shared, rows[np.arange(LENGTH) >= shared[:, None]]


def _full(shared, rest):
    """The rows of a front-coded run."""
    own = np.arange(LENGTH) >= shared[:, None].astype(np.int64)
    rows = np.zeros(own.shape, np.uint8)
    rows[own] = rest
    source = np.maximum.accumulate(np.where(own, np.arange(len(own))[:, None], 0), axis=0)
    return rows[source, np.arange(LENGTH)]


_RECORD = np.dtype([("doc", "<i4"), ("place", "<i8"), ("near", "u1"), ("far", "u1")])


def _runs(batches, parts, table_of_bits):
    """Runs of anchors whose gram repeats, by bucket; and starts known at once to repeat in this task, by the bucket of their document.

    A frequent gram is split: the strings of a range of offsets that are equal share the bytes that all of the range have, and are dealt by these.
    """
    held, size = [], 0
    bits, hot = table_of_bits.value

    def flush():
        doc, th, h, place, near, far, context, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, th, doc))
        # strings around equal anchors that are equal as a whole: the first goes on, the others repeat it
        _, first, at = np.unique(np.stack([context[order], near[order].astype(np.uint64) << np.uint64(8) | far[order].astype(np.uint64)]), axis=1, return_index=True, return_inverse=True) if len(order) else (None, order, order)
        kept = np.zeros(len(order), bool)
        kept[first] = True
        out_bucket, blobs = [], []
        # a row that repeats doc_id and text brings the first's own place once more: that repeats nothing
        again = order[~kept & ~_same(order, order[first][at.ravel()], doc, th, place)]
        if len(again):
            d, t, a, b = merged(doc[again], th[again], place[again] - far[again], place[again] - near[again] + LENGTH)
            own = _bucket(d, t, parts)
            o = np.argsort(own, kind="stable")
            for k, x, y in _deal(own[o], parts):
                out_bucket.append(k)
                blobs.append(_blob(1, d[o[x:y]], t[o[x:y]], a[o[x:y]], b[o[x:y]]))
        order = order[kept]
        low, high = near[order], far[order]
        bucket = (mix(h[order]) % np.uint64(parts)).astype(np.int64)
        frequent = np.zeros(len(order), bool)
        if len(hot):
            frequent = hot[np.minimum(np.searchsorted(hot, h[order]), len(hot) - 1)] == h[order]
        if frequent.any():
            i = order[frequent]
            order, low, high, bucket = [order[~frequent]], [low[~frequent]], [high[~frequent]], [bucket[~frequent]]
            for a, b in RANGES:
                own = i[(near[i] <= b) & (far[i] >= a)]
                order.append(own)
                low.append(np.maximum(near[own], a))
                high.append(np.minimum(far[own], b))
                bucket.append((mix(h[own] ^ mix(_row_hash(left[own, :a]) + _row_hash(right[own, : LENGTH - b]) * np.uint64(3) + np.uint64(a))) % np.uint64(parts)).astype(np.int64))
            order, low, high, bucket = (np.concatenate(x) for x in (order, low, high, bucket))
        o = np.argsort(bucket, kind="stable")
        order, low, high, bucket = order[o], low[o], high[o], bucket[o]
        for b, x, y in _deal(bucket, parts):
            by = sorted(range(y - x), key=[r.tobytes() for r in right[order[x:y]]].__getitem__)
            i = order[x:y][by]
            shared, rest = _front_coded(right[i])
            names, at = np.unique(np.stack([doc[i], th[i]], axis=1), axis=0, return_inverse=True)
            record = np.zeros(len(i), _RECORD)
            record["doc"], record["place"], record["near"], record["far"] = at.ravel(), place[i], low[x:y][by], high[x:y][by]
            out_bucket.append(b)
            blobs.append(_blob(0, names, record, shared, rest, left[i]))
        return pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "run"])

    for whole in batches:
        for batch in pieces(whole, "__text", CHUNK):
            data, offsets = utf8(batch.column(2))
            h, place, low, high, own = text_anchors(data, offsets)
            bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hit = (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
            h, place, low, high, own = (x[hit] for x in (h, place, low, high, own))
            if not len(h):
                continue
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
            context = mix((sums[high + LENGTH] - sums[low]) * powers(INVERSE, len(data) + 1)[low])
            padded = np.concatenate([np.zeros(SPAN, np.uint8), data, np.zeros(LENGTH, np.uint8)])
            right = sliding_window_view(padded, LENGTH)[place + SPAN]
            right[np.arange(LENGTH, dtype=np.int32) >= (offsets[own + 1] - place).clip(0, LENGTH).astype(np.int32)[:, None]] = 0
            left = sliding_window_view(padded, SPAN)[place][:, ::-1].copy()
            left[np.arange(SPAN, dtype=np.int32) >= (place - offsets[own]).clip(0, SPAN).astype(np.int32)[:, None]] = 0
            held.append((doc[own], th[own], h, place - offsets[own], place - high, place - low, context, left, right))
            size += len(h)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _blob(kind, *arrays):
    """Arrays as one compressed string."""
    parts = [bytes([kind])]
    for a in arrays:
        a = np.ascontiguousarray(a)
        packed = zlib.compress(a.tobytes(), 1)
        parts += [len(packed).to_bytes(4, "little"), packed]
    return b"".join(parts)


def _arrays(blob, *kinds):
    at, out = 1, []
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(np.frombuffer(zlib.decompress(blob[at + 4 : at + 4 + n]), kind))
        at += 4 + n
    return out


def _cursor(shared, full, base):
    """A run for the loser tree, read from its arrays as it goes."""
    for i, n in enumerate(shared.tolist()):
        yield n, full[i * LENGTH : (i + 1) * LENGTH], base + i


def _row_hash(rows):
    """A hash of the bytes of each row."""
    return mix((_BYTE_VALUES[rows] * powers(BASE, LENGTH)[: rows.shape[1]]).sum(axis=1, dtype=np.uint64))


def _marks(batches, parts):
    """Merge the runs of a bucket; doc, th and byte spans of what starts earlier elsewhere, dealt by document."""
    runs, doc, th, rec, left, out = [], [], [], [], [], []
    base = 0
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            if blob[0] == 1:
                out.append(_arrays(blob, *[np.int64] * 4))
                continue
            names, record, shared, rest, before = _arrays(blob, np.int64, _RECORD, np.uint8, np.uint8, np.uint8)
            names = names.reshape(-1, 2)
            runs.append(_cursor(shared, _full(shared, rest).tobytes(), base))
            doc.append(names[record["doc"], 0])
            th.append(names[record["doc"], 1])
            rec.append(record)
            left.append(before.reshape(-1, SPAN))
            base += len(record)
    if base:
        order, shared = np.empty(base, np.int64), np.empty(base, np.int64)
        for i, (s, value) in enumerate(LoserTree(runs).merge()):
            order[i], shared[i] = value, s
        runs.clear()
        doc, th, rec, left = (np.concatenate(x)[order] for x in (doc, th, rec, left))
        out.append(_judged(doc, th, rec, left, shared))
        del doc, th, rec, left, order, shared
    if out:
        d, t, a, b = merged(*(np.concatenate(x) for x in zip(*out, strict=True)))
        bucket = _bucket(d, t, parts)
        o = np.argsort(bucket, kind="stable")
        d, t, a, b = d[o], t[o], a[o], b[o]
        dealt = _deal(bucket[o], parts)
        blobs = [_blob(0, d[x:y], t[x:y], a[x:y], b[x:y]) for _, x, y in dealt]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in dealt], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "marks"])


def merged(doc, th, a, b):
    """The union of the spans [a, b) of each document: maximal runs, by document and in order."""
    o = np.lexsort((a, th, doc))
    doc, th, a, b = doc[o], th[o], a[o], b[o]
    new = np.ones(len(o), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    apart = np.cumsum(new) << 40  # no span of one document reaches the next one's
    a, b = covered(a + apart, b + apart)
    own = (a >> 40) - 1
    first = np.flatnonzero(new)[own]
    return doc[first], th[first], a - ((own + 1) << 40), b - ((own + 1) << 40)


def _bucket(doc, th, parts):
    """The bucket of a document."""
    return (mix(mix(doc.view(np.uint64)) ^ th.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def covered(a, b):
    """Union of spans [a, b): maximal runs, in order. Spans are sorted by a."""
    if not len(a):
        return a, b
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    return a[first], reach[np.r_[first[1:], len(a)] - 1]


def _same(i, j, doc, th, place):
    """Whether the records i and j are of the same place of the same document."""
    return (doc[i] == doc[j]) & (th[i] == th[j]) & (place[i] == place[j])


def _judged(doc, th, rec, left, shared):
    """Spans of starts whose string also starts earlier, for anchors in suffix order with the prefix each shares with the one before."""
    n = len(doc)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((rec["place"], th, doc))] = np.arange(n)
    by_rank = np.argsort(rank)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    before = np.zeros(n, np.uint64)
    place = rec["place"]
    for o in range(SPAN + 1):
        if o:
            before = mix(before * np.uint64(31) + left[:, o - 1] + np.uint64(1))
        own = (rec["near"] <= o) & (o <= rec["far"])
        if own.sum() < 2:
            continue
        # equal right parts are neighbours; equal left parts have equal hashes
        group = np.cumsum(shared < LENGTH - o).astype(np.uint64)
        i = by_rank[own[by_rank]]
        key = mix(group[i] * np.uint64(0x9E3779B97F4A7C15) ^ before[i])
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        i = i[~_same(i, i[first][at.ravel()], doc, th, place)]
        low[i] = np.minimum(low[i], place[i] - o)
        high[i] = np.maximum(high[i], place[i] - o)
    i = np.flatnonzero(high >= 0)
    return doc[i], th[i], low[i], high[i] + LENGTH


def removed(docs):
    """doc_id, text and spans array<struct<start,end>> (maximal runs of bytes that repeat an earlier 100-byte string) of each row of docs(doc_id, text).

    Documents are ordered by doc_id, those without one last, those with equal ones by a hash of the text; rows that
    repeat doc_id and text are one document. Matches never cross documents. Null and empty texts, and texts under 100
    bytes, lose nothing; an empty table stays empty; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = _columns(docs)
    size = docs.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, MOST_BUCKETS))
    bits = spark.sparkContext.broadcast(_repeated(docs, parts))
    runs = docs.mapInArrow(worker("suffixes")(lambda batches: _runs(batches, parts, bits)), "bucket int, run binary")
    marks = runs.repartitionById(parts, "bucket").mapInArrow(worker("suffixes")(lambda batches: _marks(batches, parts)), "bucket int, marks binary")

    @worker("suffixes")
    def place(batches):
        for batch in batches:
            bucket = _bucket(batch.column(0).to_numpy(), batch.column(1).to_numpy(), parts)
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), none, *(batch.column(i) for i in range(3))], names=["bucket", "marks", "doc", "th", "text"])

    @worker("suffixes")
    def cut(batches):
        held, found = [], {}
        for batch in batches:
            marks = [_arrays(x, *[np.int64] * 4) for x in batch.column(1).to_pylist() if x is not None]
            if marks:
                held += marks
            texts = batch.filter(batch.column(1).is_null())
            if not texts.num_rows:
                continue
            if held:
                d, t, a, b = merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
                begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
                found = {(int(d[x]), int(t[x])): (a[x:y], b[x:y]) for x, y in zip(begin, np.r_[begin[1:], len(d)].astype(np.int64), strict=True)}
            spans = [[{"start": int(x), "end": int(y)} for x, y in zip(*found.get(key, ((), ())), strict=True)] for key in zip(texts.column(2).to_pylist(), texts.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([texts.column(2), texts.column(4), pa.array(spans, kind)], names=["doc", "text", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    both = "bucket int, marks binary, doc long, th long, text string"
    marks = marks.select("bucket", "marks", *[F.lit(None).cast(k).alias(n) for n, k in (("doc", "long"), ("th", "long"), ("text", "string"))])
    rows = docs.mapInArrow(place, both).unionByName(marks).repartitionById(parts, "bucket")
    rows = rows.sortWithinPartitions(F.col("marks").isNull())  # a bucket's marks come before its texts
    out = rows.mapInArrow(cut, "doc long, text string, spans array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("doc") < (1 << 63) - 1, F.col("doc")).alias("doc_id"), "text", "spans")


def op4_suffix_dedup(spark, sf_dir):
    """The contract's digest of removed()."""
    found = removed(table(spark, sf_dir, "documents"))

    @worker("suffixes")
    def run(batches):
        for batch in batches:
            out: list = [[], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, kept, at = (text or "").encode(), hashlib.sha256(), 0
                for s in spans:
                    kept.update(data[at : s["start"]])
                    at = s["end"]
                kept.update(data[at:])
                for column, value in zip(out, (len(data), sum(s["end"] - s["start"] for s in spans), len(spans), kept.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def digest(rows):
    """The same by plain Python for [(doc_id, text)] with distinct ids: {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    seen: set = set()
    out = {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - LENGTH + 1):
            s = data[p : p + LENGTH]
            if s in seen:
                gone[p : p + LENGTH] = True
            seen.add(s)
        n_spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(gone) else b""
        out[doc_id] = (len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest())
    return out

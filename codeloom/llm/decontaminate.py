"""Benchmark decontamination by a broadcast hash set of test n-grams."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import carried, lower_ascii, pieces, scratch, table, tune, utf8, window_hashes, word_hashes, word_spans, worker

WINDOW = 13
#: Benchmark text that one broadcast holds at most, in bytes of its longest reading (lower-cased words and 20 bytes a window).
SLICE_BYTES = 8 << 20
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD_BYTES[128:] = True


class GramSet:
    """Windows of a benchmark slice: sorted hashes, and where each one's words stand in the normalised item text."""

    def __init__(self, items, window=WINDOW):
        ids, texts = [i for i, _ in items], [t for _, t in items]
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        data = lower_ascii(data)
        starts, ends, doc = word_spans(data, offsets, _WORD_BYTES)
        words = word_hashes(data, starts, ends)
        self.text = b" ".join(bytes(data[a:b]) for a, b in zip(starts, ends, strict=True))
        begin = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int64)  # of each word in self.text
        sizes = np.bincount(doc, minlength=len(ids))
        parts = []
        self.lengths = sorted({min(window, int(n)) for n in sizes if n})
        for k in self.lengths:
            first = np.arange(max(0, len(words) - k + 1))
            ok = doc[first] == doc[first + k - 1] if len(first) else np.zeros(0, bool)
            if len(first):
                ok &= np.minimum(sizes[doc[first]], window) == k
            first = first[ok]
            parts.append((window_hashes(words, k)[first], np.full(len(first), k), doc[first], begin[first], begin[first + k] - 1))
        hashes, k, item, a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.k, self.item, self.a, self.b = hashes[order], k[order].astype(np.int8), item[order].astype(np.int32), a[order], b[order]
        self.ids = ids
        self.bits = max(16, int(len(hashes) * 64).bit_length())
        self.bits = min(self.bits, 26)

    def mask(self):
        """A table over the first bits of a hash: whether any window starts so."""
        out = np.zeros(1 << self.bits, bool)
        out[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        return out

    def items_of(self, h, k, words):
        """Items that hold exactly these words as a window."""
        lo = int(np.searchsorted(self.hashes, h, "left"))
        found = set()
        while lo < len(self.hashes) and self.hashes[lo] == h:
            if self.k[lo] == k and self.text[self.a[lo] : self.b[lo]] == words:
                found.add(int(self.item[lo]))
            lo += 1
        return found


def scan_piece(column, grams, mask):
    """For each text: words, words hit, hit byte spans, item numbers."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    starts, ends, doc = word_spans(data, offsets, _WORD_BYTES)
    n_docs = len(offsets) - 1
    n_words = np.bincount(doc, minlength=n_docs)
    items: list[set] = [set() for _ in range(n_docs)]
    edge = np.zeros(len(starts) + 1, np.int64)
    words = word_hashes(data, starts, ends)
    known: dict = {}
    for k in grams.lengths:
        if len(words) < k:
            continue
        hashes = window_hashes(words, k)
        at = np.flatnonzero(mask[(hashes >> np.uint64(64 - grams.bits)).astype(np.int64)])
        at = at[doc[at] == doc[at + k - 1]]
        where = np.searchsorted(grams.hashes, hashes[at])
        at = at[(where < len(grams.hashes)) & (grams.hashes[np.minimum(where, len(grams.hashes) - 1)] == hashes[at])]
        for i in at:
            text = b" ".join([data[a:b].tobytes() for a, b in zip(starts[i : i + k], ends[i : i + k], strict=True)])
            hit = known.get((k, text))
            if hit is None:
                hit = known[k, text] = grams.items_of(hashes[i], k, text)
            if hit:
                items[doc[i]] |= hit
                edge[i] += 1
                edge[i + k] -= 1
    return n_words, *covered(starts, ends, doc, offsets, edge), items


def covered(starts, ends, doc, offsets, edge):
    """For each text: words hit, and byte spans of runs of them; edge has +1 at a hit window's first word and -1 after its last."""
    n_docs = len(offsets) - 1
    inside = np.cumsum(edge[:-1]) > 0
    spans: list[list] = [[] for _ in range(n_docs)]
    for i in np.flatnonzero(inside):
        a, b, own = int(starts[i] - offsets[doc[i]]), int(ends[i] - offsets[doc[i]]), spans[doc[i]]
        if own and inside[i - 1] and doc[i - 1] == doc[i]:
            own[-1]["end"] = b
        else:
            own.append({"start": a, "end": b})
    return np.bincount(doc[inside], minlength=n_docs), spans


def scan(docs, benchmark, keep=("doc_id",), window=WINDOW, slice_bytes=SLICE_BYTES):
    """docs(text, ...) with n_words, n_hit, spans (bytes of hit runs) and items (ids of items that occur), by row.

    The benchmark's windows are broadcast as sorted hashes with their words; its size is summed first. Beyond slice_bytes
    only a bit table of fixed size is broadcast: windows that it lets through meet the benchmark's by a join on their
    words, and texts that may have any are shuffled once. A hash hit counts only if the words are equal.
    Null texts have no words; repeated rows are scanned each; repeated items count by id; items
    without an id or words are dropped; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    tune(spark)
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    key = "long" if dict(items.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint") else "string"
    items = items.withColumn("item_id", F.col("item_id").cast(key))
    df = docs.select(*keep, docs["text"].alias("__text"))
    schema = ", ".join([f"`{df.schema[c].name}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["n_words long, n_hit long, spans array<struct<start:long,end:long>>", f"items array<{key}>"])
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64() if key == "long" else pa.string()))

    def rows(batch, *found):
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], names=[*keep, "n_words", "n_hit", "spans", "items"])

    if total > slice_bytes:
        return _scan_joined(df, items, key, window, schema, rows)
    shared = spark.sparkContext.broadcast(GramSet([tuple(r) for r in items.collect()], window))

    @worker("decontaminate")
    def run(batches):
        grams = shared.value
        mask = grams.mask()
        for whole in batches:
            for batch in pieces(whole, "__text"):
                n_words, n_hit, spans, found = scan_piece(batch.column(len(keep)), grams, mask)
                yield rows(batch, n_words, n_hit, spans, [sorted(grams.ids[i] for i in x) for x in found])

    return df.mapInArrow(run, schema)


#: Bits of the tables that are broadcast where the benchmark is too large to be: of window hashes, and of texts that may be hit.
BITMAP_BITS = 24


def _bits(spark, rows):
    """A broadcast bit table of fixed size from rows(bit)."""
    words = rows.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("v"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for w, v in words.toLocalIterator():
        out[w] = v
    return spark.sparkContext.broadcast(out)


def _has(table, bit):
    return (table[bit >> 6] >> (bit & 63)) & 1 == 1


def _scan_joined(df, items, key, window, schema, rows):
    """scan() for a benchmark of any size."""
    spark = df.sparkSession
    keep = df.columns[:-1]

    @worker("decontaminate")
    def windows(batches):
        for batch in batches:
            grams = GramSet(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), window)
            words = [grams.text[a:b] for a, b in zip(grams.a, grams.b, strict=True)]
            own = pa.array([grams.ids[i] for i in grams.item], batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([pa.array((grams.hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)), pa.array(grams.k.astype(np.int32)), pa.array(words, pa.binary()), own], names=["bit", "k", "words", "item"])

    known = items.mapInArrow(windows, f"bit long, k int, words binary, item {key}").groupBy("bit", "k", "words").agg(F.collect_set("item").alias("__own"))
    known = scratch(spark, known, "windows")
    lengths = sorted(r[0] for r in known.select("k").distinct().collect())
    bits = _bits(spark, known.select("bit").distinct())

    @worker("decontaminate")
    def find(batches):
        for whole in batches:
            for batch in pieces(whole, "__text"):
                data, offsets = utf8(batch.column(2))
                data = lower_ascii(data)
                starts, ends, doc = word_spans(data, offsets, _WORD_BYTES)
                words = word_hashes(data, starts, ends)
                first = np.searchsorted(doc, np.arange(len(offsets) - 1))
                for k in lengths:
                    at = np.flatnonzero(_has(bits.value, (window_hashes(words, k) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)))
                    at = at[doc[at] == doc[at + k - 1]]
                    text = [b" ".join([data[a:b].tobytes() for a, b in zip(starts[i : i + k], ends[i : i + k], strict=True)]) for i in at]
                    own = pa.array(doc[at])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(at - first[doc[at]]), pa.array(np.full(len(at), k, np.int32)), pa.array(text, pa.binary())], names=["__t1", "__t2", "i", "k", "words"])

    # a text is named by two hashes, so what is found holds for all rows that repeat it
    named = df.select("*", F.xxhash64("__text").alias("__t1"), F.xxhash64(F.lit(1), "__text").alias("__t2"))
    hits = named.select("__t1", "__t2", "__text").mapInArrow(find, "__t1 long, __t2 long, i long, k int, words binary").distinct()
    hits = hits.join(known.drop("bit"), ["k", "words"]).groupBy("__t1", "__t2").agg(F.collect_list(F.struct("i", "k")).alias("__at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__own")))).alias("__own"))
    hits = scratch(spark, hits, "hits")
    bit = F.pmod("__t1", F.lit(1 << BITMAP_BITS))
    marked = _bits(spark, hits.select(bit.alias("bit")).distinct())
    may = F.pandas_udf(lambda b: pd.Series(_has(marked.value, b.to_numpy())), "boolean")(bit)

    @worker("decontaminate")
    def judge(batches):
        for whole in batches:
            for batch in pieces(whole, "__text"):
                data, offsets = utf8(batch.column(len(keep)))
                starts, ends, doc = word_spans(lower_ascii(data), offsets, _WORD_BYTES)
                first, edge = np.searchsorted(doc, np.arange(len(offsets) - 1)), np.zeros(len(starts) + 1, np.int64)
                for d, found in enumerate(batch.column(len(keep) + 1).to_pylist()):
                    for w in found or ():
                        edge[first[d] + w["i"]] += 1
                        edge[first[d] + w["i"] + w["k"]] -= 1
                yield rows(batch, np.bincount(doc, minlength=len(offsets) - 1), *covered(starts, ends, doc, offsets, edge), [x or [] for x in batch.column(len(keep) + 2).to_pylist()])

    none = [F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("__at", "__own")]
    with_bit = named.withColumn("__may", F.coalesce(may, F.lit(False)))
    met = with_bit.where("__may").join(hits.hint("shuffle_hash"), ["__t1", "__t2"], "left").select(*keep, "__text", "__at", "__own")
    return with_bit.where("NOT __may").select(*keep, "__text", *none).unionByName(met).mapInArrow(judge, schema)


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs, benchmark, documents=True, **bounds):
    """docs without what the benchmark holds: without contaminated documents, or with hit spans cut from their texts.

    Every column stays under its name, whatever that is. Null and wordless texts stay as they are, as does all of docs if the
    benchmark is empty; repeated rows are judged each; no documents give none. A cut leaves what stands between the spans, blanks included.
    """
    renamed, names, back = carried(docs)
    if documents:
        return back(scan(renamed, benchmark, keep=names, **bounds).where(~contaminated()))
    found = scan(renamed, benchmark, keep=names, **bounds)
    at = names[docs.columns.index("text")]
    schema = found.schema

    @worker("decontaminate")
    def run(batches):
        for batch in batches:
            i, j = batch.schema.get_field_index(at), batch.schema.get_field_index("spans")
            texts = [cut(t, s) for t, s in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return back(found.mapInArrow(run, schema))


def cut(text, spans):
    """text without some spans of its bytes."""
    if not spans:
        return text
    data, edge = text.encode(), [0, *(x for s in spans for x in (s["start"], s["end"]))]
    return b"".join(data[a:b] for a, b in zip(edge[::2], [*edge[1::2], len(data)], strict=True)).decode()


def op3_decontaminate(spark, sf_dir):
    """The contract's digest of scan()."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, len(w) >= 13 AS whole, least(len(w), 13) AS k, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM g),
win AS (
  SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)
), hits AS (SELECT doc_id, p, win.k AS k, item_id FROM win JOIN g ON g.t = win.t AND g.k = win.k),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def digest(text, items):
    """n_words, n_hit, n_items, items_sha256, contaminated by plain Python, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item_id, t in items:
        w = split(t)
        k = min(len(w), WINDOW)
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item_id))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)

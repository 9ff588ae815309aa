"""Target-distribution importance resampling: hashed n-gram counts by DuckDB in each partition, merged and scored by Spark."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces, scratch, table, tune, worker

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, 0.1, 2024
#: Text bytes that one statement counts, and what DuckDB may take for it at least and for each byte of a longer text.
PIECE, LEAST_MEMORY, MEMORY_PER_BYTE = 4 << 20, 256 << 20, 100


def grams_sql(longest):
    """SQL that gives (r, n_words, n, buckets, counts) of the texts in piece(r, text): runs of up to so many words, hashed and counted."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = ["SELECT r, w AS gram FROM words"]
    for k in range(2, longest + 1):
        rest = ", ".join(f"lead(w, {i}) OVER t" for i in range(1, k))
        runs.append(f"SELECT r, CASE WHEN lead(w, {k - 1}) OVER t IS NOT NULL THEN concat_ws(' ', w, {rest}) END AS gram FROM words WINDOW t AS (PARTITION BY r ORDER BY i)")
    return rf"""
        WITH split AS (SELECT r, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM piece),
        words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
        grams AS ({" UNION ALL ".join(runs)}),
        counted AS (SELECT r, gram, count(*) AS c FROM grams WHERE gram IS NOT NULL GROUP BY r, gram),
        hashed AS (SELECT gram, bucket_of(gram) AS b FROM (SELECT DISTINCT gram FROM counted)),
        cells AS (SELECT r, b, sum(c)::BIGINT AS c FROM counted JOIN hashed USING (gram) GROUP BY r, b),
        lists AS (SELECT r, list(b ORDER BY b) AS buckets, list(c ORDER BY b) AS counts, sum(c)::BIGINT AS n FROM cells GROUP BY r)
        SELECT split.r, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
        FROM split LEFT JOIN lists USING (r) ORDER BY split.r
    """


def bucket_counts(docs, keep=(), longest=LONGEST, buckets=BUCKETS):
    """docs(text, ...) with n_words, n_features, buckets and counts: how often each bucket of hashed runs of words occurs in each text.

    A statement of an in-memory DuckDB database counts the rows of one piece of a partition; runs are hashed by zlib's
    CRC once for each distinct one. Null and empty texts have no words; repeated rows are counted each; an empty table stays
    empty; only the columns in keep go along.
    """
    own = [f"__k{i}" for i in range(len(keep))]
    sql = grams_sql(longest)

    @worker("resample")
    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.create_function(
            "bucket_of",
            lambda grams: pa.array([zlib.crc32(g.encode()) % buckets for g in grams.to_pylist()], pa.int32()),
            ["VARCHAR"], "INTEGER", type="arrow",
        )
        try:
            for whole in batches:
                for batch in pieces(whole, "text", PIECE):
                    text = batch.column(len(own))
                    con.execute(f"SET memory_limit = '{max(LEAST_MEMORY, MEMORY_PER_BYTE * text.nbytes) >> 20}MB'")
                    piece = pa.table({"r": pa.array(range(batch.num_rows), pa.int32()), "text": text})
                    con.register("piece", piece)
                    found = con.sql(sql).to_arrow_table().combine_chunks()
                    con.unregister("piece")
                    names = ["n_words", "n", "buckets", "counts"]
                    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                    made = [found.column(n).cast(t) for n, t in zip(names, types, strict=True)]
                    out = pa.table([*batch.columns[: len(own)], *made], names=[*own, "n_words", "n_features", "buckets", "counts"])
                    yield from out.combine_chunks().to_batches()
        finally:
            con.close()

    kinds = "".join(f"{o} {docs.schema[c].dataType.simpleString()}, " for c, o in zip(keep, own, strict=True))
    rows = docs.select(*[docs[c].alias(o) for c, o in zip(keep, own, strict=True)], docs["text"].cast("string").alias("text"))
    counted = rows.mapInArrow(run, kinds + "n_words long, n_features long, buckets array<int>, counts array<long>")
    return counted.select(*[F.col(o).alias(c) for c, o in zip(keep, own, strict=True)], "n_words", "n_features", "buckets", "counts")


def totals(counted):
    """bucket, n: a table's counts summed by bucket; tasks add up their own first, so at most a row for each bucket and task is shuffled."""
    return counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def bucket_gains(source, target, buckets=BUCKETS):
    """A thousand times the log ratio of each bucket's smoothed share in the target to that in the source, floored: a bounded list for the driver."""
    s, t = ({r[0]: r[1] for r in totals(x).collect()} for x in (source, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    spark = source.sparkSession
    rows = spark.createDataFrame([(b, float(s.get(b, 0)), float(t.get(b, 0))) for b in range(buckets)], "b int, s double, t double")
    ratio = ((F.col("t") + 1) * F.lit(float(all_s + buckets))) / ((F.col("s") + 1) * F.lit(float(all_t + buckets)))
    return [r[0] for r in rows.orderBy("b").select(F.floor(1000 * F.log(ratio)).cast("long")).collect()]


def drawn(scored, share):
    """scored(doc_id, n_words, score, ...) with rank: 1, 2, 3 .. by falling score, ties to the smaller doc_id, for that share of the eligible rows.

    Scores are integers of a bounded range (logs of counts and of 32-bit noise): their histogram gives the least score drawn and
    how many rows stand above each score. Only rows from that score on are shuffled, by score, and numbered within it; the noise spreads them, so no
    score holds more than one in 2,500 of different ids.
    """
    can = F.col("eligible")
    counts = scored.where(can).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    wanted = int(sum(r["n"] for r in counts) * round(share * 100) // 100)
    above, least, before = 0, None, []
    for r in counts:
        if above >= wanted:
            break
        before.append((r["score"], above))
        least, above = r["score"], above + r["n"]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    before = scored.sparkSession.createDataFrame(before, "score long, above long")
    in_score = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    top = scored.where(can & (F.col("score") >= least)).withColumn("__n", in_score).join(F.broadcast(before), "score")
    rank = F.col("above") + F.col("__n")
    top = top.withColumn("rank", F.when(rank <= wanted, rank)).select(*scored.columns, "rank")
    return top.unionAll(scored.where(~(can & (F.col("score") >= least))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs, target, share=SHARE, least_words=LEAST_WORDS, longest=LONGEST, buckets=BUCKETS, seed=SEED):
    """doc_id, n_features, weight, score and rank of docs(doc_id, text), a row each: a draw without replacement towards target(text).

    weight is the floored mean gain of a text's features, score that plus Gumbel noise from the hash of seed and doc_id, so that the
    highest scores are a draw by weight. Bucket counts of every document are written to the shared folder as Parquet by the only pass over texts;
    sums, gains, scores and ranks come from there.

    Null and empty texts have no features, weight 0 and aren't drawn; repeated rows score alike and take ranks next to each other; a null
    doc_id counts as empty text in the noise and comes last among ties; an empty table stays empty, an empty target is smoothed; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    counted = scratch(spark, bucket_counts(ids, ("doc_id",), longest, buckets), "resample-source")
    wanted = scratch(spark, bucket_counts(target.select("text"), (), longest, buckets), "resample-target")
    gains = F.split(F.lit(",".join(map(str, bucket_gains(counted, wanted, buckets)))), ",").cast("array<bigint>")
    summed = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.element_at(gains, b + 1) * c), F.lit(0).cast("long"), lambda a, b: a + b)
    mean = F.when(F.col("n_features") > 0, F.floor(summed / F.col("n_features"))).otherwise(0).cast("long")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = counted.select("doc_id", (F.col("n_words") >= least_words).alias("eligible"), "n_features", mean.alias("weight"), noise.alias("noise"))
    scored = scored.select("doc_id", "eligible", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))
    return drawn(scratch(spark, scored, "resample-scored"), share).drop("eligible")


def op13_resample(spark, sf_dir):
    """A tenth of the documents of at least 20 words, drawn towards the benchmark's words."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS b, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE k = 8),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, true AS doc FROM documents UNION ALL SELECT -row_number() OVER (), item_id, text, false FROM benchmark),
split AS (
  SELECT r, doc_id, doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
words AS (SELECT r, doc, unnest(ws) AS w FROM split),
per AS (SELECT r, doc, w, count(*) AS c FROM words GROUP BY r, doc, w),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::BIGINT + 1, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT w FROM per), crc),
sums AS (
  SELECT b, coalesce(sum(c) FILTER (doc), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (NOT doc), 0)::DOUBLE AS t FROM per JOIN hashed USING (w) GROUP BY b),
alls AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums),
gains AS (SELECT b, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM sums, alls),
weights AS (SELECT r, sum(c * gain)::BIGINT AS g, sum(c)::BIGINT AS n FROM per JOIN hashed USING (w) JOIN gains USING (b) WHERE doc GROUP BY r),
scored AS (
  SELECT split.r, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
         ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE AS h
  FROM split LEFT JOIN weights ON split.r = weights.r WHERE doc),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM noisy WHERE n_words >= 20),
size AS (SELECT 10 * count(*) // 100 AS wanted FROM ranked)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= wanted THEN rank END::BIGINT AS rank
FROM noisy LEFT JOIN ranked USING (r), size
"""

"""Ranked full-text search of symbols: an inverted index as a table, phrase-prefix terms, BM25."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import functions as F

from ..functions.predicates import is_test_rank

COLUMNS = ("name", "fqn", "doc", "words")
#: Latin letters and what they fold to; fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
K1, B = 1.2, 0.75


def folded(text):
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text):
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _count(found):
    """How many tokens; none of null."""
    return F.coalesce(F.size(F.coalesce(found, F.array().cast("array<string>"))), F.lit(0))


def keyed(symbols):
    """Symbols with a column row: the key that postings name them by."""
    return symbols.withColumn("row", F.xxhash64("file_id", "sym_id", "start_line", "start_col"))


def postings(symbols, keep=("row",), sized=False):
    """row, col, token, pos: one row for each token; row is the symbol's key. keep names other columns to go along; sized adds d, the symbol's number of tokens."""
    parts = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("t")) for c in COLUMNS])
    whole = symbols.select(*keep, parts.alias("parts"))
    d = [F.aggregate("parts", F.lit(0), lambda n, p: n + _count(p["t"])).alias("d")] if sized else []
    also = ["d"] if sized else []
    cols = whole.select(*keep, *d, F.explode("parts").alias("p")).select(*keep, *also, "p.col", F.posexplode("p.t").alias("pos", "token"))
    return cols.select(*keep, "col", "token", "pos", *also)


def stored(symbols):
    """The postings that a store keeps, with the file each is of, so that a run replaces those of changed files only, and its symbol's number of tokens."""
    return postings(keyed(symbols), ("file_id", "row"), sized=True)


def lengths(symbols):
    """file_id, rows, tokens: how many symbols and tokens a file has. Stored, they are all that ranking needs to know of symbols that don't match."""
    tokens_of = reduce(lambda a, b: a + b, [_count(tokens(F.col(c))) for c in COLUMNS])
    return symbols.groupBy("file_id").agg(F.count("*").alias("rows"), F.sum(tokens_of.cast("long")).alias("tokens"))


def terms(query: str):
    """Phrases of tokens; the last token of each is a prefix. A phrase of separators only matches nothing."""
    fields = [f for f in re.split(r"[ \"':\\()\[\]{}<>,;]", query) if f]
    if not fields:
        raise ValueError("empty query")
    fold = str.maketrans(ACCENTED, PLAIN)
    return [re.findall(r"[^\W_]+", f.lower().translate(fold)) for f in fields]


def phrase_hits(index, phrase):
    """row, f, d: how often a phrase occurs in any one column, and the row's length."""
    *whole, last = phrase
    found = index.where(F.col("token").startswith(last)).select("row", "col", (F.col("pos") - len(whole)).alias("at"), "d")
    for i, t in enumerate(whole):
        found = found.join(index.where(F.col("token") == t).select("row", "col", (F.col("pos") - i).alias("at")), ["row", "col", "at"], "left_semi")
    return found.groupBy("row").agg(F.count("*").alias("f"), F.first("d").alias("d"))


def _named(phrases):
    """Tokens that any phrase looks at."""
    fits = F.lit(False)
    for *whole, last in filter(None, phrases):
        fits = fits | F.col("token").startswith(last)
        if whole:
            fits = fits | F.col("token").isin(*whole)
    return fits


def ranked(index, query, sizes, held=None):
    """row, score of the rows that match all terms; lower scores are better. index has d; sizes is lengths() of all symbols, or (rows, tokens).

    Only postings of the query's tokens are read, once, and persisted: they are put into held, for the caller to release. Lengths of other
    symbols count by their stored sums.
    """
    phrases = terms(query)
    n, tokens_in_all = sizes if isinstance(sizes, tuple) else sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    average = tokens_in_all / max(1, n)
    own = index.where(_named(phrases)).select("row", "col", "token", "pos", "d").persist()
    if held is not None:
        held.append(own)
    out, counts = None, []
    for i, phrase in enumerate(phrases):
        hits = phrase_hits(own, phrase).withColumnRenamed("f", f"f{i}") if phrase else own.where("false").select("row", F.lit(0).alias(f"f{i}"), "d")
        counts.append(hits.count() if phrase else 0)
        out = hits if out is None else out.join(hits.drop("d"), "row")
    score = F.lit(0.0)
    for i, c in enumerate(counts):
        idf = math.log((n - c + 0.5) / (c + 0.5))
        score = score - F.lit(idf if idf > 0 else 1e-6) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("d") / average))
    return out.select("row", F.round(score, 12).alias("score"))


def search(symbols, files, query, kind="", name="", limit=50, offset=0, index=None, sizes=None):
    """(page of row, fqn, kind, path, score; total): project code first, then tests, then vendor; by rank within each. A page is
    an answer of at most limit rows, which is fetched. No limit: all from offset on, as a plan.

    index and sizes are what a store keeps, stored() and lengths(); left out, they are made here.
    """
    index = index if index is not None else postings(symbols, ("row",), sized=True)
    own, held = symbols, []
    if kind:
        own = own.where(F.col("kind") == kind)
    if name:
        own = own.where(F.col("name") == name)
    scores = ranked(index, query, sizes if sizes is not None else lengths(symbols), held)
    found = own.select("row", "file_id", "fqn", "kind").join(scores, "row").join(files.select("file_id", "path", "vendor"), "file_id")
    order = ("vendor", is_test_rank(F.col("path")), "score", "row")
    columns = ("row", "fqn", "kind", "path", "score")
    if limit is None:
        return found.orderBy(*order).offset(offset).select(*columns), found.count()
    held.append(found.persist())
    total = found.count()  # the matches are held, so the page costs no second search
    page = found.orderBy(*order).offset(offset).limit(limit).select(*columns)
    page = symbols.sparkSession.createDataFrame(page.collect(), page.schema)
    for df in held:
        df.unpersist()
    return page, total

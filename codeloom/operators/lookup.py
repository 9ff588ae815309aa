"""Symbol, outline and code lookups over symbols ⋈ files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import has_prefix, is_test_rank, line_matches
from ..functions.scalars import doc_summary, short_name_of, snippet
from ..schema import CLASS_KINDS, SYMBOL_COLUMNS
from .trigrams import candidates, required


def placed(symbols, files):
    """Symbols with the path and vendor flag of their file."""
    return symbols.join(files.select("file_id", "path", "vendor"), "file_id")


def hits(df):
    """The columns of a symbol hit; doc is its summary."""
    return df.withColumn("doc", doc_summary(F.col("doc"))).select(*SYMBOL_COLUMNS)


def exact(symbols, files, fqn, limit=20):
    """Declarations of a full name."""
    return hits(placed(symbols.where(F.col("fqn") == fqn), files).orderBy("path", "start_line").limit(limit))


def by_suffix(symbols, files, name, limit=20):
    """Declarations whose full name ends with a separator and name; project code first."""
    tails = [s + name for s in "\\./#"]
    if not name.endswith("()"):
        tails += [t + "()" for t in tails]
    fits = F.lit(False)
    for t in tails:
        fits = fits | F.lower("fqn").endswith(t.lower())
    found = placed(symbols.where((F.col("name") == short_name_of(name)) & fits), files)
    return hits(found.orderBy("vendor", "fqn", "path", "start_line").limit(limit))


def resolve(symbols, files, name):
    """The full name that is meant: itself if declared, else the first suffix match, else itself."""
    if symbols.where(F.col("fqn") == name).limit(1).count():
        return name
    found = by_suffix(symbols, files, name, 1).collect()
    return found[0]["fqn"] if found else name


def members(symbols, files, container, limit=500):
    return hits(placed(symbols.where(F.col("container") == container), files).orderBy("start_line", "fqn", "path").limit(limit))


def outline(symbols, files, path, limit=1000):
    """Symbols of a file in order."""
    return hits(placed(symbols, files.where(F.col("path") == path)).orderBy("start_line", "fqn").limit(limit))


def by_names(symbols, files, names, limit=50):
    """Project symbols outside tests of given short names; classes first."""
    found = placed(symbols.where(F.col("name").isin(*list(names)[:50])), files).where(~F.col("vendor") & ~is_test_rank(F.col("path")))
    return hits(found.orderBy(F.desc(F.col("kind").isin(*CLASS_KINDS)), "fqn", "path", "start_line").limit(limit))


def search_code(files, contents, pattern, regex=False, path_prefix="", limit=50, index=None):
    """file, line, text of matching lines of project files. One row beyond limit tells that there are more.

    contents is path, content, or a function that gives it for files(path). With trigram postings index(path or file_id, gram) only the
    texts that hold what the pattern requires are read and split into lines.
    """
    own = files.where(~F.col("vendor"))
    if path_prefix:
        own = own.where(has_prefix(F.col("path"), path_prefix))
    if index is not None:
        key = "file_id" if "file_id" in index.columns else "path"
        found = candidates(index, required(pattern, regex), key)
        if found is not None:
            own = own.join(found, key, "left_semi")
    own = own.select("path")
    texts = contents(own) if callable(contents) else contents.join(own, "path", "left_semi")
    lines = texts.select("path", F.posexplode(F.split("content", "\n")).alias("at", "raw"))
    found = lines.where(line_matches(F.col("raw"), pattern, regex)).select(F.col("path").alias("file"), (F.col("at") + 1).alias("line"), snippet(F.col("raw")).alias("text"))
    return found.orderBy("file", "line").limit(limit + 1)


def stats(files, symbols):
    return files.agg(F.count("*").alias("files")).crossJoin(symbols.agg(F.count("*").alias("symbols")))


def source_counts(ext_edges):
    return ext_edges.groupBy("source").agg(F.count("*").alias("n"))


def language_counts(files):
    return files.where(~F.col("vendor")).groupBy("lang").agg(F.count("*").alias("n"))


def project_paths(files, prefix=""):
    own = files.where(~F.col("vendor"))
    return (own.where(has_prefix(F.col("path"), prefix)) if prefix else own).select("path").orderBy("path")

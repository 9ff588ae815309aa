"""Extraction as a table function: one file in, one row of nested symbols, imports and edges out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.scalars import split_words
from ..schema import FILE_INDEX
from . import golang, php, ts

#: Extension to (language, parser); register() adds one.
LANGUAGES = {".php": ("php", php.extract), ".go": ("go", golang.extract)} | {e: ("typescript" if e.startswith(".ts") else "javascript", ts.extract) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")}


def register(extension, language, parser):
    """Another language: parser(path, text, shallow, modules) gives rows and whether the file has errors."""
    LANGUAGES[extension] = (language, parser)


def language_of(path):
    dot = path.rfind(".")
    return LANGUAGES.get(path[dot:].lower()) if dot >= 0 else None


def extract_file(path, text, shallow=False, modules=None):
    """One file's index as a dict, or None for an unknown extension. modules is {'go': {root: module}, 'js': {name: root}}."""
    found = language_of(path)
    if found is None:
        return None
    language, parser = found
    rows, broken = parser(path, text, shallow, (modules or {}).get("go" if language == "go" else "js", {}))
    return {"path": path, "lang": language, "has_errors": broken, "symbols": rows.symbols, "imports": rows.imports, "edges": rows.edges}


_SYMBOL = pa.struct([(n, pa.string()) for n in ("kind", "name", "fqn", "container")] + [(n, pa.int32()) for n in ("start_line", "start_col", "end_line", "end_col")] + [("signature", pa.string()), ("doc", pa.string())])
_IMPORT = pa.struct([(n, pa.string()) for n in ("alias", "fqn", "kind")])
_EDGE = pa.struct([("from_fqn", pa.string()), ("kind", pa.string()), ("to_fqn", pa.string()), ("resolved", pa.bool_()), ("line", pa.int32())])
_ARROW = pa.schema([("path", pa.string()), ("lang", pa.string()), ("vendor", pa.bool_()), ("has_errors", pa.bool_()), ("symbols", pa.list_(_SYMBOL)), ("imports", pa.list_(_IMPORT)), ("edges", pa.list_(_EDGE))])


def extract(files, modules=None, keep=()):
    """Rows of FILE_INDEX from files(path, content, vendor); vendor files give declarations and hierarchy only.

    No file needs another, so there is no shuffle; modules is a project's handful of roots. Columns of strings that keep names go along.
    """
    schema = pa.schema([*_ARROW, *((k, pa.string()) for k in keep)])

    def run(batches):
        for batch in batches:
            out = []
            for path, content, vendor, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content or ""
                found = extract_file(path, text, bool(vendor), modules)
                if found:
                    out.append(found | {"vendor": bool(vendor)} | dict(zip(keep, more, strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content", "vendor", *keep).mapInArrow(run, FILE_INDEX + "".join(f", `{k}` STRING" for k in keep))


def tables(index):
    """symbols, imports and edges as flat tables with the file's id; index is what extract() gave."""
    own = index.withColumn("file_id", F.xxhash64("path"))
    symbols = own.select("file_id", "lang", F.explode("symbols").alias("s")).select("file_id", F.concat("lang", F.lit(":"), "s.fqn").alias("sym_id"), "lang", "s.*").withColumn("words", split_words(F.col("name")))
    imports = own.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.*")
    edges = own.select("file_id", F.explode("edges").alias("e")).select("file_id", "e.*")
    return symbols, imports, edges

"""The ten questions and their envelopes: limits clamped, names resolved, rows as plain dicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.scalars import source_window
from .operators import fts, graph, lookup


def clamp(n, default=50, most=500):
    """A limit: the default where it is missing or not positive, most at most."""
    return default if not n or n <= 0 else min(n, most)


def reset(n, default, most):
    """A limit that falls back to its default where it is out of bounds."""
    return default if not n or n <= 0 or n > most else n


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


class Graph:
    """Questions to one snapshot: files, symbols, edges, ext_edges, and for what reads source contents(path, content) or a function that gives it for files(path)."""

    def __init__(self, tables, contents=None):
        self.files, self.symbols = tables["files"], tables["symbols"]
        self.edges = graph.all_edges(tables["edges"], tables["files"], tables["ext_edges"])
        self.ext_edges, self.contents = tables["ext_edges"], contents
        self.labels = tables.get("ancestors")
        self.postings, self.lengths, self.trigrams = tables.get("postings"), tables.get("lengths"), tables.get("trigrams")

    def name(self, fqn):
        return lookup.resolve(self.symbols, self.files, fqn)

    def index(self):
        """Symbols by key, and their postings: the stored ones, or made here if the tables have none."""
        keyed = fts.keyed(self.symbols)
        return keyed, self.postings if self.postings is not None else fts.postings(keyed, sized=True)

    def search_symbols(self, query, kind="", name="", limit=0, offset=0):
        keyed, postings = self.index()
        page, total = fts.search(keyed, self.files, query, kind, name, clamp(limit), max(offset, 0), postings, self.lengths)
        found = rows(page)
        return {"results": found, "total": total, "truncated": offset > 0 or total > len(found)}

    def _declarations(self, fqn, limit=20):
        found = lookup.exact(self.symbols, self.files, fqn, limit)
        hits = rows(found)
        return hits or rows(lookup.by_suffix(self.symbols, self.files, fqn, limit))

    def _source(self, hit, offset, most):
        if self.contents is None:
            return None
        own = self.files.where(F.col("path") == hit["path"]).select("path")
        text = self.contents(own) if callable(self.contents) else self.contents.where(F.col("path") == hit["path"])
        text = text.where("content IS NOT NULL").select(source_window(F.col("content").cast("string"), F.lit(hit["start_line"]), F.lit(hit["end_line"]), offset, most).alias("s")).first()
        if text is None:
            raise LookupError(f"stale index: {hit['path']} is gone")
        if text["s"] is None:
            raise ValueError("the offset lies past the declaration's end")
        return text["s"]

    def get_symbol(self, fqn, include_source=False, source_offset=0):
        out = []
        for hit in self._declarations(fqn):
            members = rows(lookup.members(self.symbols, self.files, hit["fqn"])) if hit["kind"] in ("class", "interface", "trait", "enum") else []
            out.append(hit | {"members": members} | ({"source": self._source(hit, source_offset, 200)} if include_source else {}))
        return {"declarations": out}

    def _edges(self, df, limit):
        found = rows(df)
        return {"edges": found, "truncated": len(found) >= limit}

    def find_references(self, fqn, limit=0, path_prefix="", exclude_tests=False):
        n = clamp(limit)
        return self._edges(graph.references(self.edges, self.name(fqn), n, path_prefix, exclude_tests), n)

    def get_callers(self, fqn, limit=0, path_prefix="", exclude_tests=False):
        n = clamp(limit)
        return self._edges(graph.callers(self.edges, self.name(fqn), n, path_prefix, exclude_tests, self.labels), n)

    def get_callees(self, fqn, limit=0):
        n = clamp(limit)
        return self._edges(graph.callees(self.edges, self.name(fqn), n), n)

    def class_hierarchy(self, fqn):
        found = rows(graph.hierarchy(self.edges, self.name(fqn), self.labels))
        pick = lambda d: [{"fqn": r["fqn"], "kind": r["kind"]} for r in found if r["direction"] == d]
        return {"ancestors": pick("ancestor"), "descendants": pick("descendant")}

    def explore(self, fqn, skip_source=False, max_edges=0):
        n, own = reset(max_edges, 15, 100), self.name(fqn)
        out = []
        for hit in self._declarations(own, 3):
            out.append(hit | {"members": rows(lookup.members(self.symbols, self.files, hit["fqn"]))} | ({} if skip_source or self.contents is None else {"source": self._source(hit, 0, 120)}))
        relatives = self.class_hierarchy(own)
        count = graph.reference_count(self.edges, own).first()["n"]
        return {"declarations": out, "callers": self.get_callers(own, n)["edges"], "callees": self.get_callees(own, n)["edges"], "ancestors": relatives["ancestors"], "descendants": relatives["descendants"][:50], "references": count}

    def search_code(self, query, regex=False, path_prefix="", limit=0):
        n = reset(limit, 50, 200)
        found = rows(lookup.search_code(self.files, self.contents, query, regex, path_prefix, n, self.trigrams))
        return {"matches": found[:n], "truncated": len(found) > n}

    def impact(self, fqn, depth=0, per_level=0):
        own = self.name(fqn)
        callers, tests, cut = graph.impact(self.edges, own, reset(depth, 3, 5), reset(per_level, 25, 200), hold=False)
        found, levels = rows(callers), {}
        for r in found:
            levels.setdefault(r["depth"], []).append({k: r[k] for k in ("fqn", "file", "line")})
        tests, note = graph.affected_tests(self.edges, own, tests)
        files = [r["file"] for r in rows(tests)]
        note = note if files else ""
        return {"levels": [{"depth": d, "callers": c} for d, c in sorted(levels.items())], "tests": files, "truncated": cut, "note": note}

    def file_outline(self, path):
        found = rows(lookup.outline(self.symbols, self.files, path))
        if not found:
            raise LookupError(f"no symbols in {path}")
        return {"symbols": found}

    def status(self):
        """Counts, and a warning where PHP files have no layer from an analyser."""
        languages = {r["lang"]: r["n"] for r in lookup.language_counts(self.files).collect()}
        layers = {r["source"]: r["n"] for r in lookup.source_counts(self.ext_edges).collect()}
        return rows(lookup.stats(self.files, self.symbols))[0] | {"languages": languages, "layers": layers, "warning": "PHP calls are heuristic: no analyser layer is imported" if languages.get("php") and not layers.get("phpstan") else ""}

    def hints(self, prompt):
        """Symbols that a prompt names, at most five."""
        from .functions.scalars import identifier_candidates

        names = self.files.sparkSession.range(1).select(identifier_candidates(F.lit(prompt)).alias("n")).first()["n"]
        return rows(lookup.by_names(self.symbols, self.files, names, 5)) if names else []

"""Matches and levels without a limit."""

from codeloom.operators import fts, graph
from codeloom.plans import queries


def test_search_without_limit(spark):
    symbols = spark.createDataFrame([(i, f"a.User_{i}", f"User_{i}", "class", 1, None, f"User_{i}") for i in range(70)], "row long, fqn string, name string, kind string, file_id long, doc string, words string")
    files = spark.createDataFrame([(1, "a.php", False)], "file_id long, path string, vendor boolean")
    page, total = fts.search(symbols, files, "user", limit=None)
    assert page.count() == total == 70
    assert fts.search(symbols, files, "user", limit=None, offset=60)[0].count() == 10


def test_impact_without_limit(spark):
    rows = [(f"c{i}", "calls", "a", "s.php", i, True, "ast") for i in range(40)] + [("d", "calls", "c39", "s.php", 50, True, "ast")]
    edges = spark.createDataFrame(rows, "from_fqn string, kind string, to_fqn string, file string, line int, resolved boolean, source string")
    callers, _, cut = graph.impact(edges, "a", 3, None)
    assert sorted(r["depth"] for r in callers.collect()) == [1] * 40 + [2] and not cut


def test_queries_pass_no_limit(monkeypatch):
    met = []
    monkeypatch.setattr(queries, "_indexed", lambda *_: (None, None))
    monkeypatch.setattr(queries, "load", lambda *_: None)
    monkeypatch.setattr(queries.fts, "search", lambda *_, limit=50, **__: met.append(limit) or 1 / 0)
    monkeypatch.setattr(queries.graph, "impact", lambda edges, fqn, depth, per_level=25: met.append(per_level) or 1 / 0)
    for name in ("l01_search_symbols", "g09_impact", "g09_impact_tests"):
        try:
            queries.QUERIES[name](None, "")
        except ZeroDivisionError:
            pass
    assert met == [None] * 3

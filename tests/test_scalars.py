"""Scalars against plain statements of their rules, and full-text search against SQLite's."""

import re
import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import paths, scalars
from codeloom.operators import enrich, fts, graph

TEXT = st.text(alphabet="aBcD09_-.\\/:#$()", max_size=14)


def split_plain(s):
    out = ""
    for i, c in enumerate(s):
        p, n = s[i - 1 : i], s[i + 1 : i + 2]
        if c in "_-":
            out += " "
            continue
        up, low, dig = str.isupper, str.islower, str.isdigit
        if i and (up(c) and (low(p) or dig(p) or up(p) and n and low(n)) or dig(c) and not dig(p)):
            out += " "
        out += c.lower()
    return out


@settings(max_examples=3, deadline=None)
@given(st.lists(TEXT, min_size=150, max_size=300))
def test_names(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "s string").select("s", scalars.split_words(F.col("s")).alias("w"), scalars.short_name(F.col("s")).alias("n"), scalars.method_split(F.col("s")).alias("m")).collect()
    for r in rows:
        assert r["w"] == split_plain(r["s"]), r["s"]
        assert r["n"] == scalars.short_name_of(r["s"]), r["s"]
        want = scalars.method_split_of(r["s"])
        assert (tuple(r["m"]) if r["m"] else None) == want, r["s"]


def test_docs_and_windows(spark):
    doc = "/**\n * @param x\n *  Does it. */\n"
    one = spark.range(1)
    assert one.select(scalars.doc_summary(F.lit(doc))).first()[0] == "Does it."
    assert one.select(scalars.doc_summary(F.lit(doc), both_ends=False)).first()[0] == "Does it. */"
    window = lambda offset, most: one.select(scalars.source_window(F.lit("a\nb\nc\nd\ne"), F.lit(2), F.lit(4), offset, most)).first()[0]
    assert window(0, 10) == "b\nc\nd" and window(1, 10) == "c\nd" and window(3, 10) is None
    assert window(0, 2) == "b\nc\n// … truncated at line 3 — call again with sourceOffset=2 …"
    assert one.select(scalars.snippet(F.lit("  " + "x" * 300))).first()[0] == "x" * 200 + "…"
    assert one.select(scalars.identifier_candidates(F.lit("fix getUser and user_id or plain, getUser"))).first()[0] == ["getUser", "user_id"]
    assert one.select(paths.package_path(F.lit("a/b/c.go"), {".": "m", "a": "n"})).first()[0] == "n/b"


def test_normalize(spark):
    indexed = spark.createDataFrame([("a/b.go",), ("src/x.php",)], "path string")
    cases = {"/p/a/b.go": "a/b.go", "/app/src/x.php": "src/x.php", "src/x.php": "src/x.php", "zzz.php": "zzz.php", "/a/b.go": "/a/b.go", "": ""}
    got = enrich.normalize_paths(spark.createDataFrame([(c,) for c in cases], "p string"), indexed, "/p").collect()
    assert {r["p"]: r["path"] for r in got} == cases


def test_search_equals_sqlite(spark):
    names = ["UserService", "user_repo", "find_user", "OrderService", "order", "Über", "a.b", "getUserById", "HTTPServer2", "x"] * 6
    rows = [(i, n + (str(i) if i > 9 else ""), f"App\\{n}.{i}()", f"the {n} number {i % 5}") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "row long, name string, fqn string, doc string").withColumn("words", scalars.split_words(F.col("name"))).withColumn("file_id", F.col("row") % 7)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, fqn, doc, words)")
    for r in df.drop("file_id").orderBy("row").collect():
        con.execute("INSERT INTO t(rowid, name, fqn, doc, words) VALUES (?, ?, ?, ?, ?)", tuple(r))
    index = fts.postings(df, sized=True).cache()
    for query in ("user", "serv numb", "app.user", "uber", "order 3", "get user", "a.b", "http"):
        match = " ".join(f'"{f}"*' for f in re.split(r"[ \"':\\()\[\]{}<>,;]", query) if f)
        want = dict(con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (match,)).fetchall())
        got = {r["row"]: r["score"] for r in fts.ranked(index, query, fts.lengths(df)).collect()}
        assert got.keys() == want.keys(), query
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got), query


def test_limits_and_levels(spark):
    e = [("b", "calls", "a"), ("c", "calls", "a"), ("d", "calls", "b"), ("a", "calls", "d"), ("t", "calls", "b"), ("", "calls", "a")]
    rows = [(f, k, t, "tests/t.php" if f == "t" else "s.php", i, True, "ast") for i, (f, k, t) in enumerate(e)]
    edges = spark.createDataFrame(rows, "from_fqn string, kind string, to_fqn string, file string, line int, resolved boolean, source string")
    callers, tests, cut = graph.impact(edges, "a", 3, 25)
    assert [(r["depth"], r["fqn"]) for r in callers.collect()] == [(1, "b"), (1, "c"), (2, "d")] and not cut
    assert [r["file"] for r in tests.collect()] == ["tests/t.php"]
    callers, _, cut = graph.impact(edges, "a", 3, 1)
    assert [(r["depth"], r["fqn"]) for r in callers.collect()] == [(1, "b"), (2, "d")] and cut
    twins = spark.createDataFrame([("x", "calls", "y", "f", 1, False, "ast"), ("x", "calls", "y", "f", 1, True, "phpstan"), ("z", "calls", "y", "f", 2, True, "ast")], edges.schema)
    assert [(r["from_fqn"], r["resolved"]) for r in graph.references(twins, "y", 2).collect()] == [("x", True), ("z", True)]

"""The edges as Spark makes them against the text that SQL runs, on odd tables."""

import re

import duckdb
import pytest

from codeloom.plans import projection, queries
from codeloom.plans.projection import EDGES, load

TABLES = {
    "region": ("r_regionkey INT, r_name VARCHAR", "(0, 'ASIA'), (1, 'AFRICA'), (1, 'TWICE'), (2, NULL)"),
    "nation": ("n_nationkey INT, n_name VARCHAR, n_regionkey INT", "(0, 'CHINA', 0), (1, 'KENYA', 1), (2, NULL, 2), (3, 'LOST', 9)"),
    "customer": ("c_custkey BIGINT, c_nationkey INT", "(1, 0), (2, 1), (3, 9), (NULL, 0)"),
    "supplier": ("s_suppkey BIGINT, s_nationkey INT", "(1, 0), (2, 1), (3, 0), (3, 1), (6, 2), (7, NULL), (NULL, 0)"),
    "part": ("p_partkey BIGINT", "(1)"),
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT", "(1, 1), (2, NULL), (99, NULL), (3, 2), (3, 2), (4, 5), (-4, 1), (NULL, 1)"),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber BIGINT, l_returnflag VARCHAR",
        "(1, 1, 1, 1, 'R'), (1, 1, 1, 1, 'R'), (1, 1, 2, 1, 'N'), (1, 2, 3, 2, NULL), (2, 5, 1, 1, 'R'), (99, 5, 2, 1, 'A'), (3, 4, 6, 1, 'R'), (3, NULL, 7, 2, 'R'), (4, NULL, 1, NULL, 'R'),"
        " (-4, 1, 3, 1, 'R'), (5, 1, 1, 1, 'R'), (NULL, 1, 1, 1, 'R'), (1, 1, NULL, 3, 'R')",
    ),
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    for name, (columns, rows) in TABLES.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.execute(f"INSERT INTO {name} VALUES {rows}")
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, con


def test_edges_of_odd_tables(spark, odd):
    folder, con = odd
    edges = load(spark, folder, "g_edges")
    want = con.execute(f"SELECT {', '.join(edges.columns)} FROM ({EDGES})").fetchall()
    assert sorted(map(repr, map(tuple, edges.collect()))) == sorted(map(repr, want)) and len(want) > 20


def test_edges_are_dealt_by_no_name(spark, odd, capsys):
    """Equal instantiations meet by their order, which the join has dealt already, and not by names made of it."""
    load(spark, odd[0], "g_edges").explain()
    plan = capsys.readouterr().out
    assert "lineitem" in plan and "hashpartitioning(from_fqn" not in plan


def test_a_target_is_looked_for_before_orders_are_met(spark, odd, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    load(spark, odd[0], "g_edges").where("kind = 'calls' AND to_fqn = 'geo.CHINA.supply()'").explain()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "SortMergeJoin [l_orderkey" in line]
    tests = [line for line in plan.splitlines() if "Filter" in line and "CASE WHEN" in line and "n_name" in line] + [line for line in plan.splitlines() if "SortMergeJoin" in line and "CASE WHEN" in line]
    assert joins and tests and min(len(line) - len(line.lstrip(" :|+-*()0123456789")) for line in tests) > max(len(line) - len(line.lstrip(" :|+-*()0123456789")) for line in joins)


def test_layers_of_odd_tables(spark, odd):
    folder, con = odd
    layers = load(spark, folder, "g_layers")
    want = con.execute(f"SELECT {', '.join(layers.columns)} FROM ({EDGES}) WHERE source <> 'ast'").fetchall()
    assert sorted(map(repr, map(tuple, layers.collect()))) == sorted(map(repr, want)) and len(want) > 5


def test_parts_follow_the_lines(spark, odd, monkeypatch):
    folder, con = odd
    assert projection.parts(spark, folder) is None
    monkeypatch.setattr(projection, "LINES", 1)
    n = projection.parts(spark, folder)
    assert n == con.execute("SELECT count(*) FROM lineitem").fetchone()[0] > spark.sparkContext.defaultParallelism
    edges = load(spark, folder, "g_edges", parts=n)
    want = con.execute(f"SELECT {', '.join(edges.columns)} FROM ({EDGES})").fetchall()
    assert sorted(map(repr, map(tuple, edges.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["a10_dedupe", "a11_extraction_dedupe", "u01_all_edges"])
def test_memory_of_a_task_is_bounded_by_parts(spark, odd, monkeypatch, capsys, name):
    """Lines meet orders, and equal edges each other, in parts by the number of lines and not by Spark's setting."""
    monkeypatch.setattr(projection, "LINES", 1)
    odd[1].execute(f"COPY (SELECT CAST(1 AS BIGINT) AS doc_id, 'x' AS source, 'en' AS lang, CAST(1 AS BIGINT) AS n_chars) TO '{odd[0]}/documents.parquet' (FORMAT parquet)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    queries.QUERIES[name](spark, odd[0]).explain()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    dealt = re.findall(r"hashpartitioning\(([lo]_orderkey|file|from_fqn)#.*?, (\d+)\)", plan)
    assert {k for k, _ in dealt} >= {"l_orderkey", "o_orderkey"} | ({"file"} if "a11" in name else {"from_fqn"} if "a10" in name else set())
    assert {int(n) for _, n in dealt} <= {13, 26}

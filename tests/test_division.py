"""Relational division against brute force over all of part."""

import os
from collections import defaultdict

import pytest

from codeloom.plans import queries

DATA = os.environ.get("CODELOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_division_reads_every_interface(spark):
    read = lambda t, *c: spark.read.parquet(f"{DATA}/{t}.parquet").select(*c).collect()
    customer = dict(map(tuple, read("orders", "o_orderkey", "o_custkey")))
    types, faces = defaultdict(set), defaultdict(set)
    for order, part in read("lineitem", "l_orderkey", "l_partkey"):
        types[f"T{customer[order]}"].add(part)
    for part, size in read("part", "p_partkey", "p_size"):
        faces[f"I{part - part % (1 + size % 3)}"].add(part)
    assert {len(x) for x in faces.values()} == {1, 2, 3} and max(max(x) for x in faces.values()) >= 90
    got = [tuple(x) for x in queries.QUERIES["g14_implements_division_whole"](spark, DATA).select("from_fqn", "to_fqn").collect()]
    assert sorted(got) == sorted((t, i) for t, own in types.items() for i, need in faces.items() if need <= own)

"""Path and edge predicates as columns. LIKE tests ignore the case of ASCII letters unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_like(path: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.ilike(p)
    return out


#: What counts as a test file where.
RANK_TESTS = ("tests/%", "%/tests/%", "%/Tests/%")
EXCLUDED_TESTS = (*RANK_TESTS, "%/__tests__/%", "%_test.go", "%.test.ts", "%.test.tsx")
REFERENCING_TESTS = (*RANK_TESTS, "%/__tests__/%", "%_test.go", "%.test.%")


def is_test_rank(path: Column) -> Column:
    """Tests that rank after other code in searches."""
    return _any_like(path, RANK_TESTS)


def is_test_excluded(path: Column) -> Column:
    """Tests that an edge filter leaves out; _ is a wildcard."""
    return _any_like(path, EXCLUDED_TESTS)


def is_test_impact(path: Column) -> Column:
    """Tests that end an impact walk; letters' case counts."""
    return path.startswith("tests/") | path.contains("/tests/") | path.contains("/Tests/") | path.contains("/__tests__/") | path.endswith("_test.go") | path.contains(".test.")


def is_test_referencing(path: Column) -> Column:
    """Tests that can be listed as referencing a symbol."""
    return _any_like(path, REFERENCING_TESTS)


def has_prefix(path: Column, prefix: str) -> Column:
    return F.lower(path).startswith(prefix.lower())


def edge_filter(edges, path_prefix: str = "", exclude_tests: bool = False):
    """Edges of files under a prefix, without tests if asked."""
    if path_prefix:
        edges = edges.where(has_prefix(F.col("file"), path_prefix))
    return edges.where(~is_test_excluded(F.col("file"))) if exclude_tests else edges


#: Folders of other people's code.
VENDOR_FOLDERS = frozenset(("vendor", "node_modules"))


def in_vendor(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, sorted(VENDOR_FOLDERS))))


def proper_edge(source: Column, target: Column) -> Column:
    """No empty target, no self edge."""
    return (target != "") & (target != source)


def line_matches(line: Column, pattern: str, regex: bool) -> Column:
    """A regular expression, unanchored and case-sensitive, or a literal in any case."""
    return line.rlike(pattern) if regex else F.lower(line).contains(pattern.lower())

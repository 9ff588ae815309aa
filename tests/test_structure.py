"""Labels, method sets, containment and package paths against plain versions on random graphs."""

import random

import pytest

from codeloom.functions.paths import package_paths
from codeloom.operators import incremental, labels, methods


def plain_ancestors(steps):
    """node, ancestor, depth, and the least kinds of the first and last step of the ways of that length."""
    up = {}
    for a, b, k in steps:
        up.setdefault(a, []).append((b, k))
    out = set()
    for start in up:
        level, seen, depth = {start: ""}, set(), 0
        while level:
            depth += 1
            following, last = {}, {}
            for x, first in level.items():
                for y, k in up.get(x, []):
                    if y not in seen:
                        following[y] = min(following.get(y, "z"), first or k)
                        last[y] = min(last.get(y, "z"), k)
            seen |= set(following)
            out |= {(start, y, depth, f, last[y]) for y, f in following.items()}
            level = following
    return out


def random_steps(r, n, m):
    return {(f"c{r.randrange(n)}", f"c{r.randrange(n)}", r.choice(["extends", "implements", "uses_trait"])) for _ in range(m)}


def labelled(spark, steps):
    return spark.createDataFrame(sorted(steps), "src string, dst string, kind string")


@pytest.mark.parametrize("n,m,drop,add,reach", [(12, 14, 3, 3, 32), (30, 30, 5, 2, 4), (8, 20, 4, 4, 2)])
def test_labels_and_their_upkeep(spark, monkeypatch, n, m, drop, add, reach):
    monkeypatch.setattr(labels, "REACH", reach)
    r = random.Random(n)
    near = lambda steps: {x for x in plain_ancestors(steps) if x[2] <= reach}
    steps = random_steps(r, n, m)
    found = labels.ancestors(labelled(spark, steps))
    assert set(map(tuple, found.collect())) == near(steps)
    assert set(map(tuple, labels.complete(found).collect())) == plain_ancestors(steps)
    later = (steps - set(r.sample(sorted(steps), drop))) | random_steps(r, n + 2, add)
    after, dirty = labels.changed(found, labelled(spark, steps), labelled(spark, later))
    assert sorted(map(tuple, after.collect())) == sorted(near(later))
    touched = {a for a, _, _ in steps ^ later}
    assert {x[0] for x in dirty.collect()} == touched | {a for a, b, *_ in near(steps) if b in touched}
    assert labels.changed(found, labelled(spark, steps), labelled(spark, steps))[0] is found


def test_long_chains_are_met_by_hops(spark, monkeypatch):
    monkeypatch.setattr(labels, "REACH", 4)
    chain = {(f"c{i}", f"c{i + 1}", "extends") for i in range(10)} | {("c3", "x", "implements"), ("x", "c9", "extends")}
    known = labels.ancestors(labelled(spark, chain))
    assert known.where("depth > 4").isEmpty()
    want = plain_ancestors(chain)
    for fqn in ("c0", "c5", "c10"):
        assert {tuple(r) for r in labels.relatives(known, fqn, True).collect()} == {(b, k, d) for a, b, d, _, k in want if a == fqn}
        assert {tuple(r) for r in labels.relatives(known, fqn, False).collect()} == {(a, k, d) for a, b, d, k, _ in want if b == fqn}
    assert {r["depth"] for r in labels.relatives(known, "c0", True, 2).collect()} == {1, 2} and labels.relatives(known, "c10", False, 3).count() == 3
    line = {s for s in chain if "x" not in s}
    assert labels.families(labels.ancestors(labelled(spark, line))).count() == 121


def test_calls_meet_the_nearest_declaration(spark):
    steps = spark.createDataFrame([(*x, "extends") for x in ("AB", "AC", "BD", "CD", "DA")], "src string, dst string, kind string")
    declared = spark.createDataFrame([("D", "m"), ("C", "m"), ("B", "m"), ("D", "k"), ("A", "own"), ("A", "own")], "owner string, member string")
    calls = [("A", "m"), ("A", "k"), ("A", "own"), ("A", "none"), ("D", "m"), ("D", "own"), ("X", "m"), ("A", "m")]
    frame = spark.createDataFrame([(i, o, m, "::") for i, (o, m) in enumerate(calls)], "i int, owner string, member string, separator string")
    got = {r["i"]: r["target"] for r in labels.resolved_calls(frame, labels.ancestors(steps), declared).collect()}
    assert got == {0: "B::m", 1: "D::k", 2: "A::own", 3: None, 4: "D::m", 5: "A::own", 6: None, 7: "B::m"}


def plain_method_set(owner, declared, embeds):
    """Names by level of embedding: a type met at one level isn't met below, what a level has twice is hidden with all below it."""
    level, seen, out, depth = [(owner, False)], set(), {}, 0
    while level:
        names = {}
        for t, indirect in level:
            for o, name, signature, pointer in declared:
                if o == t:
                    names.setdefault(name, []).append((signature, pointer, indirect))
        for name, found in names.items():
            out.setdefault(name, (depth, found))
        seen |= {t for t, _ in level}
        level = [(p, indirect or pointer) for t, indirect in level for o, p, pointer in embeds if o == t and p not in seen]
        depth += 1
    return {(owner, name, s[0][0], not s[0][1] or s[0][2], d) for name, (d, s) in out.items() if len(s) == 1 and s[0][0] is not None}


def test_method_sets_and_implementations(spark):
    r = random.Random(9)
    for _ in range(4):
        types = [f"T{i}" for i in range(9)]
        declared = list({(t, f"m{r.randrange(6)}"): None for t in types for _ in range(r.randint(0, 3))})
        declared = [(t, m, r.choice(["()", "(int)", None]), r.random() < 0.5) for t, m in declared]
        embeds = list({(r.choice(types), r.choice(types)): None for _ in range(11)})
        embeds = [(a, b, r.random() < 0.4) for a, b in embeds]
        d = spark.createDataFrame(declared, "owner string, name string, signature string, pointer boolean")
        e = spark.createDataFrame(embeds, "owner string, part string, pointer boolean")
        sets = methods.method_sets(d, e).cache()
        want = set().union(*[plain_method_set(t, declared, embeds) for t in types])
        assert {tuple(x) for x in sets.collect()} == want
        faces = {(f"I{r.randrange(5)}", f"m{r.randrange(6)}", r.choice(["()", "(int)"])) for _ in range(9)}
        inner = [("I0", "I1"), ("I1", "I2"), ("I2", "I0"), ("I5", "I3")]
        i = methods.interface_sets(spark.createDataFrame(sorted(faces), "owner string, name string, signature string"), spark.createDataFrame(inner, "owner string, part string"))
        whole = {}
        for o in {f for f, _, _ in faces} | {"I0", "I1", "I2", "I5"}:
            reach, todo = set(), [o]
            while todo:
                x = todo.pop()
                if x not in reach:
                    reach.add(x)
                    todo += [b for a, b in inner if a == x]
            whole[o] = {(m, s) for f, m, s in faces if f in reach}
        assert {tuple(x) for x in i.collect()} == {(o, *m) for o, ms in whole.items() for m in ms}
        has = {t: {(m, s) for o, m, s, _, _ in want if o == t} for t in types}
        got = sorted(map(tuple, methods.implementations(sets, i).collect()))
        assert got == sorted((t, o) for t in types for o, ms in whole.items() if ms and ms <= has[t])
    none = spark.createDataFrame([], "owner string, part string, pointer boolean")
    lone = spark.createDataFrame([("A", "m", "()", True)], "owner string, name string, signature string, pointer boolean")
    assert [tuple(x) for x in methods.method_sets(lone, none).collect()] == [("A", "m", "()", False, 0)]


def test_package_paths(spark):
    roots = [("", "top"), ("a", "m/a"), ("a/b/", "m/b"), ("./c", "m/c"), ("a", "m/z"), ("ab", "no")]
    files = ["x.go", "a/x.go", "a/b/x.go", "a/b/c/d/x.go", "a/bb/x.go", "c/x.go", "d/e/x.go", "a/x.go"]
    frame = spark.createDataFrame([(f,) for f in files], "path string")
    got = lambda rows: {r["path"]: r["package"] for r in package_paths(frame, spark.createDataFrame(rows, "root string, module string")).collect()}
    assert got(roots) == {"x.go": "top", "a/x.go": "m/a", "a/b/x.go": "m/b", "a/b/c/d/x.go": "m/b/c/d", "a/bb/x.go": "m/a/bb", "c/x.go": "m/c", "d/e/x.go": "top/d/e"}
    assert got(roots[1:])["d/e/x.go"] == "d/e" and got(roots[1:])["x.go"] == "" and got([(".", "p")])["a/x.go"] == "p/a"


def test_folded_counts(spark):
    frame = lambda rows, schema="k string": spark.createDataFrame(rows, schema)
    got = incremental.folded(frame([("a", 2), ("b", 1), ("c", 5)], "k string, n long"), frame([("b",), ("a",), ("x",)]), frame([("a",), ("x",), ("y",)]), "k")
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("c", 5), ("y", 1)}

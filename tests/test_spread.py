"""Keys that hold most rows are dealt over many parts, and the results stay."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import enrich, graph, methods, spread


def dealt(monkeypatch, *modules):
    """How many parts the joins' largest key goes to, a number a join."""
    seen, plain = [], spread.joined

    def watched(many, few, on, by):
        top = many.groupBy(*on).count().orderBy(F.desc("count")).first()
        rows = many.where(" AND ".join(f"{c} <=> '{top[c]}'" for c in on)).select(F.pmod(F.xxhash64(*by), F.lit(spread.WAYS)).alias("way"))
        seen.append(rows.distinct().count())
        return plain(many, few, on, by)

    for m in modules:
        monkeypatch.setattr(m, "joined", watched)
    return seen


@pytest.mark.parametrize("few", [0, 100])
def test_import_of_one_large_file(spark, monkeypatch, few):
    seen = dealt(monkeypatch, enrich)
    monkeypatch.setattr(enrich, "FEW", few)
    raw = spark.range(600).selectExpr("id AS n", "'a' || id % 300 AS `from`", "'calls' AS kind", "'b' AS `to`", "CASE WHEN id % 100 = 7 THEN '/x/y.php' ELSE '/proj/big.php' END AS file", "CAST(id AS INT) AS line")
    indexed = spark.createDataFrame([("big.php",), ("y.php",)], "path string")
    got = {tuple(r) for r in enrich.import_edges(raw, indexed, "/proj", "s").collect()}
    assert got == {("s", f"a{i}", "calls", "b", "y.php" if i % 100 == 7 else "big.php", i) for i in range(300)}
    assert seen == ([] if few else [spread.WAYS])


def test_one_root_around_all_files(spark, monkeypatch):
    seen = dealt(monkeypatch, paths)
    files = spark.range(500).selectExpr("'a/f' || id || '.go' AS path")
    got = paths.package_paths(files, spark.createDataFrame([("a", "m")], "root string, module string"))
    assert {(r["path"], r["package"]) for r in got.collect()} == {(f"a/f{i}.go", "m") for i in range(500)} and seen == [spread.WAYS]


def test_one_part_in_all_types(spark, monkeypatch):
    seen = dealt(monkeypatch, methods)
    embeds = spark.range(500).selectExpr("'T' || id AS owner", "'R' AS part", "false AS pointer")
    declared = spark.createDataFrame([("R", "m", "()", False), ("T3", "m", "(int)", True), ("X", "k", "()", False)], "owner string, name string, signature string, pointer boolean")
    got = {tuple(r) for r in methods.method_sets(declared, embeds).collect()}
    assert got == {(f"T{i}", "m", "()", True, 1) for i in range(500) if i != 3} | {("T3", "m", "(int)", False, 0), ("R", "m", "()", True, 0), ("X", "k", "()", True, 0)}
    assert seen == [spread.WAYS]


def test_interfaces_meet_blocks_of_types(spark, monkeypatch):
    """Several blocks and chunks give what plain sets do, and no candidate that fails becomes a row."""
    monkeypatch.setattr(methods, "TYPES", 7)
    monkeypatch.setattr(methods, "WANTED", 11)
    types = {f"T{i}": {(f"m{k}", f"({(i * k) % 3})") for k in range(9) if (i >> k % 5) & 1 or (i + k) % 4 == 0} for i in range(40)}
    faces = {f"I{i}": {(f"m{k}", f"({(i + k) % 3})") for k in range(9) if (i + k * k) % 5 == 0} for i in range(25)} | {"I90": {("m1", None), ("m0", "(0)")}, "I91": {("m1", "(9)")}, "T1": {("m4", "(1)")}}
    frame = lambda sets: spark.createDataFrame([(o, *m) for o, ms in sets.items() for m in sorted(ms, key=str)], "owner string, name string, signature string")
    has = types | {"T90": {("m1", None), ("m0", "(0)")}, "T91": {("m", "1(1)"), ("m1", "(1)")}}
    got = methods.implementations(frame(has), frame(faces | {"I92": {("m1", "1(1)")}}))
    assert sorted(map(tuple, got.collect())) == sorted((t, f) for t, ms in has.items() for f, ws in faces.items() if ws and ws <= ms and t != f and not any(s is None for _, s in ws))
    assert got.count() > 30


def test_sets_are_dealt_packed(spark, monkeypatch):
    """What goes to the cells are packs of sets, not a row a method, and pairs are those of plain sets with methods both rare and frequent."""
    rows, frame = [], type(spark.range(0))
    for name in ("repartition", "repartitionById"):
        plain = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, *a, plain=plain: (rows.append(self.count()), plain(self, *a))[1])
    monkeypatch.setattr(methods, "TYPES", 200)
    monkeypatch.setattr(methods, "WANTED", 400)
    r = random.Random(5)
    some = lambda n: {int(60 * r.random() ** 3) for _ in range(n)}
    types = {f"T{i}": some(25) for i in range(600)}
    faces = {f"I{i}": some(r.randint(1, 3)) for i in range(300)} | {"none": {999}, "T5": some(2)}
    for i in range(3, 300):  # as interfaces that embed others: many lists begin alike, some are equal
        faces[f"I{i}"] |= faces[f"I{i // 3}"] if i % 2 else set()
    sets = lambda many: spark.createDataFrame([(o, f"m{k}", "()") for o, ks in many.items() for k in ks], "owner string, name string, signature string")
    got = methods.implementations(sets(types), sets(faces)).collect()
    assert sorted(map(tuple, got)) == sorted((t, f) for t, ks in types.items() for f, ws in faces.items() if ws <= ks and t != f) and len(got) > 5000
    assert len(rows) == 1 and rows[0] < 150


def test_names_of_types_meet_in_parts_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(methods, "REACHED", 50)
    embeds = spark.range(500).selectExpr("'T' || id AS owner", "'R' AS part", "false AS pointer")
    declared = spark.createDataFrame([("R", "m", "()", False), ("T3", "m", "(int)", True)], "owner string, name string, signature string, pointer boolean")
    sets = methods.method_sets(declared, embeds)
    assert sets.rdd.getNumPartitions() == 10 and sets.count() == 501
    faces = methods.interface_sets(declared, embeds)
    assert faces.rdd.getNumPartitions() == 20 and faces.count() == 502


@pytest.mark.parametrize("few", [2, 100])
def test_files_of_most_edges_are_not_dealt(spark, monkeypatch, capsys, few):
    monkeypatch.setattr(graph, "FEW", few)
    edges = spark.range(300).selectExpr("CASE WHEN id % 50 = 0 THEN id WHEN id % 7 = 6 THEN null ELSE id % 3 END AS file_id", "'a' || id AS from_fqn", "'calls' AS kind", "'b' AS to_fqn", "CAST(id AS INT) AS line", "true AS resolved")
    files = spark.createDataFrame([(0, "p0"), (1, "p1"), (100, "p100"), (100, "q100"), (5, "p5")], "file_id long, path string")
    often = spark.createDataFrame([(0,), (1,), (1,), (2,), (None,)], "file_id long")
    ext = edges.where("line < 3").selectExpr("from_fqn", "kind", "to_fqn", "'f' AS file", "line", "'layer' AS source")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    found = graph.all_edges(edges, files, ext, often)
    found.explain()
    got = sorted(tuple(r) for r in found.collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(tuple(r) for r in graph.all_edges(edges, files, ext).collect()) and len(got) > 150
    assert ("BroadcastHashJoin" in capsys.readouterr().out) == (few == 100)

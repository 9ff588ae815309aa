"""Index runs over a real folder, enrichment layers, the API and a refresh stream."""

import json
import os

import pytest

from codeloom.api import Graph, clamp, reset
from codeloom.operators import fts
from codeloom.plans import index
from codeloom.sources import layers, tree
from codeloom.sources.store import Store, Superseded


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def touch(root, path, when):
    os.utime(os.path.join(root, path), (when, when))


#: Path and text of a small bookkeeping project: two classes, a test, a library, and a build folder that is ignored.
PROJECT = {
    "app/books/Ledger.php": "<?php\nclass Ledger {\n  public function post() { $this->check(); }\n  public function check() {}\n}\n",
    "app/books/Audit.php": "<?php\nclass Audit extends Ledger { public function check() {} }\n",
    "tests/LedgerTest.php": "<?php\nclass LedgerTest { public function posts() { $ledger = new Ledger(); } }\n",
    "vendor/acme/Clock.php": "<?php\nclass Clock { function tick() { new Ledger(); } }\n",
    "build/out/Stub.php": "<?php\nclass Stub {}\n",
    ".gitignore": "# made by the build\nbuild/\n/vendor\n",
}


@pytest.fixture()
def project(tmp_path):
    root = str(tmp_path / "p")
    for path, text in PROJECT.items():
        put(root, path, text)
        touch(root, path, 1_650_000_000)
    return root


def test_runs(spark, project, tmp_path):
    store = Store(spark, "file:" + str(tmp_path / "store"))
    assert index.run(store, project) == {"new": 4}
    assert index.run(store, project) == {"unchanged": 4}
    touch(project, "app/books/Ledger.php", 1_650_000_060)
    assert index.run(store, project) == {"unchanged": 3, "touched": 1}
    assert index.run(store, project) == {"unchanged": 4}
    put(project, "app/books/Ledger.php", "<?php class Journal {}")
    os.remove(os.path.join(project, "app/books/Audit.php"))
    assert index.run(store, project) == {"unchanged": 2, "changed": 1, "removed": 1}
    names = {r["name"] for r in store.read("symbols").collect()}
    assert "Journal" in names and not names & {"Ledger", "Audit", "Stub"}
    assert store.read("files").where("vendor").count() == 1


def test_vendor_skip_and_config(spark, project):
    assert {r["path"] for r in tree.walk(spark, project, tree.config("vendor: skip")).collect()} == {"app/books/Ledger.php", "app/books/Audit.php", "tests/LedgerTest.php"}
    assert tree.config()["vendor"] == "index"
    with pytest.raises(ValueError):
        tree.config("vendor: maybe")


def plain_walk(root, vendor="index"):
    """What a tree's walk gives, by the rules as they are told: whole folders go, the last rule that fits counts, vendor folders know no rules."""
    out, rules = {}, []

    def below(folder, rules):
        here = os.path.join(root, folder)
        own = [*rules]
        in_vendor = bool({"vendor", "node_modules"} & set(folder.split("/")))
        if not in_vendor and os.path.isfile(os.path.join(here, ".gitignore")):
            with open(os.path.join(here, ".gitignore")) as f:
                own += [(folder, line.rstrip("\n")) for line in f]

        def gone(path):
            state = False
            for at, line in own:
                found = tree.ignore_regex(line, at)
                if found and __import__("re").match(found[0], path):
                    state = not found[1]
            return state

        for name in os.listdir(here):
            path = f"{folder}/{name}" if folder else name
            full = os.path.join(root, path)
            if os.path.isdir(full) and not os.path.islink(full):
                if name == ".git" or (not in_vendor and name not in ("vendor", "node_modules") and gone(path + "/")) or (vendor == "skip" and name in ("vendor", "node_modules")):
                    continue
                below(path, own)
            elif os.path.isfile(full) and name.lower().endswith((".php", ".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")) and (in_vendor or not gone(path)):
                out[path] = (os.stat(full).st_size, os.stat(full).st_mtime_ns, in_vendor)

    below("", rules)
    return out


@pytest.mark.parametrize("entries", [1, 3, 20_000])
def test_walk_by_levels(spark, tmp_path, monkeypatch, entries):
    """Whatever a task may meet before it hands back, the same files are found, each once."""
    import random

    r, root = random.Random(7), str(tmp_path / "t")
    names = ["a", "b", "_c", ".d", "gen", "vendor", "node_modules", ".git"]
    for _ in range(120):
        folder = "/".join(r.choice(names) for _ in range(r.randint(0, 5)))
        put(root, f"{folder}/{r.choice('xyz')}{r.choice(['.php', '.go', '.TS', '.txt', '.log.js'])}".lstrip("/"), "z" * r.randint(0, 9))
    for folder, lines in (("", "gen/\n*.log.js\n!keep.log.js\n"), ("a", "/b\n!b/\nx.*\n"), ("b", "*\n!*/\n!y.go\n"), ("a/vendor", "*\n"), ("_c", "# none\n\n")):
        put(root, f"{folder}/.gitignore".lstrip("/"), lines)
    put(root, "a/keep.log.js", "k")
    os.symlink(root, os.path.join(root, "a", "loop"))
    os.symlink(os.path.join(root, "nowhere.php"), os.path.join(root, "a", "dead.php"))
    monkeypatch.setattr(tree, "ENTRIES", entries)
    for vendor in ("index", "skip"):
        found = tree.walk(spark, root, tree.config(f"vendor: {vendor}")).collect()
        assert len(found) == len({r["path"] for r in found})
        assert {r["path"]: (r["size"], r["mtime_ns"], r["vendor"]) for r in found} == plain_walk(root, vendor)
    some = tree.walk(spark, root, tree.config("include: [a/vendor, a, a/b/]")).collect()
    assert {r["path"] for r in some} == {p for p in plain_walk(root) if p.startswith("a/")}


@pytest.mark.parametrize(
    "line, folder, path, hit",
    [("*.log", "", "a/b.log", True), ("/a", "", "b/a/x", False), ("/a", "", "a/x", True), ("a/", "", "a", False), ("a/", "", "x/a/b", True), ("a/**/b", "", "a/x/y/b", True), ("x?.go", "s", "s/d/xy.go", True), ("x?.go", "s", "t/xy.go", False), ("[!a]b", "", "cb", True)],
)
def test_ignore(spark, line, folder, path, hit):
    import re

    assert bool(re.match(tree.ignore_regex(line, folder)[0], path)) == hit


def test_modules(spark, tmp_path):
    put(str(tmp_path), "go.mod", "module example.com/m\n")
    put(str(tmp_path), "web/package.json", '{"name": "@a/web"}')
    put(str(tmp_path), "bad/package.json", "no")
    put(str(tmp_path), "vendor/go.mod", "module example.com/other\n")
    assert tree.modules(tree.walk(spark, str(tmp_path))) == {"go": {".": "example.com/m"}, "js": {"@a/web": "web"}}


def test_layers_and_questions(spark, project, tmp_path):
    store = Store(spark, "file:" + str(tmp_path / "store"))
    index.run(store, project)
    folder = str(tmp_path / "layers")
    put(folder, "enrich.phpstan.jsonl", "\n".join(json.dumps(e) for e in [{"from": "Audit::check()", "kind": "calls", "to": "Ledger::post()", "file": "/srv/app/books/Audit.php", "line": 1}, {"from": "Audit::check()", "kind": "calls", "to": "Ledger::post()", "file": project + "/app/books/Audit.php", "line": 2}, {"from": "", "kind": "calls", "to": ""}]) + "\n\n")
    assert index.import_layers(store, project, "file:" + folder) == ["phpstan"]
    rows = store.read("ext_edges").collect()
    assert [(r["from_fqn"], r["file"], r["line"]) for r in rows] == [("Audit::check()", "app/books/Audit.php", 1)]

    g = Graph(store.tables(), tree.texts(project))
    assert [e["from_fqn"] for e in g.get_callers("Ledger::post()")["edges"]] == ["Audit::check()"]
    assert {e["from_fqn"] for e in g.get_callers("Ledger::check()")["edges"]} == {"Ledger::post()"}
    assert g.class_hierarchy("Ledger")["descendants"] == [{"fqn": "Audit", "kind": "extends"}]
    found = g.search_symbols("ledger")
    assert found["total"] >= 2 and found["results"][0]["path"].startswith("app/")
    assert g.get_symbol("Ledger", include_source=True)["declarations"][0]["source"].startswith("class Ledger")
    assert g.search_code("NEW ledger", limit=1)["matches"][0]["file"] == "tests/LedgerTest.php"
    assert g.impact("Ledger::check()")["levels"][0]["callers"][0]["fqn"] == "Ledger::post()"
    assert g.impact("Ledger")["tests"] == ["tests/LedgerTest.php"]
    assert g.file_outline("app/books/Ledger.php")["symbols"][0]["fqn"] == "Ledger"
    assert g.explore("Ledger", skip_source=True)["references"] == 2
    assert g.status()["warning"] == ""
    assert {h["fqn"] for h in g.hints("why does Ledger fail?")} == {"Ledger"}
    with pytest.raises(LookupError):
        g.file_outline("nope")
    assert [e["to_fqn"] for e in g.get_callees("Ledger::post()")["edges"]] == ["Ledger::check()"]
    assert len(g.find_references("Ledger", limit=1)["edges"]) == 1 and len(g.find_references("Ledger")["edges"]) == 2
    os.remove(os.path.join(folder, "enrich.phpstan.jsonl"))
    put(folder, "enrich.go-types.jsonl", "")
    index.import_layers(store, project, "file:" + folder)
    assert store.read("ext_edges").count() == 0


def test_limits():
    assert [clamp(n) for n in (None, 0, -3, 1, 500, 501)] == [50, 50, 50, 1, 500, 500]
    assert [reset(n, 15, 100) for n in (None, 0, -1, 1, 100, 101)] == [15, 15, 15, 1, 100, 15]


def test_forced_run_and_snapshots(spark, project, tmp_path):
    """A forced run reads everything anew and gives the same rows; two snapshots are kept, and no half-written pointer."""
    store = Store(spark, "file:" + str(tmp_path / "store"))
    rows = lambda: sorted(map(tuple, store.read("symbols").drop("sym_id").collect()))
    index.run(store, project)
    first = rows()
    assert index.run(store, project, force=True) == {"changed": 4}
    assert rows() == first
    at = store.current()
    index.run(store, project)
    assert store.current() == at
    words = sorted(map(tuple, fts.stored(store.read("symbols")).collect()))
    assert sorted(map(tuple, store.read("postings").collect())) == words
    put(project, "app/books/Audit.php", "<?php class Auditor {}")
    index.run(store, project)
    assert {r["token"] for r in store.read("postings").where("col = 'name'").collect()} >= {"auditor", "ledger"}
    assert not store.read("postings").where("token = 'audit'").count()
    own = os.listdir(tmp_path / "store")
    own, after = os.listdir(tmp_path / "store"), store.manifest(store.current())["symbols"]
    assert not any(n.startswith("NEXT") for n in own) and {n for n in own if n.startswith("AT-")} == {"AT-2", "AT-3"}
    shared = {b for b, p in store.manifest(at)["symbols"].items() if after.get(b) == p}
    assert shared and len(after) - len(shared) == 1  # the changed file's bucket alone was written
    assert {p.split("/")[0] for p in after.values()} <= set(own)


def test_two_writers(spark, project, tmp_path, monkeypatch):
    """Of two runs over one snapshot the second loses nothing of the first: it is told and compares anew. Its folder goes, another's that is being filled stays."""
    store = Store(spark, "file:" + str(tmp_path / "store"))
    index.run(store, project)
    since = store.pointers()[-1]
    store.write({"meta": spark.createDataFrame([("k", "first")], "key string, value string")}, since=since)
    with pytest.raises(Superseded):
        store.write({"meta": spark.createDataFrame([("k", "second")], "key string, value string")}, since=since)
    assert [r["value"] for r in store.read("meta").collect()] == ["first"] and store.read("files").count() == 4
    own = os.listdir(tmp_path / "store")
    assert not any(n.startswith("NEXT") for n in own) and sum(n.startswith("s-") for n in own) == 2
    os.makedirs(tmp_path / "store" / "s-beingfilled")
    os.makedirs(tmp_path / "store" / "s-leftover")
    os.utime(tmp_path / "store" / "s-leftover", (1, 1))
    put(project, "app/books/Ledger.php", "<?php class Journal {}")
    other, fold = Store(spark, "file:" + str(tmp_path / "store")), index.fold

    def late(*args):
        monkeypatch.setattr(index, "fold", fold)
        other.write({"meta": spark.createDataFrame([("k", "other")], "key string, value string")})
        fold(*args)

    monkeypatch.setattr(index, "fold", late)
    assert index.run(store, project) == {"unchanged": 3, "changed": 1}
    assert [r["value"] for r in store.read("meta").collect()] == ["other"]
    assert "Journal" in {r["name"] for r in store.read("symbols").collect()}
    own = os.listdir(tmp_path / "store")
    assert "s-beingfilled" in own and "s-leftover" not in own


def test_code_search_reads_candidates_only(spark, project, tmp_path):
    store = Store(spark, "file:" + str(tmp_path / "store"))
    index.run(store, project)
    read = []

    def texts(files):
        read.append({r["path"] for r in files.collect()})
        return tree.texts(project)(files)

    g = Graph(store.tables(), texts)
    assert [m["file"] for m in g.search_code("NEW ledger")["matches"]] == ["tests/LedgerTest.php"] and read.pop() == {"tests/LedgerTest.php"}
    assert [m["line"] for m in g.search_code("function (post|check)\\(", regex=True, path_prefix="app/books/L")["matches"]] == [3, 4] and read.pop() == {"app/books/Ledger.php"}
    assert g.search_code("nothing like it")["matches"] == [] and read.pop() == set()
    assert len(g.search_code("s+", regex=True)["matches"]) == 4 and len(read.pop()) == 3  # requires nothing, so all are read
    os.remove(os.path.join(project, "tests/LedgerTest.php"))
    assert g.search_code("NEW ledger")["matches"] == []
    with pytest.raises(LookupError):
        g.get_symbol("LedgerTest", include_source=True)


def test_bad_layer_line(spark, tmp_path):
    put(str(tmp_path), "enrich.x.jsonl", '{"from": "a"}\nnot json\n')
    with pytest.raises(Exception):
        layers.read_layer(spark, str(tmp_path / "enrich.x.jsonl")).collect()


def test_layer_files(spark, tmp_path):
    rows = [("a", "calls", "b", "f.php", 1), ("c", "extends", "d", "g.php", 2)]
    edges = spark.createDataFrame(rows, "from_fqn string, kind string, to_fqn string, file string, line int")
    path = str(tmp_path / "enrich.own.jsonl")
    for table in (edges, edges, edges.where("false")):
        layers.write_layer(table, "file:" + path)
        assert os.path.isfile(path) and sorted(tuple(r)[1:] for r in layers.read_layer(spark, path).collect()) == (rows if table is edges else [])
    put(str(tmp_path), "enrich.long.jsonl", json.dumps({"from": "x" * (1 << 20), "kind": "calls", "to": "y"}))
    with pytest.raises(Exception, match="more than"):
        layers.read_layer(spark, str(tmp_path / "enrich.long.jsonl")).collect()


STREAM = "path string, content string, vendor boolean, size long, mtime_ns long"


def streamed(spark, folder, batches):
    """The store after these batches of rows, and how many snapshots it took."""
    from codeloom.streaming.refresh import refresh

    source, store = str(folder / "in"), Store(spark, "file:" + str(folder / "store"))
    for batch in batches:
        spark.createDataFrame(batch, STREAM).coalesce(1).write.mode("append").json(source)
        refresh(spark.readStream.schema(STREAM).json(source), store, str(folder / "ck"), once=True).awaitTermination()
    return store


def test_stream(spark, tmp_path):
    rows = [("a.go", "package a\nfunc F() {}\n", False, 1, 1), ("b.go", "package a\nfunc G() { F() }\n", False, 1, 1)]
    store = streamed(spark, tmp_path, [rows, [("a.go", "package a\nfunc H() {}\n", False, 1, 2), ("b.go", None, False, 1, 2)]])
    assert [r["name"] for r in store.read("symbols").collect()] == ["H"]


def test_stream_in_any_order(spark, tmp_path):
    """Late rows change nothing, whatever batches they come in: the same rows end in one store."""
    go = lambda name: f"package a\nfunc {name}() {{}}\n"
    rows = [("a.go", go("One"), False, 1, 10), ("a.go", go("Two"), False, 2, 20), ("a.go", go("Two"), False, 2, 25), ("b.go", go("Bee"), False, 1, 5), ("b.go", None, False, 1, 7), ("c.go", go("See"), False, 1, 3), ("c.go", None, False, 1, 3), ("d.go", None, False, 1, 1)]
    orders = [[rows], [rows[:3], rows[3:]], [rows[4:], rows[2:4], rows[:2]], [[rows[2]], [rows[0], rows[4], rows[6]], [rows[1], rows[3], rows[5], rows[7]]]]
    found = []
    for i, batches in enumerate(orders):
        store = streamed(spark, tmp_path / str(i), batches)
        found.append((sorted((r["path"], r["hash"], r["mtime_ns"]) for r in store.read("files").collect()), sorted(r["name"] for r in store.read("symbols").collect())))
    assert found == [found[0]] * len(orders)
    assert [(p, m) for p, _, m in found[0][0]] == [("a.go", 25), ("c.go", 3)] and found[0][1] == ["See", "Two"]  # of equal times a removal comes first
    before = store.current()
    again = streamed(spark, tmp_path / "3", [[rows[0], ("a.go", go("Two"), False, 2, 25)]])
    assert again.current() == before  # nothing new, so nothing is written


def test_commands(spark, project, tmp_path, monkeypatch, capsys):
    import io

    from codeloom import __main__ as command

    monkeypatch.setattr(command, "session", lambda: spark)
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))

    def ask(text):
        monkeypatch.setattr("sys.stdin", io.StringIO(text))
        command.main(["prompt", "--root", project])
        return capsys.readouterr().out

    assert ask('{"prompt": "what calls Ledger?"}') == "" and not os.path.exists(command.default_store(project))
    command.main(["index", project, "--quiet"])
    assert capsys.readouterr().out == ""
    command.main(["index", project])
    assert json.loads(capsys.readouterr().out) == {"unchanged": 4}
    command.main(["index", project, "--rebuild"])
    assert json.loads(capsys.readouterr().out) == {"new": 4}
    assert "Ledger (class, app/books/Ledger.php:2)" in ask('{"prompt": "what calls Ledger?"}')
    assert ask('{"prompt": "nothing here"}') == ask("no json") == ask('{"prompt": 3}') == ask("[]") == ""


def test_serving(spark, project, tmp_path):
    import io

    from codeloom.serve import Server

    store = Store(spark, "file:" + str(tmp_path / "store"))
    index.run(store, project)
    put(project, "app/books/Ledger.php", "<?php class Journal {}")
    server, out = Server(store, project), io.StringIO()
    ask = lambda name: json.dumps({"id": name, "question": "get_symbol", "arguments": {"fqn": name}})
    server.serve([ask("Ledger"), "\n", "no json", json.dumps({"id": 3, "question": "drop"})], out)
    first, bad, unknown = map(json.loads, out.getvalue().splitlines())
    assert first["id"] == "Ledger" and "result" in first and "error" in bad and unknown["id"] == 3 and "questions" in unknown["error"]
    server.refresh().join()
    assert server.error == ""
    assert [d["fqn"] for d in json.loads(server.answer(ask("Journal")))["result"]["declarations"]] == ["Journal"]
    assert json.loads(server.answer(ask("Ledger")))["result"]["declarations"] == []

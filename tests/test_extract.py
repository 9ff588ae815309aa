"""Per-rule extraction tests on fixtures of our own."""

from codeloom.extract import golang, php, ts
from codeloom.extract.run import extract, extract_file, language_of, tables

GO = '''package svc

import (
	"fmt"
	db "example.com/app/storage"
)

// Limit caps things.
const Limit = 10
var cache, _ = 1, 2

// Store keeps rows.
type Store struct {
	*Base
	db.Conn
	repo *db.Repo
	names, tags []string `json:"x"`
}

type Getter interface {
	fmt.Stringer
	Get(id int) (Row, error)
}

type Row = map[string]Item

// New builds.
func New(r *db.Repo, n int) *Store {
	s := &Store{repo: r}
	for _, x := range list() { fmt.Println(x, len(x)) }
	return s
}

func (s *Store) Load(q db.Query) error {
	s.repo.Find(q)
	s.helper()
	go func() { run(Item{}) }()
	if v := db.Make(); v { return nil }
	return nil
}
'''

PHP = r'''<?php
namespace App\Core;
use App\Db\{Conn, Query as Q};
use function App\Util\fmt;
use Vendor\Base;
/** Makes things. */
#[Attr(1)]
abstract class Maker extends Base implements \Countable, Q
{
    use LogTrait, Other;
    const MAX = 1, MIN = 0;
    private ?Conn $conn, $other;
    public function __construct(private readonly Conn $db, string $x = "a") { }
    /** Runs. */
    public function run(Q $q, int|Conn $z): ?Result {
        $this->db->exec($q);
        $q->all(); $this->conn->close(); $this->help();
        self::make(); parent::run(); Q::VALUE; Conn::class; static::$n;
        $o = new Conn(fmt("x"), strlen("y"));
        \App\boot();
        if ($o instanceof Q) {}
        try { } catch (A | \B $e) { }
        return $o?->nope();
    }
    abstract protected function help(): void;
}
interface Thing extends \A, B {}
enum Suit: string { case Hearts = 'h'; public function label(): string { return 'x'; } }
function helper(Conn $c): void { $c->ping(); }
namespace Second;
trait T1 { public $p; }
'''

TS = '''import React, { useState as useS, type Props } from "react";
import * as api from "./api/client";
import { Button } from "@acme/ui/button";
/** Max. */
export const MAX = 3;
let count: number = 0;
export type Id = string | Model;
export interface Model extends api.Thing {
  id: Id;
  load(x: Model): Promise<Model>;
}
export enum Color { Red = 1, Green }
export abstract class Service extends api.Core implements Model {
  private client: Model;
  handler = (e: Event) => { this.run(); };
  constructor(private readonly api2: Model, name: string) { super(); helper(); }
  async run(m: Model): Promise<void> {
    this.client.load(m);
    m.load(m);
    api.fetchIt(1);
    const s = new Service(m, "x");
    const d = new api.Dep();
    this.api2.load(m);
  }
}
export function helper(a: Model): Id { useS(1); return a as Id; }
export const View = (p: Props) => {
  return <div><Button onClick={() => helper(p)} /><api.Panel>{MAX}</api.Panel></div>;
};
'''


def edges(rows):
    return {(e["from_fqn"].rsplit("/", 1)[-1], e["kind"], e["to_fqn"], e["resolved"]) for e in rows.edges}


def test_go():
    rows, broken = golang.extract("internal/svc/a.go", GO, modules={".": "example.com/app"})
    assert not broken
    p = "example.com/app/internal/svc"
    assert {(s["kind"], s["fqn"].removeprefix(p + ".")) for s in rows.symbols} == {
        ("constant", "Limit"), ("property", "cache"), ("class", "Store"), ("property", "Store.repo"), ("property", "Store.names"), ("property", "Store.tags"),
        ("interface", "Getter"), ("method", "Getter.Get()"), ("type_alias", "Row"), ("function", "New()"), ("method", "Store.Load()"),
    }
    got = edges(rows)
    for e in [
        ("svc.Store", "extends", f"{p}.Base", True), ("svc.Store", "extends", "example.com/app/storage.Conn", True), ("svc.Store", "references_type", "example.com/app/storage.Repo", True),
        ("svc.Getter", "extends", "fmt.Stringer", True), ("svc.Row", "references_type", f"{p}.Item", True), ("svc.New()", "instantiates", f"{p}.Store", True),
        ("svc.New()", "calls", f"{p}.list()", False), ("svc.New()", "calls", "fmt.Println()", True), ("svc.Store.Load()", "calls", "example.com/app/storage.Repo.Find()", False),
        ("svc.Store.Load()", "calls", f"{p}.Store.helper()", False), ("svc.Store.Load()", "calls", f"{p}.run()", False), ("svc.Store.Load()", "instantiates", f"{p}.Item", True), ("svc.Store.Load()", "calls", "example.com/app/storage.Make()", True),
    ]:
        assert e in got, e
    assert not any(t.endswith(".len()") for _, _, t, _ in got)
    doc = {s["name"]: s["doc"] for s in rows.symbols}
    assert doc["Limit"] == "// Limit caps things." and doc["Store"] == "// Store keeps rows."
    assert next(s for s in rows.symbols if s["name"] == "New")["signature"] == "func New(r *db.Repo, n int) *Store"


def test_go_shallow_and_paths():
    rows, _ = golang.extract("v/a.go", GO, shallow=True)
    assert {e["kind"] for e in rows.edges} == {"extends"}
    assert golang.package_path("a/b", {".": "m", "a": "n"}) == "n/b"
    assert golang.package_path("c", {"a": "n"}) == "c"


def test_php():
    rows, broken = php.extract("a.php", PHP)
    assert not broken
    c = "App\\Core\\Maker"
    kinds = {(s["kind"], s["fqn"]) for s in rows.symbols}
    for s in [("class", c), ("constant", c + "::MAX"), ("constant", c + "::MIN"), ("property", c + "::$conn"), ("property", c + "::$other"), ("property", c + "::$db"), ("method", c + "::run()"), ("method", c + "::help()"), ("interface", "App\\Core\\Thing"), ("enum", "App\\Core\\Suit"), ("enum_case", "App\\Core\\Suit::Hearts"), ("function", "App\\Core\\helper()"), ("trait", "Second\\T1")]:
        assert s in kinds, s
    got = edges(rows)
    run = c + "::run()"
    for e in [
        (c, "extends", "Vendor\\Base", True), (c, "implements", "Countable", True), (c, "implements", "App\\Db\\Query", True), (c, "uses_trait", "App\\Core\\LogTrait", True),
        (run, "calls", "App\\Db\\Conn::exec()", False), (run, "calls", "App\\Db\\Query::all()", False), (run, "calls", c + "::help()", False), (run, "calls", c + "::make()", True), (run, "calls", "Vendor\\Base::run()", False),
        (run, "references", "App\\Db\\Query::VALUE", True), (run, "references", c + "::$n", True), (run, "instantiates", "App\\Db\\Conn", True), (run, "calls", "App\\Util\\fmt()", True), (run, "calls", "strlen()", False),
        (run, "calls", "App\\boot()", True), (run, "references_type", "B", True), (run, "references_type", "App\\Core\\A", True), ("App\\Core\\Thing", "extends", "A", True), ("App\\Core\\helper()", "calls", "App\\Db\\Conn::ping()", False),
    ]:
        assert e in got, e
    assert not any("nope" in t for _, _, t, _ in got)
    assert {(i["alias"], i["kind"]) for i in rows.imports} == {("Conn", ""), ("Q", ""), ("fmt", "function"), ("Base", "")}
    assert next(s for s in rows.symbols if s["fqn"] == c)["doc"] == "/** Makes things. */"


def test_ts():
    rows, broken = ts.extract("src/app/view.tsx", TS, modules={"@acme/ui": "packages/ui"})
    assert not broken
    kinds = {(s["kind"], s["fqn"].removeprefix("src/app/view#")) for s in rows.symbols}
    assert kinds == {
        ("constant", "MAX"), ("property", "count"), ("type_alias", "Id"), ("interface", "Model"), ("property", "Model.id"), ("method", "Model.load()"), ("enum", "Color"), ("enum_case", "Color.Red"), ("enum_case", "Color.Green"),
        ("class", "Service"), ("property", "Service.client"), ("method", "Service.handler()"), ("method", "Service.constructor()"), ("property", "Service.api2"), ("method", "Service.run()"), ("function", "helper()"), ("function", "View()"),
    }
    got = edges(rows)
    for e in [
        ("view#Service", "extends", "src/app/api/client#Core", False), ("view#Service", "implements", "src/app/view#Model", True), ("view#Service.run()", "calls", "src/app/view#Model.load()", False),
        ("view#Service.run()", "calls", "src/app/api/client#fetchIt()", False), ("view#Service.run()", "instantiates", "src/app/view#Service", True), ("view#Service.run()", "instantiates", "src/app/api/client#Dep", False),
        ("view#helper()", "calls", "react#useState()", False), ("view#View()", "calls", "packages/ui/button#Button()", False), ("view#View()", "calls", "src/app/api/client#Panel()", False), ("view#View()", "calls", "src/app/view#helper()", True),
    ]:
        assert e in got, e
    assert ts.module_path("a/b/index.tsx") == "a/b" and ts.module_path("a/b.d.ts") == "a/b"


def test_unbalanced_is_flagged():
    assert extract_file("a.go", "package a\nfunc f() { (")["has_errors"]
    assert extract_file("a.txt", "x") is None and language_of("A.PHP")[0] == "php"


def test_in_spark(spark):
    files = spark.createDataFrame([("internal/svc/a.go", GO, False), ("vendor/x.php", PHP, True), ("b.txt", "x", False)], "path string, content string, vendor boolean")
    index = extract(files, {"go": {".": "example.com/app"}, "js": {}})
    assert index.count() == 2
    symbols, imports, own = tables(index)
    assert symbols.where("name = 'Load'").first()["words"] == "load"
    assert {r["kind"] for r in own.join(index.where("vendor").selectExpr("xxhash64(path) AS file_id"), "file_id").collect()} == {"extends", "implements", "uses_trait"}
    assert imports.count() == 6


def test_outline():
    import json

    import pytest

    from codeloom.outline import outline_json, outline_text

    text = outline_text("internal/svc/a.go", GO)
    assert "class Store" in text and "extends internal/svc.Base" in text and "Store keeps rows." in text
    assert json.loads(outline_json("a.php", PHP))["lang"] == "php"
    with pytest.raises(ValueError):
        outline_text("a.txt", "")

"""One query for each extraction rule: a source file for every supplier, which names it, and the rows these files must give as SQL over supplier."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..extract.run import extract

QUERIES: dict = {}
ORACLE_SQL: dict = {}
SYMBOLS, IMPORTS, EDGES = ("kind", "fqn"), ("alias", "fqn", "kind"), ("from_fqn", "kind", "to_fqn", "resolved")
#: Where a supplier's key goes in a source and in its rows.
KEY = "§"


def _literal(value):
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _named(source, rows):
    """The source and its rows with the key behind one of their names: the last one of the rows that the source has with a capital, or else the last that it has."""
    words = [w for r in rows for v in r if isinstance(v, str) for w in re.findall(r"[A-Za-z]{3,}", v) if re.search(rf"\b{w}\b", source)]
    word = ([w for w in words if w[0].isupper() and not w.isupper()] or [w for w in words if w not in ("constructor", "default")])[-1]
    put = lambda v: re.sub(rf"\b{word}\b", f"{word}_{KEY}", v) if isinstance(v, str) else v
    return put(source), [tuple(map(put, r)) for r in rows]


def rule(name, path, source, part, columns, rows, modules=None, kinds=None, vendor=False):
    """Register a query: columns of the symbols, imports or edges of each supplier's source, of some kinds or all."""
    source, rows = _named(source, rows)

    def run(spark, d):
        keys = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("key"))
        files = keys.select(F.lit(path).alias("path"), F.replace(F.lit(source), F.lit(KEY), "key").alias("content"), F.lit(vendor).alias("vendor"), "key")
        found = extract(files, modules, keep=("key",)).select("key", F.explode(part).alias("r")).select(F.col("key").cast("long").alias("supplier"), *[F.col(f"r.{c}").alias(c) for c in columns])
        return found.where(F.col("kind").isin(*kinds)) if kinds else found

    QUERIES[name] = run
    texts = {c for i, c in enumerate(columns) if isinstance(rows[0][i], str)}
    filled = ", ".join(f"replace({c}, '{KEY}', CAST(s_suppkey AS VARCHAR)) AS {c}" if c in texts else c for c in columns)
    ORACLE_SQL[name] = f"SELECT s_suppkey AS supplier, {filled} FROM supplier, (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(columns)})"


# PHP

rule("ep01_namespaces", "a.php", "<?php\nnamespace Shop\\Cart;\nfunction total() {}\nclass Basket {}\nnamespace Shop\\Till { function open() {} }\nnamespace { function bare() {} }\n", "symbols", SYMBOLS,
     [("function", "Shop\\Cart\\total()"), ("class", "Shop\\Cart\\Basket"), ("function", "Shop\\Till\\open()"), ("function", "bare()")])
rule("ep02_uses", "a.php", "<?php\nnamespace N;\nuse Shop\\Basket;\nuse Shop\\Till as Register;\nuse function Shop\\sum;\nuse const Shop\\LIMIT;\nuse Shop\\Tax\\{Rate, Zone as Area, function levy};\n", "imports", IMPORTS,
     [("Basket", "Shop\\Basket", ""), ("Register", "Shop\\Till", ""), ("sum", "Shop\\sum", "function"), ("LIMIT", "Shop\\LIMIT", "const"), ("Rate", "Shop\\Tax\\Rate", ""), ("Area", "Shop\\Tax\\Zone", ""), ("levy", "Shop\\Tax\\levy", "function")])
rule("ep03_classes", "a.php", "<?php\nnamespace N;\nuse Lib\\Root;\nfinal class Leaf extends Root implements \\Countable, Twig {}\ninterface Twig extends Stem {}\ntrait Bark {}\nenum Hue: int implements Twig {}\n", "edges", EDGES,
     [("N\\Leaf", "extends", "Lib\\Root", True), ("N\\Leaf", "implements", "Countable", True), ("N\\Leaf", "implements", "N\\Twig", True), ("N\\Twig", "extends", "N\\Stem", True), ("N\\Hue", "implements", "N\\Twig", True)])
rule("ep04_property_types", "a.php", "<?php\nclass Pump {\n private ?Valve $valve;\n private int|Pipe $pipe;\n function __construct(private Tank $tank) {}\n function go() { $this->valve->open(); $this->tank->fill(); $this->pipe->flow(); $this->other->no(); }\n}\n", "edges", EDGES,
     [("Pump::go()", "calls", "Valve::open()", False), ("Pump::go()", "calls", "Tank::fill()", False)], kinds=("calls",))
rule("ep05_enums_traits", "a.php", "<?php\nenum Size: string { case Small = 's'; case Large = 'l'; const Usual = self::Small; }\nclass Box { use Sealed, \\Lib\\Stamped; }\n", "edges", EDGES,
     [("Box", "uses_trait", "Sealed", True), ("Box", "uses_trait", "Lib\\Stamped", True)], kinds=("uses_trait",))
rule("ep05_enum_cases", "a.php", "<?php\nenum Size: string { case Small = 's'; case Large = 'l'; const Usual = self::Small; }\n", "symbols", ("kind", "fqn", "container"),
     [("enum", "Size", ""), ("enum_case", "Size::Small", "Size"), ("enum_case", "Size::Large", "Size"), ("constant", "Size::Usual", "Size")])
rule("ep06_members", "a.php", "<?php\nnamespace N;\nconst RATE = 3, STEP = 4;\nabstract class Lamp {\n const MAX = 9, MIN = 1;\n protected static $on = true, $off;\n public function __construct(private readonly Bulb $bulb, int $watts) {}\n abstract function dim(int $by): void;\n}\nfunction light(): Lamp { return new Lamp; }\n", "symbols", SYMBOLS,
     [("constant", "N\\RATE"), ("constant", "N\\STEP"), ("class", "N\\Lamp"), ("constant", "N\\Lamp::MAX"), ("constant", "N\\Lamp::MIN"), ("property", "N\\Lamp::$on"), ("property", "N\\Lamp::$off"), ("method", "N\\Lamp::__construct()"), ("property", "N\\Lamp::$bulb"), ("method", "N\\Lamp::dim()"), ("function", "N\\light()")])
rule("ep07_signature_types", "a.php", "<?php\nnamespace N;\nfunction ship(Crate $c, ?Port $p, int $n, \\Sea|Lake $w): ?Bill { $c->lift(); $p->dock(); $w->calm(); }\n", "edges", EDGES,
     [("N\\ship()", "references_type", "N\\Crate", True), ("N\\ship()", "references_type", "N\\Port", True), ("N\\ship()", "references_type", "Sea", True), ("N\\ship()", "references_type", "N\\Lake", True), ("N\\ship()", "references_type", "N\\Bill", True), ("N\\ship()", "calls", "N\\Crate::lift()", False), ("N\\ship()", "calls", "N\\Port::dock()", False)])
rule("ep08_class_names", "a.php", "<?php\nnamespace N;\nuse Lib\\Gear as G;\nclass Axle extends \\Base\\Rod {\n function spin() { new \\Out\\Nut; new self; new static; new G; new G\\Tooth; new Near; parent::spin(); }\n}\nclass Bare { function spin() { parent::spin(); } }\n", "edges", EDGES,
     [("N\\Axle", "extends", "Base\\Rod", True), ("N\\Axle::spin()", "instantiates", "Out\\Nut", True), ("N\\Axle::spin()", "instantiates", "N\\Axle", True), ("N\\Axle::spin()", "instantiates", "Lib\\Gear", True), ("N\\Axle::spin()", "instantiates", "Lib\\Gear\\Tooth", True), ("N\\Axle::spin()", "instantiates", "N\\Near", True), ("N\\Axle::spin()", "calls", "Base\\Rod::spin()", False)])
rule("ep09_functions", "a.php", "<?php\nnamespace N { use function Lib\\fold; function go() { \\Far\\away(); fold(); near(); } }\nnamespace { function top() { plain(); } }\n", "edges", EDGES,
     [("N\\go()", "calls", "Far\\away()", True), ("N\\go()", "calls", "Lib\\fold()", True), ("N\\go()", "calls", "near()", False), ("top()", "calls", "plain()", True)])
rule("ep10_body_edges", "a.php", "<?php\nclass Kiln {\n private Clay $clay;\n #[Glossy]\n function bake(Pot $pot) {\n  $f = #[Fired(3)] fn() => 1;\n  new Glaze; Oven::heat(); Oven::MAX; Oven::class; Oven::$count;\n  $this->cool(); $pot->dry(); $this->clay->wet();\n  if ($pot instanceof Bowl) { try { stack(); } catch (Crack | Chip $e) {} }\n  return $x->unknown();\n }\n}\n", "edges", EDGES,
     [("Kiln::bake()", "instantiates", "Glaze", True), ("Kiln::bake()", "calls", "Oven::heat()", True), ("Kiln::bake()", "references", "Oven::MAX", True), ("Kiln::bake()", "references_type", "Oven", True), ("Kiln::bake()", "references", "Oven::$count", True), ("Kiln::bake()", "calls", "Kiln::cool()", False), ("Kiln::bake()", "calls", "Pot::dry()", False), ("Kiln::bake()", "calls", "Clay::wet()", False), ("Kiln::bake()", "references_type", "Bowl", True), ("Kiln::bake()", "calls", "stack()", True), ("Kiln::bake()", "references_type", "Crack", True), ("Kiln::bake()", "references_type", "Chip", True), ("Kiln::bake()", "references_type", "Pot", True), ("Kiln", "references_type", "Clay", True), ("Kiln::bake()", "references_type", "Fired", True)])
rule("ep10_interpolated_calls", "a.php", "<?php\nfunction say(Bird $b, Tree $t) {\n echo \"a {$b->sing(\"hi\")} and {$t->sway()} \\{$b}\";\n return <<<END\n {$b->fly()} $t->leaf\n END;\n}\n", "edges", EDGES,
     [("say()", "calls", "Bird::sing()", False), ("say()", "calls", "Tree::sway()", False), ("say()", "calls", "Bird::fly()", False)], kinds=("calls",))
rule("ep11_docs", "a.php", "<?php\n/** Holds ink. */\nclass Pen {\n // not this\n function a() {}\n /** Writes. */\n #[Pure]\n function b() {}\n /* no */\n function c() {}\n}\n", "symbols", ("kind", "fqn", "doc"),
     [("class", "Pen", "/** Holds ink. */"), ("method", "Pen::a()", ""), ("method", "Pen::b()", "/** Writes. */"), ("method", "Pen::c()", "")])

# Go

_GO = {"go": {".": "ex.org/farm"}}
rule("eg01_two_passes", "barn/a.go", "package barn\nfunc Feed(c Cow) { c.Eat() }\ntype Cow struct{}\nfunc (c Cow) Eat() {}\n", "edges", EDGES,
     [("ex.org/farm/barn.Feed()", "references_type", "ex.org/farm/barn.Cow", True), ("ex.org/farm/barn.Feed()", "calls", "ex.org/farm/barn.Cow.Eat()", False)], modules=_GO)
rule("eg02_imports", "barn/a.go", "package barn\nimport \"os\"\nimport (\n\tseed \"ex.org/farm/grain\"\n\t\"ex.org/lib/tools\"\n)\n", "imports", IMPORTS,
     [("os", "os", ""), ("seed", "ex.org/farm/grain", ""), ("tools", "ex.org/lib/tools", "")], modules=_GO)
rule("eg03_types", "a.go", "package main\ntype Plot struct{ Rows int }\ntype Grower interface{ Grow() }\ntype Crop = string\ntype Field []Plot\n", "symbols", SYMBOLS,
     [("class", "ex.org/farm.Plot"), ("property", "ex.org/farm.Plot.Rows"), ("interface", "ex.org/farm.Grower"), ("method", "ex.org/farm.Grower.Grow()"), ("type_alias", "ex.org/farm.Crop"), ("type_alias", "ex.org/farm.Field")], modules=_GO)
rule("eg04_fields", "a.go", "package main\nimport \"ex.org/lib/tools\"\ntype Cart struct {\n\tWheel\n\t*tools.Axle\n\tload *tools.Load\n\ta, b int\n}\nfunc (c *Cart) Roll() { c.load.Shift() }\n", "edges", EDGES,
     [("ex.org/farm.Cart", "extends", "ex.org/farm.Wheel", True), ("ex.org/farm.Cart", "extends", "ex.org/lib/tools.Axle", True), ("ex.org/farm.Cart", "references_type", "ex.org/lib/tools.Load", True), ("ex.org/farm.Cart.Roll()", "calls", "ex.org/lib/tools.Load.Shift()", False)], modules=_GO)
rule("eg05_interfaces", "a.go", "package main\nimport \"io\"\ntype Mill interface {\n\tio.Reader\n\tWheel\n\tGrind(s Sack) Flour\n}\n", "edges", EDGES,
     [("ex.org/farm.Mill", "extends", "io.Reader", True), ("ex.org/farm.Mill", "extends", "ex.org/farm.Wheel", True)], modules=_GO)
rule("eg06_values", "a.go", "package main\nconst Acre = 4047\nconst (\n\tNorth = iota\n\tSouth\n)\nvar gate, _ = open(), 1\nvar _ Grower = Plot{}\n", "symbols", SYMBOLS,
     [("constant", "ex.org/farm.Acre"), ("constant", "ex.org/farm.North"), ("constant", "ex.org/farm.South"), ("property", "ex.org/farm.gate")], modules=_GO)
rule("eg07_functions", "a.go", "package main\nfunc Sow[T any](n int) {}\nfunc (p *Plot) Dig() {}\nfunc (q Heap[T]) Turn() {}\n", "symbols", ("kind", "fqn", "container", "signature"),
     [("function", "ex.org/farm.Sow()", "", "func Sow[T any](n int)"), ("method", "ex.org/farm.Plot.Dig()", "ex.org/farm.Plot", "func (p *Plot) Dig()"), ("method", "ex.org/farm.Heap.Turn()", "ex.org/farm.Heap", "func (q Heap[T]) Turn()")], modules=_GO)
rule("eg08_type_edges", "a.go", "package main\nimport \"ex.org/lib/tools\"\nfunc Trade(m map[string]*Goat, f func(Hen) error, t ...tools.Saw) ([]Egg, bool) { return nil, true }\n", "edges", EDGES,
     [("ex.org/farm.Trade()", "references_type", f"ex.org/{x}", True) for x in ("farm.Goat", "farm.Hen", "lib/tools.Saw", "farm.Egg")], modules=_GO)
rule("eg09_literals", "a.go", "package main\nimport \"ex.org/lib/tools\"\nfunc Make() { _ = &Plot{1}; _ = tools.Saw{}; _ = []int{1}; _ = []Hen{{}} }\n", "edges", EDGES,
     [("ex.org/farm.Make()", "instantiates", "ex.org/farm.Plot", True), ("ex.org/farm.Make()", "instantiates", "ex.org/lib/tools.Saw", True)], modules=_GO, kinds=("instantiates",))
rule("eg10_calls", "a.go", "package main\nimport \"ex.org/lib/tools\"\ntype Plot struct{ well tools.Well }\nfunc (p Plot) Water(h Hose) { drip(); tools.Cut(); p.Soak(); h.Coil(); p.well.Pump(); p.a.b.Deep(); len(nil); x.Lost() }\n", "edges", EDGES,
     [("ex.org/farm.Plot.Water()", "calls", "ex.org/farm.drip()", False), ("ex.org/farm.Plot.Water()", "calls", "ex.org/lib/tools.Cut()", True), ("ex.org/farm.Plot.Water()", "calls", "ex.org/farm.Plot.Soak()", False), ("ex.org/farm.Plot.Water()", "calls", "ex.org/farm.Hose.Coil()", False), ("ex.org/farm.Plot.Water()", "calls", "ex.org/lib/tools.Well.Pump()", False)], modules=_GO, kinds=("calls",))
rule("eg11_docs", "a.go", "package main\n\n// Row of\n// plants.\nfunc Row() {}\n\n// Apart.\n\nfunc Bed() {}\n", "symbols", ("kind", "fqn", "doc"),
     [("function", "ex.org/farm.Row()", "// Row of\n// plants."), ("function", "ex.org/farm.Bed()", "")], modules=_GO)

# TypeScript and JavaScript

_JS = {"js": {"@zoo": "packages/zoo", "@zoo/birds": "packages/birds"}}
rule("et01_two_passes", "src/a.ts", "export function feed() { groom(); }\nimport { wash } from './b';\nfunction groom() { wash(); later(); }\nconst later = () => feed();\n", "edges", EDGES,
     [("src/a#feed()", "calls", "src/a#groom()", True), ("src/a#groom()", "calls", "src/b#wash()", False), ("src/a#groom()", "calls", "src/a#later()", True), ("src/a#later()", "calls", "src/a#feed()", True)])
rule("et02_imports", "src/a.ts", "import Ape, { Bear, Cat as Puss, type Dog } from 'zoo';\nimport * as eel from './water/eel';\nimport './side';\n", "imports", IMPORTS,
     [("Ape", "zoo#default", ""), ("Bear", "zoo#Bear", ""), ("Puss", "zoo#Cat", ""), ("Dog", "zoo#Dog", ""), ("eel", "src/water/eel", "")])
rule("et03_specifiers", "src/cages/a.tsx", "import { a } from './b';\nimport { c } from '../d/index';\nimport { e } from '@zoo/birds/owl';\nimport { f } from '@zoo';\nimport { g } from '@zoology/x';\n", "imports", IMPORTS,
     [("a", "src/cages/b#a", ""), ("c", "src/d#c", ""), ("e", "packages/birds/owl#e", ""), ("f", "packages/zoo#f", ""), ("g", "@zoology/x#g", "")], modules=_JS)
rule("et04_names", "src/a.ts", "import Ape, { Cat as Puss } from 'zoo';\nclass Own {}\nexport function go() { new Ape(); new Puss(); new Own(); new Date(); }\n", "edges", EDGES,
     [("src/a#go()", "instantiates", "zoo#Ape", False), ("src/a#go()", "instantiates", "zoo#Cat", False), ("src/a#go()", "instantiates", "src/a#Own", True)])
rule("et05_declarations", "src/a.ts", "export abstract class Den<T> extends Cave<T> implements Warm {}\nclass Cave<T> {}\nexport interface Warm extends Dry { heat: number }\ninterface Dry {}\nexport const enum Fur { Short, Long = 2 }\nexport type Paw = Fur | string;\nexport default async function roar() {}\n", "symbols", SYMBOLS,
     [("class", "src/a#Den"), ("class", "src/a#Cave"), ("interface", "src/a#Warm"), ("property", "src/a#Warm.heat"), ("interface", "src/a#Dry"), ("enum", "src/a#Fur"), ("enum_case", "src/a#Fur.Short"), ("enum_case", "src/a#Fur.Long"), ("type_alias", "src/a#Paw"), ("function", "src/a#roar()")])
rule("et05_unnamed_class", "src/a.ts", "class Cave {}\nexport default class extends Cave { hide() { this.seek(); } }\n", "edges", EDGES,
     [("src/a#default", "extends", "src/a#Cave", True), ("src/a#default.hide()", "calls", "src/a#default.seek()", False)])
rule("et06_members", "src/a.ts", "class Cub {\n  static age: number = 1;\n  play = (toy: Toy) => { this.nap(); };\n  constructor(private mother: Bear, name: string) {}\n  async nap(): Promise<void> {}\n  get size() { return 1; }\n}\n", "symbols", ("kind", "fqn", "container"),
     [("class", "src/a#Cub", ""), ("property", "src/a#Cub.age", "src/a#Cub"), ("method", "src/a#Cub.play()", "src/a#Cub"), ("method", "src/a#Cub.constructor()", "src/a#Cub"), ("property", "src/a#Cub.mother", "src/a#Cub"), ("method", "src/a#Cub.nap()", "src/a#Cub"), ("method", "src/a#Cub.size()", "src/a#Cub")])
rule("et07_variables", "src/a.ts", "export const CAGES = 4, walk = () => 1;\nlet keeper: string = 'x';\nvar count = 2;\nconst swim = function () {};\n", "symbols", SYMBOLS,
     [("constant", "src/a#CAGES"), ("function", "src/a#walk()"), ("property", "src/a#keeper"), ("property", "src/a#count"), ("function", "src/a#swim()")])
rule("et08_type_edges", "src/a.ts", "import { Bear } from 'zoo';\nimport * as sea from './sea';\ntype Pack = Wolf[] | Map<string, Bear>;\ninterface Wolf { leader: Wolf; howl(at: sea.Moon): Bear }\n", "edges", EDGES,
     [("src/a#Pack", "references_type", "src/a#Wolf", True), ("src/a#Pack", "references_type", "zoo#Bear", False), ("src/a#Wolf.howl()", "references_type", "zoo#Bear", False)])
rule("et09_body_edges", "src/a.tsx", "import { Cage } from './cage';\nfunction clean() {}\nexport const Zoo = () => {\n  const n: Visitor = [1].map(() => clean());\n  new Ticket();\n  return <div><Cage /><p>x</p></div>;\n};\nclass Visitor {}\nclass Ticket {}\n", "edges", EDGES,
     [("src/a#Zoo()", "references_type", "src/a#Visitor", True), ("src/a#Zoo()", "calls", "src/a#clean()", True), ("src/a#Zoo()", "instantiates", "src/a#Ticket", True), ("src/a#Zoo()", "calls", "src/cage#Cage()", False)])
rule("et09_template_calls", "src/a.ts", "function name() {}\nfunction count(o: object) {}\nexport function label() { return `a ${name()} b ${`c ${count({ d: 1 })}`}\n ${'}'}`; }\n", "edges", EDGES,
     [("src/a#label()", "calls", "src/a#name()", True), ("src/a#label()", "calls", "src/a#count()", True)])
rule("et10_receivers", "src/a.ts", "import * as api from './api';\nimport { Vet } from './vet';\nclass Ward {\n  private vet: Vet;\n  round(v: Vet) { rest(); api.call(); v.look(); this.close(); this.vet.heal(); this.a.b.deep(); other.lost(); }\n}\nfunction rest() {}\n", "edges", EDGES,
     [("src/a#Ward.round()", "calls", "src/a#rest()", True), ("src/a#Ward.round()", "calls", "src/api#call()", False), ("src/a#Ward.round()", "calls", "src/vet#Vet.look()", False), ("src/a#Ward.round()", "calls", "src/a#Ward.close()", False), ("src/a#Ward.round()", "calls", "src/vet#Vet.heal()", False)], kinds=("calls",))
rule("et11_docs", "src/a.ts", "/** Big cat. */\nexport class Lion {\n  // loud\n  roar() {}\n}\n// one\n// two\nexport function run() {}\n", "symbols", ("kind", "fqn", "doc"),
     [("class", "src/a#Lion", "/** Big cat. */"), ("method", "src/a#Lion.roar()", "// loud"), ("function", "src/a#run()", "// one\n// two")])
rule("s10_shallow_vendor", "vendor/a.php", "<?php\nclass Leaf extends Root { use Bark; function go(Sun $s): Rain { return new Rain; } }\n", "edges", EDGES,
     [("Leaf", "extends", "Root", True), ("Leaf", "uses_trait", "Bark", True)], vendor=True)
rule("a11_equal_edges_once", "a.php", "<?php\nfunction go(Cup $c): Cup {\n fill();\n new Cup;\n fill();\n return new Cup;\n}\n", "edges", ("from_fqn", "kind", "to_fqn", "line"),
     [("go()", "references_type", "Cup", 2), ("go()", "calls", "fill()", 3), ("go()", "instantiates", "Cup", 4)])

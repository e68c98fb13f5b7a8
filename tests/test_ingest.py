"""Parsing and call resolution over small corpora of every language."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import ingest
from brindle.sources import parsers

CORPUS = {
    "game/__init__.py": ("Python", ""),
    "game/board.py": (
        "Python",
        "from .utils import clamp\nfrom game import pieces\nimport game.pieces as gp\n\nSIZE = 8\n\nclass Base:\n    pass\n\nclass Board(Base):\n    def __init__(self):\n        self.tile = pieces.Tile()\n        self.reset()\n\n"
        "    def reset(self):\n        def inner():\n            return clamp(1)\n        return inner()\n\n    def size(self, t: Base) -> int:\n        b = Board()\n        b.reset()\n        return self.tile.width()\n",
    ),
    "game/utils.py": ("Python", "def clamp(x):\n    return x\n\ndef clamp(x, y=0):\n    return x + y\n"),
    "game/pieces.py": ("Python", "from game.utils import *\n\nclass Tile:\n    def width(self):\n        return clamp(3)\n"),
    "game/broken.py": ("Python", "from game.utils import clamp\nimport game.pieces as gp\n\ndef f(:\n\ndef g(x):\n    # clamp(0)\n    gp.Tile()\n    return clamp('clamp(1)')\n"),
    "deep/app.py": ("Python", "from deep.engine import Engine\n\nclass App:\n    def __init__(self):\n        self.engine = Engine()\n\n    def go(self):\n        self.engine.pump.valve.turn()\n        e = Engine()\n        e.pump.start()\n        self.engine.missing.turn()\n"),
    "deep/engine.py": ("Python", "from deep.pump import Pump\n\nclass Engine:\n    def __init__(self):\n        self.pump = Pump()\n"),
    "deep/pump.py": ("Python", "class Valve:\n    def turn(self):\n        pass\n\nclass Pump:\n    def __init__(self):\n        self.valve = Valve()\n\n    def start(self):\n        pass\n"),
    "svc/repo.ts": ("TypeScript", "export class Repo {\n  save(): void {\n    return;\n  }\n}\n"),
    "svc/app.ts": ("TypeScript", "import { Repo } from './repo';\n\nexport class App {\n  private spare: Repo;\n  constructor(private readonly repo: Repo) {\n    this.made = new Repo();\n  }\n  run(): void {\n    this.repo.save();\n  }\n  other(): void {\n    this.made.save();\n  }\n  third(): void {\n    this.spare.save();\n  }\n}\n"),
    "jv/Repo.java": ("Java", "package jv;\n\npublic class Repo {\n  public void save() {\n  }\n}\n"),
    "jv/App.java": ("Java", "package jv;\nimport jv.Repo;\n\npublic class App {\n  private final Repo repo = new Repo();\n  public void run() {\n    this.repo.save();\n  }\n}\n"),
    "rs/repo.rs": ("Rust", "pub struct Repo { n: u32 }\n\nimpl Repo {\n    pub fn save(&self) {}\n}\n"),
    "rs/app.rs": ("Rust", "use rs::repo::Repo;\n\npub struct App {\n    repo: Box<Repo>,\n}\n\nimpl App {\n    pub fn run(&self) {\n        self.repo.save();\n    }\n}\n"),
    "web/card.tsx": ("TypeScript", "import { load as fetchIt } from './api';\nimport * as fmt from './fmt';\n\nexport interface Props { a: string }\nexport class Card extends Base {\n  render(x: number): void {\n    fetchIt(x);\n    fmt.pad(1);\n    this.draw();\n  }\n  draw() { return 1; }\n}\nexport const App = () => {\n  return <Card a='b' />;\n};\n"),
    "web/api.ts": ("TypeScript", "export function load(x: number) {\n  // load(2)\n  return x;\n}\n"),
    "web/fmt.js": ("JavaScript", "exports.pad = function (n) { return n; };\nfunction Shape() {}\nShape.prototype.area = function () { return exports.pad(2); };\n"),
    "src/lib.rs": ("Rust", "pub mod store;\nuse crate::store::{Store, open as open_store};\n\nfn main() {\n    let s = Store::new();\n    s.get();\n    open_store();\n}\n"),
    "src/store.rs": ("Rust", "pub struct Store { n: u32 }\n\nimpl Store {\n    pub fn new() -> Self { Store { n: 0 } }\n    pub fn get(&self) -> u32 { self.n }\n}\n\nimpl Display for Store {\n    fn fmt(&self) {}\n}\n\npub fn open() -> Store { Store::new() }\n"),
    "pkg/a.go": ("Go", 'package pkg\n\nimport "example.com/x/util"\n\ntype T struct { n int }\n\nfunc (t *T) Run() {\n\thelper()\n\tutil.Trim("run()")\n}\n'),
    "pkg/b.go": ("Go", "package pkg\n\nfunc helper() int { return 1 }\n"),
    "util/trim.go": ("Go", "package util\n\nfunc Trim(s string) string { return s }\n"),
    "app/Main.java": ("Java", "package app;\nimport app.model.Item;\n\npublic class Main extends Item implements Runnable {\n  public void run() {\n    Item it = new Item();\n    it.name();\n    local();\n  }\n  private static int local() { return 1; }\n}\n"),
    "app/model/Item.java": ("Java", "package app.model;\n\npublic class Item {\n  public String name() { return \"x\"; }\n}\n"),
    "c/main.c": ("C", '#include "list.h"\n\nstatic int twice(int x)\n{\n    return list_len(x) * 2;\n}\n\nint main(void) {\n    return twice(3);\n}\n'),
    "c/list.h": ("C", "struct list { int n; };\nstatic inline int list_len(int x) { return x; }\n"),
    "cpp/shape.cpp": ("Cpp", '#include "shape.hpp"\n\nint Shape::area() {\n    return side() * 2;\n}\n'),
    "cpp/shape.hpp": ("Cpp", "class Shape : public Base {\npublic:\n    int side() { return 1; }\n};\n"),
    "cs/App.cs": ("CSharp", "using Lib;\n\nnamespace App {\n  public class Program : Tool {\n    public static void Main(string[] args) {\n      Run(1);\n    }\n    static void Run(int x) { }\n  }\n}\n"),
}


@pytest.fixture(scope="module")
def corpus(spark):
    files = spark.createDataFrame([(p, lang, text) for p, (lang, text) in CORPUS.items()], "path string, language string, content string")
    return spark.createDataFrame(parsers.facts(files).collect(), parsers.FACTS)


@pytest.fixture(scope="module")
def edges(corpus):
    return {(r.ty, f"{r.source_path}::{r.source_key}", f"{r.target_path}::{r.target_key}") for r in ingest.edges(corpus).collect()}


def test_symbols(corpus):
    got = {(r.path, r.key, r.disambiguator): r.kind for r in ingest.symbols(corpus).collect()}
    assert got["game/board.py", "$file", ""] == "File"
    assert got["game/board.py", "Board.reset", ""] == "Function"
    assert got["game/board.py", "SIZE", ""] == "Function"
    assert ("game/board.py", "inner", "") not in got and ("game/board.py", "Board.reset.inner", "") not in got
    assert got["game/utils.py", "clamp", ""] == "Function" and got["game/utils.py", "clamp", "fn:0"] == "Function"
    for path, key, kind in [
        ("web/card.tsx", "Card", "Class"), ("web/card.tsx", "Card.render", "Function"), ("web/card.tsx", "App", "Function"), ("web/card.tsx", "Props", "Class"),
        ("web/fmt.js", "pad", "Function"), ("web/fmt.js", "Shape.area", "Function"), ("src/store.rs", "Store", "Class"), ("src/store.rs", "Store.new", "Function"),
        ("src/store.rs", "open", "Function"), ("pkg/a.go", "T", "Class"), ("pkg/a.go", "T.Run", "Function"), ("app/Main.java", "Main", "Class"), ("app/Main.java", "Main.run", "Function"),
        ("c/main.c", "twice", "Function"), ("c/main.c", "main", "Function"), ("cpp/shape.cpp", "Shape.area", "Function"), ("cpp/shape.hpp", "Shape", "Class"), ("cs/App.cs", "Program", "Class"),
    ]:
        keys = {k for p, k, d in got if p == path}
        assert any(k == key or k.endswith("." + key) for k in keys), (path, key, keys)
        assert got.get((path, key, ""), kind) == kind


def test_errors_are_rows(corpus):
    assert [r.path for r in corpus.filter("fact = 'error'").collect()] == ["game/broken.py"]


@pytest.mark.parametrize(
    "edge",
    [
        ("Imports", "game/board.py::$file", "game/utils.py::clamp"),
        ("Imports", "game/board.py::$file", "game/pieces.py::$file"),
        ("Imports", "game/pieces.py::$file", "game/utils.py::$file"),
        ("Extends", "game/board.py::Board", "game/board.py::Base"),
        ("Uses", "game/board.py::Board.size", "game/board.py::Base"),
        ("Calls", "game/board.py::Board.reset", "game/utils.py::clamp"),
        ("Calls", "game/board.py::Board.__init__", "game/board.py::Board.reset"),
        ("Calls", "game/board.py::Board.__init__", "game/pieces.py::Tile"),
        ("Calls", "game/board.py::Board.size", "game/board.py::Board.reset"),
        ("Calls", "game/pieces.py::Tile.width", "game/utils.py::clamp"),
        ("Imports", "web/card.tsx::$file", "web/api.ts::load"),
        ("Calls", "web/card.tsx::Card.render", "web/api.ts::load"),
        ("Calls", "web/card.tsx::Card.render", "web/fmt.js::pad"),
        ("Calls", "web/card.tsx::Card.render", "web/card.tsx::Card.draw"),
        ("Calls", "web/card.tsx::App", "web/card.tsx::Card"),
        ("Calls", "src/lib.rs::main", "src/store.rs::Store.new"),
        ("Calls", "src/lib.rs::main", "src/store.rs::Store.get"),
        ("Calls", "src/lib.rs::main", "src/store.rs::open"),
        ("Calls", "pkg/a.go::T.Run", "pkg/b.go::helper"),
        ("Calls", "pkg/a.go::T.Run", "util/trim.go::Trim"),
        ("Imports", "app/Main.java::$file", "app/model/Item.java::Item"),
        ("Extends", "app/Main.java::Main", "app/model/Item.java::Item"),
        ("Calls", "app/Main.java::Main.run", "app/model/Item.java::Item.name"),
        ("Calls", "app/Main.java::Main.run", "app/Main.java::Main.local"),
        ("Calls", "game/broken.py::g", "game/utils.py::clamp"),
        ("Calls", "game/broken.py::g", "game/pieces.py::Tile"),
        ("Calls", "deep/app.py::App.go", "deep/pump.py::Valve.turn"),
        ("Calls", "deep/app.py::App.go", "deep/pump.py::Pump.start"),
        ("Calls", "svc/app.ts::App.run", "svc/repo.ts::Repo.save"),
        ("Calls", "svc/app.ts::App.other", "svc/repo.ts::Repo.save"),
        ("Calls", "svc/app.ts::App.third", "svc/repo.ts::Repo.save"),
        ("Calls", "jv/App.java::App.run", "jv/Repo.java::Repo.save"),
        ("Calls", "rs/app.rs::App.run", "rs/repo.rs::Repo.save"),
        ("Calls", "c/main.c::main", "c/main.c::twice"),
        ("Calls", "c/main.c::twice", "c/list.h::list_len"),
    ],
)
def test_edges(edges, edge):
    assert edge in edges, sorted(e for e in edges if e[1].split("::")[0] == edge[1].split("::")[0])


def test_no_calls_from_comments_or_strings(edges):
    assert not any(e[0] == "Calls" and e[1] == e[2] for e in edges if e[1].startswith("web/api"))


def test_no_false_edges(edges):
    """All calls of the small corpora of chains and fields, and no others."""
    got = {e[1:] for e in edges if e[0] == "Calls" and e[1].split("/")[0] in ("deep", "svc", "jv", "rs")}
    made = {("deep/app.py::App.__init__", "deep/engine.py::Engine"), ("deep/app.py::App.go", "deep/engine.py::Engine"), ("deep/engine.py::Engine.__init__", "deep/pump.py::Pump"), ("deep/pump.py::Pump.__init__", "deep/pump.py::Valve")}
    want = made | {
        ("deep/app.py::App.go", "deep/pump.py::Valve.turn"), ("deep/app.py::App.go", "deep/pump.py::Pump.start"), ("svc/app.ts::App.run", "svc/repo.ts::Repo.save"), ("svc/app.ts::App.other", "svc/repo.ts::Repo.save"),
        ("svc/app.ts::App.third", "svc/repo.ts::Repo.save"), ("jv/App.java::App.run", "jv/Repo.java::Repo.save"), ("rs/app.rs::App.run", "rs/repo.rs::Repo.save"),
    }
    assert want <= got and all(t.split("::")[1] in ("Repo", "App") for _, t in got - want), got - want


def test_large_files_are_read_in_little_time():
    import time

    text = "class Big {\n" + "".join(f"  m{i}() {{\n    return this.m{i // 2}();\n  }}\n" for i in range(6000)) + "}\n"
    began = time.time()
    ix = parsers.parse_braces("big.js", text, "JavaScript")
    assert sum(r[3] == "symbol" for r in ix.rows) == 6002 and time.time() - began < 20


def test_next_revisions(spark, corpus):
    syms = ingest.symbols(corpus).filter("path = 'game/pieces.py'")
    rows = {r.key: r.identity_id for r in syms.collect()}
    bodies = spark.createDataFrame([(rows["Tile"], "b1"), (rows["Tile.width"], "b2"), (rows["$file"], "b3")], "identity_id string, body_hash string")
    prim = spark.createDataFrame([(rows["Tile"], "r1", "b1", "game/pieces.py"), (rows["Tile.width"], "r2", "old", "game/pieces.py"), ("gone", "r3", "b9", "game/pieces.py"), ("other", "r4", "b9", "x.py")], "identity_id string, revision_id string, body_hash string, file_path string")
    got = {r.identity_id: (r.action, r.parent_revision_id) for r in ingest.next_revisions(syms, bodies, prim, 0).collect()}
    assert got == {rows["Tile"]: ("reuse", None), rows["Tile.width"]: ("change", "r2"), rows["$file"]: ("new", None), "gone": ("retire", None)}
    again = ingest.next_revisions(syms, bodies, prim.limit(0), 0).agg(F.count_if(F.col("action") == "new")).head()[0]
    assert again == 3

"""From source text to findings: extraction, resolution, edges, dead code and incremental snapshots, on small projects of each language."""

import pytest
from pyspark.sql import functions as F

from arborlight.extract.facts import extract
from arborlight.extract.packs import PACKS, load_packs, pack_for
from arborlight.index import Store
from arborlight.operators import resolve as X
from arborlight.operators.deadcode import AllowList, dead_code
from arborlight.sources.workspace import scan_workspace

PROJECTS = {
    "python": {
        "shop/cart.py": "from shop.tax import rate, Till\n\n\ndef main():\n    t = Till()\n    t.open()\n    print(rate())\n\n\ndef _gone():\n    return 1\n\n\ndef _ping():\n    return _pong()\n\n\ndef _pong():\n    return _ping()\n\n\nif __name__ == '__main__':\n    main()\n",
        "shop/tax.py": "def rate():\n    return 1\n\n\ndef spare():\n    return 2\n\n\ndef _for_tests():\n    return 3\n\n\nclass Till:\n    def __init__(self):\n        self.n = 0\n\n    def open(self):\n        self._step()\n\n    def _step(self):\n        self.n += 1\n\n    def _never(self):\n        return None\n\n    def closing(self):\n        return None\n",
        "shop/dyn.py": "import sys\n\n\ndef _by_name():\n    return 4\n\n\ndef find():\n    return getattr(sys.modules[__name__], '_by_name')()\n",
        "shop/web.py": "from shop.cart import app\nfrom base import Server\n\n\n@app.route('/x')\ndef view():\n    return 'x'\n\n\nclass Page(Server):\n    def serve(self):\n        return None\n\n\nPAGE = Page\n",
        "shop/old.py": "# tool:keep(plugins call it)\ndef hook():\n    return 1\n\n\ndef listed():\n    return 2\n",
        "tests/test_tax.py": "from shop.tax import _for_tests\n\n\ndef test_it():\n    assert _for_tests() == 3\n",
    },
    "js": {
        "page.html": "<script>onlyHere()</script>",
        "src/main.js": "import { used } from './lib.js';\nimport fs from 'node:fs';\n\nfunction dead() {\n  return 1;\n}\n\nexport function spare() {\n  return 2;\n}\n\nconsole.log(used(), fs.existsSync('x'));\n\nexport function onlyHere() {\n  return 3;\n}\n",
        "src/lib.js": "export function used() {\n  return help();\n}\n\nfunction help() { return 1; }\n\nexport class Box {\n  constructor() {\n    this.n = 1;\n  }\n  render() {\n    return this.n;\n  }\n  unusedMethod() {\n    return `${help()} {`;\n  }\n}\n",
    },
    "rust": {
        "src/main.rs": "mod util;\nuse util::used;\n\nfn main() {\n    used();\n}\n\nfn dead() -> char { '{' }\n\nstruct Gone;\n\nfn for_tests() -> u8 { 1 }\n\n#[cfg(test)]\nmod tests {\n    use super::*;\n    #[test]\n    fn t() {\n        assert_eq!(for_tests(), 1);\n    }\n}\n",
        "src/util.rs": "pub fn used() -> S {\n    S::make()\n}\n\npub fn spare() {}\n\npub struct S;\n\nimpl S {\n    pub fn make() -> S { S }\n    pub fn other(&self) -> u8 { 2 }\n}\n\nimpl std::fmt::Display for S {\n    fn fmt(&self, f: &mut std::fmt::Formatter<'_>) -> std::fmt::Result { write!(f, \"S\") }\n}\n",
    },
    "java": {
        "src/app/Main.java": "package app;\n\nimport app.Tool;\n\npublic class Main {\n    public static void main(String[] args) {\n        new Tool().go();\n    }\n    private void never() { }\n    @Override\n    public String toString() { return \"{\"; }\n}\n",
        "src/app/Tool.java": "package app;\n\npublic class Tool {\n    public void go() { }\n    public void spare() { }\n}\n",
        "src/test/ToolTest.java": "package app;\n\nclass ToolTest {\n    @Test\n    void works() { new Tool().spare(); }\n}\n",
    },
    "go": {
        "main.go": "package main\n\nimport (\n\t\"fmt\"\n\t\"x.org/m/lib\"\n)\n\nfunc main() {\n\tfmt.Println(lib.Used())\n}\n\nfunc dead() {}\n",
        "lib/lib.go": "package lib\n\ntype Box struct{}\n\nfunc Used() int { return Box{}.size() }\n\nfunc (b Box) size() int { return 1 }\n\nfunc (b Box) String() string { return \"\" }\n\nfunc (b Box) lost() int { return 2 }\n",
    },
}
FOUND = {
    "python": {("high", 0.95, "_gone", 10), ("high", 0.95, "Till._never", 23), ("medium", 0.77, "spare", 5), ("medium", 0.77, "Till.closing", 26), ("medium", 0.8, "_ping", 14), ("medium", 0.8, "_pong", 18), ("medium", 0.8, "_for_tests", 9),
               ("low", 0.52, "_by_name", 4), ("low", 0.6, "find", 8), ("low", 0.51, "view", 6), ("low", 0.55, "Page.serve", 11)},
    "js": {("high", 0.95, "dead", 4), ("medium", 0.77, "spare", 8), ("medium", 0.77, "Box", 7), ("medium", 0.77, "Box.unusedMethod", 14)},
    "rust": {("high", 0.95, "dead", 8), ("high", 0.95, "Gone", 10), ("medium", 0.77, "spare", 5), ("medium", 0.77, "S::other", 11), ("medium", 0.8, "for_tests", 12)},
    "java": {("high", 0.95, "Main.never", 9), ("low", 0.63, "Tool.spare", 5)},
    "go": {("high", 0.95, "dead", 12), ("high", 0.95, "Box.lost", 11)},
}


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.mark.parametrize("name", sorted(PROJECTS))
def test_projects_give_their_findings(spark, tmp_path, name):
    write(tmp_path / "p", PROJECTS[name])
    store = Store(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], "eco string, name string")
    graph = store.update(scan_workspace(spark, str(tmp_path / "p")), none)
    allow = AllowList.parse('[[allow]]\nsymbol = "listed"\n')
    got = dead_code(graph, allow, least=0.0).collect()
    assert {(r.level, r.confidence, r.symbol, r.line) for r in got} == FOUND[name]
    assert [r.confidence for r in got] == sorted((r.confidence for r in got), reverse=True)
    if name == "python":
        lib = {r.symbol for r in dead_code(graph, allow, library=True).collect()}
        assert "spare" not in lib and "_gone" in lib
        assert {r.file for r in dead_code(graph, allow, prefix="shop/t", kinds=("function",)).collect()} == {"shop/tax.py"}


def test_snapshots_take_what_is_unchanged(spark, tmp_path):
    write(tmp_path / "p", PROJECTS["python"])
    store, none = Store(spark, str(tmp_path / "store")), spark.createDataFrame([], "eco string, name string")
    store.update(scan_workspace(spark, str(tmp_path / "p")), none, stamp="a")
    first = store.meta()["number"]
    store.update(scan_workspace(spark, str(tmp_path / "p")), none, stamp="a")
    assert store.meta()["number"] == first  # nothing changed, nothing written
    (tmp_path / "p/shop/tax.py").write_text("def rate():\n    return 1\n")
    (tmp_path / "p/shop/dyn.py").unlink()
    graph = store.update(scan_workspace(spark, str(tmp_path / "p")), none, stamp="a")
    assert store.meta()["number"] == first + 1
    names = {r.name for r in graph["symbols"].select("name").collect()}
    assert "rate" in names and "spare" not in names and "find" not in names and "_gone" in names
    store.update(scan_workspace(spark, str(tmp_path / "p")), none, stamp="b")
    assert store.meta()["number"] == first + 2


@pytest.mark.parametrize("path,text,want", [
    ("a/b.py", "from . import x, y\n", ("local", ["a/__init__.py", "a/x.py"])), ("a/b.py", "from .none import q\n", ("unresolved", [])), ("a/b.py", "from ..c import z\n", ("local", ["c/__init__.py"])),
    ("a/b.py", "import pkg.mod\n", ("local", ["src/pkg/mod.py"])), ("a/b.py", "import os.path\n", ("stdlib", [])), ("a/b.py", "import numpy as np\n", ("external", [])),
    ("web/a.ts", "import q from './t.js'\n", ("local", ["web/t.ts"])), ("web/a.ts", "import './lib'\n", ("local", ["web/lib/index.tsx"])), ("web/a.ts", "import '@s/p/q'\n", ("external", [])), ("web/a.ts", "import '@/x'\n", ("alias", [])),
    ("web/a.ts", "import './gone'\n", ("unresolved", [])), ("web/a.ts", "import '../../../x'\n", ("unresolved", [])), ("web/a.ts", "import 'fs'\n", ("stdlib", [])),
    ("src/lib.rs", "mod one;\n", ("local", ["src/one.rs"])), ("src/one.rs", "mod two;\n", ("unresolved", [])), ("src/lib.rs", "use crate::one::Thing;\n", ("local", ["src/one.rs"])), ("src/lib.rs", "use serde::de;\n", ("external", [])), ("src/lib.rs", "use std::fmt;\n", ("stdlib", [])), ("src/lib.rs", "use one::q;\n", ("local", [])),
    ("m.go", "package m\nimport \"x.org/r/util\"\n", ("local", ["r/util/u.go"])), ("m.go", "package m\nimport \"fmt\"\n", ("stdlib", [])), ("M.java", "import org.q.Thing;\n", ("local", ["j/org/q/Thing.java"])), ("M.java", "import org.q.*;\n", ("local", ["j/org/q/Other.java", "j/org/q/Thing.java"])),
    ("M.java", "import java.util.List;\n", ("stdlib", [])), ("m.cs", "using System.Text;\n", ("stdlib", [])), ("m.cs", "using Acme.Core;\n", ("external", [])),
])
def test_imports_resolve_by_language(spark, path, text, want, _view={}):  # noqa: B006
    if not _view:
        known = ["a/b.py", "a/x.py", "a/__init__.py", "c/__init__.py", "src/pkg/mod.py", "web/t.ts", "web/lib/index.tsx", "src/lib.rs", "src/one.rs", "r/util/u.go", "r/util/u_test.go", "j/org/q/Thing.java", "j/org/q/Other.java"]
        files = spark.createDataFrame([(p, pack_for(p).id) for p in known], "path string, lang string")
        imports = spark.createDataFrame([("src/lib.rs", "rust", "one", [], "mod")], "file string, lang string, module string, names array<string>, kind string")
        _view["rows"] = {(r.space, r.key): r.found for r in X.targets(files, imports, spark.createDataFrame([], "eco string, name string")).collect()}
    i = extract(path, text, pack_for(path))["imports"][0]
    default, _, tries = X.candidates(path, pack_for(path).id, i["module"], i["names"], i["kind"])
    met: dict = {}
    for g, prio, space, key in tries:
        if (space, key) in _view["rows"]:
            met[g] = min(met.get(g, (99, None)), (prio, _view["rows"][space, key]), key=lambda x: x[0])
    got = ("local", sorted({f for _, found in met.values() for f in found})) if met else (default, [])
    assert got == want


def test_extraction_of_odd_files():
    broken = extract("a.py", "def f(:\n    pass\nclass C:\n    def g(self):\n        return (\n", PACKS["python"])
    assert broken["parse_status"] == "syntax-errors" and [s["qname"] for s in broken["symbols"]] == ["f", "C", "C.g"]
    optional = extract("a.py", "try:\n    import simplejson as json\nexcept ImportError:\n    import json\n", PACKS["python"])
    assert [(i["module"], i["kind"]) for i in optional["imports"]] == [("simplejson", "optional"), ("json", "import")]
    alias = extract("a.py", "from m import long_name as ln\nln()\n", PACKS["python"])
    assert [r["name"] for r in alias["refs"]] == ["long_name"]
    rust = extract("a.rs", 'pub use a::{b, c as d};\nfn f() { println!("{name} {{no}}"); }\n#[my::attr]\npub(crate) fn g() {}\nextern crate zed;\n', PACKS["rust"])
    assert "name" in {r["name"] for r in rust["refs"]} and "no" not in {r["name"] for r in rust["refs"]}
    assert [(s["name"], s["exported"], s["decorated"]) for s in rust["symbols"]] == [("f", False, False), ("g", False, True)]
    assert {(i["module"], tuple(i["names"])) for i in rust["imports"]} == {("a::{b, c as d}", ("b", "d")), ("zed", ())}
    for pack in PACKS.values():
        for text in ("", "\n", "{{{", "}}}", "'", '"', "/*", "\x00", "é = '🙂'\n", "#" * 5000):
            extract(f"x{pack.extensions[0]}", text, pack)
    made = extract("x.pb.go", "package x\n", PACKS["go"])
    assert made["is_generated"] and extract("a.go", "// Code generated by x\n", PACKS["go"])["is_generated"] and not extract("a.py", "# do not edit\n", PACKS["python"])["is_generated"]


def test_use_bindings_and_joins():
    assert X.rust_use_bindings("a::b::{c, d::e, f as g, self}") == ["c", "e", "g", "b"]
    assert X.rust_use_bindings("a::*") == [] and X.rust_use_bindings("a::b") == ["b"] and X.rust_use_bindings("x") == ["x"]
    assert X.lexical_join("a/b", "../c") == "a/c" and X.lexical_join("a", "../../c") is None


def test_packs_of_users(tmp_path):
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/pack.toml").write_text('id = "starlark"\ngrammar = "python"\nextensions = [".bzl"]\ntest_globs = ["**/t/**"]\n')
    packs = load_packs(str(tmp_path))
    assert pack_for("a/B.BZL", packs).id == "starlark" and packs["starlark"].is_test("x/t/y.bzl") and pack_for("q.txt") is None
    (tmp_path / "mine/pack.toml").write_text('id = "x"\ngrammar = "cobol"\nextensions = [".cob"]\n')
    with pytest.raises(ValueError):
        load_packs(str(tmp_path))


def test_allow_lists(spark):
    for bad in ("[[allow]]\nreason = 'x'\n", "[[deps_allow]]\npath = 'a'\nreason = ' '\n"):
        with pytest.raises(ValueError):
            AllowList.parse(bad)
    a = AllowList.parse("[[allow]]\nsymbol = 'A.*'\npath = 'x/**'\nreason = 'one'\n[[allow]]\npath = '**/y.py'\n[[deps_allow]]\npath = 'v/**'\npackage = 'num*'\nreason = 'ok'\n")
    df = spark.createDataFrame([("f", "A.f", "x/q.py"), ("f", "B.f", "x/q.py"), ("g", "g", "z/y.py")], "name string, qname string, path string")
    assert [r[0] for r in df.select(a.reason(F.col("name"), F.col("qname"), F.col("path"))).collect()] == ["one", None, "allow-listed"]
    d = spark.createDataFrame([("v/a.py", "numpy"), ("v/a.py", None), ("w/a.py", "numpy")], "path string, package string")
    assert [r[0] for r in d.select(a.allows_dependency(F.col("path"), F.col("package"))).collect()] == [True, False, False]

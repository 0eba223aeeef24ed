"""Analyzers and ingest on source trees that are written here."""

import pytest
from sparkloom.sources import config, ingest
from sparkloom.sources.analyzers import cpp, objc, python, rust, script

TREE = {
    "app/__init__.py": "from .core import run\n",
    "app/core.py": "import os, json as j\nfrom app.util import helper as h, Other\nfrom . import sibling\nfrom .sibling import *\nfrom ..nowhere import x\nimport lib.deep\n\n@deco\nasync def run():\n    import re\n    return h(Other)\n\nclass _Hidden: pass\nclass __Dunder__: pass\nA = B = 1\nA: int = 2\nx.y = 3\n(c, d) = 1, 2\nif True:\n    nested = 1\n",
    "app/sibling.py": "", "app/util.py": "def helper(): pass\nclass Other: pass\n", "lib/deep/__init__.py": "VALUE = 1\n", "app/broken.py": "def (:\n",
    "web/tsconfig.json": "{}", "tsconfig.json": '{ // comment\n "compilerOptions": {"baseUrl": "web", "paths": {"@app/*": ["src/*"],},}}', "package.json": '{"dependencies": {"react": "1", "@s/kit": "2"}}',
    "web/src/index.ts": "export { Button as Knob } from './button';\nexport * from './deep';\nimport def from './default';\nexport { def as renamed };\n",
    "web/src/deep.ts": "export * from './deeper';\n", "web/src/deeper.ts": "export const low = 1;\nexport interface Shape { a: number }\nexport function overloaded(a: string): void;\nexport function overloaded(a: number): void;\nexport function overloaded(a: any) {}\n",
    "web/src/button.tsx": "import React from 'react';\nexport class Button { render() { return React; } }\n", "web/src/default.ts": "export default function main() {}\n",
    "web/src/use.ts": "import { Knob, low, type Shape, renamed } from '@app/index';\nimport * as all from './deeper.js';\nimport type { X } from '@s/kit/sub';\nimport './side';\nimport fs from 'fs';\nimport util from 'src/util';\nconst text = `import { no } from 'no'`; /* import x from 'x' */\nlet s: Shape = new Knob(low, renamed); all.overloaded(1);\nconst a = 1, b = { c: 2, d: [3, 4] }, e = (x) => x;\nenum E { A }\nnamespace N { export const hidden = 1 }\ntype T = string;\ndeclare function ambient(): void;\nexport default class Named {}\n",
    "web/src/util.js": "export const u = 1;\n", "web/src/side.d.ts": "",
    "Cargo.toml": '[package]\nname = "own"\n[dependencies]\nserde-json = "1"\n', "src/lib.rs": "pub mod net;\nmod missing;\nmod inline { fn inner() {} }\nuse crate::net::{self, tcp::Stream as S, udp::*};\nuse serde_json::{Value, json};\nuse std::io;\nuse net::Local;\npub use self::net::tcp;\npub struct Point<'a> { x: &'a str }\npub(crate) enum E { A }\ntrait T {}\ntype U = u8;\nconst C: char = '\"';\nstatic mut G: u8 = 0;\nmacro_rules! mac { () => {} }\npub unsafe fn danger() {}\nimpl E { pub fn method() {} }\nfn danger() {}\n// fn commented() {}\nconst S2: &str = \"fn no() {}\";\n",
    "src/net/mod.rs": "use super::net::tcp::Stream;\n", "src/net/tcp.rs": "pub struct Stream;\n", "src/net/udp.rs": "",
    "c/main.c": '#include "util.h"\n#include <stdio.h>\n#include <shared.h>\n#include "../include/shared.h"\n// #include "no.h"\n#define MAX(a, b) ((a) > (b))\n#define FLAG\nstatic int counter = 0, *ptr;\nint main(int argc, char **argv) { int local = 1; return local; }\nstruct point { int x; };\nunion u { int a; };\nenum color { RED };\ntypedef struct point point_t;\ntypedef int (*callback)(int);\nvoid declared(int);\nint table[3] = {1, 2, 3};\n#ifdef X\nint both;\n#else\nint both;\n#endif\nstruct point origin;\n',
    "c/util.h": "#pragma once\nint util(void);\n", "include/shared.h": "",
    "c/shape.hpp": 'namespace geo {\nclass Shape { public: virtual ~Shape(); int area() const { return 0; } };\ntemplate <typename T, int N> T add(T a, T b) { return a + b; }\nnamespace inner { struct In {}; }\n}\nvoid geo::Shape::draw() {}\nShape& operator+(const Shape& a, const Shape& b) { return a; }\nextern "C" { int cfn(void) { return 1; } }\nusing namespace std;\n',
    "ios/Animal.h": '#import <Foundation/Foundation.h>\n#import "Habitat.h"\n@class Food, Water;\n@protocol Eating;\n@protocol Walking <NSObject>\n- (void)walk;\n@end\n@interface Animal : NSObject <Walking>\n@end\n@interface Animal (Training)\n@end\n#define LEGS 4\n',
    "ios/Habitat.h": "@import UIKit;\n@interface Food : NSObject\n@end\n", "ios/Animal.m": '#import "Animal.h"\n@implementation Animal\n@end\n@implementation Animal (Training)\n@end\n', "ios/Mixed.mm": "#include <vector>\n",
    "node_modules/react/index.js": "export default 1;\n", "dist/out.js": "", ".hidden/x.py": "", "readme.md": "# no\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        f = at / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (at / "bad.py").write_bytes(b"x = '\xff'\n")
    (at / "linked").symlink_to(at / "app")
    return at


@pytest.fixture(scope="module")
def graph(spark, root):
    c = config.read(root)
    c["cpp"]["include_dirs"] = c["objc"]["include_dirs"] = ["include", "ios"]
    g = ingest.build(ingest.scan(spark, str(root)), c, python_references=True)
    nodes = {r.id: r for r in g.nodes.collect()}
    edges = {(r.src, r.kind, r.dst): r for r in g.edges.collect()}
    return nodes, edges


def symbols(nodes, path):
    return {r.id.split("#", 1)[1]: r.symbol_kind for r in nodes.values() if r.kind == "symbol" and r.file == path}


def targets(edges, path, kind="import"):
    return {d for s, k, d in edges if s == f"file:{path}" and k == kind}


def test_scan(spark, root):
    found = {r.path: r.text for r in ingest.scan(spark, str(root)).collect()}
    want = {p for p in TREE if not p.startswith(("node_modules", "dist", ".hidden"))} | {"bad.py"}
    assert set(found) == want and found["app/__init__.py"] == TREE["app/__init__.py"] and found["app/sibling.py"] == ""
    assert found["bad.py"] == "x = '�'\n"
    assert "readme.md" not in {r.path for r in ingest.scan(spark, str(root), ("**/*.md",)).collect()}


def test_python(graph):
    nodes, edges = graph
    assert symbols(nodes, "app/core.py") == {"run": "function", "_Hidden": "class", "__Dunder__": "class", "A": "variable", "A~1": "variable"}
    assert not nodes["sym:app/core.py#_Hidden"].exported and nodes["sym:app/core.py#__Dunder__"].exported
    assert targets(edges, "app/core.py") == {"ext:os", "ext:json", "file:app/util.py", "file:app/__init__.py", "file:app/sibling.py", "unresolved:..nowhere", "file:lib/deep/__init__.py", "ext:re"}
    assert edges["file:app/core.py", "import", "file:app/sibling.py"].wildcard
    assert edges["file:app/core.py", "import", "unresolved:..nowhere"].resolution == "unresolved"
    assert tuple(edges["file:app/core.py", "import", "file:app/util.py"].loc) == (2, 5)
    assert targets(edges, "app/core.py", "reference") == {"sym:app/util.py#helper", "sym:app/util.py#Other"}
    assert symbols(nodes, "app/broken.py") == {} and "file:app/broken.py" in nodes


def test_typescript(graph):
    nodes, edges = graph
    p = "web/src/use.ts"
    assert symbols(nodes, p) == {"text": "variable", "s": "variable", "a": "variable", "b": "variable", "e": "variable", "E": "enum", "N": "module", "T": "type", "ambient": "function", "Named": "class"}
    assert symbols(nodes, "web/src/deeper.ts") == {"low": "variable", "Shape": "interface", "overloaded": "function"}
    assert targets(edges, p) == {"file:web/src/index.ts", "file:web/src/deeper.ts", "ext:@s/kit", "file:web/src/side.d.ts", "ext:fs", "file:web/src/util.js"}
    assert edges[f"file:{p}", "import", "ext:@s/kit"].type_only and edges[f"file:{p}", "import", "file:web/src/deeper.ts"].wildcard
    assert edges[f"file:{p}", "import", "ext:fs"].resolution == "unresolved" and edges[f"file:{p}", "import", "ext:@s/kit"].resolution == "resolved"
    refs = targets(edges, p, "reference")
    assert refs == {"sym:web/src/button.tsx#Button", "sym:web/src/deeper.ts#low", "sym:web/src/deeper.ts#Shape", "sym:web/src/default.ts#main", "sym:web/src/deeper.ts#overloaded"}
    assert edges[f"file:{p}", "reference", "sym:web/src/deeper.ts#Shape"].type_only
    assert targets(edges, "web/src/index.ts") == {"file:web/src/button.tsx", "file:web/src/deep.ts", "file:web/src/default.ts"}
    assert nodes["file:web/src/util.js"].language == "js" and "ext:react" in targets(edges, "web/src/button.tsx", "reference")


def test_rust(graph):
    nodes, edges = graph
    assert symbols(nodes, "src/lib.rs") == {"inline": "module", "Point": "struct", "E": "enum", "T": "trait", "U": "type", "C": "variable", "G": "variable", "mac": "macro", "danger": "function", "danger~1": "function", "S2": "variable"}
    assert nodes["sym:src/lib.rs#danger"].exported and not nodes["sym:src/lib.rs#danger~1"].exported
    assert targets(edges, "src/lib.rs") == {"file:src/net/mod.rs", "file:<unresolved>/src/lib.rs::missing", "file:src/net/tcp.rs", "file:src/net/udp.rs", "ext:rust:serde_json::Value", "ext:rust:serde_json::json", "ext:rust:std::io", "ext:rust:net::Local"}
    assert edges["file:src/lib.rs", "import", "file:src/net/udp.rs"].wildcard
    assert edges["file:src/lib.rs", "import", "ext:rust:serde_json::json"].resolution == "resolved" and edges["file:src/lib.rs", "import", "ext:rust:net::Local"].resolution == "unresolved"
    assert targets(edges, "src/net/mod.rs") == {"file:src/net/tcp.rs"}


def test_use_trees():
    assert rust.uses("a::{b, c::{d as e, f::*}, self}") == [(["a", "b"], False), (["a", "c", "d"], False), (["a", "c", "f"], True), (["a", "self"], False)]
    assert rust.uses("crate::*") == [(["crate"], True)] and rust.uses("x") == [(["x"], False)]


def test_c(graph):
    nodes, edges = graph
    assert symbols(nodes, "c/main.c") == {
        "MAX": "macro", "FLAG": "macro", "counter": "variable", "ptr": "variable", "main": "function", "point": "struct", "u": "struct", "color": "enum", "point_t": "type",
        "callback": "type", "declared": "variable", "table": "variable", "both": "variable", "both_1": "variable", "origin": "variable",
    }
    assert targets(edges, "c/main.c") == {"file:c/util.h", "ext:stdio.h", "file:include/shared.h"}
    assert tuple(edges["file:c/main.c", "import", "file:c/util.h"].loc) == (1, 9)
    assert nodes["file:c/util.h"].language == "c" and nodes["file:c/shape.hpp"].language == "cpp"
    assert symbols(nodes, "c/shape.hpp") == {"geo": "module", "Shape": "class", "add": "function", "inner": "module", "In": "struct", "draw": "function", "operator+": "function", "cfn": "function"}


def test_objc(graph):
    nodes, edges = graph
    assert symbols(nodes, "ios/Animal.h") == {"Walking": "protocol", "Animal": "class", "Animal(Training)": "class", "LEGS": "macro"}
    assert targets(edges, "ios/Animal.h") == {"ext:objc:Foundation", "file:ios/Habitat.h"}
    assert targets(edges, "ios/Animal.h", "reference") == {"sym:ios/Habitat.h#Food", "sym:?#Water"}
    assert ("sym:ios/Animal.h#Animal(Training)", "reference", "sym:ios/Animal.h#Animal") in edges
    assert targets(edges, "ios/Animal.m", "reference") == {"sym:ios/Animal.h#Animal"} and edges["file:ios/Habitat.h", "import", "ext:objc:UIKit"].wildcard
    assert nodes["ext:objc:UIKit"].name == "UIKit" and nodes["file:ios/Mixed.mm"].language == "objc"


def test_every_edge_starts_in_the_graph(graph):
    nodes, edges = graph
    assert all(s in nodes for s, _, _ in edges)
    assert all(d in nodes or d.startswith(("unresolved:", "sym:?", "file:<unresolved>")) for _, _, d in edges)


FAULTY = '''"""doc
import not_one
"""
import os
from . import (
    one,
    two)
print "old"
x = 1
@deco
def f(a):
    import json
    from .util import (
        b, c)
    print "%s" % a

class A(object):
    pass

class B:
    def g(self: = 3
s = """
import nothing
def nothing(): pass
"""
def last(): return s
'''


def test_python_with_faults():
    f = python.analyze("d/m.py", FAULTY, {})
    assert [(s.name, s.kind, s.line, s.col) for s in f.symbols] == [
        ("x", "variable", 9, 0), ("f", "function", 11, 4), ("A", "class", 17, 6), ("B", "class", 20, 6), ("s", "variable", 22, 0), ("last", "function", 26, 4),
    ]
    assert [(i.specifier, i.line, i.col) for i in f.imports] == [("os", 4, 7), (".", 5, 5), ("json", 12, 11), (".util", 13, 9)]
    whole = FAULTY.replace('print "old"', "pass").replace('print "%s" % a', "pass").replace("(self: = 3", "(self): pass")
    assert python.analyze("d/m.py", whole, {}).symbols == f.symbols and python.analyze("d/m.py", whole, {}).imports == f.imports


@pytest.mark.parametrize("module", [python, script, rust, cpp, objc])
def test_analyzers_take_anything(module):
    ext = {python: ".py", script: ".ts", rust: ".rs", cpp: ".cpp", objc: ".m"}[module]
    for text in ["", "\n", "{{{", "}}})", '"unclosed', "/* open", "'", "#include", "import", "export {", "use {", "@interface", "x" * 5000, "é = 'ü'\n", "\x00", "namespace {", "template <", "enum", "typedef", "class", "a, b, c", "(" * 500]:
        f = module.analyze(f"d/x{ext}", text, {})
        assert f.symbols == module.analyze(f"d/x{ext}", text, {}).symbols
        for s in f.symbols:
            assert s.line >= 1 and s.col >= 0 and s.name


def test_config(tmp_path):
    (tmp_path / "setup.cfg").write_text("[options]\npackage_dir =\n    = src\n")
    assert config.python_roots(tmp_path) == ["src"]
    (tmp_path / "pyproject.toml").write_text('[tool.setuptools.packages.find]\nwhere = ["lib", "more"]\n')
    assert config.python_roots(tmp_path) == ["lib", "more"] and config.python_roots(tmp_path, ["x"]) == ["x"]
    (tmp_path / "compile_commands.json").write_text('[{"directory": "%s", "file": "a.c", "command": "cc -Iinc -I other -isystem \\"a b\\" -DX=1 -D Y a.c"}]' % tmp_path)
    c = config.includes(tmp_path, "a.c", ["extra"])
    assert c["include_dirs"] == ["inc", "other", "a b", "extra"] and c["defines"] == {"X": "1", "Y": "1"}
    (tmp_path / "compile_commands.json").unlink()
    (tmp_path / "CMakeLists.txt").write_text("include_directories(a ${CMAKE_SOURCE_DIR}/b)\ntarget_include_directories(t PUBLIC c) # include_directories(no)\n")
    assert config.includes(tmp_path)["include_dirs"] == ["a", "b", "c"]
    (tmp_path / "CMakeLists.txt").unlink()
    (tmp_path / "src").mkdir()
    assert config.includes(tmp_path)["include_dirs"] == ["src"]
    assert config.cargo(tmp_path)["crate_root"] == "src/main.rs"


def test_cache(spark, root, tmp_path):
    folder = str(tmp_path / "cache")
    files = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "x = 1")], "path string, text string")
    first = ingest.analyze_cached(files, {}, folder)
    assert {r.path for r in first.collect()} == {"a.py", "b.py"}  # same text, each its own ids
    changed = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "y = 2")], "path string, text string")
    again = ingest.analyze_cached(changed, {}, folder)
    assert {(r.path, r.name) for r in again.where("record = 'symbol'").collect()} == {("a.py", "x"), ("b.py", "y")}
    assert spark.read.parquet(folder).select("path", "hash").distinct().count() == 3
    hits, misses = ingest.lookup(ingest.with_key(changed), spark.read.parquet(folder))
    assert hits.count() == 2 and misses.count() == 0
    rows = spark.createDataFrame([(f"p{k}", "h", k) for k in range(5)], "path string, hash string, accessed_at int")
    assert sorted(r.path for r in ingest.evict(rows, 3).collect()) == ["p2", "p3", "p4"]


def test_reexports_through_long_chains_and_circles(spark):
    """A name passes 30 barrels; two barrels that pass on each other end without it."""
    files = [(f"b{k}.ts", f"export * from './b{k + 1}';") for k in range(30)] + [("b30.ts", "export class Deep {}")]
    files += [("x.ts", "export * from './y';"), ("y.ts", "export * from './x';")]
    files += [("main.ts", "import { Deep } from './b0';\nimport { None } from './x';\nnew Deep(); None();\n")]
    graph = ingest.build(spark.createDataFrame(files, "path string, text string"), {})
    got = {(r.src, r.dst) for r in graph.edges.where("kind = 'reference'").collect()}
    assert ("file:main.ts", "sym:b30.ts#Deep") in got and not any("None" in d for _, d in got)


def test_long_scripts_take_time_by_their_length():
    import time

    from sparkloom.sources.analyzers import script

    took = []
    for n in (3_000, 12_000):
        text = "import { a } from './m';\n" + "".join(f"export const v{k} = a(x{k}, {{ y{k}: z{k} }});  \n" for k in range(n))
        at = time.time()
        assert len(script.analyze("f.ts", text, {}).symbols) == n
        took.append(time.time() - at)
    assert took[1] < 8 * took[0] + 0.5


def test_packages_are_gone_through_once_a_task(spark):
    """Not once a file: a project may name as many packages as it has files."""

    class Once:
        seen = 0

        def __iter__(self):
            self.seen += 1
            assert self.seen == 1
            return iter(["@lib/a"])

    files = spark.createDataFrame([(f"f{k}.ts", "import x from '@lib/a/sub';\nimport y from 'other';") for k in range(3)], "path string, text string").coalesce(1)
    got = ingest.analyze(files, {"script": {"packages": Once()}}).where("record = 'import'").collect()
    assert sorted((r.otherwise, r.resolution) for r in got) == [("ext:@lib/a", "resolved")] * 3 + [("ext:other", "unresolved")] * 3
    text = "import x from '@lib/a/sub';"
    assert script.analyze("f.ts", text, {"packages": ["@lib/a"]}) == script.analyze("f.ts", text, script.prepared({"packages": ["@lib/a"]}))


def test_registered_analyzers(spark):
    """The last one wins, for an extension and for a group; it goes to the executors with the job."""
    from sparkloom.sources.analyzers import Fragment, Symbol

    def first(path, text, config):
        return Fragment("toy", [Symbol("wrong", "function", 1, 0)])

    def second(path, text, config):
        return Fragment("toy", [Symbol(f"{config['prefix']}{w}", "function", 1, 0) for w in text.split()])

    try:
        ingest.register("toy", (".toy",), first)
        ingest.register("toy", (".TOY", ".ts"), second)
        assert ingest.registered("toy") is second and ingest.registered("rust").__module__.endswith("rust")
        files = spark.createDataFrame([("a.toy", "x y"), ("b.ts", "z")], "path string, text string")
        got = {(r.path, r.name) for r in ingest.analyze(files, {"toy": {"prefix": "p_"}}).where("record = 'symbol'").collect()}
        assert got == {("a.toy", "p_x"), ("a.toy", "p_y"), ("b.ts", "p_z")}
    finally:
        ingest._BY_EXTENSION.clear()
        ingest._BY_GROUP.clear()


def test_cache_keeps_what_was_used_last(spark, tmp_path):
    """A hit is a use; a put beyond the capacity evicts; a key that is put twice is there once."""
    folder = str(tmp_path / "cache")
    run = lambda *names, rows=2: sorted(r.path for r in ingest.analyze_cached(spark.createDataFrame([(n, f"def f_{n[0]}(): pass") for n in names], "path string, text string"), {}, folder, rows).where("record = 'symbol'").collect())
    keys = lambda: sorted(r.path for r in ingest.used_last(spark, folder).collect())
    assert run("a.py") == ["a.py"] and run("b.py") == ["b.py"]
    before = {r.path: r.accessed_at for r in ingest.used_last(spark, folder).collect()}
    assert run("a.py") == ["a.py"]
    after = {r.path: r.accessed_at for r in ingest.used_last(spark, folder).collect()}
    assert after["a.py"] > before["a.py"] and after["b.py"] == before["b.py"]
    assert run("c.py") == ["c.py"] and keys() == ["a.py", "c.py"]
    cached = spark.read.parquet(folder)
    assert sorted(r.path for r in cached.select("path").distinct().collect()) == ["a.py", "c.py"]
    cached.where("path = 'a.py'").write.mode("append").parquet(folder)
    assert run("a.py") == ["a.py"] and run("b.py", "c.py", rows=9) == ["b.py", "c.py"] and keys() == ["a.py", "b.py", "c.py"]

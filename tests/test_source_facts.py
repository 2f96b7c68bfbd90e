import pytest

from cairn.operators.imports import import_edges
from cairn.operators.symbols import call_edges, calls_by_export, most_exports, symbols

TREE = {
    "src/main.ts": "import { add as plus, type Shape } from './util.js';\nimport Box from './box'\nimport * as all from './util';\nimport './side';\nimport x from 'outside';\n\nexport function run(a: number) {\n  const y = plus(a, 1);\n  return Box.of(y);\n}\n\nexport const later = async (b) => {\n  return { v: plus (b, 2) };\n};\n",
    "src/util.ts": "export async function add(a, b) { return a + b }\r\nexport interface Shape { n: number }\r\nconst hidden = x => x;\nexport { hidden as shown, add };\n",
    "src/box/index.tsx": "export default class Box {\n  constructor() {}\n  static of<T>(v: T): Box {\n    return new Box();\n  }\n  #secret() { return { a: 1 } }\n}\nexport type Kind = 'a';\nexport enum E { A }\n",
    "src/side.jsx": "export * from '../src/util'\nexport { Box } from './box/'\n",
    "pkg/__init__.py": "",
    "pkg/a.py": "import pkg.b as q, os\nfrom . import (\n    b,  # first\n    c as d,\n)\nfrom .sub.deep import thing\nfrom pkg.c import *\n    from pkg import hidden\nfrom ..pkg import a\n",
    "pkg/b.py": "from pkg import c, b\n",
    "pkg/c.py": "",
    "pkg/sub/deep/__init__.py": "from ... import c\nfrom ...b import name\n",
    "go.mod": "module example.test/m\n\ngo 1.22\n",
    "main.go": 'package main\nimport "fmt"\nimport (\n  "example.test/m/auth"\n  u "example.test/m/util"\n)\n',
    "auth/a_test.go": "package auth",
    "auth/auth.go": 'package auth\nimport "example.test/m/auth"\n',
    "util/a_test.go": "package util",
    "util/b.go": "package util",
    "empty.ts": None,
}


@pytest.fixture(scope="module")
def tree(spark):
    contents = spark.createDataFrame(list(TREE.items()), "path string, content string").coalesce(1)
    return contents, import_edges(contents, contents.select("path")).cache(), symbols(contents).cache()


def test_import_edges(tree):
    found = {(r["src"], r["dst"]): r["specifiers"] for r in tree[1].collect()}
    assert found == {
        ("src/main.ts", "src/util.ts"): ["add as plus", "Shape"],
        ("src/main.ts", "src/box/index.tsx"): ["Box"],
        ("src/main.ts", "src/side.jsx"): [],
        ("src/side.jsx", "src/util.ts"): [],
        ("pkg/a.py", "pkg/b.py"): ["pkg.b"],
        ("pkg/a.py", "pkg/sub/deep/__init__.py"): ["thing"],
        ("pkg/a.py", "pkg/c.py"): [],
        ("pkg/a.py", "pkg/__init__.py"): ["a"],
        ("pkg/b.py", "pkg/c.py"): ["c", "b"],
        ("pkg/sub/deep/__init__.py", "pkg/c.py"): ["c"],
        ("pkg/sub/deep/__init__.py", "pkg/b.py"): ["name"],
        ("main.go", "auth/auth.go"): ["example.test/m/auth"],
        ("main.go", "util/b.go"): ["example.test/m/util"],
    }


def test_symbols(tree):
    found = {(r["path"], r["container"], r["name"], r["kind"]): (r["line"], r["exported"], r["is_default"]) for r in tree[2].collect()}
    assert found == {
        ("src/main.ts", None, "run", "function"): (7, True, False),
        ("src/main.ts", None, "later", "const"): (12, True, False),
        ("src/util.ts", None, "add", "function"): (1, True, False),
        ("src/util.ts", None, "Shape", "interface"): (2, True, False),
        ("src/util.ts", None, "hidden", "const"): (3, False, False),
        ("src/util.ts", None, "hidden", "variable"): (4, True, False),
        ("src/util.ts", None, "add", "variable"): (4, True, False),
        ("src/box/index.tsx", None, "Box", "class"): (1, True, True),
        ("src/box/index.tsx", "Box", "of", "method"): (3, False, False),
        ("src/box/index.tsx", "Box", "secret", "method"): (6, False, False),
        ("src/box/index.tsx", None, "Kind", "type"): (8, True, False),
        ("src/box/index.tsx", None, "E", "enum"): (9, True, False),
    }
    assert [(r["path"], r["exports"]) for r in most_exports(tree[2], 2).collect()] == [("src/util.ts", 4), ("src/box/index.tsx", 3)]


def test_calls(tree):
    contents, edges, found = tree
    calls = call_edges(contents, edges, found)
    assert {(r["symbol"], r["to_path"], r["to_symbol"], r["line"]) for r in calls.collect()} == {
        ("run", "src/util.ts", "add", 8),
        ("run", "src/box/index.tsx", "Box", 9),
        ("later", "src/util.ts", "add", 13),
    }
    by = {(r["path"], r["name"]): r for r in calls_by_export(found, calls).collect()}
    assert [tuple(x) for x in by["src/util.ts", "add"]["called_by"]] == [("src/main.ts", "later", 13), ("src/main.ts", "run", 8)]
    assert by["src/util.ts", "Shape"]["calls"] is None


def test_the_last_statement_names_a_local(spark):
    texts = [("a.ts", "export function f() {}"), ("z.ts", "export function f() {}"), ("m.ts", "import { f } from './z';\nimport { f } from './a';\nexport function g() { f(); }\n"), ("n.ts", "import { f } from './a';\nimport { f } from './z';\nexport function g() { f(); }\n")]
    contents = spark.createDataFrame(texts, "path string, content string")
    calls = call_edges(contents, import_edges(contents, contents), symbols(contents))
    assert sorted((r["path"], r["to_path"]) for r in calls.collect()) == [("m.ts", "a.ts"), ("n.ts", "z.ts")]


def test_repositories_stay_apart(spark):
    rows = [("r1", "a.py", "import b"), ("r1", "b.py", ""), ("r2", "a.py", "import b"), ("r2", "c.ts", "export class C { m() { } }\n"), (None, "b.py", ""), ("r3", None, "x"), ("r3", "d.ts", None)]
    contents = spark.createDataFrame(rows, "repo string, path string, content string")
    assert [(r["repo"], r["src"], r["dst"]) for r in import_edges(contents, contents).collect()] == [("r1", "a.py", "b.py")]
    assert sorted((r["repo"], r["name"]) for r in symbols(contents).collect()) == [("r2", "C"), ("r2", "m")]


def test_called_names_are_those_the_pattern_finds():
    import re

    from cairn.operators.facts import Extractor

    body = "export function f() { a(1); b.c(2); $d (3); x$y(4); new Box(); z . w (5); if (q) return p; a(6) }"
    names = {x["name"] for x in Extractor().symbols(body) if x["fact"] == "call"}
    for local in ("a", "b", "c", "d", "$d", "y", "x$y", "$y", "Box", "z", "w", "p", "q", "if", "f", "x"):
        pattern = r"\b" + re.escape(local) + r"(?:\s*\(|\s*\.\s*\w+\s*\()"
        assert (local in names) == bool(re.search(pattern, body.partition(" {")[0] + body.partition(" {")[2], re.ASCII)), local


def test_a_large_text_costs_no_more_than_its_length(spark):
    import time

    from cairn.operators.facts import Extractor

    text = "".join(f"export function f{i}(x) {{ return g{i}(x); }}\n" for i in range(20_000))
    start = time.time()
    found = list(Extractor().facts("a.ts", text))
    assert time.time() - start < 20 and sum(x["fact"] == "call" for x in found) == 40_000
    assert found[-1]["line"] == 20_000

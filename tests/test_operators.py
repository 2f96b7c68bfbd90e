import re

import pytest
from pyspark.sql import functions as F

from cairn.functions.globs import glob_regex, is_glob, token_match
from cairn.functions.paths import at_least_one, extension, is_test, normalised, stem
from cairn.operators import changes, graph, text


def edge_table(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize(
    "glob, path, fits",
    [
        ("src/**/*.ts", "src/a/b.ts", True),
        ("src/**/*.ts", "src/b.ts", True),
        ("src/*.ts", "src/a/b.ts", False),
        ("*.{ts,js}", "a.js", True),
        ("*.ts", ".a.ts", False),
        ("[!a]?.md", "bc.md", True),
        ("@(x|y).go", "y.go", True),
    ],
)
def test_globs(glob, path, fits):
    assert is_glob(glob)
    assert bool(re.fullmatch(glob_regex(glob), path)) is fits


def test_path_columns(spark):
    df = spark.createDataFrame([(" ./a\\b/",), ("/",), ("tests/x.ts",), ("a/test_b.py",), ("a/.env",)], "p string").select(normalised(F.col("p")).alias("p"))
    rows = df.select("p", extension(F.col("p")), stem(F.col("p")), is_test(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("a/b", "", "b", False), (".", "", "", False), ("tests/x.ts", "ts", "x", True), ("a/test_b.py", "py", "test_b", True), ("a/.env", "", "", False)]


def test_argument_defaults():
    assert [at_least_one(x, 7) for x in (None, 0, -1, 2.9, float("nan"), True, "3", 4)] == [7, 7, 7, 2, 7, 7, 7, 4]


def test_impact_of_a_cycle_ends(spark):
    edges = edge_table(spark, ("b", "a"), ("c", "b"), ("a", "c"), ("d", "b"))
    found = graph.impact(edges, spark.createDataFrame([("a",)], "node string"), 9)
    assert sorted(map(tuple, found.collect())) == [("b", 1, 2), ("c", 2, 1), ("d", 2, 0)]


def test_hub_ties_go_by_name(spark):
    edges = edge_table(spark, ("x", "b"), ("y", "b"), ("x", "a"), ("y", "a"))
    assert [tuple(r) for r in graph.hubs(edges).collect()] == [("a", 2, 0), ("b", 2, 0)]


def test_shortest_paths(spark):
    edges = edge_table(spark, ("m1", "leaf"), ("m2", "leaf"), ("top", "m1"), ("top", "m2"), ("far", "top"))
    found = graph.path_between(edges, "leaf", "top", max_paths=1)
    assert [tuple(r) for r in found.collect()] == [(["leaf", "m1", "top"], 2, True)]
    assert graph.path_between(edges, "leaf", "far", max_depth=2).count() == 0
    assert graph.path_between(edges, "leaf", "leaf").first()["length"] == 0
    assert graph.path_between(edges, "nowhere", "nowhere").count() == 0


def test_a_page_past_the_end_is_empty(spark):
    edges = edge_table(spark, ("a", "b"), ("a", "c"))
    assert graph.fan_out(edges, "a", limit=5, offset=9).count() == 0


def test_lines_and_grep(spark):
    contents = spark.createDataFrame([("a.txt", "one\r\nTwo \n"), ("b.png", "one"), ("c.txt", "x\0one"), ("d.txt", None), ("e.txt", "y" * 300 + "one")], "path string, content string")
    assert [tuple(r) for r in text.lines(contents).filter("path = 'a.txt'").orderBy("line").collect()] == [("a.txt", 1, "one"), ("a.txt", 2, "Two "), ("a.txt", 3, "")]
    assert [tuple(r) for r in text.grep(contents, "TWO").collect()] == [("a.txt", 2, "Two")]
    assert text.grep(contents, "(", regex=True).count() == 0
    assert text.grep(contents, "one", glob="e.*").first()["text"] == "y" * 240 + "…"
    assert tuple(text.grep_report(contents, "one", limit=1).select("count", "truncated", "scanned_files").first()) == (1, True, 1)


def test_tokens(spark):
    df = spark.createDataFrame([("Small ring",), ("ring",)], "p string")
    assert df.filter(token_match(F.col("p"), "RING small")).count() == 1


@pytest.mark.parametrize(
    "events, left",
    [(["add", "change"], "add"), (["change", "unlink", "change"], "change"), (["unlink", "add"], "add"), (["add", "unlink"], "unlink"), (["unlink", "add", "change"], "add"), (["mkdir", "change"], "change")],
)
def test_pending(spark, events, left):
    rows = spark.createDataFrame([("p", e, i) for i, e in enumerate(events)], "path string, event string, seq bigint")
    assert [tuple(r) for r in changes.pending(rows).collect()] == [("p", left)]


def test_requested_paths(spark):
    from cairn.operators.resolve import resolve_paths

    files = spark.createDataFrame([(p,) for p in ("src/mcp/cache.ts", "src/mcp/cache.test.ts", "src/mcp/server.ts", "src/utils.ts", "lib/a.test/x.ts")], "path string")
    dirs = spark.createDataFrame([(p,) for p in ("src", "src/mcp", "lib", "lib/a.test")], "path string")

    def ask(path, expected="file"):
        r = resolve_paths(spark.createDataFrame([(path,)], "request string"), files, dirs, expected).first()
        return r["path"], r["found"], r["kind"], r["resolved_from"], r["suggestions"], r["warning"]

    assert ask("src/mcp/cache.ts") == ("src/mcp/cache.ts", True, "file", None, [], None)
    assert ask("src/utils") == ("src/utils.ts", True, "file", "src/utils", ["src/utils.ts"], "extended")
    assert ask("src/mcp/cach") == ("src/mcp/cach", False, None, None, ["src/mcp/cache.test.ts", "src/mcp/cache.ts"], "similar")
    assert ask("src/mcp/cache") == ("src/mcp/cache", False, None, None, ["src/mcp/cache.test.ts", "src/mcp/cache.ts"], "ambiguous")
    assert ask("lib/a") == ("lib/a.test/x.ts", True, "file", "lib/a", ["lib/a.test/x.ts"], "extended")
    assert ask("src/mpc", "any")[4:] == (["src/mcp"], "similar")
    assert ask("src/mcp", "file")[:3] == ("src/mcp", False, None)
    assert ask("", "dir")[:3] == (".", True, "directory")
    assert ask("zzz/q") == ("zzz/q", False, None, None, [], "missing")


def test_many_requests_equal_single_ones(spark, monkeypatch):
    pairs = sorted({((i * 7 + j * 3) % 40, (i * 5 + j) % 40) for i in range(40) for j in range(2)})
    edges = edge_table(spark, *((f"n{a}", f"n{b}") for a, b in pairs))
    roots = [(f"r{k}", f"n{k % 40}") for k in range(50)] + [("r0", "n3"), ("r0", "n3")]
    want = {}
    for request, node in roots:
        level, front = 0, {n for q, n in roots if q == request}
        seen = dict.fromkeys(front, 0)
        while front and level < 3:
            level += 1
            front = {f"n{a}" for a, b in pairs if f"n{b}" in front} - seen.keys()
            seen |= dict.fromkeys(front, level)
        want[request] = {n: x for n, x in seen.items() if x}
    asked = spark.createDataFrame(roots, "request string, node string")
    for most in (graph.BROADCAST_NODES, 3):
        monkeypatch.setattr(graph, "BROADCAST_NODES", most)
        found = {}
        for r in graph.impact(edges, asked, 3).collect():
            found.setdefault(r["request"], {})[r["node"]] = r["level"]
        assert found == {k: v for k, v in want.items() if v}
    assert max(r["count"] for r in graph.impact(edges, asked, 3, limit=2).groupBy("request").count().collect()) == 2


def test_projects_above_a_folder(spark):
    from cairn.operators.context import directory_map, reading_order, rebased, upstream_projects

    files = spark.createDataFrame([("package.json",), ("a/b/go.mod",), ("a/b/c/d/setup.py",), ("a/x.ts",)], "path string")
    asked = spark.createDataFrame([("a/b/c/d",), ("a/b",), (".",), ("q",), (None,)], "root string")
    assert {(r["root"], r["project_root"]) for r in upstream_projects(asked, files).collect()} == {("a/b/c/d", "a/b"), ("a/b", "."), (".", None), ("q", "."), (None, None)}
    known = spark.createDataFrame([(".",)], "path string")
    assert {r["project_root"] for r in upstream_projects(asked.filter("root = 'a/b/c/d'"), files, known).collect()} == {"."}
    moved = spark.createDataFrame([("a/b", "a/b/c.ts"), ("a/b", "a/b"), ("a/b", "a/bc"), (".", "z")], "prefix string, path string")
    assert sorted(r["path"] for r in rebased(moved).collect()) == [".", "c.ts", "z"]
    assert sorted(r["entry"] for r in directory_map(files, 2).collect()) == ["a/", "a/b/", "a/x.ts", "package.json"]
    none = spark.createDataFrame([], "path string, place int")
    assert [tuple(r)[1:] for r in reading_order(files, none, none).collect()] == [("package.json", 1)]


def test_reports_name_what_is_missing(spark):
    edges = edge_table(spark, ("b", "a"), ("c", "b"), ("z", "y"), ("tests/t.ts", "b"))
    ends = lambda *row: spark.createDataFrame([row], "start string, start_found boolean, end string, end_found boolean")
    assert graph.path_report(edges, ends("q", False, "a", True)).first()["status"] == "missing_start"
    assert graph.path_report(edges, ends("a", True, "q", False)).first()["status"] == "missing_end"
    assert tuple(graph.path_report(edges, ends("a", True, "z", True)).first()) == ("a", "z", "not_connected", None, [], False)
    assert tuple(graph.path_report(edges, ends("a", True, "c", True)).first()) == ("a", "c", "connected", 2, [["a", "b", "c"]], False)
    assert graph.path_report(edges, ends("a", True, "a", True)).first()["status"] == "same"
    resolved = spark.createDataFrame([("a", True, None), ("q", False, "missing")], "path string, found boolean, warning string")
    found = sorted((r["part"], r["node"]) for r in graph.affected_report(edges, resolved).collect())
    assert found == [("affected", "b"), ("affected", "c"), ("affected", "tests/t.ts"), ("changed", "a"), ("missing", "q"), ("test", "tests/t.ts")]


def test_trees_are_shown_in_locale_order(spark):
    files = spark.createDataFrame([(p,) for p in ("b.ts", "B.ts", "a.ts", "Z.ts", "é.ts", "f.ts", "_x.ts", "a/k.ts")], "path string")
    shown = [r["path"] for r in text.ordered_tree(files).collect()]
    assert shown == ["_x.ts", "a", "a.ts", "a/k.ts", "b.ts", "B.ts", "é.ts", "f.ts", "Z.ts"]

"""Joins of files and their facts that stay off the driver, and what is left out of the search of texts."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import context, facts, imports, symbols
from tests.test_sizes import plan_of


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("1", "a.ts", "export const f = (x) => { g(x) };\n"), ("1", "b.ts", "import { f } from './a';\nexport function h() { f() }\n"), ("1", "go.mod", "module m\n"), ("1", "main.go", 'import "m/p"\n'), ("1", "p/p.go", "package p")]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def test_joins_of_files_are_not_broadcast(spark, tree):
    known = facts.source_facts(tree)
    edges = imports.edges_of(known, tree)
    calls = symbols.calls_of(known, edges, symbols.symbols_of(known))
    roots = spark.createDataFrame([("1", "p/q")], "repo string, root string")
    for found in (edges, calls, context.upstream_projects(roots, tree, tree)):
        plan = plan_of(found)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r)[1:5] for r in calls.collect()] == [("b.ts", "h", "a.ts", "f")]


def test_script_targets_meet_files_as_their_candidates_do(spark):
    random.seed(3)
    stems, ends = ["a", "a/index", "b", "a/index/index", "", "c.x"], ["", ".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs", ".js.ts", ".json", "/", "/index.ts", "/index.js"]
    names = [s + e for s in stems for e in ends]
    files = spark.createDataFrame([("r", p) for p in random.sample(names, 60)], "repo string, path string")
    asked = spark.createDataFrame([("r", "s", n, ["x"], t) for n, t in enumerate(names)], "repo string, src string, ordinal int, specifiers array<string>, target string")
    columns = ["ordinal", "path"]
    got = imports.script_hits(asked, files).groupBy(columns).agg(F.min("rank").alias("rank"))
    want = imports.candidate_hits(asked.withColumn("candidates", imports.script_candidates(F.col("target"))), files).groupBy(columns).agg((F.min("rank") + 1).alias("rank"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_patterns_are_left_out_only_without_their_words():
    assert facts.needed(r"export\s+(?:async\s+)?function\s+(\w+)") == {"export", "function"}
    assert facts.needed(facts.FUNCTION_VALUE) == {"export"}
    assert facts.needed(facts.CLASS) == {"class"}
    tried = facts.Extractor().tried("import './a'")
    assert tried[0] == [False, False, False, True, False, False] and not any(map(any, tried[1:]))
    kept = [f["name"] for f in facts.Extractor().symbols("export function f() { ab.c(); d$e (1); xy }") if f["fact"] == "call"]
    assert kept == ["f", "ab", "c", "d$e", "$e", "e"]


def test_facts_become_batches_by_column():
    row = ("r", "p", "symbol", 1, 2, None, 4, "n", "k", True, None, "", None, None, None, None)
    assert [tuple(x.values()) for x in facts.batch_of([row, row]).to_pylist()] == [row, row]


def test_edges_alone_take_no_symbols(spark, tree, monkeypatch):
    kept = []
    monkeypatch.setattr(imports, "materialise", lambda df: kept.append(df) or df)
    edges = imports.import_edges(tree, tree)
    assert {r["fact"] for r in kept[0].select("fact").distinct().collect()} == {"script", "module", "go"}
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [("b.ts", "a.ts"), ("main.go", "p/p.go")]


def test_candidates_are_ranked_without_being_made(spark):
    asked = spark.createDataFrame([("r", "s", 0, ["x"], "a")], "repo string, src string, ordinal int, specifiers array<string>, target string")
    plan = plan_of(imports.script_hits(asked, asked.select("repo", F.col("target").alias("path"))))
    assert "lambda" not in plan and "transform(" not in plan


def test_paths_lose_their_dots_as_segments_do(spark):
    def joined(folder: str, rest: str) -> str:
        kept = []
        for part in f"{folder}/{rest}".split("/"):
            if part == ".." and kept and kept[-1] != "..":
                kept.pop()
            elif part not in ("", "."):
                kept.append(part)
        return "/".join(kept) + ("/" if rest.endswith("/") else "")

    random.seed(5)
    parts = ["..", ".", "", "a", "b.c", "...", "..d", ".e", "f."]
    pairs = [tuple("/".join(random.choices(parts, k=random.randint(1, 5))) for _ in range(2)) for _ in range(3000)]
    pairs += [("src/o", "../c/c1.js"), ("", "./x"), ("a/b", "../../x"), ("a", "..")]
    rows = spark.createDataFrame(pairs, "folder string, rest string").select("folder", "rest", imports.joined(F.col("folder"), F.col("rest")).alias("path")).collect()
    assert [r["path"] for r in rows] == [joined(r["folder"], r["rest"]) for r in rows]

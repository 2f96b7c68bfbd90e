"""Versions of tables, the source of tree changes, and the index that is kept up by both."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators.facts import source_facts
from cairn.operators.imports import edges_of
from cairn.operators.symbols import calls_of, symbols_of
from cairn.sources.repository import RepositorySource
from cairn.sources.tree_changes import TreeChangesSource, differences
from cairn.sources.versions import Versions, VersionTaken
from cairn.streaming.changes import pending_stream
from cairn.streaming.index import SourceIndex


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n bigint")


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    with pytest.raises(LookupError):
        store.open()
    assert store.publish({"a": numbers(spark, 1, 2), "b": numbers(spark, 3)}) == 1
    with store.pinned() as old:
        assert store.publish({"a": numbers(spark, 9), "b": numbers(spark)}) == 2
        assert store.collect() == [1] and store.numbers() == [2]
        assert sorted(r["n"] for r in old["a"].collect()) == [1, 2] and old["b"].first()["n"] == 3
        with store.pinned() as new:
            assert [r["n"] for r in new["a"].collect()] == [9] and new["b"].count() == 0
    assert sum(name.startswith("data-") for name in store.folder.names()) == 2
    store.collect()  # the pin has gone
    assert sum(name.startswith("data-") for name in store.folder.names()) == 1
    with pytest.raises(LookupError), store.pinned(1):
        pass


def test_a_failed_publish_leaves_the_version_before(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    store.publish({"a": numbers(spark, 1), "b": numbers(spark, 1)})
    broken = numbers(spark, 1).select(F.raise_error(F.lit("no")).cast("bigint").alias("n"))
    with pytest.raises(Exception, match="no"):
        store.publish({"a": numbers(spark, 2), "b": broken})
    assert store.numbers() == [1] and [r["n"] for r in store.open()["a"].collect()] == [1]
    assert sum(name.startswith("data-") for name in store.folder.names()) == 1
    store.publish({"a": numbers(spark, 3)})
    with pytest.raises(VersionTaken):
        store.publish({"a": numbers(spark, 4)}, after=1)
    assert [r["n"] for r in store.open()["a"].collect()] == [3]


def test_data_of_dead_publishers_is_collected(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"), pin_seconds=3600)
    store.publish({"a": numbers(spark, 1)})
    for name in ("data-alive", "data-dead"):
        store.folder.write(f"{name}/a/part", "x")
    store.folder.write("_pins/data-alive.publisher", "")
    store.collect()
    assert "data-alive" in store.folder.names() and "data-dead" not in store.folder.names()
    store.pin_seconds = -1
    store.collect()
    assert "data-alive" not in store.folder.names() and [r["n"] for r in store.open()["a"].collect()] == [1]


def put(root, path, text):
    place = root / path
    place.parent.mkdir(parents=True, exist_ok=True)
    before = place.stat().st_mtime_ns if place.exists() else 0
    place.write_text(text)
    os.utime(place, ns=(before + 10**9 if before else place.stat().st_mtime_ns,) * 2)


def test_differences():
    assert list(differences({"a": [1, 1], "b": [1, 1], "c": [1, 1]}, {"a": [1, 1], "b": [1, 2], "d": [0, 0]})) == [("b", "change"), ("c", "unlink"), ("d", "add")]


def test_changes_of_a_tree_outlast_a_restart(spark, tmp_path):
    root = tmp_path / "root"
    for path in ("a.ts", "b/c.ts", "b/d.ts", "node_modules/x.js"):
        put(root, path, "1")
    spark.dataSource.register(TreeChangesSource)

    def start(rows):
        stream = spark.readStream.format("cairn_tree_changes").option("root", str(root)).option("log", str(tmp_path / "log")).load()
        return pending_stream(stream).writeStream.outputMode("update").foreachBatch(lambda batch, _: rows.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "state")).start()

    first, second = [], []
    query = start(first)
    query.processAllAvailable()
    put(root, "b/e.ts", "new")
    put(root, "a.ts", "22")
    put(root, "node_modules/x.js", "22")
    query.processAllAvailable()
    query.stop()
    assert sorted(first) == [("a.ts", "change"), ("b/e.ts", "add")]
    put(root, "b/e.ts", "newer")  # while nobody looks
    put(root, "b/c.ts", "333")
    (root / "b/d.ts").unlink()
    query = start(second)
    query.processAllAvailable()
    put(root, "b/d.ts", "back")
    query.processAllAvailable()
    query.stop()
    assert sorted(second) == [("b/c.ts", "change"), ("b/d.ts", "add"), ("b/d.ts", "unlink"), ("b/e.ts", "add")]
    assert len(os.listdir(tmp_path / "log")) <= 2  # those that were committed past are gone


def module(r, n, k):
    """A source that imports others, exports functions and calls what it imports."""
    lines, names = [], []
    for other in r.sample(range(n), 3):
        lines.append(f"import {{ f{other} as g{other}, h{r.randrange(2)} }} from './m{other}';")
        names += [f"g{other}", "h0", "h1"]
    lines.append(f"export function f{k}(x) {{ {' '.join(f'{r.choice(names)}(x);' for _ in range(3))} }}")
    for i in range(r.randrange(3)):
        lines.append(f"export const h{i} = (y) => {{ return {r.choice(names)}.z(y) }};")
    return "\n".join(lines) + "\n"


def full(contents):
    files, facts = contents.select("repo", "path"), source_facts(contents).cache()
    edges, found = edges_of(facts, files).cache(), symbols_of(facts).cache()
    return {"files": files, "edges": edges, "symbols": found, "calls": calls_of(facts, edges, found)}


def test_maintained_tables_equal_a_full_scan(spark, tmp_path):
    r = random.Random(7)
    texts = {f"m{k}.ts": module(r, 9, k) for k in range(9)}
    texts |= {"go.mod": "module m1\n", "main.go": 'package main\nimport "m1/p"\nimport "m2/q"\n', "p/p.go": "package p", "q/q.go": "package q", "x.py": "import y\n", "y.py": "from .x import a\n"}
    index = SourceIndex(spark, str(tmp_path / "index"))
    contents = lambda: spark.createDataFrame([(repo, p, t) for repo in "ab" for p, t in texts.items()], "repo string, path string, content string")
    status = index.refresh(spark.createDataFrame([("a", "m1.ts", "change")], "repo string, path string, event string"), contents()).first()
    assert (status["version"], status["action"], status["fresh"], status["next_action"]) == (1, "full", True, "none")
    rounds = [["m1.ts"], ["m2.ts", "m3.ts", "x.py", "unknown.ts"], ["go.mod"], ["m0.ts", "m5.ts", "main.go"], []]
    for number, changed in enumerate(rounds):
        for path in changed:
            if path in texts:
                texts[path] = module(r, 9, int(path[1])) if path[0] == "m" and path[1].isdigit() else "module m2\n" if path == "go.mod" else texts[path] + "import y\n"
        event = spark.createDataFrame([(repo, p, "change") for repo in "ab" for p in changed], "repo string, path string, event string")
        status = index.refresh(event, contents()).first()
        assert status["action"] == ("incremental" if changed else "none") and status["version"] == min(number, 3) + 2
        with index.versions.pinned() as tables:
            for name, want in full(contents()).items():
                assert sorted(map(repr, tables[name].select(want.columns).collect())) == sorted(map(repr, want.collect())), (number, name)
    del texts["m4.ts"]
    status = index.refresh(spark.createDataFrame([("a", "m4.ts", "unlink"), ("b", "m4.ts", "unlink")], "repo string, path string, event string"), contents()).first()
    assert status["action"] == "full" and status["files"] == 2 * len(texts)
    assert index.status(spark.createDataFrame([("m1.ts", "change")], "path string, event string")).first()["next_action"] == "refresh"


def test_a_stream_keeps_the_index_up(spark, tmp_path):
    root = tmp_path / "root"
    put(root, "a.ts", "import { f } from './b';\nexport function g() { f(); }\n")
    put(root, "b.ts", "export function f() {}\n")
    spark.dataSource.register(TreeChangesSource)
    spark.dataSource.register(RepositorySource)
    contents = lambda: spark.read.format("cairn_repository").option("root", str(root)).load().select("path", "content")
    changes = spark.readStream.format("cairn_tree_changes").option("root", str(root)).option("log", str(tmp_path / "log")).option("initial", "true").load()
    index = SourceIndex(spark, str(tmp_path / "index"))
    calls = lambda: sorted((x["path"], x["symbol"], x["to_path"], x["to_symbol"]) for x in index.versions.open()["calls"].collect())
    query = index.follow(changes, contents, str(tmp_path / "state"))
    query.processAllAvailable()
    assert calls() == [("a.ts", "g", "b.ts", "f")]
    put(root, "b.ts", "export function other() {}\n")
    query.processAllAvailable()
    assert calls() == [] and len(index.versions.numbers()) == 1
    query.stop()
    put(root, "b.ts", "export function f() { }\n")
    put(root, "c.ts", "export { f } from './b';\n")
    query = index.follow(changes, contents, str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert calls() == [("a.ts", "g", "b.ts", "f")]
    assert sorted(x["path"] for x in index.versions.open()["files"].collect()) == ["a.ts", "b.ts", "c.ts"]

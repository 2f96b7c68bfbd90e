import re

import pytest

from cairn.functions.ignore import ScanConfig, ignore_regex
from cairn.operators import changes
from cairn.operators.keyfiles import key_files
from cairn.sources.repository import RepositorySource


@pytest.mark.parametrize(
    "rule, path, ignored",
    [("build", "a/build/x", True), ("build", "rebuild/x", False), ("/a/b", "a/b/c", True), ("a/b", "x/a/b", False), ("**/*.test.*", "a/b.test.ts", True), ("*.log", "a/.log", True), ("# x", "# x", False)],
)
def test_ignore_rules(rule, path, ignored):
    assert bool(re.search(ignore_regex([rule]), path)) is ignored


def test_config():
    assert ScanConfig.of({"maxDepth": 2, "unknown": 1}).max_depth == 2
    assert "tests" in ScanConfig.of({"includeTests": False}).rules()
    with pytest.raises(ValueError, match="maxDepth"):
        ScanConfig.of({"maxDepth": 0})


def test_repository_source(spark, tmp_path):
    for path, content in {"package.json": "{}", "src/__init__.py": "", "src/.env": "a=1", "node_modules/x.js": "x", "a/dist/y.js": "y", ".github/workflows/ci.yml": "name: ci"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    spark.dataSource.register(RepositorySource)
    found = spark.read.format("cairn_repository").option("root", str(tmp_path)).load()
    assert sorted(map(tuple, found.collect())) == [(".github/workflows/ci.yml", 8, "name: ci"), ("package.json", 2, "{}"), ("src/.env", 3, "a=1"), ("src/__init__.py", 0, "")]
    assert [r["path"] for r in key_files(found).collect()] == [".github/workflows", "package.json", "src"]


def test_streaming_pending_equals_batch(spark, tmp_path):
    from cairn.streaming.changes import pending_stream

    events = ["add", "change", "unlink", "change", "add", "mkdir", "unlink"]
    rows = spark.createDataFrame([(f"p{i % 5}", events[(i * i + i // 5) % 7], i) for i in range(60)], "path string, event string, seq bigint")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = pending_stream(stream).writeStream.outputMode("update").format("memory").queryName("pending").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("pending").collect())) == sorted(map(tuple, changes.pending(rows).collect()))


def test_filters_open_no_other_file_and_large_folders_are_split(spark, tmp_path):
    import os

    from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

    from cairn.sources.repository import FilteringReader, RepositoryReader

    for k in range(40):
        (tmp_path / f"big/d{k % 4}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"big/d{k % 4}/f{k}.txt").write_text("x" * 1000)
    (tmp_path / "other").mkdir()
    (tmp_path / "other/a.py").write_text("a")
    options = {"root": str(tmp_path), "partitionbytes": str(5 * 65_000)}
    parts = RepositoryReader(options).partitions()
    assert len(parts) == 9 and max(len(p.files) for p in parts) == 5 and sum(len(p.files) for p in parts) == 41

    def listed(*filters):
        reader = FilteringReader(options)
        left = list(reader.pushFilters(list(filters)))
        return sorted(path for p in reader.partitions() for path, _ in p.files), left

    assert listed(EqualTo(("path",), "other/a.py"))[0] == ["other/a.py"]
    assert listed(StringStartsWith(("path",), "big/d1/"), StringEndsWith(("path",), "9.txt"))[0] == ["big/d1/f9.txt", "big/d1/f29.txt"][::-1]
    assert listed(In(("path",), ("big/d0/f0.txt", "no/such", None)), EqualTo(("size",), 3)) == (["big/d0/f0.txt"], [EqualTo(("size",), 3)])
    (tmp_path / "other/secret.py").write_text("b")
    os.chmod(tmp_path / "other/secret.py", 0)
    (tmp_path / "big/gone.txt").symlink_to(tmp_path / "nowhere")
    spark.dataSource.register(RepositorySource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("cairn_repository").option("root", str(tmp_path)).option("pushdown", "true").load()
        assert [tuple(r) for r in rows.filter("path = 'other/a.py'").collect()] == [("other/a.py", 1, "a")]
        assert rows.filter("path like 'big/d2/%' and size > 5").count() == 10
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)

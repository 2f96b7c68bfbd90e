"""What keeps tasks and broadcasts from growing with the tables."""

import re
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from cairn.operators import graph, resolve, storage
from cairn.plans import corpus
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_graph_is_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    dealt = storage.in_shares(corpus.table(spark, SF, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    assert max(len(x) for x in dealt.rdd.glom().collect()) < 1000
    plan = plan_of(corpus.dep(spark, SF))
    assert "REPARTITION_BY_NUM" in plan
    same(corpus.dep(spark, SF), connect(SF), corpus.DEP)


def test_edges_of_null_keys_count_once(spark, tmp_path):
    for path in Path(SF).glob("*.parquet"):
        shutil.copy(path, tmp_path)
    for name, key, columns in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        odd = rows.limit(1).withColumn(key, F.lit(None).cast("bigint")).withColumn(columns, F.lit(3))
        rows.unionByName(odd).unionByName(odd).coalesce(1).write.parquet(str(tmp_path / f"{name}-rows"))
        (tmp_path / f"{name}.parquet").chmod(0o644)
        shutil.copy(next((tmp_path / f"{name}-rows").glob("part-*.parquet")), tmp_path / f"{name}.parquet")
    same(corpus.dep(spark, str(tmp_path)), connect(str(tmp_path)), corpus.DEP)


def test_edges_both_ways_take_no_second_distinct(spark):
    edges = corpus.dep(spark, SF, corpus.BACK_KEYS)
    names = "keys=[src#"  # the distinct over names is left to edges with a null end, after a filter of them
    assert plan_of(edges).count(names) == plan_of(corpus.dep(spark, SF)).count(names)
    same(edges, connect(SF), corpus.BACK)


def chain_edges(spark):
    """0 <- 1, 2, 3; each of these <- 4, 5, 6; all of these <- 7; 7 <- 0."""
    pairs = [(a, "0") for a in "123"] + [(b, a) for b in "456" for a in "123"] + [("7", b) for b in "456"] + [("0", "7")]
    return spark.createDataFrame(pairs, "src string, dst string")


def test_large_levels_meet_edges_that_are_not_sorted(spark, monkeypatch):
    edges, kept, materialise = chain_edges(spark), [], storage.materialise
    roots, ends = spark.createDataFrame([("0",)], "node string"), ("0", "7")
    want = [graph.impact(edges, roots, 4).collect(), graph.path_between(edges, *ends).collect()]
    monkeypatch.setattr(graph, "materialise", lambda df: kept.append(plan_of(df)) or materialise(df))
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    got = [graph.impact(edges, roots, 4).collect(), graph.path_between(edges, *ends).collect()]
    assert got == want and {r["node"]: r["level"] for r in got[0]} == dict(zip("1234567", (1, 1, 1, 2, 2, 2, 3)))
    joins = [p for p in kept if "Join" in p and "Window" not in p]  # without the growing chains, of which a few are kept a node
    assert joins and all("ShuffledHashJoin" in p and "SortMergeJoin" not in p and "BroadcastHashJoin" not in p for p in joins)


def test_edges_of_an_impact_are_made_once(spark):
    edges = spark.range(1, 9).select(F.col("id").cast("string").alias("src"), F.floor(F.col("id") / 2).cast("string").alias("dst"))
    roots = spark.createDataFrame([("0",)], "node string")
    found = graph.impact(edges, roots, 3)
    assert "Range (" not in plan_of(found)
    assert {r["node"]: (r["level"], r["dependents"]) for r in found.collect()} == {"1": (1, 2), "2": (2, 2), "3": (2, 2), "4": (3, 1), "5": (3, 0), "6": (3, 0), "7": (3, 0)}


def test_paths_of_a_report_are_resolved_once(spark):
    edges = chain_edges(spark)
    known = spark.range(8).select(F.col("id").cast("string").alias("path"))
    asked = spark.createDataFrame([("0",), ("none",)], "request string")
    report = graph.impact_report(edges, resolve.resolve_paths(asked, known, known.limit(0), "file"), 2)
    assert "Range (" not in plan_of(report)
    assert [(r["roots"], r["missing_roots"], r["total"], r["level_totals"]) for r in report.collect()] == [(["0", "none"], ["none"], 6, {1: 3, 2: 3})]


def test_degrees_pass_over_the_edges_once(spark):
    edges = spark.range(9).select(F.col("id").cast("string").alias("src"), (F.col("id") % 3).cast("string").alias("dst"))
    found = graph.degrees(edges)
    assert plan_of(found).count("Range (") == 1
    assert {r["node"]: (r["dependents"], r["dependencies"]) for r in found.collect()} == {str(n): (3 if n < 3 else 0, 1) for n in range(9)}


def in_small_shares(spark, monkeypatch, name: str) -> str:
    """The plan of a query whose tasks take 500 rows of the key graph; its rows equal its SQL."""
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    df = corpus.QUERIES[name](spark, SF)
    plan = plan_of(df)
    dealt = re.findall(r"Exchange hashpartitioning\(([ol]_\w+key)#\w+, \w+#\w+, (\d+)\), (\w+)", plan)
    rows = {key: corpus.table(spark, SF, t).count() for t, key in (("orders", "o_orderkey"), ("lineitem", "l_partkey"))}
    assert dealt == [(key, str(n // 500 + 1), "REPARTITION_BY_NUM") for key, n in rows.items()]  # once each, and not again for the distinct
    assert plan.count("Exchange hashpartitioning(src#") == 1  # edges with a null end
    same(df, connect(SF), corpus.ORACLES[name])
    return plan


def test_status_counts_takes_edges_in_shares(spark, monkeypatch):
    in_small_shares(spark, monkeypatch, "status_counts")


def test_entry_like_takes_edges_once_and_in_shares(spark, monkeypatch):
    plan = in_small_shares(spark, monkeypatch, "entry_like")
    assert plan.count("Generate inline") == 1 and "TakeOrderedAndProject" in plan


def test_graph_degrees_takes_edges_once_and_in_shares(spark, monkeypatch):
    plan = in_small_shares(spark, monkeypatch, "graph_degrees")
    assert plan.count("Generate inline") == 1

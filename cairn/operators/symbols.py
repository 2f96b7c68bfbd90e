"""Symbols of TypeScript and JavaScript sources and calls between exported functions.

All come from the facts of `source_facts`, which read each text once; nothing here sees a text. Rows carry `repo`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.facts import source_facts
from cairn.operators.storage import materialise, shuffled


def symbols_of(facts: DataFrame) -> DataFrame:
    """(repo, path, name, kind, is_default, exported, container, line); the first of equal (container, name, kind) stays."""
    first = facts.filter("fact = 'symbol'").groupBy("repo", "path", "container", "name", "kind").agg(F.min_by(F.struct("is_default", "exported", "line"), F.struct("rank", "pos", "k")).alias("s"))
    return first.select("repo", "path", "name", "kind", "s.is_default", "s.exported", F.when(F.col("container") != "", F.col("container")).alias("container"), "s.line")


def symbols(contents: DataFrame) -> DataFrame:
    """The symbols of contents; the facts are stored between."""
    return symbols_of(materialise(source_facts(contents)))


def imported_symbols(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, path, local, to_path, to_symbol); of one local name the import of the last statement counts."""
    exported = found.filter("exported").select("repo", F.col("path").alias("to_path"), F.col("name").alias("to_symbol")).distinct()
    rows = edges.select("repo", F.col("src").alias("path"), F.col("dst").alias("to_path"), "ordinal", F.posexplode("specifiers").alias("pos", "spec"))
    rows = rows.withColumn("words", F.split("spec", r"\s+as\s+")).select("repo", "path", "to_path", F.struct("ordinal", "pos").alias("place"), F.element_at("words", -1).alias("local"), F.element_at("words", 1).alias("to_symbol"))
    last = rows.join(shuffled(exported), ["repo", "to_path", "to_symbol"]).groupBy("repo", "path", "local").agg(F.max_by(F.struct("to_path", "to_symbol"), "place").alias("t"))
    return last.select("repo", "path", "local", "t.*")


def calls_of(facts: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, path, symbol, to_path, to_symbol, line) where an exported function calls an imported symbol or its member."""
    called = facts.filter("fact = 'call'").select("repo", "path", F.col("container").alias("symbol"), F.col("name").alias("local"), "line", F.struct("rank", "pos").alias("ord"))
    hits = called.join(shuffled(imported_symbols(edges, found)), ["repo", "path", "local"])
    return hits.groupBy("repo", "path", "symbol", "to_path", "to_symbol").agg(F.min_by("line", F.struct("ord", "local")).alias("line"))


def call_edges(contents: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """The calls of contents, given their edges and symbols."""
    return calls_of(source_facts(contents), edges, found)


def calls_by_export(found: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, path, name, calls, called_by) of every export, each list by path, symbol and line."""
    out = calls.groupBy("repo", "path", F.col("symbol").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col("to_path").alias("path"), F.col("to_symbol").alias("symbol"), "line"))).alias("calls"))
    into = calls.groupBy("repo", F.col("to_path").alias("path"), F.col("to_symbol").alias("name")).agg(F.array_sort(F.collect_list(F.struct("path", "symbol", "line"))).alias("called_by"))
    names = ["repo", "path", "name"]
    return found.filter("exported").select(*names).distinct().join(shuffled(out), names, "left").join(shuffled(into), names, "left")


def most_exports(found: DataFrame, limit: int = 15) -> DataFrame:
    """(repo, path, exports, symbols) of the files with the most exports."""
    counted = found.groupBy("repo", "path").agg(F.count_if("exported").alias("exports"), F.count("*").alias("symbols"))
    return counted.orderBy(F.desc("exports"), "path", "repo").limit(limit)

"""The facts of source texts, kept up as files change.

An index is four tables that are published together: files (repo, path), facts, edges, symbols and calls as their operators
define them. A full scan reads every text. A refresh after changes alone reads the changed texts only: their facts, edges and
symbols are replaced, and calls are taken anew, from stored facts, for the changed files and for those that import one of
them, as what a local name means depends on the symbols of its target. Where a file came or went, any import may lead
elsewhere, so the refresh is a full scan. Either way readers see the version before until the new one is whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.changes import pending
from cairn.operators.facts import source_facts
from cairn.operators.imports import edges_of, with_repo
from cairn.operators.storage import discard, materialise, shuffled
from cairn.operators.symbols import calls_of, symbols_of
from cairn.sources.versions import Versions

KEY = ["repo", "path"]
STATUS = "version bigint, action string, changed bigint, files bigint, edges bigint, symbols bigint, calls bigint, pending bigint, fresh boolean, next_action string"


class SourceIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def scan(self, contents: DataFrame, notes: dict | None = None) -> int:
        """Index all of contents (path, content, and repo where there are several); the version."""
        contents, after = with_repo(contents), self.versions.latest()
        files, facts = materialise(contents.select(*KEY)), materialise(source_facts(contents))
        edges, found = materialise(edges_of(facts, files)), materialise(symbols_of(facts))
        version = self.versions.publish({"files": files, "facts": facts, "edges": edges, "symbols": found, "calls": calls_of(facts, edges, found)}, after=after, notes=notes)
        discard(files, facts, edges, found)
        return version

    def refresh(self, changes: DataFrame, contents: DataFrame, notes: dict | None = None) -> DataFrame:
        """Apply changes (path, event, and repo where there are several; one event a path); the status, one row.

        contents are the texts as they are now; a scan of them alone follows where an event is add or unlink.
        """
        changes, contents = materialise(with_repo(changes).select(*KEY, "event").distinct()), with_repo(contents)
        came, n = changes.agg(F.count_if(F.col("event").isin("add", "unlink")), F.count("*")).first()
        try:
            if came or self.versions.latest() is None:
                self.scan(contents, notes)
                return self.status(action="full", changed=n)
            if not n:
                return self.status(action="none", changed=0)
            with self.versions.pinned() as old:
                self.replace(old, changes.select(*KEY), contents, notes)
            return self.status(action="incremental", changed=n)
        finally:
            discard(changes)

    def replace(self, old: dict[str, DataFrame], changed: DataFrame, contents: DataFrame, notes: dict | None) -> int:
        """Publish old with the facts of the changed files taken anew."""
        after, sources = self.versions.latest(), ["repo", "src"]
        changed = materialise(changed.join(shuffled(old["files"]), KEY, "left_semi"))  # a file that the index has never seen is not one
        fresh = materialise(source_facts(contents.join(shuffled(changed), KEY, "left_semi")))
        facts = materialise(old["facts"].join(shuffled(changed), KEY, "left_anti").unionByName(fresh))
        # a go.mod decides for all Go files of its repository
        modules = changed.filter("path = 'go.mod'").select("repo")
        touched = materialise(changed.unionByName(old["files"].filter(F.col("path").endswith(".go")).join(shuffled(modules), "repo", "left_semi")).distinct())
        moved = touched.withColumnRenamed("path", "src")
        renewed = edges_of(facts.join(shuffled(touched), KEY, "left_semi").unionByName(facts.filter("fact = 'module'").join(shuffled(touched), KEY, "left_anti")), old["files"])
        edges = materialise(old["edges"].join(shuffled(moved), sources, "left_anti").unionByName(renewed.join(shuffled(moved), sources, "left_semi")))
        found = materialise(old["symbols"].join(shuffled(changed), KEY, "left_anti").unionByName(symbols_of(fresh)))
        importers = edges.join(shuffled(changed.withColumnRenamed("path", "dst")), ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("path"))
        due = materialise(touched.unionByName(importers).distinct())
        near = edges.join(shuffled(due.withColumnRenamed("path", "src")), sources, "left_semi")
        calls = old["calls"].join(shuffled(due), KEY, "left_anti").unionByName(calls_of(facts.join(shuffled(due), KEY, "left_semi"), near, found))
        version = self.versions.publish({"files": old["files"], "facts": facts, "edges": edges, "symbols": found, "calls": calls}, after=after, notes=notes)
        discard(changed, fresh, facts, touched, edges, found, due)
        return version

    def status(self, waiting: DataFrame | None = None, *, action: str = "none", changed: int = 0) -> DataFrame:
        """One row of the latest version's sizes, and whether changes (path, event) wait for a refresh."""
        version = self.versions.latest()
        left = waiting.count() if waiting is not None else 0
        sizes = [None] * 4
        if version is not None:
            with self.versions.pinned(version) as tables:
                sizes = [tables[name].count() for name in ("files", "edges", "symbols", "calls")]
        due = bool(left) or version is None
        return self.spark.createDataFrame([(version, action, changed, *sizes, left, not due, "refresh" if due else "none")], STATUS)

    def follow(self, changes: DataFrame, contents: Callable[[], DataFrame], checkpoint: str):
        """Start a query that refreshes the index after each batch of streaming changes (path, event, seq).

        A batch that was published before the query stopped is known by the notes of its version and not applied again.
        """

        def apply(batch: DataFrame, number: int) -> None:
            last = self.versions.latest()
            if last is not None and self.versions.pointer(last)["notes"].get("batch", -1) >= number:
                return
            self.refresh(pending(batch).select("path", "event"), contents(), {"batch": number})
            self.versions.collect()

        return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()

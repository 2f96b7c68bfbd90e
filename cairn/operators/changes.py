"""Change events and derived facts in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(changes: DataFrame) -> DataFrame:
    """(path, event) left after changes(path, event, seq); event is add, change or unlink.

    unlink overwrites; add stays add over later changes; after unlink the next event counts anew. So only what follows
    the last unlink matters: nothing: unlink; any add: add; else change. Both are plain aggregates: no path is gathered.
    """
    kept = changes.filter(F.col("event").isin("add", "change", "unlink") & F.col("path").isNotNull() & (F.col("path") != ""))
    last = kept.groupBy("path").agg(
        F.max(F.when(F.col("event") == "unlink", F.col("seq"))).alias("gone"),
        F.max(F.when(F.col("event") == "add", F.col("seq"))).alias("added"),
        F.max("seq").alias("last"),
    )
    added = F.col("added").isNotNull() & (F.col("gone").isNull() | (F.col("added") > F.col("gone")))
    event = F.when(F.col("gone") == F.col("last"), "unlink").when(added, "add").otherwise("change")
    return last.select("path", event.alias("event"))


def refresh_policy(changes: DataFrame, batch: str) -> DataFrame:
    """By batch, full where a file came or went, else incremental."""
    return changes.groupBy(batch).agg(F.when(F.bool_or(F.col("event").isin("add", "unlink")), "full").otherwise("incremental").alias("action"), F.countDistinct("path").alias("paths"))


def first_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of a key's first row."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias("first_value"))


def last_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of a key's last row."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias("last_value"))


def doctor(rows: DataFrame, checks: dict[str, tuple[str, str]]) -> DataFrame:
    """(label, status) of named checks: (condition that some row must meet, status where none does)."""
    flags = rows.agg(*[F.bool_or(F.expr(c)).alias(f"c{i}") for i, (c, _) in enumerate(checks.values())])
    parts = [F.struct(F.lit(label).alias("label"), F.when(F.col(f"c{i}"), "pass").otherwise(other).alias("status")) for i, (label, (_, other)) in enumerate(checks.items())]
    return flags.select(F.inline(F.array(*parts)))

"""Merkle manifest of a table: a tree over the rows of each group, and one over the groups' roots.

Every level is a window: rows of one parent (group, index div arity) are one frame, and the ordered collect_list over the
whole frame gives each node both its parent's preimage and its siblings. The first row of a frame stands for the parent
(one row for each parent goes up). A level has 1/arity of the rows below it; levels are written to the shared folder, and
the siblings then come down again by joins of a level with the one above. No key has more than `arity` rows, so a group
with a third of all rows is no hot key.

Places in a group are counted without meeting in one task: rows are sorted by ranges, and what a range holds of each group
is summed. Null ids come first; rows of one id are ordered by their leaf, and equal rows may change places, which changes
no digest. A null group is a group of its own, before all others. Nulls, empty and long texts are leaves like all others
(see `field`). An empty table gives no rows. Columns that are not named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.shared import discard, stored


def field(value: Column) -> Column:
    """The value as it enters a leaf: `-` for null, else its UTF-8 byte count, a colon, and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in order."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*values: Column) -> Column:
    return digest(*map(field, values))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (a stored table with grp) with idx, the place in grp by order from 0, and n, grp's size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    # a group's rows in a range stand side by side
    held = ranged.groupBy("grp", "part").agg(F.min("at").alias("least"), F.count("*").alias("held"))
    by_part, whole = Window.partitionBy("grp").orderBy("part"), Window.partitionBy("grp")
    before = F.coalesce(F.sum("held").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("grp", "part", "least", before.alias("before"), F.sum("held").over(whole).alias("n"))
    out = ranged.join(held, ["grp", "part"]).withColumn("idx", F.col("before") + F.col("at") - F.col("least"))
    out.reads = ranged
    return out.drop("part", "at", "least", "before")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (grp, idx, n, node) with what stands before and after them below their parent, and the parent's digest."""
    frame = Window.partitionBy("grp", F.floor(F.col("idx") / arity)).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run, pos = F.collect_list("node").over(frame), F.pmod("idx", F.lit(arity)).cast("int")
    rows = nodes.withColumn("run", run)
    return rows.withColumns(
        {"before": F.concat_ws("", F.slice("run", F.lit(1), pos)), "after": F.concat_ws("", F.slice("run", pos + 2, F.lit(arity))), "up": digest(F.concat_ws("", "run"))}
    ).drop("run")


def levels_of(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The tree's levels from the leaves up, each stored; a group ends at the level where its n is 1."""
    levels = [stored(with_siblings(nodes, arity))]
    discard(getattr(nodes, "reads", None))
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        heads = levels[-1].filter((F.col("n") > 1) & (F.pmod("idx", F.lit(arity)) == 0))  # one row for each parent
        parents = heads.select("grp", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.col("up").alias("node"))
        levels.append(stored(with_siblings(parents, arity)))
        most = -(-most // arity)
    return levels


def with_paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level's rows, each with its path to the root (array of what stands before and after), subroot and root.

    tops: path, subroot and root of each group's own root.
    """
    paths = None
    for level in reversed(levels):
        own = [c for c in level.columns if c not in ("before", "after", "up")]
        below = level.filter("n = 1").select(*own).join(tops, "grp")
        if paths is not None:
            above = paths.select("grp", F.col("idx").alias("parent"), F.col("path").alias("rest"), "subroot", "root")
            step = F.array(F.struct("before", "after"))
            inner = level.filter("n > 1").withColumn("parent", F.floor(F.col("idx") / arity)).join(above, ["grp", "parent"])
            below = below.unionByName(inner.select(*own, F.concat(step, "rest").alias("path"), "subroot", "root"))
        paths = below
    return paths


def fold(node: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, node, lambda below, s: digest(s["before"], below, s["after"]))


def proof(path: Column) -> Column:
    """The siblings level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def merkle_manifest(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", group_col: str = "source", arity: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each of docs: id, leaf (the digest of its fields in order), subroot, root, path, and the columns of carry.

    carry names further expressions over docs, such as the leaf of an altered row, that come out beside the leaf.
    fold(leaf, path) gives the root; so does no other leaf.
    """
    if arity < 2:
        raise ValueError("a parent has two nodes or more")
    carry = carry or {}
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group)).alias("grp"), F.col(f"`{id_col}`").alias("id"),
        leaf_of(*(F.col(f"`{c}`") for c in fields)).alias("node"), F.struct(F.lit(0).alias("none"), *(v.alias(k) for k, v in carry.items())).alias("carried"),
        F.monotonically_increasing_id().alias("place"),
    )
    leaves = stored(leaves)
    levels = levels_of(numbered(leaves, ["id", "node", "place"]), arity)
    discard(leaves)
    roots = None
    for level in levels:
        ended = level.filter("n = 1").select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node")
        roots = ended if roots is None else roots.unionByName(ended)
    roots = stored(roots)
    upper = levels_of(numbered(roots, ["of"]), arity)
    discard(roots)
    last = upper[-1].filter("n = 1").select("grp", F.array().cast("array<struct<before: string, after: string>>").alias("path"), F.col("node").alias("root"), F.lit("").alias("subroot"))
    tops = stored(with_paths(upper, last, arity).select(F.col("of").alias("grp"), "path", F.col("node").alias("subroot"), "root"))
    discard(*upper)
    found = with_paths(levels, tops, arity)
    return found.select("id", F.col("node").alias("leaf"), "subroot", "root", "path", *(F.col(f"carried.`{k}`").alias(k) for k in carry))

"""Dependency graph operators over edges(src, dst): src depends on dst.

Edges are distinct. Every order has the node as its last key. Loops write each step to the shared folder, and joins are
on node keys, so a node with many dependents is split by adaptive execution instead of being gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.paths import at_least_one, is_test
from cairn.operators.storage import discard, materialise, shuffled, stored


def distinct_edges(*parts: DataFrame) -> DataFrame:
    """G1: union of edge tables, each edge once."""
    return reduce(DataFrame.unionByName, [p.select("src", "dst") for p in parts]).dropDuplicates(["src", "dst"])


def degrees(edges: DataFrame) -> DataFrame:
    """(node, dependents, dependencies) of every node that has an edge."""
    both = F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    ends = edges.select(F.inline(both))  # one pass over the edges, which may be dear
    return ends.groupBy("node").agg(F.sum("i").alias("dependents"), F.sum("o").alias("dependencies"))


def hubs(edges: DataFrame, limit: int | None = 10) -> DataFrame:
    """Nodes with dependents, most dependents first."""
    found = degrees(edges).filter("dependents > 0")
    return found.orderBy(F.desc("dependents"), "node").limit(at_least_one(limit, 10))


def entry_like(edges: DataFrame, limit: int | None = 10) -> DataFrame:
    """Nodes that depend on others and have one dependent at most, most dependencies first."""
    found = degrees(edges).filter("dependents <= 1 and dependencies > 0")
    return found.orderBy(F.desc("dependencies"), "node").limit(at_least_one(limit, 10))


def page(rows: DataFrame, order: str, limit=None, offset=None) -> DataFrame:
    """A page of rows in order, with `total` and `truncated` (rows follow the page)."""
    total = rows.agg(F.count("*").alias("total"))
    start = at_least_one(offset, 0)
    out = rows.orderBy(order).offset(start) if start else rows.orderBy(order)
    count = at_least_one(limit, 0)
    out = out.limit(count) if count else out
    end = F.least(F.lit(start).cast("bigint") + (F.lit(count) if count else F.col("total")), F.col("total"))
    return out.join(F.broadcast(total)).withColumn("truncated", end < F.col("total"))


def fan_out(edges: DataFrame, node: str, limit=None, offset=None) -> DataFrame:
    """What a node depends on."""
    return page(edges.filter(F.col("src") == node).select(F.col("dst").alias("node")), "node", limit, offset)


def fan_in(edges: DataFrame, node: str, limit=None, offset=None) -> DataFrame:
    """What depends on a node."""
    return page(edges.filter(F.col("dst") == node).select(F.col("src").alias("node")), "node", limit, offset)


#: Nodes of a level that are broadcast, so that the edges stay where they are; a larger level is joined by a shuffle.
BROADCAST_NODES = 500_000


def sent(nodes: DataFrame) -> DataFrame:
    """Stored nodes, for joins with many rows: broadcast, or dealt out and hashed, so that what they meet is not sorted."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes.hint("shuffle_hash")


def dependents_by_level(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, level): nodes that reach a root over dependencies, by their least distance up to depth; roots are left out.

    A node is taken at the first level that meets it, so cycles end (G13). roots (request, node) ask for many requests at
    once, in as many jobs as one takes; rows then have their request, and each has its own roots.
    """
    keys = ["request", "node"] if "request" in roots.columns else ["node"]
    held = stored(edges) if depth > 1 else edges
    front = materialise(roots.select(*keys, F.lit(0).alias("level")).dropDuplicates(keys))
    levels = [front]
    for level in range(1, depth + 1):
        step = front.select(*keys[:-1], F.col("node").alias("dst"))
        met = held.join(sent(step), "dst").select(*keys[:-1], F.col("src").alias("node")).distinct()
        front = materialise(met.join(sent(reduce(DataFrame.unionByName, levels)), keys, "left_anti").withColumn("level", F.lit(level)))
        levels.append(front)
        if front.isEmpty():
            break
    found = materialise(reduce(DataFrame.unionByName, levels).filter("level > 0"))
    discard(*levels, held if held is not edges else None)
    return found


def impact(edges: DataFrame, roots: DataFrame, depth=2, min_depth=1, limit=None) -> DataFrame:
    """(node, level, dependents) by level from min_depth on, ordered by dependents, then node.

    With roots (request, node), rows have their request and come by request first; limit then holds for each request.
    """
    depth = at_least_one(depth, 2)
    least = min(at_least_one(min_depth, 1), depth)
    edges = stored(edges)  # read by each level and for the counts
    found = dependents_by_level(edges, roots, depth).filter(F.col("level") >= least)
    fan = edges.groupBy("dst").agg(F.count("*").alias("dependents"))
    own = [c for c in found.columns if c == "request"]
    ranked = found.join(shuffled(fan), F.col("node") == F.col("dst"), "left").select(*own, "node", "level", F.coalesce("dependents", F.lit(0)).cast("bigint").alias("dependents"))
    ranked = ranked.orderBy(*own, F.desc("dependents"), "node")
    count = at_least_one(limit, 0)
    if count and own:
        first = Window.partitionBy("request").orderBy(F.desc("dependents"), "node")
        return ranked.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= count).drop("n")
    return ranked.limit(count) if count else ranked


def level_totals(impacted: DataFrame) -> DataFrame:
    """A3: nodes of each level."""
    return impacted.groupBy("level").agg(F.count("*").alias("total"))


def impact_report(edges: DataFrame, resolved: DataFrame, depth=2, min_depth=1, limit=None) -> DataFrame:
    """One row (roots, missing_roots, warnings, depth, min_depth, total, truncated, level_totals) of resolved paths.

    resolved comes from resolve_paths. level_totals has the levels from min_depth to the last one looked at, which may be
    empty. The nodes are the rows of `impact`, as there may be any number of them.
    """
    depth = at_least_one(depth, 2)
    least = min(at_least_one(min_depth, 1), depth)
    resolved = stored(resolved)
    found = dependents_by_level(edges, resolved.filter("found").select(F.col("path").alias("node")), depth)
    ends = found.agg(F.coalesce(F.max("level"), F.lit(0)).alias("last"), F.count_if(F.col("level") >= least).alias("total"))
    sums = found.groupBy("level").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("sums"))  # one entry a level
    asked = resolved.agg(
        F.array_sort(F.collect_list("path")).alias("roots"),
        F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("path")))).alias("missing_roots"),
        F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.concat_ws(": ", "warning", "path")))).alias("warnings"),
    )  # the stated requests
    levels = F.filter(F.sequence(F.lit(1), F.least(F.lit(depth), F.col("last") + 1)), lambda x: x >= least)
    totals = F.map_from_arrays(levels, F.transform(levels, lambda x: F.coalesce(F.try_element_at("sums", x), F.lit(0).cast("bigint"))))
    count = at_least_one(limit, 0)
    out = asked.join(F.broadcast(ends)).join(F.broadcast(sums))
    return out.select("roots", "missing_roots", "warnings", F.lit(depth).alias("depth"), F.lit(least).alias("min_depth"), "total", (F.lit(bool(count)) & (F.col("total") > count)).alias("truncated"), totals.alias("level_totals"))


def affected(edges: DataFrame, changed: DataFrame, depth=2) -> DataFrame:
    """(node, is_test) that a change reaches; the changed nodes are left out."""
    return dependents_by_level(edges, changed, at_least_one(depth, 2)).select("node", is_test(F.col("node")).alias("is_test"))


def path_between(edges: DataFrame, start: str, end: str, max_paths=5, max_depth=12) -> DataFrame:
    """(path, length, truncated): the first max_paths of all shortest chains of dependents from start to end.

    Distances from start come first; then only edges between neighbouring levels that lead to end are kept; chains grow
    over these, the first max_paths + 1 of each node by order, as later ones cannot become first again.
    """
    spark, edges = edges.sparkSession, stored(edges)
    paths, hops = at_least_one(max_paths, 5), at_least_one(max_depth, 12)
    schema = "path array<string>, length int, truncated boolean"
    known = edges.filter((F.col("src") == start) | (F.col("dst") == start)).limit(1).count()
    if start == end:
        return spark.createDataFrame([([start], 0, False)] if known else [], schema)
    front, reached = materialise(spark.createDataFrame([(start,)], "node string")), 0
    fronts = [front]
    for level in range(1, hops + 1):
        met = edges.join(sent(front.select(F.col("node").alias("dst"))), "dst").select(F.col("src").alias("node")).distinct()
        front = materialise(met.join(sent(reduce(DataFrame.unionByName, fronts)), "node", "left_anti"))
        fronts.append(front)
        if front.isEmpty():
            break
        if not front.filter(F.col("node") == end).isEmpty():
            reached = level
            break
    if not reached:
        return spark.createDataFrame([], schema)
    wanted = spark.createDataFrame([(end,)], "node string")
    steps = []
    for level in range(reached, 0, -1):
        below = fronts[level - 1].select(F.col("node").alias("dst"))
        step = materialise(edges.join(sent(wanted.select(F.col("node").alias("src"))), "src").join(sent(below), "dst").select("src", "dst"))
        steps.append(step)
        wanted = step.select(F.col("dst").alias("node")).distinct()
    chains = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    first = Window.partitionBy("node").orderBy("path")
    for step in reversed(steps):
        grown = chains.join(step, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), F.concat("path", F.array("src")).alias("path"))
        chains = grown.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= paths + 1).drop("n")
    chains = materialise(chains.select("path"))
    more = chains.count() > paths
    return chains.orderBy("path").limit(paths).select("path", F.lit(reached).alias("length"), F.lit(more).alias("truncated"))


def path_report(edges: DataFrame, ends: DataFrame, max_paths=5, max_depth=12) -> DataFrame:
    """One row (start, end, status, length, paths, truncated) for resolved ends.

    ends is one row (start, start_found, end, end_found). status is `missing_start`, `missing_end`, `same`, `connected` or
    `not_connected`; paths hold the chains, none where there is no way.
    """
    asked = ends.first()
    spark, status, found = edges.sparkSession, None, []
    if not asked["start_found"] or not asked["end_found"]:
        status = "missing_start" if not asked["start_found"] else "missing_end"
    else:
        found = path_between(edges, asked["start"], asked["end"], max_paths, max_depth).collect()  # max_paths rows at most
        status = "same" if asked["start"] == asked["end"] else "connected" if found else "not_connected"
    row = (asked["start"], asked["end"], status, found[0]["length"] if found else None, sorted(list(r["path"]) for r in found), bool(found and found[0]["truncated"]))
    return spark.createDataFrame([row], "start string, end string, status string, length int, paths array<array<string>>, truncated boolean")


def affected_report(edges: DataFrame, resolved: DataFrame, depth=2) -> DataFrame:
    """(part, node, warning): changed files as they were resolved, those that are missing, and what they reach.

    resolved comes from resolve_paths. part is `changed`, `missing`, `affected` or `test`; a test that was changed itself is
    one of the tests to run.
    """
    changed = resolved.filter("found").select(F.col("path").alias("node"), "warning")
    reached = affected(edges, changed, depth)
    tests = reached.filter("is_test").select("node").unionByName(changed.filter(is_test(F.col("node"))).select("node")).distinct()
    none = F.lit(None).cast("string").alias("warning")
    parts = [
        changed.distinct().select(F.lit("changed").alias("part"), "node", "warning"),
        resolved.filter("not found").select(F.lit("missing").alias("part"), F.col("path").alias("node"), "warning"),
        reached.select(F.lit("affected").alias("part"), "node", none),
        tests.select(F.lit("test").alias("part"), "node", none),
    ]
    return reduce(DataFrame.unionByName, parts)


def rebuild(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """T4: edges without those that start at a changed node, and the fresh edges."""
    return edges.join(changed.select(F.col("node").alias("src")).distinct(), "src", "left_anti").unionByName(fresh.select("src", "dst"))

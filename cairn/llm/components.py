"""Connected components: tasks contract the edges they hold, alternating stars join what is left between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import discard, stored

#: Edges that a task holds and contracts at a time, and so few that one task contracts them all.
HELD, FEW = 1_000_000, 200_000


def is_star_forest(edges: DataFrame) -> bool:
    """Every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("centre"))
    return seen.filter("low <> high or (low is not null and centre)").isEmpty()


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with edges u, v; one less than nodes for a component."""
    nodes, places = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with the edges (u, v) of each task replaced by stars; no shuffle, HELD edges at a time."""

    def run(batches):
        held, n = [], 0

        def flush():
            u, v = spanning_stars(*(np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of an edge (u, v) with two different ends; comp is the smallest node of the component.

    Each round contracts what a task holds, hooks neighbours to the least neighbour (large star), then lower neighbours
    to the least of them (small star), until all edges lead to a smallest node. Rounds grow with the logarithm of a
    component's width. A hub's row is never gathered: minima combine before the shuffle and the join back can be split.
    """
    edges = stored(contracted(edges.filter("u <> v")).distinct())
    if few := edges.count() <= FEW:
        before, edges = edges, stored(contracted(edges.coalesce(1)))
        discard(before)
    while not few and not is_star_forest(edges):
        close = stored(contracted(edges))
        both = close.unionByName(close.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, stored(hooked.filter("u <> v").distinct())
        discard(old, close)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())

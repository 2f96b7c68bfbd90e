"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors become integer term weights floor(scale * x). Rows are dealt in ranges of their id; a range is cut into blocks
whose forward index is the matrix of their rows. A block's bound for a query is the sum of its term maxima (over the
sign a query weight asks for). Each query takes the blocks in the order of their bounds and stops once the next bound
falls below its k-th score.

Vectors that are null or hold null or non-finite components take no part, nor do null ids. A query meets vectors of its
own length only. Rows that repeat a query's id are that query's own; of several usable rows with a query's id the least
vector is asked. Sums are exact however large the weights; a score beyond 64 bits is given as the largest or smallest
that 64 bits hold. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.shared import stored

#: Queries that are broadcast at once; more are taken in blocks of this many, each against all rows.
QUERY_BLOCK = 8192


def weights(column: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of integers) for every vector length; unusable vectors are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    out = []
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        flat = pa.compute.list_flatten(column.take(pa.array(rows)))
        flat = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rows), n)
        fine = np.isfinite(flat).all(axis=1)
        out.append((rows[fine], np.floor(scale * flat[fine])))
    return out


MOST = np.iinfo(np.int64).max


def exact(matrix: np.ndarray, kind) -> np.ndarray:
    """Whole numbers as this kind; object means Python's, which have no bound."""
    return matrix.astype(kind) if kind is not object else np.array([[int(x) for x in row] for row in matrix.tolist()], dtype=object).reshape(matrix.shape)


def sort_key(score: int) -> str:
    """A string that orders scores of equal 64-bit value: 1 for scores within 64 bits, else by sign, length and digits."""
    if -MOST <= score <= MOST:
        return "1"
    digits = str(abs(score))
    return f"1{len(digits):09d}{digits}" if score > 0 else f"0{999_999_999 - len(digits):09d}{digits.translate(COMPLEMENT)}"


COMPLEMENT = str.maketrans("0123456789", "9876543210")


def search_wide(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, cuts: np.ndarray, k: int, block: int):
    """search_range over Python's whole numbers, for sums that 64 bits may not hold: scores are exact."""
    at, names, scores = [], [], []
    for q in range(len(queries)):
        top: list[tuple[int, int]] = []
        for b in sorted(range(len(cuts)), key=lambda b: (-bound[q, b], b)):
            if len(top) == k and bound[q, b] < -top[-1][0]:
                break
            part = slice(cuts[b], cuts[b] + block)
            own = zip((docs[part] @ queries[q]).tolist(), ids[part].tolist())
            top = sorted(top + [(-score, name) for score, name in own if name != query_ids[q]])[:k]
        at += [q] * len(top)
        names += [name for _, name in top]
        scores += [-score for score, _ in top]
    return np.array(at, np.int64), np.array(names, np.int64), scores


def search_range(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int):
    """Top k of these documents for every query: (query index, id, score) arrays."""
    top = np.abs(queries).max(initial=0).astype(float) * np.abs(docs).max(initial=0) * max(1, docs.shape[1])
    kind = np.float64 if top < 2**53 else np.int64 if top < 2**62 else object  # float products are exact here, and fast
    order = np.argsort(ids, kind="stable")
    ids, docs, queries = ids[order], exact(docs[order], kind), exact(queries, kind)
    cuts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(docs, cuts, axis=0), np.minimum.reduceat(docs, cuts, axis=0)
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    if kind is object:
        return search_wide(ids, docs, query_ids, queries, bound, cuts, k, block)
    visit = np.argsort(-bound, axis=1, kind="stable")
    n = len(queries)
    least = np.iinfo(np.int64).min
    score = np.full((n, k), least, dtype=np.int64)
    doc = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
    active = np.arange(n)
    for step in range(len(cuts)):
        blocks = visit[active, step]
        going = (bound[active, blocks] >= score[active, -1]) | (score[active, -1] == least)
        active, blocks = active[going], blocks[going]
        if not len(active):
            break
        by_block = np.argsort(blocks, kind="stable")
        heads = np.flatnonzero(np.diff(blocks[by_block], prepend=-1))
        for a, b in zip(heads, [*heads[1:], len(by_block)]):
            who = active[by_block[a:b]]
            at = slice(cuts[blocks[by_block[a]]], cuts[blocks[by_block[a]]] + block)
            own = queries[who] @ docs[at].T
            own = own.astype(np.int64)
            own[query_ids[who][:, None] == ids[at][None, :]] = least
            both = np.concatenate((score[who], own), axis=1)
            names = np.concatenate((doc[who], np.where(own == least, np.iinfo(np.int64).max, np.broadcast_to(ids[at], own.shape))), axis=1)
            best = np.lexsort((names, ~both), axis=1)[:, :k]  # ~ turns the order of all 64-bit values
            score[who], doc[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
    q, j = np.nonzero(score > least)
    return q, doc[q, j], score[q, j]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = 128, range_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its k highest scores, ties to the smaller id."""
    spark = vectors.sparkSession
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    pick = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")]
    rows = vectors.select(*pick).filter("id is not null and vector is not null").filter(usable).repartitionByRange("id")
    asked = queries.select(*pick).filter("id is not null and vector is not null").filter(usable).groupBy("id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(n_blocks):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id").toArrow()
        sets = {m.shape[1]: (np.asarray(mine["id"])[r], m) for r, m in weights(mine["vector"], scale)} if mine.num_rows else {}
        held = spark.sparkContext.broadcast(sets)

        def run(batches, held=held):
            parts, n = [], 0
            for batch in batches:
                parts.append(batch)
                n += batch.num_rows
                if n >= range_rows:
                    yield from answer(pa.Table.from_batches(parts), held.value)
                    parts, n = [], 0
            if parts:
                yield from answer(pa.Table.from_batches(parts), held.value)

        def answer(table, sets):
            ids = np.asarray(table["id"])
            for r, matrix in weights(table["vector"], scale):
                if matrix.shape[1] in sets and len(r):
                    query_ids, q = sets[matrix.shape[1]]
                    at, doc, score = search_range(ids[r], matrix, query_ids, q, k, block)
                    keys = [sort_key(x) for x in score] if isinstance(score, list) else ["1"] * len(score)
                    score = [max(-MOST, min(MOST, x)) for x in score] if isinstance(score, list) else score
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[at], pa.int64()), pa.array(doc), pa.array(score, pa.int64()), pa.array(keys, pa.string())], names=["query_id", "vec_id", "score", "key"])

        part = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, key string")
        if n_blocks > 1:  # a block's queries leave the driver and the executors before the next ones come
            part = stored(best_of(part, k))
            held.destroy()
        found = part if found is None else found.select("query_id", "vec_id", "score", "key").unionByName(part.select("query_id", "vec_id", "score", "key"))
    return best_of(found, k).drop("key")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, key): the k highest scores of each query."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "key")

"""Ranked lexical search over an inverted index in shards, by block maxima over blocks of varied length.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. A document's score
for a query is the sum, over the query's terms with repeats, of the term's weight times the term's impact in the document;
weights and impacts are whole numbers (see `weight` and `impacts`), so the order of sums does not matter.

Index: a task turns each megabyte of texts that it reads into a shard, one row of the index table: ids and lengths of
its documents, its terms, their postings, and the postings' blocks. Dynamic programming chooses the boundaries of a list's
blocks: least is the sum, over blocks, of a fixed cost and of what the block's greatest impact overstates its postings.
The statistics (documents, terms, documents of a term) are counted over all documents.

Search: queries are sent to the tasks in blocks of bounded size. In a shard, the blocks of a query's terms cut the documents
into ranges, and the sum of the block maxima that cover a range bounds its scores. Ranges whose bound is below the query's
k-th score so far, in this shard or an earlier one of the task, are skipped with their postings; documents of the others are
looked up in the postings. The ranges of the highest bounds come first, to raise the k-th score, then the rest in order. No
document is lost: bounds are never below scores, and ties are kept.

Null and empty texts, and texts without terms, are no documents of the statistics and match nothing. Repeated rows are
documents of their own. Ties go to the smaller id, null ids last; ids are cast to long (others end the job). Each row of
queries is a query of its own, also where item ids repeat or are null. Queries without terms, or without a document with
a score above 0, give no rows. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.shared import BATCH_SIZE, ROWS_READ, discard, settings, stored
from cairn.llm.textbytes import ALNUM, LOWER, by_bytes, string_bytes, words_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a block costs beside the error of its bound, in impacts (the largest is below this), and its most postings.
BLOCK_COST, BLOCK_MOST = 1_000_000, 64
#: Terms (counted once for each of their queries) that are sent to the tasks at once.
QUERY_TERMS = 400_000
#: Bytes of texts that go to Python at once, and rows of the index that are decoded at once: a task holds so much of either.
TEXTS, SHARDS = {BATCH_SIZE: "4m"}, {ROWS_READ: "2"}
SHARD = "shard bigint, ids array<bigint>, lengths array<int>, terms array<string>, dfs array<int>, docs binary, tfs binary, block_counts array<int>, block_starts binary, block_maxima binary"


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of a term with these occurrences in documents of these lengths."""
    m = 100 - 75 + (75 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("bigint")


def choose_blocks(scores: np.ndarray, sizes: np.ndarray, cost: int = BLOCK_COST, most: int = BLOCK_MOST) -> np.ndarray:
    """Which postings begin a block. scores holds the lists of these sizes one after another.

    best[j] = min over i of best[i] + cost + (j - i) * max(scores[i:j]), for all lists of like size at once.
    """
    begins = np.zeros(len(scores), dtype=bool)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(level[sizes > 0]).tolist():
        lists = np.flatnonzero((level == k) & (sizes > 0))
        size, width = sizes[lists], int(sizes[lists].max())
        at = first[lists][:, None] + np.arange(width)
        inside = np.arange(width) < size[:, None]
        s = np.where(inside, scores[np.minimum(at, len(scores) - 1)], 0)
        best = np.zeros((len(lists), width + 1), dtype=np.int64)
        came = np.zeros((len(lists), width + 1), dtype=np.int32)
        top = np.zeros((len(lists), width), dtype=np.int64)  # top[i]: maximum of what lies between i and j
        for j in range(1, width + 1):
            low = max(0, j - most)
            np.maximum(top[:, low:j], s[:, j - 1 : j], out=top[:, low:j])
            sums = top[:, low:j] * np.arange(j - low, 0, -1)
            sums += best[:, low:j]
            where = np.argmin(sums, axis=1)
            best[:, j] = sums[np.arange(len(lists)), where] + cost
            came[:, j] = where + low
        row, end = np.arange(len(lists)), size.astype(np.int64)
        while len(row):
            end = came[row, end]
            begins[first[lists[row]] + end] = True
            row, end = row[end > 0], end[end > 0]
    return begins


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the rows in order, and each row's first (len+1)."""
    data, offsets = string_bytes(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, ALNUM)
    kept = data[ALNUM[data]]
    edges = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(kept)), first


def shard_of(number: int, ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One row of the index."""
    words, first = terms_of(texts)
    coded = words.dictionary_encode()
    length = np.diff(first)
    n, vocabulary = len(length), len(coded.dictionary)
    key = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length)
    key, tf = np.unique(key, return_counts=True)  # postings, by term and document
    term, doc = key // max(n, 1), key % max(n, 1)
    df = np.bincount(term, minlength=vocabulary)
    score = impacts(tf.astype(np.int64), length[doc], n_docs, n_terms) if n_terms else np.zeros(0, np.int64)
    starts = np.flatnonzero(choose_blocks(score, df))
    maxima = np.maximum.reduceat(score, starts) if len(starts) else np.zeros(0, np.int64)

    def one(values, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values.astype(kind)))

    row = [
        pa.array([number]), one(ids, None), one(length, np.int32), one(coded.dictionary.cast(pa.string()), None), one(df, np.int32), pa.array([doc.astype("<i4").tobytes()], pa.binary()),
        pa.array([tf.astype("<i4").tobytes()], pa.binary()), one(np.bincount(term[starts], minlength=vocabulary), np.int32), pa.array([starts.astype("<i4").tobytes()], pa.binary()), pa.array([maxima.astype("<i4").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(row, names=[part.split()[0] for part in SHARD.split(", ")])


def corpus_counts(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats."""

    def run(batches):
        n_docs = n_terms = 0
        for batch in by_bytes(batches, "text"):
            data, offsets = string_bytes(batch.column(0))
            length = np.diff(words_of(data, offsets, ALNUM | (LOWER != np.arange(256)))[2])
            n_docs += int((length > 0).sum())
            n_terms += int(length.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n_docs", "n_terms"])

    with settings(docs.sparkSession, TEXTS):
        found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "n_docs bigint, n_terms bigint").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return found[0] or 0, found[1] or 0


class LexicalIndex:
    """An index in the shared folder: `shards`, and the counts that scores need."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1_000_000) -> LexicalIndex:
    """Index every row of docs. A shard has at most shard_bytes of text, or one document."""
    n_docs, n_terms = corpus_counts(docs, text_col)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in by_bytes(batches, "text", shard_bytes):
            yield shard_of(number, batch.column(0), batch.column(1), n_docs, n_terms)
            number += 1

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return LexicalIndex(stored(rows.mapInArrow(run, SHARD), conf=TEXTS, long_rows=True), n_docs, n_terms)


def query_terms(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query, term, w): weight times repeats of each term of each query that some document holds. queries: query, text."""
    words = F.regexp_extract_all(F.translate("text", UPPER, SMALL), F.lit(TERM), F.lit(0))
    asked = queries.select("query", F.explode(words).alias("term")).groupBy("query", "term").agg(F.count("*").alias("repeats"))
    held = index.shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    wanted = held.join(asked.select("term").distinct(), "term", "left_semi")
    weighed = asked.join(wanted, "term").select("query", "term", (F.col("repeats") * weight(index.n_docs, F.col("df"))).alias("w"))
    return weighed.filter("w > 0")


class Shard:
    """A row of the index, ready for search."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        numbers = lambda name: np.frombuffer(row[name].as_py(), "<i4").astype(np.int64)
        flat = lambda name: row[name].values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids, self.length, self.terms = row["ids"].values, flat("lengths"), row["terms"].values
        self.n, df, per_term = len(self.length), flat("dfs"), flat("block_counts")
        self.doc, self.tf, self.starts, self.maxima = numbers("docs"), numbers("tfs"), numbers("block_starts"), numbers("block_maxima")
        self.key = np.repeat(np.arange(len(df)) * self.n, df) + self.doc
        self.block = np.concatenate(([0], np.cumsum(per_term)))
        self.from_doc = self.doc[self.starts]
        self.to_doc = self.doc[np.append(self.starts[1:], len(self.doc)) - 1] + 1 if len(self.starts) else self.starts
        self.counts = n_docs, n_terms

    def bounds(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each document, the sum of the block maxima that cover it."""
        per_term = self.block[terms + 1] - self.block[terms]
        blocks = np.repeat(self.block[terms] - np.cumsum(per_term) + per_term, per_term) + np.arange(int(per_term.sum()))
        most = np.repeat(w, per_term) * self.maxima[blocks]
        change = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(change, self.from_doc[blocks], most)
        np.subtract.at(change, self.to_doc[blocks], most)
        return np.cumsum(change[:-1])

    def scores(self, docs: np.ndarray, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Exact scores of these documents, looked up in the terms' postings."""
        want = terms[:, None] * self.n + docs[None, :]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[at] == want
        found = np.where(hit, impacts(np.where(hit, self.tf[at], 1), self.length[docs][None, :], *self.counts), 0)
        return (w[:, None] * found).sum(axis=0)


class Best:
    """The k best documents of a query so far: scores from the highest, ties by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.none, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        fine = score >= self.least
        if fine.any():
            score, none, ids = (np.concatenate(x) for x in ((self.score, score[fine]), (self.none, none[fine]), (self.id, ids[fine])))
            order = np.lexsort((ids, none, -score))[: self.k]
            self.score, self.none, self.id = score[order], none[order], ids[order]


def search_shard(shard: Shard, terms: np.ndarray, w: np.ndarray, best: Best, none: np.ndarray, ids: np.ndarray) -> None:
    """Add the shard's documents that belong to the query's best."""
    bound = shard.bounds(terms, w)
    left = np.flatnonzero(bound >= best.least)
    if len(left) > 2 * best.k:
        head = left[np.argpartition(-bound[left], best.k)[: 2 * best.k]]
        best.add(shard.scores(head, terms, w), none[head], ids[head])
        waiting = np.zeros(shard.n, dtype=bool)
        waiting[left] = True
        waiting[head] = False
        left = np.flatnonzero(waiting)
    step = 64
    while True:
        left = left[bound[left] >= best.least]  # the k-th score has risen: more ranges are skipped
        if not len(left):
            return
        now, left = left[:step], left[step:]
        best.add(shard.scores(now, terms, w), none[now], ids[now])
        step = 256


def search(index: LexicalIndex, queries: DataFrame, k: int = 10, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of queries."""
    spark = queries.sparkSession
    asked = stored(queries.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    terms = stored(query_terms(asked, index), conf=SHARDS)
    total = terms.count()
    n_blocks = 1 if total <= QUERY_TERMS else 2 * -(-total // QUERY_TERMS)
    counts, found = (index.n_docs, index.n_terms), None
    for b in range(n_blocks):
        block = terms if n_blocks == 1 else terms.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b)
        rows = block.orderBy("query").toArrow().combine_chunks()  # bounded by QUERY_TERMS and one query's terms
        vocabulary = rows["term"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        numbers, first = np.unique(np.asarray(rows["query"]), return_index=True)
        held = spark.sparkContext.broadcast((numbers, np.append(first, rows.num_rows), np.asarray(vocabulary.indices), vocabulary.dictionary, np.asarray(rows["w"])))

        def run(batches, held=held):
            numbers, first, term, vocabulary, w = held.value
            best = [Best(k) for _ in numbers]
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = Shard({c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}, *counts)
                    if not len(shard.starts):
                        continue
                    none = np.asarray(shard.ids.is_null())
                    ids = pc.fill_null(shard.ids, 0).to_numpy()
                    place = np.asarray(pc.fill_null(pc.index_in(vocabulary, value_set=shard.terms), -1)).astype(np.int64)[term]
                    for q, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                        here = place[a:z] >= 0
                        if here.any():
                            search_shard(shard, place[a:z][here], w[a:z][here], best[q], none, ids)
            count = [len(x.score) for x in best]
            if sum(count):
                ids, none, score = (np.concatenate([getattr(x, c) for x in best]) for c in ("id", "none", "score"))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, count)), pa.array(ids, mask=none), pa.array(score)], names=["query", "doc_id", "score"])

        part = stored(index.shards.mapInArrow(run, "query bigint, doc_id bigint, score bigint"), batch_rows=2, conf=SHARDS)
        held.destroy()  # one block of queries is held at a time
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    discard(terms)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

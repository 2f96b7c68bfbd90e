"""Toxicity from class-conditional Kneser-Ney models of the bytes of words.

An expression is a word (letters; ASCII and Latin-1 capitals lower-cased). Each class has its own interpolated
Kneser-Ney model of the top orders; below them both back off to counts pooled over the classes, so an expression that
one class has not seen is smoothed by what all labelled text has. An expression's value is the difference of its two
log-likelihoods over its length in bytes. The score itself is a logistic function of a document's highest values and of
its mean value, fitted on labelled rows that the counts leave out. Where these lack a class, the classes' prior odds and
the highest values, as those of ORDER bytes, take its place; where the counted rows lack one too, only the prior odds do,
and nothing is held for toxic. Phrases of words that are ordinary one by one are not seen.

Counts come from every labelled row but those kept for the fit and the held-out rows. Null and empty texts have no
expressions and get the score of a document without evidence. Rows with null or repeated ids are scored one by one, and
equal texts alike; labels that disagree count as the highest. Empty tables give no rows, or no counts.

No n-gram is left out, however many there are. A place in a word asks for the n-grams that end there, and all of them,
their contexts and the shorter n-grams they back off to share the three bytes before the last. Counts are therefore kept
in buckets by those three bytes: one task builds its bucket's part of both models and values the windows (an n-gram of the
longest order that fits) asked for. Only the orders that both classes share cross buckets: they are few (at most
156**3, letters and two marks) and are broadcast. What tasks have counted is added up in shares of a bucket first, by the
whole window, so that a bucket's task gets each of its windows once, however many tasks there were. Windows are asked for
once for each block of distinct words. The values of the MOST_WORDS most common words are
broadcast, those of all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import discard, release, stored
from cairn.llm.textbytes import LOWER, U64, by_bytes, mix, parts_of, prefix_hash, span_hash, string_bytes, words_of

ORDER, POOLED = 7, 3
#: Windows of one bucket (16 bytes each) and words of one block, on average.
BUCKET_WINDOWS, BLOCK_WORDS = 200_000, 100_000
#: Blocks that ask one copy of a bucket, and counted blocks that one share of it adds up; more of them take more copies or shares.
ASKING = 64
#: Words whose values are broadcast (16 bytes each); the others are joined.
MOST_WORDS = 250_000
#: Labelled rows, at most, that fit the logistic function.
FIT_ROWS = 40_000
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
START, END = 1, 2
TOP = 3
PIECE = 1_500_000


def lowered(data: np.ndarray) -> np.ndarray:
    data = LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 32
    return data


def distinct_words(column: pa.Array):
    """Bytes of a batch, and for its distinct (row, word): row, start, end, hash; then words in each row."""
    data, offsets = string_bytes(column)
    data = lowered(data)
    lead = data == 0xC3  # a Latin-1 letter is then one byte, and n-grams reach further
    offsets = offsets - np.concatenate(([0], np.cumsum(lead)))[offsets]
    data = data[~lead]
    starts, ends, first = words_of(data, offsets, LETTERS)
    rows = np.repeat(np.arange(len(column)), np.diff(first))
    h = span_hash(prefix_hash(data), starts, ends)
    order = np.lexsort((h, rows))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    keep = order[new]
    return data, rows[keep], starts[keep], ends[keep], h[keep]


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, window) of every place of ^word$ but ^: the ORDER bytes that end there, or fewer from ^ on, and their number."""
    size = ends - starts + 2
    base = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(base[-1]) - base[:-1][word]
    text = np.empty(len(word), dtype=np.int64)
    inner = (at > 0) & (at < size[word] - 1)
    text[at == 0], text[at == size[word] - 1] = START, END
    text[inner] = data[starts[word[inner]] + at[inner] - 1]
    last = np.flatnonzero(at > 0)
    key = np.minimum(at[last] + 1, ORDER) << 56
    for k in range(ORDER):
        reach = at[last] >= k
        key[reach] |= text[last[reach] - k] << (8 * k)
    return word[last], key


def order_of(key: np.ndarray) -> np.ndarray:
    return key >> 56


def context(key: np.ndarray, order: int) -> np.ndarray:
    return ((key & ((1 << 56) - 1)) >> 8) | (np.int64(order - 1) << 56)


def suffix(key: np.ndarray, order: int) -> np.ndarray:
    return (key & ((1 << (8 * (order - 1))) - 1)) | (np.int64(order - 1) << 56)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def bucket_of(windows: np.ndarray, buckets: int) -> np.ndarray:
    """By the three bytes before the last; windows without them, of orders that are pooled, have bucket -1."""
    own = (mix(((windows >> 8) & 0xFFFFFF).astype(U64)) % U64(buckets)).astype(np.int64)
    return np.where(order_of(windows) > POOLED, own, -1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of the rows of counts (2 x n)."""
    distinct, inv = np.unique(keys, return_inverse=True)
    return distinct, np.stack([np.bincount(inv, c, minlength=len(distinct)).astype(np.int64) for c in counts]) if len(keys) else counts


def discount(once: float, twice: float) -> float:
    return min(0.95, max(0.3, once / max(1, once + 2 * twice)))


def order_counts(windows: np.ndarray, counts: np.ndarray, top: int = ORDER, least: int = POOLED + 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and counts (2 x n) of the n-grams of each order from top down to least: the longest, and those from ^ on, by
    their count; others by distinct left neighbours.
    """
    found, longer = {}, (np.zeros(0, np.int64), np.zeros((2, 0), np.int64))
    for m in range(top, least - 1, -1):
        own = order_of(windows) == m
        found[m] = longer = summed(np.concatenate((windows[own], suffix(longer[0], m + 1))), np.concatenate((counts[:, own], (longer[1] > 0).astype(np.int64)), axis=1))
    return found


def pooled_model(windows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of order POOLED and their probability, the classes' counts added; windows has what counts for orders up to it."""
    orders = order_counts(windows, counts, POOLED, 1)
    below_keys, below = np.zeros(0, np.int64), np.zeros(0)
    for m in range(1, POOLED + 1):
        own, both = orders[m][0], orders[m][1].sum(axis=0).astype(float)
        if m == 1:
            p = (both + 1) / (both.sum() + 256)
        elif len(own):
            _, inv = np.unique(context(own, m), return_inverse=True)
            d = discount(np.count_nonzero(both == 1), np.count_nonzero(both == 2))
            sums, kinds = np.bincount(inv, both), np.bincount(inv)
            i, met = find(below_keys, suffix(own, m))
            p = np.maximum(both - d, 0) / sums[inv] + d * kinds[inv] / sums[inv] * np.where(met, below[i] if len(below) else 0, 1 / 256)
        else:
            p = both
        below_keys, below = own, p
    return below_keys, below


class BucketModel:
    """Of one bucket and each order: sorted keys with their log-likelihood ratio, contexts with the ratio of their backoff weights."""

    def __init__(self, windows: np.ndarray, counts: np.ndarray, discounts: dict, pooled: tuple[np.ndarray, np.ndarray]):
        orders = order_counts(windows, counts)
        self.orders = {}
        low_keys, low = pooled[0], np.stack((pooled[1], pooled[1]))
        for m in range(POOLED + 1, ORDER + 1):
            own, mine = orders[m]
            ctx, inv = np.unique(context(own, m), return_inverse=True)
            i, met = find(low_keys, suffix(own, m))
            lower = np.full((2, len(own)), 1e-6)
            lower[:, met] = low[:, i[met]]
            p, gamma = np.empty((2, len(own))), np.ones((2, len(ctx)))
            for k in (0, 1):
                d = discounts[m, k]
                sums, kinds = np.bincount(inv, mine[k], minlength=len(ctx)), np.bincount(inv, mine[k] > 0, minlength=len(ctx))
                some = sums > 0
                gamma[k, some] = np.maximum(d * kinds[some] / sums[some], 1e-4)
                p[k] = np.where(sums[inv] > 0, np.maximum(mine[k] - d, 0) / np.maximum(sums[inv], 1), 0) + gamma[k][inv] * lower[k]
            ratio = np.log(np.maximum(p[1], 1e-12)) - np.log(np.maximum(p[0], 1e-12))
            self.orders[m] = (own, ratio, ctx, np.log(gamma[1]) - np.log(gamma[0]))
            low_keys, low = own, p

    def values(self, windows: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of the last byte of each window: at the longest order known, after the backoffs above it."""
        total, open_ = np.zeros(len(windows)), np.ones(len(windows), dtype=bool)
        for m in range(ORDER, POOLED, -1):
            here = np.flatnonzero(open_ & (order_of(windows) >= m))
            key = (windows[here] & ((1 << (8 * m)) - 1)) | (np.int64(m) << 56)
            keys, ratio, contexts, backoff = self.orders[m]
            i, met = find(keys, key)
            total[here[met]] += ratio[i[met]]
            open_[here[met]] = False
            here, key = here[~met], key[~met]
            j, known = find(contexts, context(key, m))
            total[here[known]] += backoff[j[known]]
        return total


@dataclass
class Counts:
    """What both models are built from: stored windows by bucket, discounts, shared orders, and labelled rows by class."""

    windows: DataFrame
    buckets: int
    discounts: dict
    pooled: tuple[np.ndarray, np.ndarray]
    clean: int
    toxic: int
    told_apart: bool


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def binary(*arrays: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in arrays]


def windows_by_bucket(rows: DataFrame, buckets: int, shares: int) -> DataFrame:
    """(bucket, windows, c0, c1): blocks of the windows of rows (text, toxic), by class the distinct words of rows that have them.

    With several shares, the blocks of a bucket are added up in so many groups first; a window's share follows from the window.
    """

    def run(batches):
        held, n = [], 0

        def flush():
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held], axis=1))
            share = ((mix(keys.astype(U64)) >> U64(32)) % U64(shares)).astype(np.int64)
            parts = list(parts_of(bucket_of(keys, buckets) * shares + share))
            columns = [[x[p].tobytes() for _, p in parts] for x in (keys, *counts.astype(np.uint32))]
            places = [pa.array([b // shares for b, _ in parts], pa.int32()), pa.array([b % shares for b, _ in parts], pa.int32())]
            return pa.RecordBatch.from_arrays([*places, *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "share", "windows", "c0", "c1"])

        for batch in by_bytes(batches, "text", PIECE):
            label = np.asarray(batch.column(1)).astype(np.int64) > 0
            data, row, start, end, h = distinct_words(batch.column(0))
            if not len(h):
                continue
            _, one, inv = np.unique(h, return_index=True, return_inverse=True)
            c1 = np.bincount(inv, label[row], minlength=len(one)).astype(np.int64)
            word, key = windows_of(data, start[one], end[one])
            both = np.stack((np.bincount(inv, minlength=len(one)) - c1, c1))
            held.append(summed(key, both[:, word]))
            n += len(held[-1][0])
            if n >= 5 * BUCKET_WINDOWS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    found = rows.select("text", "toxic").mapInArrow(run, "bucket int, share int, windows binary, c0 binary, c1 binary")
    return found if shares == 1 else found.groupBy("bucket", "share").applyInArrow(share_added_up, f"bucket int, {PACKED}")


def unpacked(table: pa.Table, *kinds: tuple[str, type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[c]] or [np.zeros(0, kind)]) for c, kind in kinds]


#: Once- and twice-counts of each order and class, in this order.
STATS = [(m, k, seen) for m in range(POOLED + 1, ORDER + 1) for k in (0, 1) for seen in (1, 2)]


PACKED = "windows binary, c0 binary, c1 binary"


def windows_added_up(group: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    keys, c0, c1 = unpacked(group, ("windows", np.int64), ("c0", kind), ("c1", kind))
    return summed(keys, np.stack((c0, c1)).astype(np.int64))


def share_added_up(group: pa.Table) -> pa.Table:
    """One share's windows, each once."""
    keys, counts = windows_added_up(group, np.uint32)
    return pa.table({"bucket": group["bucket"][:1], **{c: pa.array([x], pa.binary()) for c, x in zip(("windows", "c0", "c1"), binary(keys, *counts))}})


def added_up(group: pa.Table, kind: type) -> pa.Table:
    """One bucket's windows with their counts added, its counts of counts, and its part of the counts of order POOLED."""
    keys, counts = windows_added_up(group, kind)
    bucket = group["bucket"][0].as_py()
    if bucket < 0:
        stats, (low, low_counts) = [0] * len(STATS), (keys, counts)
    else:
        orders = order_counts(keys, counts)
        stats = [int(np.count_nonzero(orders[m][1][k] == seen)) for m, k, seen in STATS]
        low, low_counts = summed(suffix(orders[POOLED + 1][0], POOLED + 1), (orders[POOLED + 1][1] > 0).astype(np.int64))
    packed = binary(keys, *counts)
    low_rows = [{"key": int(a), "c0": int(b), "c1": int(c)} for a, b, c in zip(low, *low_counts)]
    return pa.table({"bucket": pa.array([bucket], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip(("windows", "c0", "c1"), packed)}, "stats": pa.array([stats], pa.list_(pa.int64())), "low": pa.array([low_rows], LOW)})


LOW = pa.list_(pa.struct([("key", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64())]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Counts, DataFrame]:
    """Counts of the labelled rows whose crc32(id) mod 5 is 1 to 3, and the labels (label_id, toxic) of those where it is not 0."""
    marks = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")).filter("label_id is not null and toxic is not null")
    marks = marks.filter(remainder(F.col("label_id")) != 0).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    found = {(r["fit"], r["toxic"] > 0): r["n"] for r in ids.join(marks, F.col("id") == F.col("label_id")).groupBy((remainder(F.col("id")) == 4).alias("fit"), "toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = ([found.get((part, label), 0) for part in (False, True)] for label in (False, True))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    buckets = max(1, -(-size // (100 * BUCKET_WINDOWS)))  # over a window for each 100 bytes is not met
    counted = marks.filter(remainder(F.col("label_id")) != 4)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id is not null and text is not null").filter(~remainder(F.col("id")).isin(0, 4))
    rows = rows.join(counted, F.col("id") == F.col("label_id")).select("text", "toxic")
    low = "array<struct<key: bigint, c0: bigint, c1: bigint>>"
    # a task hands its counts on after some five pieces of text at the earliest, and when it ends
    blocks = docs.sparkSession.sparkContext.defaultParallelism + size // (5 * PIECE)
    shares = -(-blocks // ASKING)
    kind = np.uint32 if shares == 1 else np.int64  # one task's counts fit 32 bits
    counted = windows_by_bucket(rows, buckets, shares)
    windows = stored(counted.groupBy("bucket").applyInArrow(lambda group: added_up(group, kind), f"bucket int, {PACKED}, stats array<bigint>, low {low}"))
    release(docs.sparkSession)
    stats = windows.agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(len(STATS)))).first()
    seen = {s: stats[i] for i, s in enumerate(STATS)}
    discounts = {(m, k): discount(seen[m, k, 1], seen[m, k, 2]) for m in range(POOLED + 1, ORDER + 1) for k in (0, 1)}
    shared = windows.select(F.explode("low").alias("x")).groupBy("x.key").agg(F.sum("x.c0").alias("c0"), F.sum("x.c1").alias("c1")).toArrow()
    pooled = pooled_model(np.asarray(shared["key"]), np.stack([np.asarray(shared[c]) for c in ("c0", "c1")]))
    return Counts(windows, buckets, discounts, pooled, sum(clean), sum(toxic), clean[0] > 0 and toxic[0] > 0), marks


class WordCounts:
    """Distinct words of what a task has read, and in how many rows each stands."""

    def __init__(self):
        self.h, self.slot, self.n, self.words = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, data, starts, ends, h) -> None:
        distinct, one, n = np.unique(h, return_index=True, return_counts=True)
        at, old = find(self.h, distinct)
        self.n[self.slot[at[old]]] += n[old]
        fresh = one[~old]
        both, slots = np.concatenate((self.h, distinct[~old])), np.concatenate((self.slot, len(self.words) + np.arange(len(fresh))))
        order = np.argsort(both, kind="stable")
        self.h, self.slot, self.n = both[order], slots[order], np.concatenate((self.n, n[~old]))
        self.words += [data[s:e].tobytes() for s, e in zip(starts[fresh].tolist(), ends[fresh].tolist())]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(block, words, sizes, n): blocks of the distinct words of docs (text), joined, their lengths, and rows that have them."""

    def count(batches):
        held = WordCounts()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held.words, pa.binary()), pa.array(held.n)], names=["word", "n"])

        for batch in by_bytes(batches, "text", PIECE):
            data, _, start, end, h = distinct_words(batch.column(0))
            held.add(data, start, end, h)
            if len(held.words) >= 2 * BLOCK_WORDS:
                yield flush()
                held = WordCounts()
        if held.words:
            yield flush()

    def pack(batches):
        held, size, block = [], 0, TaskContext.get().partitionId() << 33

        def flush():
            data, offsets = string_bytes(pa.chunked_array([b.column(0) for b in held]))
            n = np.concatenate([np.asarray(b.column(1)) for b in held])
            return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x], pa.binary()) for x in binary(data, np.diff(offsets), n))], names=["block", "words", "sizes", "n"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_WORDS:
                yield flush()
                held, size, block = [], 0, block + 1
        if size:
            yield flush()

    words = docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(pack, "block bigint, words binary, sizes binary, n binary")


def block_windows(words: bytes, sizes: bytes):
    """Bytes, offsets, (word, window) of every place, and the distinct windows of a block of words."""
    data, ends = np.frombuffer(words, np.uint8), np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64))))
    word, key = windows_of(data, ends[:-1], ends[1:])
    wide = order_of(key) > POOLED  # the others have the same likelihood in both classes
    word, key = word[wide], key[wide]
    return data, ends, word, key, np.unique(key)


def word_values(blocks: DataFrame, counts: Counts) -> DataFrame:
    """(word, n, value) of the words of stored vocabulary blocks."""
    spark, buckets = blocks.sparkSession, counts.buckets
    copies = max(1, -(-blocks.count() // ASKING))
    shared = spark.sparkContext.broadcast((counts.discounts, counts.pooled))

    def ask(batches):
        for batch in batches:
            for block, words, sizes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                windows = block_windows(words, sizes)[-1]
                parts = [(b, windows[p]) for b, p in parts_of(bucket_of(windows, buckets))]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([block % copies] * len(parts), pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([w.tobytes() for _, w in parts], pa.binary())], names=["bucket", "copy", "block", "windows"])

    def answer(have: pa.Table, asked: pa.Table) -> pa.Table:
        keys, c0, c1 = unpacked(have, ("windows", np.int64), ("c0", np.int64), ("c1", np.int64))
        model = BucketModel(keys, np.stack((c0, c1)), *shared.value)
        values = [model.values(np.frombuffer(x.as_py(), np.int64)).tobytes() for x in asked["windows"]]
        return pa.table({"block": asked["block"], "bucket": asked["bucket"], "values": pa.array(values, pa.binary())})

    def give(own: pa.Table, values: pa.Table) -> pa.Table:
        data, ends, word, key, windows = block_windows(own["words"][0].as_py(), own["sizes"][0].as_py())
        where, value = bucket_of(windows, buckets), np.zeros(len(windows))
        for b, v in zip(values["bucket"].to_pylist(), values["values"]):
            value[where == b] = np.frombuffer(v.as_py(), np.float64)
        sizes = np.diff(ends)
        total = np.bincount(word, value[np.searchsorted(windows, key)], minlength=len(sizes)) / (sizes + 1)
        words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        return pa.table({"word": words, "n": pa.array(np.frombuffer(own["n"][0].as_py(), np.int64)), "value": pa.array(total)})

    asked = blocks.select("block", "words", "sizes").mapInArrow(ask, "bucket int, copy int, block bigint, windows binary")
    have = counts.windows.filter("bucket >= 0").select("bucket", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "windows", "c0", "c1")
    values = have.groupBy("bucket", "copy").cogroup(asked.groupBy("bucket", "copy")).applyInArrow(answer, "block bigint, bucket int, values binary")
    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(give, "word binary, n bigint, value double")


def evidence(texts: DataFrame, counts: Counts) -> DataFrame:
    """(key, f) of every distinct text of texts (key, text): the TOP highest values of its expressions and its mean value."""
    spark = texts.sparkSession
    blocks = stored(vocabulary(texts))
    values = stored(word_values(blocks, counts))
    discard(blocks)
    common = values.orderBy(F.desc("n"), "word").limit(MOST_WORDS).select("word", "value").toArrow()
    data, offsets = string_bytes(common["word"])
    h = span_hash(prefix_hash(data), offsets[:-1], offsets[1:])
    order = np.argsort(h)
    held = spark.sparkContext.broadcast((h[order], np.asarray(common["value"])[order]))

    def run(batches: Iterator[pa.RecordBatch]):
        known, value = held.value
        seen: set[bytes] = set()
        for batch in by_bytes(batches, "text", PIECE):
            keys = batch.column(0).to_pylist()
            fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]  # equal texts once for each task
            if len(seen) > 100_000:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64()))
            data, row, start, end, h = distinct_words(batch.column(1))
            at, met = find(known, h)
            own = np.where(met, value[at] if len(value) else 0.0, 0.0)
            n = batch.num_rows
            order = np.lexsort((-own[met], row[met]))
            best = own[met][order]
            first = np.searchsorted(row[met], np.arange(n + 1))
            top = [best[a : min(a + TOP, b)].tolist() for a, b in zip(first, first[1:])]
            rare = pa.array([data[s:e].tobytes() for s, e in zip(start[~met].tolist(), end[~met].tolist())], pa.binary())
            cut = np.searchsorted(row[~met], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(top, pa.list_(pa.float64())), pa.array(np.bincount(row, own, minlength=n)), pa.array(np.bincount(row, minlength=n)), pa.ListArray.from_arrays(pa.array(cut), rare)],
                names=["key", "top", "total", "words", "rare"],
            )

    parts = stored(texts.select("key", "text").mapInArrow(run, "key binary, top array<double>, total double, words bigint, rare array<binary>"))
    pairs = parts.select("key", F.explode("rare").alias("word")).join(values.select("word", "value"), "word")
    more = pairs.groupBy("key").agg(F.collect_set(F.struct("word", "value")).alias("more"))  # a set: tasks that met equal texts send the same
    whole = parts.groupBy("key").agg(F.first("top").alias("top"), F.first("total").alias("total"), F.first("words").alias("words")).join(more, "key", "left")
    added = F.coalesce("more.value", F.array().cast("array<double>"))
    top = F.slice(F.sort_array(F.concat("top", added), asc=False), 1, TOP)
    # in the order of the values, so that the sum does not depend on the order of arrival
    total = F.aggregate(F.array_sort(added), F.col("total"), lambda a, x: a + x)
    f = F.concat(F.transform(F.sequence(F.lit(0), F.lit(TOP - 1)), lambda i: F.coalesce(F.get(top, i), F.lit(0.0))), F.array(total / F.greatest("words", F.lit(1))))
    out = stored(whole.select("key", f.alias("f")))
    discard(parts, values)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Ridge logistic weights, the intercept last; the rarer class weighs more, by the root of the ratio."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, np.sqrt((1 - y).sum() / y.sum()), 1.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * len(x) * np.append(w[:-1], 0)
        step = np.linalg.solve((x.T * (share * p * (1 - p) + 1e-6)) @ x + ridge * len(x) * np.diag([1] * (len(w) - 1) + [1e-6]), g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def prior_weights(clean: int, toxic: int, told_apart: bool) -> np.ndarray:
    """Logistic weights without rows to fit them on, from the labelled rows of each class; told_apart: counts have both."""
    odds = float(np.log((toxic + 0.5) / (clean + 0.5)))
    if not told_apart:
        return np.append(np.zeros(TOP + 1), min(odds, -1.0))
    return np.array([ORDER / TOP] * TOP + [0.0, min(odds, 0.0)])


def score_documents(docs: DataFrame, counts: Counts, marks: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """struct `doc` (all columns), evidence f, score (0 to 1; higher: label 1 likelier), predicted (1 from 0.5 on).

    counts and marks are what fit gives. At most fit_rows labelled rows, by hash of the id, fit the logistic function.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.unhex(F.md5(text))
    found = evidence(docs.select(key.alias("key"), text.alias("text")), counts)
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("key")).filter(remainder(F.col("id")) == 4)
    chosen = ids.join(marks, F.col("id") == F.col("label_id")).join(found, "key")
    sample = chosen.orderBy(F.xxhash64("id"), "id", "key").limit(fit_rows).select("toxic", "f").toArrow()
    release(docs.sparkSession)
    y = (np.asarray(sample["toxic"]) > 0).astype(float)
    x = np.asarray(pa.compute.list_flatten(sample["f"])).reshape(len(y), TOP + 1)
    weights = fit_logistic(x, y) if counts.told_apart and 0 < y.sum() < len(y) else prior_weights(counts.clean, counts.toxic, counts.told_apart)
    z = F.lit(float(weights[-1]))
    for k in range(TOP + 1):
        z = z + F.col("f")[k] * float(weights[k])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"))
    return rows.join(found, "key").select("doc", "f").withColumn("score", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Benchmark decontamination: windows of benchmark words looked up in a broadcast hash set, then verified.

A window is `width` consecutive words of an item; an item with fewer words, but not none, is one window of them all.
A document word inside any occurrence of a window is hit. Null and empty texts have no words. Repeated rows are judged
one by one. Items that repeat an id count as one item; a null item id is written as "null". An empty benchmark hits
nothing, an empty table of documents stays empty, and columns of any name come out as they were.

A benchmark of more than BLOCK_BYTES is scanned for block by block, with one block's index in memory at a time: documents are
stored once, each block's findings are stored, and its broadcast is destroyed before the next. Long items are cut into pieces
that overlap by a window less a word, so that no block outgrows its size for one item (an item of fewer words than a window
stays whole).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import discard, stored
from cairn.llm.textbytes import ALNUM, LOWER, U64, by_bytes, prefix_hash, span_hash, string_bytes, window_hash, words_of

#: Benchmark text broadcast at once; its index takes about ten times that (32 bytes a word). A larger benchmark is dealt into
#: blocks of about this size, scanned one by one.
BLOCK_BYTES = 4_000_000
BLOOM_BITS = 22


def hashed_words(column: pa.Array):
    data, offsets = string_bytes(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, ALNUM)
    return data, starts, ends, first, span_hash(prefix_hash(data), starts, ends)


def window_index(items: list, width: int) -> dict:
    """The items' bytes and words, and by window length: a bit table of window hashes, the hashes in order, and where each starts."""
    names = [item for item, _ in items]
    data, starts, ends, first, h = hashed_words(pa.array([text or "" for _, text in items], pa.string()))
    count = np.diff(first)
    item = np.repeat(np.arange(len(names)), count)
    place = np.arange(len(h)) - np.repeat(first[:-1], count)
    length = np.minimum(count, width)[item]
    by_length = {}
    for n in np.unique(length).tolist():
        at = np.flatnonzero((length == n) & (place + n <= count[item]))
        hashes = window_hash(h, n)[at]
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
        bits[hashes >> U64(64 - BLOOM_BITS)] = True
        by_length[n] = (np.packbits(bits), hashes[order], at[order])
    return {"names": names, "item": item, "words": (data, starts, ends), "by_length": by_length}


def window_bytes(words: tuple[np.ndarray, np.ndarray, np.ndarray], at: int, n: int) -> bytes:
    data, starts, ends = words
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[at : at + n], ends[at : at + n]))


def find_hits(column: pa.Array, index: dict):
    """For each row: words, hit words, items, and hit spans as byte positions of the row's text."""
    data, starts, ends, first, h = hashed_words(column)
    offsets = string_bytes(column)[1]
    rows = len(column)
    row_of = np.repeat(np.arange(rows), np.diff(first))
    change = np.zeros(len(h) + 1, dtype=np.int64)
    items: dict[int, set] = {}
    for n, (bits, known, place) in index["by_length"].items():
        w = window_hash(h, n)
        if not len(w):
            continue
        at = np.flatnonzero(np.unpackbits(bits).view(bool)[w >> U64(64 - BLOOM_BITS)] & (row_of[: len(w)] == row_of[n - 1 :]))
        low, high = np.searchsorted(known, w[at]), np.searchsorted(known, w[at], side="right")
        for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
            own = window_bytes((data, starts, ends), i, n)
            owners = {index["names"][index["item"][j]] for j in place[a:b].tolist() if window_bytes(index["words"], j, n) == own}
            if owners:
                change[i] += 1
                change[i + n] -= 1
                items.setdefault(int(row_of[i]), set()).update(owners)
    hit = np.cumsum(change[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[first[1:]] - total[first[:-1]]
    spans: list[list] = [[] for _ in range(rows)]
    for r in items:
        inside = hit[first[r] : first[r + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
        for a, b in zip(edge[::2] + first[r], edge[1::2] + first[r]):
            spans[r].append({"first": int(a - first[r]), "last": int(b - first[r]), "start": int(starts[a] - offsets[r]), "end": int(ends[b - 1] - offsets[r])})
    return np.diff(first), n_hit, [sorted(items.get(r, ())) for r in range(rows)], spans


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words bigint, item_ids array<string>, spans array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>"


def scan(docs: DataFrame, index, text_col: str) -> DataFrame:
    """docs and the columns of FOUND; index is a broadcast of window_index()."""

    def run(batches):
        for batch in by_bytes(batches, text_col):
            n_words, _, items, spans = find_hits(batch.column(batch.schema.get_field_index(text_col)), index.value)
            columns = [*batch.columns, pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPAN)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_words", "item_ids", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {FOUND}")


def cut_items(items: DataFrame, width: int) -> DataFrame:
    """items (item, text), those of more than a quarter of a block in pieces that together have the same windows."""
    most = max(1, BLOCK_BYTES // 4)

    def run(batches):
        for batch in batches:
            names, pieces = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                starts, ends, _ = words_of(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), ALNUM)
                windows = len(starts) - width + 1
                if len(raw) <= most or windows < 2:
                    names.append(name)
                    pieces.append(text)
                    continue
                first = np.flatnonzero(np.diff(starts[:windows] // most, prepend=-1))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), windows]):
                    names.append(name)
                    pieces.append(raw[starts[a] : ends[b + width - 2]].decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.string())], names=["item", "text"])

    return items.mapInArrow(run, "item string, text string")


def scan_in_blocks(rows: DataFrame, items: DataFrame, n: int, width: int) -> DataFrame:
    """What scan gives for rows (doc, text) and items (item, text), the items dealt into n blocks."""
    spark = rows.sparkSession
    rows = stored(rows.select(F.monotonically_increasing_id().alias("place"), "doc", "text"))
    pieces = cut_items(items, width).distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    pieces = stored(pieces.repartition("block").sortWithinPartitions("block"))
    found = []
    for k in range(n):
        block = [(r["item"], r["text"]) for r in pieces.filter(F.col("block") == k).collect()]
        if found and not block:
            continue
        index = spark.sparkContext.broadcast(window_index(block, width))
        seen = scan(rows.select("place", "text"), index, "text").drop("text")
        found.append(stored(seen.filter(F.size("spans") > 0) if found else seen))  # the first has the words of every row
        index.destroy()
    discard(pieces)
    every = spark.read.schema(found[0].schema).parquet(*(t.stored_at for t in found))
    joined = every.groupBy("place").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), merge_spans(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    return rows.join(joined, "place").select("doc", "text", "n_words", "item_ids", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, action: str = "flag", width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Find benchmark windows in docs.

    action "flag" returns struct `doc` (all columns of docs but the text) with n_words, n_hit, item_ids, spans;
    "documents" returns docs without the rows that have a hit; "spans" returns docs with the hit spans cut from the
    text, the characters between neighbouring hit words included.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if action != "flag" or c != text_col]
    rows = docs.select(F.struct(*others).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= BLOCK_BYTES:
        rows = scan(rows, docs.sparkSession.sparkContext.broadcast(window_index([(r["item"], r["text"]) for r in items.collect()], width)), "text")
    else:
        rows = scan_in_blocks(rows, items, 2 * -(-total // BLOCK_BYTES), width)
    if action == "flag":
        n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
        return rows.select("doc", "n_words", n_hit.alias("n_hit"), F.array_sort("item_ids").alias("item_ids"), "spans")
    if action == "documents":
        return rows.filter(F.size("spans") == 0).select("doc.*")
    binary = F.encode("text", "utf-8")
    kept = F.aggregate(
        "spans",
        F.struct(F.lit(b"").alias("kept"), F.lit(1).cast("bigint").alias("at")),
        lambda a, s: F.struct(F.concat(a["kept"], F.substring(binary, a["at"], s["start"] + 1 - a["at"])).alias("kept"), (s["end"] + 1).alias("at")),
        lambda a: F.decode(F.concat(a["kept"], F.substring(binary, a["at"], F.length(binary))), "utf-8"),
    )
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(kept)
    return rows.select(F.col("doc").withField(f"`{text_col}`", text).alias("doc")).select("doc.*")


def merge_spans(spans):
    """Unite overlapping spans."""

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    empty = F.array().cast("array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>")
    return F.when(F.size(spans) <= 1, spans).otherwise(F.aggregate(F.array_sort(spans), empty, add))

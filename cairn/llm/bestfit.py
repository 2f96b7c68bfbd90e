"""Best-fit packing of documents into token sequences, large documents matched first.

Texts become ids of a public word-level BPE (its file is a parameter and is sent to the executors) and the end id. Only
documents longer than the width are cut, into pieces of the width; the last piece may be shorter.

What is packed where depends on lengths alone, so the whole table is packed as one: Spark counts the pieces of each length,
the plan is made over those at most `width` counts, and a piece finds its place by its number among the pieces of its
length. Large pieces, above a third of the width, stand in a sequence alone or in pairs: from the longest down, each takes
the longest large partner that still fits. Smaller ones, from the longest down, go where the least room that holds them is
left; equal lengths are placed together, which gives what placing them one by one gives.

A task counts the pieces of each length as it cuts them, and what other tasks hold of a length is summed by a window over
counts, so no length (empty texts may be a third of all rows) meets in one task.

Null and empty texts are the end id alone. Repeated rows and null ids are documents of their own. An empty table gives no
rows. Other columns are not looked at. Strings of special tokens in a text give the special ids, as in the library.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.shared import stored
from cairn.llm.textbytes import NOT_SPACE, by_bytes, string_bytes, words_of

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LETTER, POINT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
POINT[list(b",.;:!?")] = True
#: A control character that stands between chunks that are encoded together.
MARK = "\x01"
#: Fixed value: how the vocabulary writes tokens at the end of a word.
WORD_END = "</w>"


def chunks_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' chunks, without the white space around them, and the first chunk of each row (len+1).

    Chunks end at white space, and between an ASCII letter and a point: there the vocabulary's split pattern always parts,
    and neither its normalisation nor its special tokens reach across. So a text's ids are those of its chunks.
    """
    data, offsets = string_bytes(column)
    starts, _, _ = words_of(data, offsets, NOT_SPACE)
    cut = np.zeros(len(data), dtype=bool)
    cut[starts] = True
    cut[1:] |= LETTER[data[:-1]] & POINT[data[1:]]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True  # a row's first byte, which may be white space
    keep = NOT_SPACE[data]
    heads = np.flatnonzero(cut[keep])
    kept = data[keep]
    before = np.concatenate(([0], np.cumsum(cut & keep)))
    edges = np.append(heads, len(kept)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(edges), pa.py_buffer(kept)]), before[offsets]


class ChunkEncoder:
    """Ids of texts; a chunk that was met before, byte for byte, is looked up."""

    def __init__(self, path: str, most_known: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.most_known = most_known
        self.slots: dict[bytes, int] = {}
        self.starts, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def keep_only(self, words: list[bytes]) -> None:
        """Forget all chunks but these."""
        known = [w for w in words if w in self.slots]
        slot = np.fromiter((self.slots[w] for w in known), np.int64, len(known))
        size = self.starts[slot + 1] - self.starts[slot]
        starts = np.concatenate(([0], np.cumsum(size)))
        self.pool = self.pool[np.repeat(self.starts[slot] - starts[:-1], size) + np.arange(int(starts[-1]))]
        self.slots, self.starts = dict(zip(known, range(len(known)))), starts

    def encode_new(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of each chunk. Many are encoded as one text: words of letters alone, and others with the mark between them."""
        texts, out = [c.decode("utf-8", "replace") for c in chunks], [None] * len(chunks)

        def together(which: list[int], gap: str) -> None:
            for a in range(0, len(which), 512):
                some = which[a : a + 512]
                ids = np.array(self.tokenizer.encode(gap.join([texts[i] for i in some]), add_special_tokens=False).ids, dtype=np.int32)
                if gap == " ":  # a word of letters ends with its only end of a word
                    ends = np.flatnonzero(self.ends_word[ids]) + 1
                    starts = np.append(0, ends[:-1])
                else:
                    ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                    starts = np.append(0, ends[:-1] + 1)
                if len(ends) == len(some):
                    for i, start, end in zip(some, starts.tolist(), ends.tolist()):
                        out[i] = ids[start:end]

        together([i for i, t in enumerate(texts) if t.isalpha()], " ")
        if self.mark is not None:
            together([i for i, t in enumerate(texts) if out[i] is None and MARK not in t], f" {MARK} ")
        return [np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.int32) if x is None else x for i, x in enumerate(out)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, the end id after each row, and len+1 offsets."""
        chunks, first = chunks_of(column)
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slots) > self.most_known:
            self.keep_only(words)
        slots = self.slots
        new = [w for w in words if w not in slots]
        fresh = self.encode_new(new)
        sizes = np.array([len(x) for x in fresh], dtype=np.int64)
        slots.update(zip(new, range(len(self.starts) - 1, len(self.starts) - 1 + len(new))))
        self.pool = np.concatenate([self.pool, *fresh]) if fresh else self.pool
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        slot = np.fromiter((slots[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        length = self.starts[slot + 1] - self.starts[slot]
        base = np.concatenate(([0], np.cumsum(length)))
        rows = np.repeat(np.arange(len(column)), np.diff(first))
        inside = np.arange(int(base[-1])) - np.repeat(base[:-1], length)
        ids = np.empty(int(base[-1]) + len(column), dtype=np.int32)
        ids[np.repeat(base[:-1] + rows, length) + inside] = self.pool[np.repeat(self.starts[slot], length) + inside]
        close = base[first[1:]] + np.arange(len(column))
        ids[close] = END_ID
        return ids, np.concatenate(([0], close + 1))


@lru_cache(2)
def encoder_of(path: str) -> ChunkEncoder:
    """The encoder of this Python worker, which later tasks use again."""
    return ChunkEncoder(path)


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, width: int) -> DataFrame:
    """(id, piece, start, length, ids, part, nth): nth numbers the task's pieces of a length."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches):
        encoder, part, seen = encoder_of(SparkFiles.get(name)), TaskContext.get().partitionId(), np.zeros(width + 1, np.int64)
        for batch in by_bytes(batches, "text", 4_000_000):
            ids, offsets = encoder.encode(batch.column(1))
            total = np.diff(offsets)
            pieces = -(-total // width)
            doc = np.repeat(np.arange(len(total)), pieces)
            nth_piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth_piece * width
            length = np.minimum(width, total[doc] - start)
            order = np.argsort(length, kind="stable")
            heads = np.flatnonzero(np.diff(length[order], prepend=-1))
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(doc)))) + seen[length[order]]
            seen += np.bincount(length, minlength=width + 1)
            edges = np.append(0, np.cumsum(length)).astype(np.int32) * 4
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<i4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(nth_piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), packed, pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                names=["id", "piece", "start", "length", "ids", "part", "nth"],
            )

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length int, ids binary, part int, nth bigint")


def plan_lengths(counts: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Where pieces go, by length: counts[n] pieces have length n.

    Rows are in the order of (length, first): the pieces of a length from number `first` on fill the sequences from
    `sequence` on, `each` pieces a sequence, from place `base` on. The rows depend on the width and on how many lengths
    occur, not on how many pieces there are. "sequences" is how many there are in all.
    """
    left, taken, rows, rooms, opened = counts.astype(np.int64).copy(), np.zeros(width + 1, np.int64), [], {}, 0

    def put(length: int, sequence: int, bins: int, each: int, room: int) -> None:
        rows.append((length, int(taken[length]), sequence, each, width - room))
        taken[length] += bins * each
        left[length] -= bins * each

    def open_bins(bins: int) -> int:
        nonlocal opened
        opened += bins
        return opened - bins

    third = width // 3
    large = [n for n in range(width, third, -1) if left[n]]
    for a in large:
        while left[a]:
            fits = np.flatnonzero(left[third + 1 : min(a, width - a) + 1]) + third + 1
            if len(fits) and fits[-1] == a and left[a] == 1:
                fits = fits[:-1]
            b = int(fits[-1]) if len(fits) else 0
            bins = int(left[a] if not b else left[a] // 2 if b == a else min(left[a], left[b]))
            at = open_bins(bins)
            if b == a:
                put(a, at, bins, 2, width)
            else:
                put(a, at, bins, 1, width)
                if b:
                    put(b, at, bins, 1, width - a)
            rooms.setdefault(width - a - b, []).append((at, bins))
    for n in range(third, 0, -1):
        if not left[n]:
            continue
        for room in sorted(r for r in rooms if r >= n):
            waiting, each = rooms.pop(room), room // n
            while waiting and left[n]:
                at, bins = waiting.pop()
                full = int(min(bins, left[n] // each))
                if full:
                    put(n, at, full, each, room)
                    rooms.setdefault(room - each * n, []).append((at, full))
                rest = int(left[n])
                if full < bins and rest:  # fewer pieces than the next sequence has room for
                    put(n, at + full, 1, rest, room)
                    rooms.setdefault(room - rest * n, []).append((at + full, 1))
                    full += 1
                if full < bins:
                    waiting.append((at + full, bins - full))
            if waiting:
                rooms.setdefault(room, []).extend(waiting)
            if not left[n]:
                break
        each = width // n
        for bins, some in ((int(left[n]) // each, each), (1, int(left[n]) % each)):
            if bins and some:
                at = open_bins(bins)
                put(n, at, bins, some, width)
                rooms.setdefault(width - some * n, []).append((at, bins))
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {name: table[:, k] for k, name in enumerate(("length", "first", "sequence", "each", "base"))} | {"sequences": np.array([opened])}


def pack_best_fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, width: int = 4096) -> DataFrame:
    """A row for each piece: id, piece, start (the document's ids before it), length, ids (little-endian unsigned 32-bit),
    sequence_id, offset (the place in the sequence, without gaps from 0).

    vocabulary is the driver's path of the tokenizer file; it is sent to the executors.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, id_col, text_col, str(vocabulary), width))
    held = pieces.groupBy("length", "part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = stored(held.select("length", "part", "held", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before")))
    counts = np.zeros(width + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("held").alias("n")).collect():  # at most a row for each length up to the width
        counts[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(plan_lengths(counts, width))

    def place(batches):
        p = plan.value
        span = np.int64(1) << 48
        keys = p["length"] * span + p["first"]
        for batch in batches:
            length, number = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "number"))
            row = np.searchsorted(keys, length * span + number, side="right") - 1
            rank = number - p["first"][row]
            sequence, offset = p["sequence"][row] + rank // p["each"][row], p["base"][row] + rank % p["each"][row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    numbered = pieces.join(held.drop("held"), ["length", "part"]).select("id", "piece", "start", "length", "ids", (F.col("before") + F.col("nth")).alias("number"))
    kind = numbered.schema["id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"id {kind}, piece int, start bigint, length int, ids binary, sequence_id bigint, offset bigint")


def sequences_of(packed: DataFrame) -> DataFrame:
    """A row for each sequence: n_tokens, ids and first tokens of its documents, cu_seqlens, input_ids.

    A sequence has at most as many pieces as the width, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "id", "start", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select(
        "sequence_id", F.aggregate("parts", F.lit(0), lambda n, p: n + p["length"]).alias("n_tokens"), F.col("parts.id").alias("doc_ids"), F.col("parts.start").alias("doc_offsets"),
        F.concat(F.col("parts.offset"), F.array(F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]))).alias("cu_seqlens"),
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("input_ids"),
    )


def write_sequences(packed: DataFrame, path: str) -> None:
    """Write the packed sequences as Parquet."""
    sequences_of(packed).write.parquet(path)

"""Token ids packed into fixed-width matrices by best-fit decreasing with a segment tree over free capacities.

Texts are encoded with a public byte-level BPE vocabulary (a rank file whose path is a parameter) and closed by the end
id. A document longer than the width is split into full rows and a rest, without loss; rests are packed by best fit
decreasing. Each row carries the padded ids, cumulative segment lengths, and positions that restart in every segment.

Packing needs no shuffle: a task packs what it reads in shards of `shard_tokens` tokens, so its memory is bounded and a
lost task is packed again alike from the same split of the input. pack_id numbers the rows of a task.

The rank file goes to the executors with the job, so only the driver needs its path. Ids of documents are whole numbers.

Null and empty texts are the end id alone. Repeated rows are packed one by one. An empty table gives no rows. Extra
columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.textbytes import U64, by_bytes, prefix_hash, span_hash, string_bytes

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that the vocabulary was made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
SCHEMA = "pack_id bigint, n_tokens int, doc_ids array<bigint>, doc_offsets array<bigint>, cu_seqlens array<int>, input_ids binary, position_ids binary"
LATIN = 0xC3  # first byte of U+00C0 to U+00FF, none of which is white space
LETTER, SEEN, POINT = (np.zeros(256, dtype=bool) for _ in range(3))
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
SEEN[0x21:0x7F] = True
POINT[list(b",.;:!?")] = True


class Encoder:
    """Encodes batches of texts; the ids of a chunk that was met before are looked up by hash, and its bytes are compared.

    Chunks end where the split pattern always parts, so they are encoded independently of each other: before a single
    space and around a single line feed that stand between visible characters, and between a letter and a point.
    """

    def __init__(self, ranks_path: str, most_known: int = 2_000_000):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most_known = most_known
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.starts, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.spelled, self.letters = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def chunks(self, column: pa.Array):
        data, offsets = string_bytes(column)
        cut = np.zeros(len(data), dtype=bool)
        if len(data) > 3:
            ends = SEEN[data]
            ends[1:] |= (data[:-1] == LATIN) & (data[1:] >= 0x80)  # the last byte of a Latin-1 letter
            begins = SEEN[data] | (data == LATIN)
            alone = ends[:-2] & begins[2:]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            alone[edges[edges < len(data) - 1] - 1] = False
            alone[edges[edges > 1] - 2] = False
            cut[1:-1] = alone & ((data[1:-1] == 32) | (data[1:-1] == 10))
            cut[2:] |= alone & (data[1:-1] == 10)
            cut[1:] |= LETTER[data[:-1]] & POINT[data[1:]]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        return data, starts, ends, np.searchsorted(starts, offsets)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, the end id after each row, and len+1 offsets."""
        data, starts, ends, first = self.chunks(column)
        h = span_hash(prefix_hash(data), starts, ends) + (ends - starts).astype(U64)
        distinct, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.most_known:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        raw = data.tobytes()
        fresh = [self.bpe.encode_ordinary(raw[s:e].decode("utf-8", "replace")) for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist())]
        sizes = np.array([len(x) for x in fresh], dtype=np.int64)
        slots = len(self.starts) - 1 + np.arange(len(fresh))
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(fresh), np.int32, int(sizes.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        sources = [raw[s:e] for s, e in zip(starts[one[new]].tolist(), ends[one[new]].tolist())]
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(sources), np.uint8)])
        self.spelled = np.concatenate([self.spelled, self.spelled[-1] + np.cumsum(np.fromiter(map(len, sources), np.int64, len(sources)))])
        keys = np.concatenate([self.keys, distinct[new]])
        order = np.argsort(keys)
        self.keys, self.slots = keys[order], np.concatenate([self.slots, slots])[order]
        slot = self.slots[np.searchsorted(self.keys, distinct)][back]
        if not self.spells(slot, data, starts, ends):
            return self.encode_plainly(column)
        length = self.starts[slot + 1] - self.starts[slot]
        base = np.concatenate(([0], np.cumsum(length)))
        ends_at = base[first[1:]]
        total = int(base[-1])
        ids = np.empty(total + len(column), dtype=np.int32)
        rows = np.repeat(np.arange(len(column)), np.diff(first))
        target = np.repeat(base[:-1] + rows, length) + np.arange(total) - np.repeat(base[:-1], length)
        ids[target] = self.pool[np.repeat(self.starts[slot], length) + np.arange(total) - np.repeat(base[:-1], length)]
        close = ends_at + np.arange(len(column))
        ids[close] = END_ID
        return ids, np.concatenate(([0], close + 1))


    def spells(self, slot: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether every chunk has the bytes of the known one that stands for it; chunks tile the data."""
        size = ends - starts
        if not np.array_equal(self.spelled[slot + 1] - self.spelled[slot], size):
            return False
        return np.array_equal(self.letters[np.repeat(self.spelled[slot] - starts, size) + np.arange(len(data))], data)

    def encode_plainly(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode, without look-ups: for batches in which different chunks have one hash."""
        found = [self.bpe.encode_ordinary(text or "") + [END_ID] for text in column.to_pylist()]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]) if len(found) else 0), np.concatenate(([0], ends))


@lru_cache(2)
def encoder_of(name: str) -> Encoder:
    """The encoder of this Python worker, which later tasks use again, from the rank file that Spark sent along."""
    return Encoder(SparkFiles.get(name))


class FreeCapacities:
    """Segment tree over free capacities 0..width: which of them some open bin has."""

    def __init__(self, width: int):
        self.leaves = 1 << (width + 1).bit_length()
        self.some = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        node = capacity + self.leaves
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, bin) of the least capacity that holds size; None if no open bin does."""
        node = size + self.leaves
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        which = self.bins[capacity].pop()
        while node and not (self.bins[capacity] if node >= self.leaves else self.some[2 * node] or self.some[2 * node + 1]):
            self.some[node] = 0
            node >>= 1
        return capacity, which


def best_fit_decreasing(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and start in it of every size (1..width), and the number of bins."""
    bins, starts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free, count = FreeCapacities(width), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = free.take(size)
        capacity, which = found if found else (width, count)
        count += found is None
        bins[i], starts[i] = which, width - capacity
        if capacity > size:
            free.add(capacity - size, which)
    return bins, starts, count


def pack_rows(ids: np.ndarray, offsets: np.ndarray, width: int, pad_id: int):
    """(matrix, used, piece order, document, offset in document, start in row, row) of packed documents."""
    length = np.diff(offsets)
    pieces = -(-length // width)
    doc = np.repeat(np.arange(len(length)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = nth * width
    size = np.minimum(width, length[doc] - at)
    row, start, count = best_fit_decreasing(size, width)
    order = np.lexsort((start, row))
    doc, at, size, row, start = (x[order] for x in (doc, at, size, row, start))
    matrix = np.full((count, width), pad_id, dtype=np.int32)
    position = np.zeros((count, width), dtype=np.int32)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    target = np.repeat(row * width + start, size) + inside
    matrix.reshape(-1)[target] = ids[np.repeat(offsets[doc] + at, size) + inside]
    position.reshape(-1)[target] = inside
    used = np.bincount(row, size, minlength=count).astype(np.int64)
    return matrix, position, used, doc, at, start, row


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, width: int = 2048, pad_id: int = END_ID, shard_tokens: int = 4_000_000) -> DataFrame:
    """Packed rows: pack_id, n_tokens, doc_ids, doc_offsets (first token of each segment in its document), cu_seqlens
    (0 .. n_tokens), input_ids and position_ids (width little-endian 32-bit integers; what follows n_tokens is padding).
    """

    docs.sparkSession.sparkContext.addFile(ranks_path)
    ranks_name = os.path.basename(ranks_path)

    def shard(ids, offsets, names, first_pack):
        matrix, position, used, doc, at, start, row = pack_rows(ids, offsets, width, pad_id)
        cuts = np.searchsorted(row, np.arange(len(matrix) + 1))
        for a in range(0, len(matrix), 1024):
            b = min(a + 1024, len(matrix))
            lo, hi = cuts[a], cuts[b]
            own = pa.array((cuts[a : b + 1] - lo).astype(np.int32))
            ends = np.insert(start[lo:hi], cuts[a + 1 : b + 1] - lo, used[a:b]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first_pack + np.arange(a, b)),
                    pa.array(used[a:b].astype(np.int32)),
                    pa.ListArray.from_arrays(own, names.take(pa.array(doc[lo:hi]))),
                    pa.ListArray.from_arrays(own, pa.array(at[lo:hi])),
                    pa.ListArray.from_arrays(pa.array((cuts[a : b + 1] - lo + np.arange(b - a + 1)).astype(np.int32)), pa.array(ends)),
                    pa.array([x.tobytes() for x in matrix[a:b]], pa.binary()),
                    pa.array([x.tobytes() for x in position[a:b]], pa.binary()),
                ],
                names=["pack_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "input_ids", "position_ids"],
            )

    def run(batches):
        encoder, held, n = encoder_of(ranks_name), [], 0
        pack = TaskContext.get().partitionId() << 33

        def flush():
            ids = np.concatenate([x for x, _, _ in held])
            lengths = np.concatenate([np.diff(o) for _, o, _ in held])
            return shard(ids, np.concatenate(([0], np.cumsum(lengths))), pa.concat_arrays([d for _, _, d in held]), pack)

        for batch in by_bytes(batches, "text"):
            ids, offsets = encoder.encode(batch.column(1))
            held.append((ids, offsets, batch.column(0)))
            n += len(ids)
            if n >= shard_tokens:
                for out in flush():
                    pack += out.num_rows
                    yield out
                held, n = [], 0
        if held:
            yield from flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def write_matrices(packs: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: a column of id rows, one of position rows, and the segment columns."""
    packs.write.parquet(path)

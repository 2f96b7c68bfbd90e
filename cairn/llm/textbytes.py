"""Vectorised helpers over the UTF-8 bytes of Arrow string columns, used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(32))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Hashes run over blocks of this many bytes, so the tables of powers stay small however long a text is.
STRIDE = 1 << 16


def _powers(base: U64) -> np.ndarray:
    """base**0 .. base**STRIDE modulo 2**64."""
    out = np.full(STRIDE + 1, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


POWERS, INVERSES = _powers(BASE), _powers(INVERSE)


def _strides(table: np.ndarray, blocks: int) -> np.ndarray:
    """table's base**(STRIDE * k) for each of the blocks."""
    out = np.full(blocks, table[STRIDE], dtype=U64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: polynomial hash of data[:i]; see span_hash."""
    h = np.zeros(len(data) + 1, dtype=U64)
    for k, far in enumerate(_strides(POWERS, -(-len(data) // STRIDE))):
        a, b = k * STRIDE, min((k + 1) * STRIDE, len(data))
        np.cumsum(BYTE_VALUE[data[a:b]] * POWERS[: b - a], out=h[a + 1 : b + 1])
        with np.errstate(over="ignore"):
            h[a + 1 : b + 1] *= far
        h[a + 1 : b + 1] += h[a]
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], which depends on those bytes only."""
    far = _strides(INVERSES, len(h) // STRIDE + 1)
    return mix((h[end] - h[start]) * INVERSES[start % STRIDE] * far[start // STRIDE])


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from every place."""
    n = max(0, len(h) - width)
    out = h[width : width + n] - h[:n]
    for k, far in enumerate(_strides(INVERSES, -(-n // STRIDE))):
        part = out[k * STRIDE : (k + 1) * STRIDE]
        part *= INVERSES[: len(part)] * far
    return mix(out)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and len+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has at most `most` bytes of the column, or one row."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        _, offsets = string_bytes(batch.column(i))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def ranges_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The range of each 64-bit key, by its highest bits."""
    return (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def parts_of(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places in order) of every value in where."""
    order = np.argsort(where, kind="stable")
    heads = np.flatnonzero(np.diff(where[order], prepend=np.iinfo(np.int64).min))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
        yield int(where[order[a]]), order[a:b]


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that do not cross rows: starts, ends, and the first word of each row (len+1)."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[1:] = is_word[data] if n else False
    here = inside[1:]
    begins = here & ~inside[:-1]
    heads = offsets[:-1][(offsets[:-1] < offsets[1:])]
    begins[heads] = here[heads]
    starts = np.flatnonzero(begins)
    stops = np.ones(n, dtype=bool)
    stops[:-1] = ~here[1:] | begins[1:]
    ends = np.flatnonzero(here & stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive word hashes; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, dtype=U64)
    for k in range(width):
        total *= BASE
        total += words[k : k + n]
    return mix(total + U64(width))


#: Word bytes of two tokenisations. Bytes from 0x80 on belong to characters outside ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

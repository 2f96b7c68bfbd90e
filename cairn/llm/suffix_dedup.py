"""Exact removal of repeated byte strings with suffix arrays.

A byte goes where a string of `length` bytes that covers it also starts earlier: in a document before, or earlier in the
same one. Strings are judged on the input and never cross documents.

1. Every string of `length` bytes holds one anchor: the `GRAM` bytes with the least hash in it, the first of them. Starts
   with one anchor are neighbours; the bytes that their strings cover are the anchor's stretch. Equal strings have equal
   anchors, so only anchors seen twice can hold repeats. Tasks send (anchor, stretch, place) keys in blocks of key ranges;
   one task for each range unites whole stretches that are equal. All but the first place of a stretch are removed.
2. Stretches that share an anchor with others but differ from them (the edges of what was copied) become text, dealt by
   anchor: equal strings have equal anchors, so they meet in one shard. A task sorts the suffixes of a shard by
   Larsson-Sadakane refinement, takes common prefixes after Kasai, and so finds the strings that start twice in its shard
   and where each starts first.
3. Anchors of more than `HOT_BYTES` of stretches are dealt over several shards, and these merge: the sorted string keys of a
   task's shards are merged by binary search and cut into ranges, and each range's lists are merged likewise, which finds
   the first start over all shards. No other shard sends keys.
4. Removed starts go back to the documents as intervals.

Strings of one document and shard are compared byte by byte (in the suffix array); across tasks and shards they are equal
where 64 bits of hash over all their bytes and 64 more over their first half agree (for a stretch: over its anchor and
all its bytes). Bytes are not compared again there.

Copies of one document weigh little: a task keeps one place for each stretch, and joins the others to intervals at once.
Null and empty texts lose nothing. Rows with repeated or null ids are documents of their own, ordered by id (null last)
and text. An empty table gives no rows. Extra columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import discard, keyed, release, stored
from cairn.llm.textbytes import U64, by_bytes, gram_hashes, mix, prefix_hash, ranges_of, span_hash, string_bytes

GRAM = 36
#: Keys of one range, which one task merges, and of what a task sends at once. Rows that are sent are as many as ranges times
#: sends, so both are large.
RANGE_KEYS, SENT_KEYS = 500_000, 500_000
MOST_BITS = 30
#: Bytes of text that a task hashes at once, and of one suffix array: few enough for a processor's cache.
BATCH_BYTES, SHARD_BYTES = 200_000, 200_000
#: Bytes of the stretches of an anchor above which they are dealt over several shards, and of the stretches of a task.
HOT_BYTES, TASK_BYTES = 250_000, 2_000_000


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, first start, last start, anchor hash, stretch hash) of the batch; starts count from the row's beginning."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    h = prefix_hash(data)
    gram = gram_hashes(h, GRAM)
    bits = U64(max(1, int(n).bit_length()))
    low = (gram >> bits << bits) | np.arange(len(gram), dtype=U64)  # the lesser hash, then the earlier place
    span, need = 1, length - GRAM + 1
    while 2 * span <= need:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if need > span:
        low = np.minimum(low[: len(low) - (need - span)], low[need - span :])
    anchor = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    inside = np.repeat(offsets[1:] - length, sizes)[: len(anchor)] >= np.arange(len(anchor))  # the string ends in its row
    start = np.flatnonzero(inside)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    at = anchor[start]
    head = np.ones(len(start), dtype=bool)
    head[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(head)
    first, last = start[heads], start[np.append(heads[1:], len(start)) - 1]
    row = np.searchsorted(offsets, first, side="right") - 1
    # anchors are least hashes: mixed again, they fill all ranges alike
    return row, first - offsets[row], last - offsets[row], mix(gram[at[heads]] + U64(1)), span_hash(h, first, last + length) + (at[heads] - first).astype(U64)


def first_of_groups(keys: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]):
    """(order, head): rows sorted by keys then place, and which rows begin a group of equal keys."""
    order = np.lexsort((*reversed(place), *reversed(keys)))
    head = np.ones(len(order), dtype=bool)
    head[1:] = False
    for k in keys:
        head[1:] |= k[order][1:] != k[order][:-1]
    return order, head


def joined(rid: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Intervals of starts, touching ones of a document united."""
    order = np.lexsort((a, rid))
    rid, a, b = rid[order], a[order], b[order]
    new = np.ones(len(rid), dtype=bool)
    new[1:] = (rid[1:] != rid[:-1]) | (a[1:] > b[:-1] + 1)
    heads = np.flatnonzero(new)
    return rid[heads], a[heads], b[np.append(heads[1:], len(rid)) - 1] if len(rid) else b


def unpacked(table: pa.Table, kinds: dict) -> list[np.ndarray]:
    """The values of all rows, one row after another."""
    return [string_bytes(table[name])[0].copy().view(kind) for name, kind in kinds.items()]


def packed(column: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each of the sizes: so many of the ordered values each."""
    edges = np.concatenate(([0], np.cumsum(sizes))) * column.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(column[order]))])


KEYS = {"one": U64, "two": U64, "rid": np.int64, "a": np.int32, "b": np.int32, "met": bool}
DONE = {"drid": np.int64, "da": np.int32, "db": np.int32}
BLOCK = "range int, " + ", ".join(f"{c} binary" for c in (*KEYS, *DONE))
#: kind 0: starts to remove; kind 1: the first place of a stretch whose anchor others share.
FOUND = "kind int, rid bigint, a int, b int, anchor bigint"
GONE = "rid bigint, a int, b int"


def keyed_block(one, two, rid, a, b, bits: int, later=None, anchors: bool = False) -> pa.RecordBatch:
    """The first place of each (one, two), by range of one; other places, and later ones, as intervals spread over the ranges.

    anchors: keys with one `one` are looked at together. Where the block has several of them, one goes to the range of
    `one`; the others are known to share it (met) and go by both keys, so that no anchor gathers in one range.
    """
    order, head = first_of_groups((one, two), (rid, a))
    first, other = order[head], order[~head]
    gone = [rid[other], a[other], b[other]]
    if later is not None:
        gone = [np.concatenate(x) for x in zip(gone, later)]
    drid, da, db = joined(*gone)
    place, met = one[first], np.zeros(len(first), dtype=bool)
    if anchors:
        again = np.zeros(len(first), dtype=bool)
        again[1:] = place[1:] == place[:-1]
        met[1:] |= again[1:]
        met[:-1] |= again[1:]
        place = np.where(again, mix(place ^ mix(two[first])), place)
    keys, done = ranges_of(place, bits), ranges_of(mix(drid.astype(U64)), bits)
    rows = np.union1d(keys, done)
    columns = {"one": one[first], "two": two[first], "rid": rid[first], "a": a[first].astype(np.int32), "b": b[first].astype(np.int32), "met": met}
    rest = {"drid": drid, "da": da.astype(np.int32), "db": db.astype(np.int32)}
    arrays = [pa.array(rows, pa.int32())]
    for where, group in ((keys, columns), (done, rest)):
        by_range, sizes = np.argsort(where, kind="stable"), np.bincount(np.searchsorted(rows, where), minlength=len(rows))
        arrays += [packed(c, by_range, sizes) for c in group.values()]
    return pa.RecordBatch.from_arrays(arrays, names=["range", *columns, *rest])


def gone_table(rid: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"rid": pa.array(rid.astype(np.int64)), "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32))})


def unite_stretches(group: pa.Table) -> pa.Table:
    """One range of (anchor, stretch) keys: later places of equal stretches, and first places that share an anchor."""
    one, two, rid, a, b, met = unpacked(group, KEYS)
    done = unpacked(group, DONE)
    order, head = first_of_groups((one, two), (rid, a))
    first, other = order[head], order[~head]
    anchors = one[first]
    met = np.bincount(np.cumsum(head) - 1, met[order], minlength=len(first))
    run = np.cumsum(np.concatenate(([True], anchors[1:] != anchors[:-1]))) - 1 if len(first) else np.zeros(0, np.int64)
    shared = (np.bincount(run)[run] > 1) | (np.bincount(run, met)[run] > 0) if len(first) else np.zeros(0, bool)
    edge = first[shared]
    gone = [np.concatenate(x) for x in zip(done, joined(rid[other], a[other], b[other]))]
    columns = [np.concatenate(x) for x in zip(gone, (rid[edge], a[edge], b[edge]))]
    kind, anchor = np.repeat([0, 1], [len(gone[0]), len(edge)]), np.concatenate((np.zeros(len(gone[0]), np.int64), one[edge].view(np.int64)))
    return gone_table(*columns).add_column(0, "kind", pa.array(kind.astype(np.int32))).append_column("anchor", pa.array(anchor))


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` bytes at least, and the rank of each suffix (equal: not told apart).

    Larsson-Sadakane: suffixes are sorted by their first bytes; then each round sorts the groups that are still tied by
    the rank of the suffix that many bytes on, which doubles the depth. Groups of one take no more part.
    """
    n = len(text)
    padded = np.concatenate((text.astype(U64) + U64(1), np.zeros(8, U64)))
    key = np.zeros(n, U64)
    for k in range(7):
        key = (key << U64(9)) | padded[k : k + n]
    sa = np.argsort(key)
    done = 7
    head = np.ones(n, dtype=bool)
    head[1:] = key[sa][1:] != key[sa][:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while done < depth:
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, n))
        open_ = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = sa[at]
        key = rank[own] * (n + 1) + rank[np.minimum(own + done, n)] + 1  # by group, then by the rank that many bytes on
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[at] = own
        head[at[1:]] |= key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[own] = first[at]
        done *= 2
    return sa, rank[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the array, `most` at most.

    Kasai: where a suffix and its predecessor both are one byte on from the pair before, their common prefix is one byte
    shorter. Along such a run it ends at the next byte that differs; only a run's last pair is compared byte by byte.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    goes_on = np.zeros(n, dtype=bool)
    goes_on[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    heads = np.flatnonzero(~goes_on)
    last = np.append(heads[1:], n) - 1
    run = np.cumsum(~goes_on) - 1
    length = np.zeros(len(last), dtype=np.int64)
    live = np.flatnonzero(before[last] >= 0)
    while len(live):
        i, j = last[live] + length[live], before[last[live]] + length[live]
        live = live[(i < n) & (j < n) & (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)])]
        length[live] += 1
        live = live[length[live] < most]
    place = np.arange(n)
    differs = np.where(text != text[np.maximum(before, 0)], place, n)
    ahead = np.minimum.accumulate(differs[::-1])[::-1]
    end = np.where(ahead <= last[run], ahead, (last + length)[run])
    return np.where(before >= 0, np.minimum(end - place, most), 0)[sa]


def shard_strings(text: np.ndarray, offsets: np.ndarray, rid: np.ndarray, a: np.ndarray, length: int):
    """(keys one and two, rid, start) of the strings of the stretches of a shard, sorted places united; later starts apart.

    Stretches follow each other in text; a string lies within one. Returns (first starts, later starts as intervals).
    """
    sa, _ = suffix_array(text, length)
    near = common_prefixes(text, sa, length)
    group = np.cumsum(near < length)  # suffixes of one group share `length` bytes
    piece = np.searchsorted(offsets, sa, side="right") - 1
    fits = sa + length <= offsets[piece + 1]
    sa, group, piece = sa[fits], group[fits], piece[fits]
    doc, start = rid[piece], a[piece] + sa - offsets[piece]
    order, head = first_of_groups((group,), (doc, start))
    sa, doc, start = sa[order], doc[order], start[order]
    same = np.zeros(len(sa), dtype=bool)  # overlapping stretches hold the same string of the same place
    same[1:] = ~head[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
    h = prefix_hash(text)
    one, two = span_hash(h, sa[head], sa[head] + length), span_hash(h, sa[head], sa[head] + length // 2)
    later = ~head & ~same
    order, _ = first_of_groups((one, two), ())
    return tuple(x[order] for x in (one, two, doc[head], start[head])), joined(doc[later], start[later], start[later])


def merge_two(x: tuple, y: tuple):
    """Merge two sorted lists (one, two, rid, a): the first place of every string, and the later ones (rid, a)."""
    if len(x[0]) < len(y[0]):
        x, y = y, x
    at = np.searchsorted(x[0], y[0])
    inside = np.minimum(at, max(0, len(x[0]) - 1))
    step = np.zeros(len(at), dtype=np.int64)
    while True:  # strings whose first keys agree by chance stand next to each other
        other = (inside + step < len(x[0])) & (x[0][np.minimum(inside + step, len(x[0]) - 1)] == y[0])
        other &= x[1][np.minimum(inside + step, len(x[0]) - 1)] != y[1]
        if not other.any():
            break
        step[other] += 1
    i = np.minimum(inside + step, max(0, len(x[0]) - 1))
    met = (x[0][i] == y[0]) & (x[1][i] == y[1]) if len(x[0]) else np.zeros(len(at), bool)
    i, own = i[met], np.flatnonzero(met)
    sooner = (y[2][own] < x[2][i]) | ((y[2][own] == x[2][i]) & (y[3][own] < x[3][i]))
    same = (y[2][own] == x[2][i]) & (y[3][own] == x[3][i])  # shards can hold one place twice
    gone = [np.where(sooner, x[k][i], y[k][own])[~same] for k in (2, 3)]
    x = [c.copy() for c in x]
    for k in (2, 3):
        x[k][i[sooner]] = y[k][own[sooner]]
    return tuple(np.insert(x[k], at[~met], y[k][~met]) for k in range(4)), gone


def merged(lists: list[tuple]) -> tuple[tuple, list[tuple]]:
    """Lists merged pair by pair to one; and the starts, as intervals, of every place but the first."""
    gone = []
    while len(lists) > 1:
        pairs = [merge_two(lists[k], lists[k + 1]) for k in range(0, len(lists) - 1, 2)]
        gone += [joined(rid, a, a) for _, (rid, a) in pairs]
        lists = [m for m, _ in pairs] + lists[len(pairs) * 2 :]
    return lists[0], gone


def merge_shards(group: pa.Table) -> pa.Table:
    """One range of string keys: the sorted lists of all shards merged; every start but the first is removed."""
    own, first = unpacked(group, KEYS), string_bytes(group["one"])[1] // 8
    lists = [tuple(c[s:e] for c in own[:4]) for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
    _, gone = merged(lists)
    return gone_table(*(np.concatenate(x) for x in zip(unpacked(group, DONE), *gone)))


def by_shard(batches, most: int):
    """Tables of about `most` bytes of text, cut where the anchor or its share changes; rows come in that order."""
    held, n = [], 0
    for batch in batches:
        anchor, share = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("anchor", "share"))
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1])) + 1
        if held and batch.num_rows and any(np.asarray(held[-1].column(held[-1].schema.get_field_index(c)))[-1] != x[0] for c, x in (("anchor", anchor), ("share", share))):
            cuts = np.concatenate(([0], cuts))
        _, offsets = string_bytes(batch.column(batch.schema.get_field_index("text")))
        start = 0
        for cut in cuts.tolist():
            if n + offsets[cut] - offsets[start] >= most:
                held.append(batch.slice(start, cut - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, start = [], 0, cut
        if start < batch.num_rows:
            held.append(batch.slice(start))
            n += int(offsets[-1] - offsets[start])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sorted_shards(batches, length: int, most: int):
    """shard_strings of the shards of a task."""
    for table in by_shard(batches, most):
        text, offsets = string_bytes(table["text"])
        yield shard_strings(text, offsets, np.asarray(table["rid"]).astype(np.int64), np.asarray(table["a"]).astype(np.int64), length)


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(rid, a, b): intervals of starts of strings that start earlier too; docs has (rid, text)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(0, int(np.ceil(np.log2(max(1.0, total / 33 / RANGE_KEYS))))))

    def send(batches):
        held, n = [], 0

        def flush():
            return keyed_block(*(np.concatenate(x) for x in zip(*held)), bits, anchors=True)

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            data, offsets = string_bytes(batch.column(batch.schema.get_field_index("text")))
            row, a, b, one, two = stretches(data, offsets, length)
            rid = np.asarray(batch.column(batch.schema.get_field_index("rid"))).astype(np.int64)
            held.append((one, two, rid[row], a, b))
            n += len(row)
            if n >= SENT_KEYS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    found = stored(docs.mapInArrow(send, BLOCK).groupBy("range").applyInArrow(unite_stretches, FOUND))
    release(docs.sparkSession)
    edges = found.filter("kind = 1")
    anchors = stored(edges.groupBy("anchor").agg(F.sum(F.col("b") - F.col("a") + length).alias("size"), F.sum(F.col("b") - F.col("a") + 1).alias("strings")))
    hot = anchors.filter(F.col("size") > HOT_BYTES)
    size = anchors.agg(F.sum("size")).first()[0] or 0
    hot_size, hot_strings = (x or 0 for x in hot.agg(F.sum("size"), F.sum("strings")).first())
    done = found.filter("kind = 0").select("rid", "a", "b")
    if not size:
        discard(anchors)
        return done
    # hot anchors are few: one for each HOT_BYTES of stretches at most
    shares = F.coalesce(F.ceil(F.col("size") / HOT_BYTES), F.lit(1)).cast("int").alias("shares")
    dealt = edges.join(F.broadcast(hot.select("anchor", "size")), "anchor", "left").select("rid", "a", "b", "anchor", shares)
    places = dealt.groupBy("rid").agg(F.collect_list(F.struct("a", "b", "anchor", "shares")).alias("places"))

    def cut(batches):
        for batch in by_bytes(batches, "text"):
            data, offsets = string_bytes(batch.column(batch.schema.get_field_index("text")))
            own = batch.column(batch.schema.get_field_index("places"))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(own)))
            flat = pa.compute.list_flatten(own)
            a, b = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
            text = [data[s:e].tobytes() for s, e in zip(offsets[row] + a, offsets[row] + b + length)]
            rid = batch.column(batch.schema.get_field_index("rid")).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([rid, pa.array(a.astype(np.int32)), flat.field(2), flat.field(3), pa.array(text, pa.binary())], names=["rid", "a", "anchor", "shares", "text"])

    texts = stored(docs.join(places, "rid").select("rid", "text", "places").mapInArrow(cut, "rid bigint, a int, anchor bigint, shares int, text binary"))
    release(docs.sparkSession)
    pieces = texts.withColumn("share", F.pmod(F.xxhash64("rid", "a"), F.col("shares")))
    bits = min(MOST_BITS, max(0, int(np.ceil(np.log2(max(1.0, hot_strings / RANGE_KEYS))))))

    def shards(rows: DataFrame, size: int) -> DataFrame:
        """The stretches of an anchor, or of its share, together and one after another."""
        return rows.repartition(max(1, -(-size // TASK_BYTES)), "anchor", "share").sortWithinPartitions("anchor", "share").select("rid", "a", "anchor", "share", "text")

    def sort_shard(batches):
        for _, later in sorted_shards(batches, length, SHARD_BYTES):
            yield from gone_table(*later).to_batches()

    def sort_hot(batches):
        lists, gone, n = [], [], 0

        def flush():
            (one, two, doc, start), more = merged(lists)
            return keyed_block(one, two, doc, start, start, bits, [np.concatenate(x) for x in zip(*gone, *more)])

        for strings, later in sorted_shards(batches, length, SHARD_BYTES):
            lists.append(strings)
            gone.append(later)
            n += len(strings[0])
            if n >= SENT_KEYS:
                yield flush()
                lists, gone, n = [], [], 0
        if lists:
            yield flush()

    done = done.unionByName(shards(pieces.filter("shares = 1"), size - hot_size).mapInArrow(sort_shard, GONE))
    if hot_size:
        done = done.unionByName(shards(pieces.filter("shares > 1"), hot_size).mapInArrow(sort_hot, BLOCK).groupBy("range").applyInArrow(merge_shards, GONE))
    starts = stored(done)
    discard(found, anchors, texts)
    return starts


SPANS = "array<struct<start: bigint, end: bigint>>"


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(rid, id, n_bytes, n_removed, spans, kept) of every row: removed byte spans, and the bytes that stay, joined.

    rid is the id where ids are unique; kept is binary, as a span can begin or end within a character.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    rows = keyed(docs, id_col, text_col)
    starts = repeated_starts(rows.select("rid", "text"), length)
    release(docs.sparkSession)
    spans = starts.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("starts"))

    def cut(batches):
        for batch in by_bytes(batches, "text"):
            data, offsets = string_bytes(batch.column(batch.schema.get_field_index("text")))
            own = batch.column(batch.schema.get_field_index("starts"))
            count = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(own), 0)).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), count)
            flat = pa.compute.list_flatten(own)
            a, b = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
            change = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(change, offsets[row] + a, 1)
            np.add.at(change, offsets[row] + b + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[:-1] = gone
            edge[1:-1] &= ~gone[:-1]
            edge[offsets[:-1][offsets[:-1] < offsets[1:]]] |= gone[offsets[:-1][offsets[:-1] < offsets[1:]]]
            begins = np.flatnonzero(edge[:-1])
            close = gone.copy()
            close[:-1] &= ~gone[1:] | edge[1:-1]
            ends = np.flatnonzero(close) + 1
            first = np.searchsorted(begins, offsets)
            base = np.repeat(offsets[:-1], np.diff(first))
            pairs = pa.StructArray.from_arrays([pa.array(begins - base), pa.array(ends - base)], names=["start", "end"])
            kept = [data[s:e][~gone[s:e]].tobytes() for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in ("rid", "id")),
                    pa.array(np.diff(offsets)),
                    pa.array(total[offsets[1:]] - total[offsets[:-1]]),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pairs),
                    pa.array(kept, pa.binary()),
                ],
                names=["rid", "id", "n_bytes", "n_removed", "spans", "kept"],
            )

    joined_rows = rows.join(spans, "rid", "left").select("rid", "id", "text", "starts")
    return joined_rows.mapInArrow(cut, f"rid bigint, id bigint, n_bytes bigint, n_removed bigint, spans {SPANS}, kept binary")

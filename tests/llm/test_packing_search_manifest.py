"""Best-fit packing, ranked lexical search and the Merkle manifest against plain forms of themselves."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import lexical
from cairn.llm.bestfit import END_ID, VOCABULARY, ChunkEncoder, pack_best_fit, plan_lengths, sequences_of, write_sequences
from cairn.llm.lexical import build_index, choose_blocks, search
from cairn.llm.merkle import fold, leaf_of, merkle_manifest, proof
from cairn.llm.queries import op13_merkle_manifest
from tests.llm.test_operators import documents, some_texts

ODD = ["", None, " ", "\n\n", "don't stop. I'VE", "a.b,c;d", "Σας ΟΔΟΣ. ΣΑΣ", "é e ́x", "\x01 a\x01b", "x" * 3000, "<|endoftext|> y", "12 345", "日本語、です", " a b", "tab\tnew\r\nline", "!?...", "İstanbul"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]


def test_chunks_have_the_ids_of_whole_texts(tokenizer):
    texts = [t for _, t in some_texts(3, 150)] + ODD
    encoder = ChunkEncoder(public_tokenizers.path(VOCABULARY), most_known=40)
    for part in (texts[:60], texts[60:], texts):
        ids, offsets = encoder.encode(pa.array(part, pa.string()))
        for i, text in enumerate(part):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == ids_of(tokenizer, text), text


@pytest.mark.parametrize("width", [7, 64, 300])
def test_packed_pieces_give_the_documents_back(spark, tokenizer, width, tmp_path):
    rows = some_texts(4, 120) + [(500, None), (500, None), (None, "a b")] + [(600 + i, t) for i, t in enumerate(ODD)]
    packed = pack_best_fit(documents(spark, rows), width=width)
    found = packed.collect()
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= width and r["start"] == r["piece"] * width
        by_row[r["id"]].append((r["piece"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= width
    want = defaultdict(list)
    for i, t in rows:
        ids = ids_of(tokenizer, t)
        want[i] += [(k, ids[a : a + width]) for k, a in enumerate(range(0, len(ids), width))]
    assert {i: sorted(v) for i, v in by_row.items()} == {i: sorted(v) for i, v in want.items()}
    write_sequences(packed, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == len(by_sequence) == sequences_of(packed).count()
    for r in out:
        assert len(r["input_ids"]) == 4 * r["n_tokens"] == 4 * r["cu_seqlens"][-1] and len(r["doc_ids"]) + 1 == len(r["cu_seqlens"])


def plain_plan(lengths, width):
    """Sequences of the same rule, piece by piece."""
    left, rooms = sorted((n for n in lengths if n > width // 3), reverse=True), []
    while left:
        a = left.pop(0)
        fits = [n for n in left if n <= width - a]
        if fits:
            left.remove(max(fits))
        rooms.append(width - a - max(fits, default=0))
    for n in sorted((n for n in lengths if n <= width // 3), reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits, default=width)
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_by_length_is_the_plan_piece_by_piece(seed):
    r = random.Random(seed)
    width = r.choice([10, 31, 100])
    lengths = [r.choice([r.randint(1, width), r.randint(1, width // 3), width // 2, 1]) for _ in range(r.randint(0, 300))]
    plan = plan_lengths(np.bincount(lengths, minlength=width + 1), width)
    used, numbers = defaultdict(list), Counter()
    for n in lengths:
        number, numbers[n] = numbers[n], numbers[n] + 1
        row = max(i for i in range(len(plan["length"])) if plan["length"][i] == n and plan["first"][i] <= number)
        rank = number - plan["first"][row]
        used[int(plan["sequence"][row] + rank // plan["each"][row])].append((int(plan["base"][row] + rank % plan["each"][row] * n), n))
    for places in used.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert sum(3 * n > width for _, n in places) <= 2
    assert sorted(width - sum(n for _, n in p) for p in used.values()) == plain_plan(lengths, width)
    assert len(used) == plan["sequences"][0]


def test_packing_no_rows_and_other_ids(spark):
    docs = spark.createDataFrame([("a", "x y", 1), (None, "z", 2)], "name string, body string, ids int")
    assert {(r["id"], r["length"]) for r in pack_best_fit(docs, id_col="name", text_col="body").collect()} == {("a", 3), (None, 2)}
    assert pack_best_fit(docs.limit(0), id_col="name", text_col="body").count() == 0


def plain_search(rows, items, k):
    terms = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("shard_bytes, terms_at_once", [(4_000_000, 400_000), (700, 400_000), (150, 20)])
def test_search_equals_a_full_search(spark, monkeypatch, shard_bytes, terms_at_once):
    monkeypatch.setattr(lexical, "QUERY_TERMS", terms_at_once)
    rows = some_texts(8, 250) + [(None, "abc abc"), (7, "abc x"), (7, "abc x"), (901, "Ünter-abc_ABC 9"), (902, "...")]
    items = [(i, t) for i, t in some_texts(9, 25)] + [(3, "ABC"), (3, "abc 9 ünter"), (None, "abc"), (50, None), (51, "?!"), (52, "unseenterm")]
    items += [(100 + i, rows[i][1]) for i in range(20)]
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    found = search(build_index(documents(spark, rows), shard_bytes=shard_bytes), queries, 5).collect()
    assert sorted(repr(tuple(r)) for r in found) == plain_search(rows, items, 5)


def test_search_without_rows(spark):
    docs, queries = documents(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert [tuple(r)[:3] for r in search(build_index(docs), queries).collect()] == [(1, 1, 1)]
    assert search(build_index(docs), queries.limit(0)).count() == 0
    assert search(build_index(docs.limit(0)), queries).count() == 0
    assert search(build_index(docs.filter("text is null")), queries).count() == 0


def test_an_index_task_holds_a_few_megabytes_whatever_it_reads(spark, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(30_000)]
    docs = documents(spark, [(i, " ".join(r.choice(words) for _ in range(12_500))) for i in range(240)]).coalesce(1)  # 24 MB
    cut, large = lexical.by_bytes, spark.sparkContext.accumulator(0)

    def counted(batches, column, *most):
        for batch in cut(batches, column, *most):
            large.add(int(pa.compute.sum(pa.compute.binary_length(batch[column])).as_py() > 1_600_000))
            yield batch

    monkeypatch.setattr(lexical, "by_bytes", counted)
    index = build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.shards.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert large.value == 0
    assert len(groups) > 1 and max(groups) < 16_000_000
    assert index.n_docs == 240 and index.shards.count() >= 24


def test_blocks_have_the_least_error():
    r = np.random.default_rng(2)
    sizes = np.array([0, 1, 2, 9, 9, 0, 13])
    scores = r.integers(1, 50, sizes.sum())
    begins = choose_blocks(scores, sizes, cost=40, most=6)
    at = 0
    for n in sizes.tolist():
        own, cuts = scores[at : at + n].tolist(), [i for i in range(n) if begins[at + i]]
        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + 40 + (j - i) * max(own[i:j]) for i in range(max(0, j - 6), j))
        ends = [*cuts[1:], n]
        assert n == 0 or cuts[0] == 0
        assert sum(40 + (e - c) * max(own[c:e]) for c, e in zip(cuts, ends)) == best[n]
        at += n


def plain_manifest(rows, arity):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        """(root, sides of each node)"""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, a in enumerate(at):
                run = a // arity * arity
                paths[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + arity])))
            level, at = [h("".join(level[a : a + arity])) for a in range(0, len(level), arity)], [a // arity for a in at]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] is not None, (r[1] or "").encode())].append((r[0] is not None, r[0] or 0, h("".join(map(field, r)))))
    subtrees = {g: tree([leaf for _, _, leaf in sorted(v)]) for g, v in groups.items()}
    order = sorted(groups)
    root, uppers = tree([subtrees[g][0] for g in order])
    out = []
    for g, upper in zip(order, uppers):
        for (known, i, leaf), path in zip(sorted(groups[g]), subtrees[g][1]):
            out.append((i if known else None, leaf, subtrees[g][0], root, h("".join(a + b for a, b in path + upper))))
    return sorted(map(repr, out))


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_a_plain_tree(spark, arity):
    r = random.Random(arity)
    rows = [(i, r.choice(["a", "a", "a", "b", "é", "Z", "", None]), t) for i, t in some_texts(12, 90)]
    rows += [(None, "a", "x"), (None, "a", None), (3, "a", "y"), (3, "a", "y"), (1, "alone", "z" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumns({"grp": F.lit(1), "node": F.lit("n"), "idx": F.lit(2), "carried": F.lit(0)}).repartition(5)
    found = merkle_manifest(docs, ["doc_id", "source", "text"], arity=arity, carry={"again": leaf_of(F.col("doc_id"), F.col("source"), F.col("text"))})
    got = found.select("id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256), fold(F.col("again"), F.col("path")).alias("folded")).collect()
    assert {x["folded"] for x in got} == {got[0]["root"]}
    assert sorted(repr(tuple(x)[:5]) for x in got) == plain_manifest(rows, arity)
    assert merkle_manifest(docs.limit(0), ["doc_id", "text"]).count() == 0
    with pytest.raises(ValueError):
        merkle_manifest(docs, ["doc_id"], arity=1)


def test_tampering_is_seen(spark, tmp_path):
    rows = [(i, f"line\nof {i}" if i % 3 else f"one line {i}", "en", "s", 5) for i in range(40)] + [(99, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    import zlib

    for r in op13_merkle_manifest(spark, str(tmp_path)).collect():
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["doc_id"] != 99 and r["doc_id"] % 3 != 0
        assert r["verified"] == (not hit) == (r["folded_root"] == r["root"])


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from cairn.llm import packing

    texts = pa.array(["one two, three", "", None, "four\nfive two é", "one " * 50])
    plain = packing.Encoder(packing.RANKS).encode_plainly(texts)
    looked_up = packing.Encoder(packing.RANKS)
    monkeypatch.setattr(looked_up, "encode_plainly", None)
    for _ in range(2):
        assert all(np.array_equal(a, b) for a, b in zip(looked_up.encode(texts), plain))
    monkeypatch.setattr(packing, "span_hash", lambda h, starts, ends: np.zeros(len(starts), packing.U64))
    clashing = packing.Encoder(packing.RANKS)
    for _ in range(2):
        assert all(np.array_equal(a, b) for a, b in zip(clashing.encode(texts), plain))

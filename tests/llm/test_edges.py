"""Clashing names, repeated rows, nulls, long texts and empty tables, for operators and pipeline stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate as decontaminate_module
from cairn.llm.decontaminate import decontaminate
from cairn.llm.line_dedup import remove_boilerplate
from cairn.llm.mixing import fit_moves, sums_of
from cairn.llm.ngram_join import jaccard_classes
from cairn.llm.packing import pack_documents
from cairn.llm.sharding import shuffle_into_shards, write_shards
from cairn.llm.suffix_dedup import remove_repeats
from cairn.llm.textbytes import STRIDE, prefix_hash, span_hash
from cairn.llm.topk import exact_top_k
from cairn.llm.url_filter import judge_urls
from tests.llm.test_operators import repeats


def test_new_columns_take_the_place_of_old_ones_with_their_names(spark):
    docs = spark.createDataFrame([(1, "a\nb", "s", 7)], "doc_id bigint, text string, source string, shard int")
    docs = docs.withColumns({"Slot": F.lit("x"), "drop": F.lit(1), "n_lines": F.lit("old"), "text_key": F.lit("k")})
    row = shuffle_into_shards(docs, 1).collect()[0].asDict()
    assert (row["shard"], row["slot"], row["drop"]) == (0, 0, 1)
    row = remove_boilerplate(docs).collect()[0].asDict()
    assert (row["n_lines"], row["clean_text"], row["text_key"], row["shard"]) == (2, "a\nb", "k", 7)


def test_shards_follow_the_order_of_the_deal(spark, tmp_path):
    rows = [(i % 40, f"text {i % 7}" * (i % 5)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    dealt = shuffle_into_shards(spark.read.parquet(str(tmp_path / "d")), 7, bucket_bytes=900)
    out = sorted((r["shard"], r["slot"]) for r in dealt.collect())
    n, want = len(rows), []  # shard k holds the places floor(k * n / 7) up to the next shard's first
    for k in range(7):
        want += [(k, s) for s in range((k + 1) * n // 7 - k * n // 7)]
    assert out == want
    write_shards(dealt, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 7


def test_top_k_of_large_weights_and_repeated_queries(spark):
    rows = [(0, [1.0]), (0, [None]), (1, [1e8]), (2, [2e8]), (3, [3e8]), (4, [1e30]), (5, [-1e30]), (6, [float("inf")])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = {r["rank"]: (r["vec_id"], r["score"]) for r in exact_top_k(vectors, vectors.filter("vec_id = 0"), 5).collect()}
    assert out == {1: (4, 2**63 - 1), 2: (3, 256 * 256 * 300_000_000), 3: (2, 256 * 256 * 200_000_000), 4: (1, 256 * 256 * 100_000_000), 5: (5, -(2**63 - 1))}
    assert exact_top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0
    # beyond 64 bits the order is that of the exact scores
    wide = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [2e30, 0.0]), (3, [3e30, 0.0]), (4, [-2e30, 0.0]), (5, [-1e30, 0.0]), (6, [0.0, 5.0]), (7, [3e30, 0.0])], "vec_id bigint, embedding array<double>")
    for rows in (wide.coalesce(1), wide.repartition(4)):
        out = exact_top_k(rows, wide.filter("vec_id = 0"), 7, block=2).orderBy("rank").collect()
        assert [r["vec_id"] for r in out] == [3, 7, 2, 1, 6, 5, 4] and out[4]["score"] == 5 * 256 * 256


def test_query_blocks_give_what_one_block_gives(spark, monkeypatch):
    from cairn.llm import topk

    r = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(120)], "vec_id bigint, embedding array<float>")
    want = sorted(map(tuple, exact_top_k(vectors, vectors.filter("vec_id % 5 = 0"), 3).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, exact_top_k(vectors, vectors.filter("vec_id % 5 = 0"), 3).collect())) == want and len(want) == 72


def test_blocks_of_a_benchmark_give_what_one_block_gives(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(80, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(str(i), " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for i in range(30)] + [("0", "w1 w2"), (None, "w3 w4 w5")], "item_id string, text string")
    want = sorted(map(repr, decontaminate(docs, items, width=3).collect()))
    monkeypatch.setattr(decontaminate_module, "BLOCK_BYTES", 60)
    found = decontaminate(docs, items, width=3).collect()
    assert sorted(map(repr, found)) == want and sum(bool(x["item_ids"]) for x in found) > 20
    kept = sorted(x["doc"]["doc_id"] for x in found if not x["n_hit"])
    assert sorted(x["doc_id"] for x in decontaminate(docs, items, width=3, action="documents").collect()) == kept
    assert decontaminate(docs.limit(0), items).count() == 0
    assert {len(x["item_ids"]) for x in decontaminate(docs, items.limit(0)).collect()} == {0}


def test_long_items_are_cut_into_pieces_with_the_same_windows(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    long_item = [r.choice(words) for _ in range(400)]
    rows = [(i, " ".join([r.choice(words) for _ in range(5)] + long_item[i * 3 : i * 3 + r.randint(3, 9)]), i) for i in range(120)]
    docs = spark.createDataFrame([*rows, (120, None, None)], "doc_id bigint, text string, place int")
    items = spark.createDataFrame([("long", ", ".join(long_item).upper()), ("tiny", "w1 w2")] + [("same", "w3 w4 w5 w6 w7")] * 40, "item_id string, text string")
    want = sorted(map(repr, decontaminate(docs, items, width=5).collect()))
    monkeypatch.setattr(decontaminate_module, "BLOCK_BYTES", 200)
    pieces = decontaminate_module.cut_items(items.selectExpr("item_id AS item", "text"), 5).collect()
    assert max(len(x["text"]) for x in pieces) < 100 and sum(x["item"] == "long" for x in pieces) > 30
    found = decontaminate(docs, items, width=5).collect()
    assert sorted(map(repr, found)) == want and sum(bool(x["item_ids"]) for x in found) > 50


def test_urls_with_many_labels_nulls_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.b.Example.org/x/y?q"), (1, "http://A.b.Example.org/x/y?q"), (None, None), (2, "x://..org/x")], "page_id bigint, url string")
    rules = spark.createDataFrame([("example.org", "/x/", "block"), ("b.example.org", "/x", "allow"), ("org", "", "block")], "host string, path string, action string")
    assert sorted(map(repr, judge_urls(pages, rules).select("rule", "verdict").collect())) == sorted(["Row(rule='b.example.org/x', verdict='allow')"] * 2 + ["Row(rule=None, verdict='allow')", "Row(rule='org', verdict='block')"])
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_moves_equal_a_long_projected_descent():
    r = np.random.default_rng(5)
    for n in (2, 3, 4):
        tokens, p = r.integers(1, 500, 400).astype(float), r.dirichlet(np.ones(n) * 0.7, 400)
        shares = r.dirichlet(np.ones(n) * 2)
        budget = tokens.sum()
        moved, reached, met = fit_moves(lambda m, tokens=tokens, p=p: sums_of(tokens, p, m), shares)
        # min sum(t (r - 1)^2) / 2 with sum(t r p) = budget * shares, r >= 0: long ascent of its dual
        slow = np.zeros(n)
        for _ in range(60_000):
            rate = np.maximum(0.0, 1.0 - p @ slow)
            slow += ((tokens * rate) @ p - budget * shares) / budget
        want = (tokens * np.maximum(0.0, 1.0 - p @ slow)) @ p / budget
        assert met and np.abs(reached - shares).max() < 1e-3 and np.abs(want - shares).max() < 1e-3
        assert np.abs(np.maximum(0.0, 1.0 - p @ moved) - np.maximum(0.0, 1.0 - p @ slow)).max() < 0.02


def test_hashes_of_long_texts_depend_on_the_bytes_only():
    part = np.frombuffer(random.Random(3).randbytes(500), np.uint8)
    data = np.concatenate([np.zeros(3 * STRIDE - 200, np.uint8), part, np.ones(7, np.uint8), part])
    h = prefix_hash(data)
    at = np.array([3 * STRIDE - 200, 3 * STRIDE + 307])
    assert len(set(span_hash(h, at, at + 500).tolist()) | set(span_hash(prefix_hash(part), np.array([0]), np.array([500])).tolist())) == 1


def test_very_long_texts_and_null_ids(spark):
    r = random.Random(7)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(40_000))
    rows = [(1, long), (2, long[:150_000] + " zz " + long[150_000:]), (3, "x " * 40), (3, "x " * 40), (None, long), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard_classes(docs).collect()
    assert sorted((str(x["id"]), str(x["component_id"])) for x in found) == sorted([("1", "1"), ("2", "1"), ("3", "3"), ("3", "3"), ("None", "1"), ("None", "None"), ("None", "None")])
    out = sorted((str(x["id"]), x["n_removed"]) for x in remove_repeats(docs).collect())
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or ""))
    want = repeats([(k, t) for k, (_, t) in enumerate(order)])
    assert out == sorted((str(i), want[k][1]) for k, (i, _) in enumerate(order))
    assert sum(x["n_tokens"] for x in pack_documents(docs).collect()) > 100_000


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with small tables: nulls, repeats, copies, a toxic word, a benchmark passage and columns with clashing names."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    passage = " ".join(r.choice(words) for _ in range(15))
    for i in range(240):
        text = " ".join(r.choice(words) for _ in range(40))
        text += " xyzzyq qyzzyx" if i % 6 == 0 else " " + passage if i % 10 == 1 else ""
        rows += [(i, text)] * (2 if i % 40 == 2 else 1)
        labels.append((i, i % 2, int(i % 6 == 0)))
    rows += [(500, rows[5][1] + " more"), (None, rows[5][1]), (None, None), (501, ""), (502, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumns({"node": F.lit("n"), "key": F.lit("k"), "mix_doc": F.lit(1)}).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return tmp_path, rows, passage


def test_stages_of_the_pipeline(spark, tables):
    folder, rows, passage = tables
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def texts(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    clean = stages["toxicity"](spark, docs, str(folder))
    assert clean.columns == columns and sorted(map(repr, texts(clean))) == sorted(repr(x) for x in rows if "xyzzyq" not in (x[1] or ""))
    single = stages["near_duplicates"](spark, docs, str(folder))
    assert single.columns == columns
    kept, seen = texts(single), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        if t:
            seen.setdefault(t.removesuffix(" more"), i)
    assert sorted(map(repr, kept)) == sorted([*(repr((i, t)) for t, i in seen.items()), repr((None, None)), repr((501, "")), repr((502, None))])
    safe = stages["decontamination"](spark, docs, str(folder))
    assert safe.columns == columns and sorted(map(repr, texts(safe))) == sorted(repr(x) for x in rows if passage not in (x[1] or ""))
    mixed = stages["mixing"](spark, docs, str(folder))
    assert mixed.columns == columns and {repr(x) for x in texts(mixed)} <= {repr(x) for x in rows} and len([t for _, t in texts(mixed) if t is None]) == 2
    dealt = stages["sharding"](spark, docs, str(folder))
    assert dealt.columns == [*columns, "shard", "slot"] and sorted(map(repr, texts(dealt))) == sorted(map(repr, rows))


def test_the_pipeline_runs_and_takes_empty_tables(spark, tables, tmp_path):
    folder, rows, passage = tables
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert out and not any("xyzzyq" in (x["text"] or "") or passage in (x["text"] or "") for x in out)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(folder / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_rows_keep_their_names_however_scans_are_split(spark, tmp_path):
    rows = [(i // 2 if i % 7 else None, " ".join(f"w{(i // 4) * 31 + k}" for k in range(40)) if i % 5 else None, f"s{i % 3}", i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, near_place string, row int").coalesce(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        kept, dealt = corpus_pipeline.drop_near_copies(spark, docs, ""), shuffle_into_shards(docs, 3, bucket_bytes=2000)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert docs.rdd.getNumPartitions() > 3
        kept, dealt = kept.collect(), dealt.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    texts = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is not None:
            texts.setdefault(r[1], r[0])
    assert {(r["text"], r["doc_id"]) for r in kept if r["text"] is not None} == set(texts.items())
    assert len(kept) == len(texts) + sum(r[1] is None for r in rows)
    by_row = {r[3]: r for r in rows}
    assert all(tuple(r) == by_row[r["row"]] for r in kept)
    assert sorted(r["row"] for r in dealt) == list(range(400))
    slots = {}
    for r in dealt:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert {k: sorted(v) for k, v in slots.items()} == {k: list(range(len(v))) for k, v in slots.items()} and len(slots) == 3

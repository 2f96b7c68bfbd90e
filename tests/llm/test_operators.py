import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import components as components_module
from cairn.llm import line_dedup, ngram_join, suffix_dedup, toxicity
from cairn.llm.components import components, spanning_stars
from cairn.llm.decontaminate import decontaminate
from cairn.llm.line_dedup import remove_boilerplate
from cairn.llm.mixing import fit_rates, mix_to_targets, mixture_rates
from cairn.llm.packing import END_ID, RANKS, Encoder, best_fit_decreasing, pack_documents
from cairn.llm.sharding import shuffle_into_shards
from cairn.llm.topk import exact_top_k
from cairn.llm.toxicity import fit, score_documents
from cairn.llm.url_filter import judge_urls
from corpus_pipeline import drop_near_copies


def some_texts(seed: int, n: int):
    """Rows with nulls, empty texts, long runs, exact and near copies, and shared passages."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(60)]
    passage = " ".join(r.choice(words) for _ in range(70))
    rows = []
    for i in range(n):
        k = r.random()
        old = rows[r.randrange(len(rows))][1] if rows else "x"
        if k < 0.06:
            t = None
        elif k < 0.12:
            t = ""
        elif k < 0.2:
            t = "a" * r.randint(0, 400)
        elif k < 0.4:
            t = old
        elif k < 0.6 and old:
            w = old.split(" ")
            w[r.randrange(len(w))] = "ZZ"
            t = " ".join(w)
        else:
            t = " ".join(r.choice(words) for _ in range(r.randint(1, 50))) + r.choice(["", " " + passage])
        rows.append((i, t))
    return rows


def documents(spark, rows, parts: int = 3):
    """Rows with columns whose names clash with those inside the operators."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"rid": F.lit("r"), "node": F.lit(1), "n": F.lit(None).cast("int"), "source": F.concat(F.lit("s"), F.pmod("doc_id", F.lit(3)))}).repartition(parts)


def repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = [True] * length
            seen.add(b[k : k + length])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("shard, keys", [(1_000_000, 500_000), (9_000, 300)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, shard, keys):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "RANGE_KEYS", keys)
    rows = some_texts(5, 90)
    found = suffix_dedup.remove_repeats(documents(spark, rows)).select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == repeats(rows)


@pytest.mark.parametrize("hot", [300, 1_000])
def test_hot_anchors_are_dealt_over_shards_that_merge(spark, monkeypatch, hot):
    for name, value in {"SHARD_BYTES": 1_500, "HOT_BYTES": hot, "RANGE_KEYS": 100, "SENT_KEYS": 50}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    merge = suffix_dedup.merge_shards
    met = spark.sparkContext.accumulator(0)

    def counted(group):
        met.add(group.num_rows)
        return merge(group)

    monkeypatch.setattr(suffix_dedup, "merge_shards", counted)
    rows = some_texts(7, 150)
    found = suffix_dedup.remove_repeats(documents(spark, rows)).select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == repeats(rows)
    assert met.value > 1


def test_strings_of_one_anchor_meet_in_one_shard(spark, monkeypatch):
    """Shards whose anchors are not hot send no keys, whose number of blocks grew as the square of the input."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 9_000)
    monkeypatch.setattr(suffix_dedup, "RANGE_KEYS", 300)

    def none_meet(group):
        raise AssertionError("keys of shards were sent")

    monkeypatch.setattr(suffix_dedup, "merge_shards", none_meet)
    rows = some_texts(5, 90)
    found = suffix_dedup.remove_repeats(documents(spark, rows)).select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == repeats(rows)


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(1)
    for _ in range(30):
        t = r.integers(0, r.integers(1, 4), r.integers(1, 300)).astype(np.uint8)
        b = t.tobytes()
        sa, _ = suffix_dedup.suffix_array(t, 40)
        assert [b[i : i + 40] for i in sa] == sorted(b[i : i + 40] for i in range(len(b)))
        near = suffix_dedup.common_prefixes(t, sa, 30)
        for k in range(1, len(sa)):
            x, y = b[sa[k - 1] :][:30], b[sa[k] :][:30]
            assert near[k] == next((n for n in range(min(len(x), len(y))) if x[n] != y[n]), min(len(x), len(y)))


def classes(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("LINEAR", 0), ("LARGE", 3), ("COUNTED_TOKENS", 60), ("AGAINST_TOKENS", 90), ("RANGE_ROWS", 300), ("SENT_ROWS", 100), ("LEAST_FREQUENT", 3)):
            monkeypatch.setattr(ngram_join, name, n)
        monkeypatch.setattr(components_module, "FEW", 0)
    rows = some_texts(9, 150)
    edits = random.Random(4)
    base = [f"w{k}" for k in range(90)]
    for i in range(150, 230):  # near copies of one text, many of which link only through others
        words = list(base)
        for k in edits.sample(range(90), edits.randint(0, 3)):
            words[k] = f"x{edits.randrange(3)}"
        rows.append((i, " ".join(words)))
    found = ngram_join.jaccard_classes(documents(spark, rows)).select("id", "n_shingles", "component_id")
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == classes(rows)


def test_packing_round_trip(spark):
    rows = [*some_texts(2, 40), (40, "it's a'b  c d é f\n\n g h " * 200)]
    width = 64
    encoder = Encoder(RANKS)
    parts = defaultdict(dict)
    for row in pack_documents(documents(spark, rows), width=width).collect():
        ids, places, ends = np.frombuffer(row["input_ids"], "<i4"), np.frombuffer(row["position_ids"], "<i4"), row["cu_seqlens"]
        assert len(ids) == len(places) == width and ends[-1] == row["n_tokens"] and len(ends) == len(row["doc_ids"]) + 1
        for doc, at, a, b in zip(row["doc_ids"], row["doc_offsets"], ends, ends[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            parts[doc][at] = ids[a:b].tolist()
    for i, t in rows:
        assert sum((parts[i][k] for k in sorted(parts[i])), []) == [*encoder.bpe.encode_ordinary(t or ""), END_ID]


def test_best_fit_decreasing_equals_a_plain_search():
    r = np.random.default_rng(0)
    for _ in range(100):
        sizes = r.integers(1, 33, r.integers(1, 60))
        bins, _, count = best_fit_decreasing(sizes, 32)
        free = []
        for s in sorted(sizes, reverse=True):
            fits = [x for x in free if x >= s]
            if fits:
                free[free.index(min(fits))] -= s
            else:
                free.append(32 - s)
        assert count == len(free) and sorted(32 - np.bincount(bins, sizes, minlength=count).astype(int)) == sorted(free)


def test_rates_meet_the_targets(spark):
    rows = [(i, ("apple pear plum " if i % 4 else "iron zinc lead ") * 20) for i in range(200)] + [(200, None), (201, "")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id bigint, quality int")
    rated, domains = mixture_rates(docs, labels, {0: 0.5, 1: 0.5})
    out = rated.collect()
    total = np.sum([np.array(r["posterior"]) * r["n_tokens"] * r["rate"] for r in out], axis=0)
    assert domains == [0, 1] and len(out) == 202 and min(r["rate"] for r in out) >= 0
    assert abs(total[0] / total.sum() - 0.5) < 0.01
    mixed = mix_to_targets(docs, labels, {0: 0.5, 1: 0.5})
    assert mixed.columns == docs.columns and mixed.filter("text is null").count() == 1


@pytest.mark.parametrize("high, longest, targets", [(0.95, 3, [0.4, 0.6]), (0.95, 3, [0.6, 0.4]), (0.5, 5, [0.51, 0.49])])
def test_rates_meet_the_targets_beside_very_long_rows(spark, high, longest, targets):
    r = random.Random(8)
    rows = [(r.randint(20, 400), r.choice([0.05, 0.95]) if high > 0.5 else r.uniform(0.2, 0.5)) for _ in range(2000)] + [(200_000, high / 2 if high < 0.9 else high)] * longest
    table = spark.createDataFrame([(n, [1 - p, p]) for n, p in rows], "n_tokens bigint, posterior array<double>")
    rated, reached = fit_rates(table, np.array(targets))
    out = rated.collect()
    found = np.sum([np.array(x["posterior"]) * x["n_tokens"] * x["rate"] for x in out], axis=0) / sum(n for n, _ in rows)
    assert len(out) == len(rows) and min(x["rate"] for x in out) >= 0
    assert np.abs(found - targets).max() < 2e-4 and np.abs(reached - targets).max() < 2e-4


def test_rates_out_of_reach_are_told(spark):
    table = spark.createDataFrame([(10, [0.7, 0.3]), (30, [0.5, 0.5]), (0, [0.6, 0.4])], "n_tokens bigint, posterior array<double>")
    with pytest.warns(UserWarning, match="nearest"):
        rated, reached = fit_rates(table, np.array([0.1, 0.9]))
    assert reached[0] == pytest.approx(reached[1], abs=0.01) and [x["rate"] for x in rated.filter("n_tokens <> 30").orderBy("n_tokens").collect()] == [1.0, 0.0]


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = some_texts(3, 101)
    documents(spark, rows).write.parquet(str(tmp_path / "d"))
    out = shuffle_into_shards(spark.read.parquet(str(tmp_path / "d")), 8, bucket_bytes=2000).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out if r["text"]) == sorted(r for r in rows if r[1]) and len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 8
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_toxic_words_are_learned(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    bad = ["xyzzyq", "qqyzzx", "zyxqzy"]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [r.choice(words) for _ in range(30)] + ([r.choice(bad) for _ in range(3)] if toxic else [])
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    docs = documents(spark, [*rows, (600, None), (601, "")])
    found = {x["doc"]["doc_id"]: x["predicted"] for x in score_documents(docs, *fit(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))).collect()}
    assert np.mean([found[i] == t for i, t in marks]) > 0.97 and found[600] == found[601] == 0


def kneser_ney(words):
    """value(word) by the definition; words has (bytes, count in class 0, count in class 1)."""
    top, pooled = toxicity.ORDER, toxicity.POOLED
    counts = {m: defaultdict(lambda: [0, 0]) for m in range(1, top + 1)}
    for w, *c in words:
        t = bytes([toxicity.START]) + w + bytes([toxicity.END])
        for at in range(1, len(t)):
            m = min(at + 1, top)
            for k in (0, 1):
                counts[m][t[at + 1 - m : at + 1]][k] += c[k]
    for m in range(top - 1, 0, -1):
        for g, c in counts[m + 1].items():
            for k in (0, 1):
                counts[m][g[1:]][k] += c[k] > 0

    def discount(values):
        values = list(values)
        return min(0.95, max(0.3, values.count(1) / max(1, values.count(1) + 2 * values.count(2))))

    def of_context(m, g, k):
        return [(sum(c) if k is None else c[k]) for x, c in counts[m].items() if x[:-1] == g]

    d_pooled = {m: discount(sum(c) for c in counts[m].values()) for m in range(1, pooled + 1)}
    d = {(m, k): discount(c[k] for c in counts[m].values()) for m in counts for k in (0, 1)}

    def shared(g):
        m = len(g)
        if m == 1:
            return (sum(counts[1][g]) + 1) / (sum(map(sum, counts[1].values())) + 256)
        inside = of_context(m, g[:-1], None)
        return max(sum(counts[m][g]) - d_pooled[m], 0) / sum(inside) + d_pooled[m] * len(inside) / sum(inside) * shared(g[1:])

    def weight(g, k):
        inside = of_context(len(g) + 1, g, k)
        return max(d[len(g) + 1, k] * sum(x > 0 for x in inside) / sum(inside), 1e-4) if sum(inside) else 1.0

    def p(g, k):
        m = len(g)
        if m == pooled:
            return shared(g)
        total = sum(of_context(m, g[:-1], k))
        return (max(counts[m][g][k] - d[m, k], 0) / total if total else 0) + weight(g[:-1], k) * p(g[1:], k)

    def value(w):
        t, total = bytes([toxicity.START]) + w + bytes([toxicity.END]), 0.0
        for at in range(pooled, len(t)):
            for m in range(min(at + 1, top), pooled, -1):
                g = t[at + 1 - m : at + 1]
                if g in counts[m]:
                    total += np.log(p(g, 1)) - np.log(p(g, 0))
                    break
                if any(x[:-1] == g[:-1] for x in counts[m]):
                    total += np.log(weight(g[:-1], 1)) - np.log(weight(g[:-1], 0))
        return total / (len(w) + 1)

    return value


@pytest.mark.parametrize("small", [False, True])
def test_toxicity_equals_kneser_ney_by_definition(spark, monkeypatch, small):
    if small:
        for name, n in (("BUCKET_WINDOWS", 5), ("BLOCK_WORDS", 20), ("ASKING", 2), ("MOST_WORDS", 15)):
            monkeypatch.setattr(toxicity, name, n)
    r = random.Random(6)
    words = ["".join(r.choice("abcdeéÉ") for _ in range(r.randint(1, 9))) for _ in range(90)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 25))) + (" xyzzy" if i % 4 == 0 else "")) for i in range(200)] + [(200, None), (None, "xyzzy abc"), (7, "abc")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None), (9999, 1)], "doc_id bigint, toxic int")
    flat = lambda w: w.encode().replace(b"\xc3", b"")
    seen = defaultdict(lambda: [0, 0])
    for i, t in rows:
        if i is not None and i < 150 and remainder_of(i) not in (0, 4):
            for w in set(re.findall("[a-zé]+", (t or "").lower())):
                seen[flat(w)][i % 4 == 0] += 1
    value = kneser_ney([(w, *c) for w, c in seen.items()])
    out = score_documents(docs, *fit(docs, labels)).collect()
    assert len(out) == len(rows) and out[0]["doc"].asDict().keys() == set(docs.columns)
    for x in out:
        mine = sorted((value(flat(w)) for w in set(re.findall("[a-zé]+", (x["doc"]["text"] or "").lower()))), reverse=True)
        assert x["f"] == pytest.approx([*(mine + [0, 0, 0])[:3], np.mean(mine) if mine else 0], abs=1e-9)
        assert 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5)


def remainder_of(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.mark.parametrize("kept", [lambda i, toxic: False, lambda i, toxic: not toxic, lambda i, toxic: toxic])
def test_no_row_is_toxic_without_labels_of_both_classes(spark, kept):
    docs = documents(spark, [(i, f"some words {'xyzzy' if i % 3 == 0 else 'abc'}") for i in range(40)] + [(40, None)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40) if kept(i, i % 3 == 0)], "doc_id bigint, toxic int")
    found = score_documents(docs, *fit(docs, labels)).collect()
    assert len(found) == 41 and all(x["predicted"] == 0 and x["score"] < 0.5 for x in found)


def test_toxic_words_are_learned_where_the_fit_rows_lack_a_class(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + (" xyzzyq qqyzzx zyxqzy" if i % 5 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 5 == 0)) for i in range(400) if i % 5 or remainder_of(i) != 4]
    docs = documents(spark, [*rows, (400, None)])
    found = {x["doc"]["doc_id"]: x["predicted"] for x in score_documents(docs, *fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))).collect()}
    assert np.mean([found[i] == int(i % 5 == 0) for i in range(400)]) > 0.95 and found[400] == 0


def test_one_row_of_each_near_copy_stays(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, a), (3, a + " more"), (7, b), (7, c), (9, c), (None, b + " end"), (None, "d e f g h i"), (None, "d e f g h i"), (None, None), (None, ""), (11, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    kept = drop_near_copies(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert kept.columns == ["doc_id", "text"]
    want = [(3, a + " more"), (7, b), (7, c), (None, "d e f g h i"), (None, None), (None, ""), (11, "")]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_shares_below_what_the_join_is_made_for_are_refused(spark):
    with pytest.raises(ValueError, match="80"):
        ngram_join.jaccard_classes(documents(spark, [(1, "x")]), percent=70)


def test_decontaminate_cuts_spans(spark):
    docs = documents(spark, [(0, "x y The cat, sat on a mat z"), (1, "clean text"), (2, None)])
    items = spark.createDataFrame([("q", "the CAT sat"), ("r", ""), ("s", None)], "item_id string, text string")
    assert {x["doc_id"]: x["text"] for x in decontaminate(docs, items, action="spans").collect()} == {0: "x y  on a mat z", 1: "clean text", 2: None}
    assert sorted(x["doc_id"] for x in decontaminate(docs, items, action="documents").collect()) == [1, 2]


def test_boilerplate_lines(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nshared line\n\nend", f"s{i}") for i in range(20)] + [(20, None, None), (21, "", "s1")], "doc_id bigint, text string, source string")
    out = {r["doc_id"]: r["clean_text"] for r in remove_boilerplate(docs).collect()}
    assert out[3] == "own 3\n" and out[20] is None and out[21] == ""


@pytest.mark.parametrize("many", [200_000, 40])
def test_lines_of_any_weight_are_removed_alike(spark, monkeypatch, many):
    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup, "HOT", many // 10)
    r = random.Random(8)
    lines = [f"line {k}" for k in range(60)]
    rows = [(i, "\n".join(r.choices(lines, [600 / (k + 1) for k in range(60)], k=r.randint(1, 12))), f"s{r.randint(0, 25)}" if r.random() > 0.1 else None) for i in range(150)]
    rows += [(i, "line 0\nline 59\n\n", "hot") for i in range(150, 230)] + [(230, None, "s1"), (231, "", None)]
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites[line].add(site)
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or len(sites[x]) < 12) for i, t, _ in rows}
    found = remove_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(found) == len(rows) and {x["doc_id"]: x["clean_text"] for x in found} == want
    assert 5 < sum(len(x) >= 12 for x in sites.values()) < 55


def test_top_k_equals_a_full_search(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in rows[:300]}
    want = {}
    for q in range(0, 300, 50):
        best = sorted(((-int(whole[q] @ w), i) for i, w in whole.items() if i != q))[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    found = exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, block=16, range_rows=64)
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()} == want


def test_url_rules(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(0, "http://WWW.Example.org/es/x?y"), (1, "https://notexample.org/es/"), (2, "http://a.com/de/"), (3, None), (4, "no url"), (5, "http://com.net/de/")], "page_id int, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect()} == {0: ("example.org/es/", "block"), 1: ("org/", "allow"), 2: ("com/de/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow")}


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, ngram_join.jaccard_classes, pack_documents, shuffle_into_shards, remove_boilerplate])
def test_empty_tables(spark, run, tmp_path):
    documents(spark, [(1, "x")]).filter("doc_id > 1").write.parquet(str(tmp_path / "d"))
    assert run(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def test_contraction_matches_union_find():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 40))
        u, v = r.integers(-20, 20, n), r.integers(-20, 20, n)
        least = {}

        def find(x):
            while least.setdefault(x, x) != x:
                x = least[x]
            return x

        for a, b in zip(u.tolist(), v.tolist()):
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
        wanted = {x: find(x) for x in list(least) if find(x) != x}
        assert dict(zip(*(x.tolist() for x in spanning_stars(u, v)))) == wanted


def test_components_of_a_long_chain(spark):
    n = 3000
    order = list(range(1, n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(k, k - 1) for k in order] + [(n + 1, n + 2), (7, 7)], "u bigint, v bigint").repartition(16)
    found = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(n), 0), n + 1: n + 1, n + 2: n + 1}

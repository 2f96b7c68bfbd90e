"""One query per operator, with its DuckDB form where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bestfit import pack_best_fit
from cairn.llm.decontaminate import decontaminate
from cairn.llm.lexical import build_index, search
from cairn.llm.line_dedup import remove_boilerplate
from cairn.llm.merkle import fold, leaf_of, merkle_manifest, proof
from cairn.llm.mixing import mixture_rates
from cairn.llm.ngram_join import jaccard_classes
from cairn.llm.packing import pack_documents
from cairn.llm.sharding import shuffle_into_shards
from cairn.llm.suffix_dedup import remove_repeats
from cairn.llm.topk import exact_top_k
from cairn.llm.toxicity import fit, remainder, score_documents
from cairn.llm.url_filter import judge_urls

#: Fixed values of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, domains = mixture_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), {0: 0.4, 1: 0.6})
    shares = [F.get("posterior", F.lit(k)).alias(f"p_quality_{d}") for k, d in enumerate(domains)]
    return rated.select(F.col("id").alias("doc_id"), "n_tokens", *shares, "rate")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc.doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"), F.sha2("clean_text", 256).alias("clean_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shuffle_into_shards(table(spark, sf_dir, "documents"), 8)
    return dealt.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc.doc_id", (remainder(F.col("doc.doc_id")) == 0).alias("held_out"), "score", "predicted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_best_fit(table(spark, sf_dir, "documents"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    tampered = leaf_of(*map(F.col, fields[:-1]), text)
    found = merkle_manifest(table(spark, sf_dir, "documents"), fields, carry={"tampered": tampered})
    found = found.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_pack_tokens": op1_pack_tokens,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_shuffle_shards": op8_shuffle_shards,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.w)), lambda i: q.w[i] * d.w[i])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.w) = len(d.w)
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op5_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), i AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), iw AS (
            SELECT item_id, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p, w FROM i WHERE len(w) > 0
        ), windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM iw),
        sizes AS (SELECT DISTINCT n FROM windows),
        dw AS (
            SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS p, w FROM d, sizes WHERE len(w) >= n
        ), dg AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM dw),
        met AS (SELECT dg.doc_id, dg.n, dg.p, windows.item_id FROM dg JOIN windows ON dg.n = windows.n AND dg.g = windows.g),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS k FROM met) GROUP BY doc_id),
        got AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN got USING (doc_id)
    """,
    "op6_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
        ), wide AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT site) >= 12),
        k AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE wide.line IS NOT NULL) AS n_removed,
                   string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE wide.line IS NULL) AS clean
            FROM l LEFT JOIN wide ON l.line = wide.line GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(clean, '')) END AS clean_sha256
        FROM documents d LEFT JOIN k USING (doc_id)
    """,
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, g FROM (
                SELECT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM w WHERE len(w) > 0))
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r(node, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id
        FROM w JOIN r ON w.doc_id = r.node LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
    """,
    "op10_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), s AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), r(rh, rp, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        f AS (
            SELECT s.*, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS n
            FROM s LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        )
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE n = 1
    """,
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), c AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
        i AS (
            SELECT item_id, term, count(*) AS repeats
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
        ), p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
        x AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM x, c),
        s AS (
            SELECT item_id, doc_id, CAST(sum(repeats * g.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM i JOIN p USING (term) JOIN g USING (term), c GROUP BY item_id, doc_id
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op13_merkle_manifest": r"""
        WITH RECURSIVE f AS (
            SELECT *, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: CASE WHEN x IS NULL THEN '-' ELSE CAST(strlen(x) AS VARCHAR) || ':' || x END) AS head,
                   list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS crc
            FROM documents
        ), t AS (SELECT *, CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS altered FROM f),
        leaves AS (
            SELECT doc_id, coalesce('=' || source, '-') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
                   sha256(array_to_string(head, '') || CASE WHEN text IS NULL THEN '-' ELSE CAST(strlen(text) AS VARCHAR) || ':' || text END) AS node,
                   sha256(array_to_string(head, '') || CASE WHEN altered IS NULL THEN '-' ELSE CAST(strlen(altered) AS VARCHAR) || ':' || altered END) AS tampered
            FROM t
        ), lower_levels AS (
            SELECT 0 AS level, grp, idx, n, node FROM leaves
            UNION ALL
            SELECT level + 1, grp, idx // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY idx)) FROM lower_levels WHERE n > 1 GROUP BY level, grp, idx // 3
        ), subroots AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM lower_levels WHERE n = 1),
        upper_levels AS (
            SELECT 0 AS level, '' AS grp, place AS idx, n, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, grp, idx // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY idx)) FROM upper_levels WHERE n > 1 GROUP BY level, grp, idx // 3
        ), nodes AS (SELECT 'lower' AS tree, * FROM lower_levels UNION ALL SELECT 'upper', * FROM upper_levels),
        sides AS (
            SELECT tree, level, grp, idx, n, coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, grp, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(node, '') OVER (PARTITION BY tree, level, grp, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
            FROM nodes
        ), low(grp, leaf_idx, level, idx, proof, folded) AS (
            SELECT grp, idx, 0, idx, '', tampered FROM leaves
            UNION ALL
            SELECT low.grp, leaf_idx, low.level + 1, low.idx // 3, proof || before || behind, sha256(before || folded || behind)
            FROM low JOIN sides ON tree = 'lower' AND sides.level = low.level AND sides.grp = low.grp AND sides.idx = low.idx AND n > 1
        ), ended AS (SELECT grp, leaf_idx, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM low GROUP BY grp, leaf_idx),
        up(grp, leaf_idx, level, idx, proof, folded) AS (
            SELECT grp, leaf_idx, 0, place, proof, folded FROM ended JOIN subroots USING (grp)
            UNION ALL
            SELECT up.grp, leaf_idx, up.level + 1, up.idx // 3, proof || before || behind, sha256(before || folded || behind)
            FROM up JOIN sides ON tree = 'upper' AND sides.level = up.level AND sides.idx = up.idx AND n > 1
        ), done AS (SELECT grp, leaf_idx, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM up GROUP BY grp, leaf_idx),
        top AS (SELECT node AS root FROM upper_levels WHERE n = 1)
        SELECT doc_id, leaves.node AS leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM leaves JOIN done ON leaves.grp = done.grp AND leaves.idx = done.leaf_idx JOIN subroots ON subroots.grp = leaves.grp, top
    """,
}

"""N-gram Jaccard join by token-combination prefixes, and the classes its links form.

A document's set holds its distinct `width`-word shingles (ASCII letters lower-cased; the whole sequence counts as one
where there are fewer words). Two documents link when 100 * intersection >= percent * union.

* Tokens (shingle hashes) have one global order: rare before frequent, by hash within each. A token is frequent where a
  bit table says so; the table holds the tokens whose document frequency over all documents reaches a bound.
* A prefix extends until no partner can miss all of its signatures: rare tokens are signatures alone, frequent tokens
  in combinations of two within their subclass. A prefix that a partner can damage in t places must keep one, so with
  n_1 rare tokens and n_g frequent tokens of subclass g it extends until n_1 + sum(max(0, n_g - 1)) > t. The number of
  subclasses follows the set's size band, so combinations stay proportional to the set; a set signs for its own band
  and the next, and linked sets are at most one band apart.
* Documents that share a signature are candidates, less those that their sizes and positions rule out, and are verified
  on their whole sets. Equal sets are one node. Candidates within one class found so far need no check. First each node
  is verified with the two candidates that lead most of its signatures, and classes unite. Then nodes gather in clusters
  by the node that leads most of their signatures (the least hash of those that share one). Within a cluster of LARGE nodes or more
  those outside its largest class are counted against all its nodes, block by block inside tasks, which send on only what
  unites classes. Candidates of different clusters and classes are then all verified as pairs. So no link between classes is lost and pairs within a group of copies are not listed.

Null and empty texts have empty sets and are linked with nothing. Rows with null or repeated ids are documents of their
own; their component_id is the smallest id of the component, nulls last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.components import components, spanning_stars
from cairn.llm.shared import discard, keyed, release, stored
from cairn.llm.textbytes import LOWER, NOT_SPACE, U64, by_bytes, mix, parts_of, prefix_hash, ranges_of, span_hash, string_bytes, window_hash, words_of

#: Bits of the frequent-token table (2 MB). It takes at most a sixteenth of them as tokens: the frequency bound rises with the corpus.
TABLE_BITS = 24
LEAST_FREQUENT = 16
#: Signature rows or tokens of one range, which one task sorts, and of what a task sends at once.
RANGE_ROWS, SENT_ROWS = 250_000, 200_000
MOST_BITS = 30
#: Rows of an Arrow batch of texts, token sets or pairs of them; about 2 MB of common texts.
BATCH_ROWS = 1_000
#: Bytes of text that a task hashes at once; a word costs it about 50 bytes while it does.
PIECE_BYTES = 500_000
#: Nodes of a cluster that is counted as a whole; in smaller ones candidates are verified as pairs.
LARGE = 32
#: Tokens of the nodes that a task counts, and of those that it counts them against.
COUNTED_TOKENS, AGAINST_TOKENS = 250_000, 500_000
#: Pairs between classes for each signature row from which on nodes meet in buckets of BUCKET first: so many tests of sizes
#: and positions cost about as much as a row on its way through a round's shuffles.
LINEAR, BUCKET = 64, 4
#: Nodes whose ids are broadcast (below 100 MB as a hash table) to keep other sets out of a shuffle.
BROADCAST_NODES = 2_000_000
SMALL = 4  # sets below four tokens link with equal sets only


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    data, offsets = string_bytes(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, NOT_SPACE)
    words = span_hash(prefix_hash(data), starts, ends)
    whole = window_hash(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        else:
            out.append(window_hash(words[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def fingerprint(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    own = [int(np.sum(mix(tokens + mix(np.array([2 * seed + k], U64))[0]), dtype=U64)) for k in (1, 2)]
    return tuple(int(np.uint64(x).astype(np.int64)) for x in own)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def bands(most: int = 1 << 40) -> list[int]:
    """Least size of each band; sizes whose ratio is 4/5 or more are at most one band apart."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 5 // 4 + 1)
    return out


BANDS = np.array(bands())


def frequent_signatures(tokens: np.ndarray, need: int, scheme: int) -> np.ndarray:
    """Two-token combinations of a prefix of frequent tokens that `need - 1` lost tokens cannot all break."""
    subclasses = max(1, int(BANDS[scheme]) // 16)
    own = mix(tokens ^ U64(0x51ED270B)) % U64(subclasses)
    _, firsts = np.unique(own, return_index=True)
    worth = np.ones(len(tokens), dtype=np.int64)
    worth[firsts] = 0
    end = int(np.searchsorted(np.cumsum(worth), need)) + 1
    tokens, own = tokens[:end], own[:end]
    order = np.argsort(own, kind="stable")
    tokens, own = tokens[order], own[order]
    found = []
    for gap in range(1, len(tokens)):
        same = own[gap:] == own[:-gap]
        if not same.any():
            break
        found.append(mix(mix(tokens[:-gap][same]) + tokens[gap:][same] * U64(3) + U64(scheme)))
    return np.concatenate(found) if found else np.zeros(0, U64)


def signatures(tokens: np.ndarray, table: np.ndarray, shift: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set and, for each, the most tokens that a partner first met there can share."""
    n = len(tokens)
    need = n - -(-percent * n // 100) + 1
    frequent = table[mix(tokens >> U64(shift)) >> U64(64 - TABLE_BITS)]
    rare = tokens[~frequent]
    head = rare[:need]
    marks, rest = [mix(head + U64(7))], [n - np.arange(len(head))]
    if len(rare) < need:
        scheme = int(np.searchsorted(BANDS, n, side="right")) - 1
        for s in (scheme, scheme + 1):
            marks.append(frequent_signatures(tokens[frequent], need - len(rare), s))
            rest.append(np.full(len(marks[-1]), n - len(rare)))
    return np.concatenate(marks), np.concatenate(rest)


def distinct_sets(batches, width: int, seed: int):
    """(fingerprint, set) of each distinct set of a task's rows."""
    seen = set()
    for batch in by_bytes(batches, "text", PIECE_BYTES):
        for tokens in shingle_sets(batch.column(batch.schema.get_field_index("text")), width):
            if len(tokens) >= SMALL and (own := fingerprint(tokens, seed)) not in seen:
                seen.add(own)
                yield own, tokens


def power_of_two(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, n)))))


def frequent_table(docs: DataFrame, width: int, seed: int, total: int) -> tuple[np.ndarray, int]:
    """Bit table of the frequent tokens and the shift that makes its keys.

    Tasks send (range, tokens, counts) blocks; one task for each range adds up the counts of its tokens.
    """
    bits = min(MOST_BITS, power_of_two(total / (2 * RANGE_ROWS)))
    shift = 32 - bits

    def send(batches):
        held, n = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held) >> U64(shift), return_counts=True)
            parts = list(parts_of((keys >> U64(32)).astype(np.int64)))
            keys, more = keys.astype(np.uint32), [p[counts[p] > 1] for _, p in parts]
            columns = [[keys[p].tobytes() for _, p in parts], [keys[m].tobytes() for m in more], [(counts[m] - 1).astype(np.uint32).tobytes() for m in more]]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["range", "once", "again", "extra"])

        for _, tokens in distinct_sets(batches, width, seed):
            held.append(tokens)
            n += len(tokens)
            if n >= SENT_ROWS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def add(group: pa.Table) -> pa.Table:
        r = group["range"][0].as_py()
        once = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["once"]])
        again = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["again"]])
        extra = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["extra"]])
        keys, counts = np.unique(once, return_counts=True)
        np.add.at(counts, np.searchsorted(keys, again), extra)
        often = counts >= LEAST_FREQUENT
        return pa.table({"key": pa.array((np.int64(r) << 32) + keys[often].astype(np.int64)), "df": pa.array(counts[often].astype(np.int64))})

    blocks = docs.mapInArrow(send, "range int, once binary, again binary, extra binary")
    counted = stored(blocks.groupBy("range").applyInArrow(add, "key bigint, df bigint"), BATCH_ROWS)
    sizes = {r["b"]: r["n"] for r in counted.groupBy(F.floor(F.log2("df")).alias("b")).agg(F.count("*").alias("n")).collect()}
    least = LEAST_FREQUENT
    while sum(n for b, n in sizes.items() if 2**b >= least) > (1 << TABLE_BITS) // 16:
        least *= 2
    keys = np.asarray(counted.filter(F.col("df") >= least).select("key").toArrow()["key"]).astype(U64)
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[mix(keys) >> U64(64 - TABLE_BITS)] = True
    discard(counted)
    return np.packbits(table), shift


def shared_signatures(docs: DataFrame, width: int, percent: int, seed: int, packed, shift: int, total: int) -> DataFrame:
    """(sig, node, n, rest) of the signatures that two nodes or more have.

    Of the nodes that a task sends of one signature, one goes to the signature's range; the others are known to share it
    and are dealt out by node, so a signature of very many nodes does not gather in one range.
    """
    bits = min(MOST_BITS, power_of_two(total * (100 - percent) / 100 / RANGE_ROWS))

    def send(batches):
        table = np.unpackbits(packed.value).astype(bool)
        held, n = [], 0

        def flush():
            sig, node, size, rest = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((-rest, node, sig))
            sig, node, size, rest = (x[order] for x in (sig, node, size, rest))
            _, other, met = shared_runs(sig, node)
            sig, node, size, rest = sig[other], node[other], size[other], rest[other]
            met = met[other]
            later = np.zeros(len(sig), dtype=bool)
            later[1:] = sig[1:] == sig[:-1]
            place = np.where(later, mix(sig ^ mix(node.view(U64))), sig)
            parts = list(parts_of(ranges_of(place, bits)))
            columns = [[x[p].tobytes() for _, p in parts] for x in (sig, node, size, rest, met)]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["range", "sig", "node", "n", "rest", "met"])

        for (node, _), tokens in distinct_sets(batches, width, seed):
            sig, rest = signatures(tokens, table, shift, percent)
            held.append((sig, np.full(len(sig), node, np.int64), np.full(len(sig), len(tokens), np.int32), rest.astype(np.int32)))
            n += len(sig)
            if n >= SENT_ROWS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        sig, node, n, rest, met = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in group[c]]) for c, kind in (("sig", U64), ("node", np.int64), ("n", np.int32), ("rest", np.int32), ("met", bool)))
        order = np.lexsort((~met, -rest, node, sig))
        sig, node, n, rest, met = sig[order], node[order], n[order], rest[order], met[order]
        run, new, many = shared_runs(sig, node)
        known = np.bincount(run, met, minlength=run[-1] + 1 if len(run) else 0)[run] > 0
        keep = new & (many | known)
        return pa.table({"sig": signed(sig[keep]), "node": node[keep], "n": n[keep], "rest": rest[keep]})

    return docs.mapInArrow(send, "range int, sig binary, node binary, n binary, rest binary, met binary").groupBy("range").applyInArrow(meet, "sig bigint, node bigint, n int, rest int")


def shared_runs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by (sig, node): the run of equal signatures, the first row of each node in it, and runs of two nodes or more."""
    begin, new = np.ones(len(sig), dtype=bool), np.ones(len(sig), dtype=bool)
    begin[1:] = sig[1:] != sig[:-1]
    new[1:] = begin[1:] | (node[1:] != node[:-1])  # tasks that hold the same set sent it more than once
    run = np.cumsum(begin) - 1
    return run, new, np.bincount(run, new)[run] > 1 if len(run) else np.zeros(0, bool)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of stored pairs (a, b); sets of no pair are left out before the shuffle where the ids may be broadcast."""

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = np.sort(np.concatenate((x, y)))
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * inter >= percent * (len(both) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if needed.count() <= BROADCAST_NODES:
        sets = sets.join(F.broadcast(needed), "node", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, linked boolean")


def possible(x: str, y: str, percent: int):
    """Sizes and positions allow the pair to link."""
    nx, ny, least = F.col(f"{x}.n"), F.col(f"{y}.n"), F.least(F.col(f"{x}.rest"), F.col(f"{y}.rest"))
    return (percent * F.greatest(nx, ny) <= 100 * F.least(nx, ny)) & ((100 + percent) * least.cast("long") >= percent * (nx + ny))


def best_per_node(pairs: DataFrame, most: int | None, checked: DataFrame | None = None) -> DataFrame:
    """(a, b) of a node's candidates, less checked ones, with the most common signatures; all where most is None."""
    counted = pairs.groupBy("node", "other").agg(F.count("*").alias("common"))
    counted = counted.select("node", "other", "common", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    if checked is not None:
        counted = counted.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    if most is not None:
        order = Window.partitionBy("node").orderBy(F.desc("common"), "other")
        counted = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return counted.select("a", "b").distinct()


def clusters_of(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, cluster, comp, main, against, counted) of the nodes of large clusters that hold several classes.

    A node's cluster is the node of the least hash that leads most of its signatures. main is the cluster's largest class
    by tokens, against and counted are the blocks its nodes, and those outside main, are dealt into.
    """
    leader = shared.groupBy("sig").agg(F.min(F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("cluster"))).alias("y"))
    votes = shared.join(leader.select("sig", "y.cluster"), "sig").groupBy("node", "cluster").agg(F.count("*").alias("k"), F.first("n").cast("long").alias("n"))
    rows = votes.groupBy("node").agg(F.max(F.struct("k", "cluster", "n")).alias("best")).select("node", "best.cluster", "best.n")
    rows = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    held = rows.groupBy("cluster", "comp").agg(F.sum("n").alias("size"), F.count("*").alias("nodes"))
    held = held.groupBy("cluster").agg(F.max(F.struct("size", "comp")).alias("main"), F.count("*").alias("classes"), F.sum("nodes").alias("nodes"), F.sum("size").alias("size"))
    held = held.filter((F.col("classes") > 1) & (F.col("nodes") >= LARGE))
    held = held.select("cluster", F.col("main.comp").alias("main"), F.ceil(F.col("size") / AGAINST_TOKENS).cast("int").alias("against"), F.ceil((F.col("size") - F.col("main.size")) / COUNTED_TOKENS).cast("int").alias("counted"))
    return rows.drop("n").join(held, "cluster")


def links_in_clusters(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that unite the classes of a cluster wherever nodes of the cluster link."""

    def count(group: pa.Table) -> pa.Table:
        own, others = (group.filter(pa.compute.equal(group["own"], side)) for side in (True, False))
        x, y = ([np.frombuffer(t.as_py(), U64) for t in side["tokens"]] for side in (own, others))
        node, comp = np.asarray(others["node"]), np.asarray(others["comp"])
        size = np.array([len(t) for t in y], dtype=np.int64)
        owner, tokens = np.repeat(np.arange(len(y)), size), np.concatenate([*y, np.zeros(0, U64)])
        order = np.argsort(tokens, kind="stable")
        owner, tokens = owner[order], tokens[order]
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, mine, t in zip(own["node"].to_pylist(), own["comp"].to_pylist(), x):
            low, high = np.searchsorted(tokens, t), np.searchsorted(tokens, t, side="right")
            runs = high - low
            at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(low, runs)
            common = np.bincount(owner[at], minlength=len(y))
            linked = np.flatnonzero((100 * common >= percent * (len(t) + size - common)) & (comp != mine))
            linked = linked[np.unique(comp[linked], return_index=True)[1]]  # one link with a class is enough
            u.append(np.full(len(linked), name, np.int64))
            v.append(node[linked].astype(np.int64))
        a, b = spanning_stars(np.concatenate(u), np.concatenate(v))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def dealt(side: DataFrame, own: bool) -> DataFrame:
        mine, other = ("counted", "against") if own else ("against", "counted")
        block, all_of_other = F.pmod(F.xxhash64("node"), F.col(mine)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return side.select(block, all_of_other, "cluster", "node", "comp", F.lit(own).alias("own"))

    sent = dealt(clusters.filter("comp <> main"), True).unionByName(dealt(clusters, False)).join(sets.select("node", "tokens"), "node")
    return sent.groupBy("cluster", "counted", "against").applyInArrow(count, "a bigint, b bigint")


def links_between_nodes(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of the nodes that link with others.

    Between clusters, while the pairs are more than LINEAR times the signature rows, nodes meet in small random buckets of a signature
    first; where that finds no more links, all pairs that are left between classes are checked.
    """
    spark = shared.sparkSession
    centre = shared.groupBy("sig").agg(F.min(F.struct(F.xxhash64("sig", "node").alias("o"), "node", "n", "rest")).alias("y"))
    near = shared.alias("x").join(centre.select("sig", "y.*").alias("y"), "sig")
    near = near.filter((F.col("x.node") != F.col("y.node")) & possible("x", "y", percent)).select(F.col("x.node").alias("node"), F.col("y.node").alias("other"))
    first = stored(best_per_node(near, 2))
    release(spark)
    checked = stored(verify(first, sets, percent), BATCH_ROWS)
    discard(first)
    release(spark)
    before = united(None, checked.filter("linked"))
    clusters = stored(clusters_of(shared, before))
    inside = stored(links_in_clusters(clusters, sets, percent), BATCH_ROWS)
    comps, open_rows, fruitless, turn = united(before, inside), shared, False, 0
    discard(before, inside)
    while True:
        release(spark)
        rows = open_rows.join(clusters.select("node", "cluster"), "node", "left").join(comps, "node", "left")
        rows = rows.withColumns({"comp": F.coalesce("comp", "node"), "cluster": F.coalesce("cluster", "node")})  # pairs of small clusters are open
        kinds = [rows.groupBy("sig", kind).agg(F.count("*").alias("k")).groupBy("sig").agg(F.count("*").alias(f"{kind}s"), F.sum("k").alias("members"), F.sum(F.col("k") * F.col("k")).alias(f"{kind}_pairs")) for kind in ("comp", "cluster")]
        split = kinds[0].filter("comps > 1").join(kinds[1].drop("members").filter("clusters > 1"), "sig")
        split = stored(split.select("sig", "members", (F.col("members") * F.col("members") - F.greatest("comp_pairs", "cluster_pairs")).alias("pairs")))
        work = split.agg(F.sum("members").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if not work["rows"]:
            discard(split, checked, clusters, None if open_rows is shared else open_rows)
            return comps
        every = work["pairs"] <= LINEAR * work["rows"] or fruitless
        rows, old_rows = rows.join(split, "sig"), None
        if not every:  # signatures of one class stay so
            old_rows, open_rows = open_rows, stored(rows.select(*shared.columns))
        meet = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.cluster") != F.col("y.cluster"))
        if not every:
            turn += 1
            bucket = F.pmod(F.xxhash64(F.lit(turn), "sig", "node"), F.ceil(F.col("members") / BUCKET))
            rows = rows.withColumn("bucket", bucket)
            meet = meet & (F.col("x.bucket") == F.col("y.bucket"))
        met = rows.alias("x").join(rows.alias("y"), meet & (F.col("x.node") < F.col("y.node")) & possible("x", "y", percent))
        open_pairs = stored(best_per_node(met.select(F.col("x.node").alias("node"), F.col("y.node").alias("other")), None if every else 8, checked))
        discard(split)
        fresh = stored(verify(open_pairs, sets, percent), BATCH_ROWS)
        n_open, n_linked = open_pairs.count(), fresh.filter("linked").count()
        discard(open_pairs, None if old_rows is shared else old_rows)
        if n_linked:
            before, comps = comps, united(comps, fresh.filter("linked"))
            discard(before)
        if every:  # all pairs between the classes of this round have been verified
            discard(checked, fresh, clusters, None if open_rows is shared else open_rows)
            return comps
        fruitless = fruitless or 20 * n_linked < n_open
        before, checked = checked, stored(checked.select("a", "b").unionByName(fresh.select("a", "b")))
        discard(before, fresh)


def united(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after the links (a, b) have united classes."""
    if comps is None:
        return stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    links = links.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    found = components(links.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")))
    moved = found.select(F.col("node").alias("old"), F.col("comp").alias("new"))
    kept = comps.join(moved, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    fresh = found.join(comps.select("node"), "node", "left_anti").join(comps.select(F.col("comp").alias("node")).distinct(), "node", "left_anti")
    return stored(kept.unionByName(fresh))


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """(rid, id, n_shingles, component_id) of every row; rid is the id where ids are unique.

    SMALL and BANDS hold for links of 80 percent or more, so less is refused.
    """
    if not 80 <= percent <= 100:
        raise ValueError(f"percent must be 80 to 100, not {percent}")
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)

    def measure(seed):
        def run(batches):
            for batch in by_bytes(batches, "text", PIECE_BYTES):
                sets = shingle_sets(batch.column(batch.schema.get_field_index("text")), width)
                marks = [fingerprint(s, seed) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())], names=["rid", "id", "n", "node", "second"])

        return stored(rows.mapInArrow(run, "rid bigint, id bigint, n bigint, node bigint, second bigint"), BATCH_ROWS)

    for seed in range(8):  # two sets that share 64 bits are told apart by another seed
        measured = measure(seed)
        nodes = stored(measured.filter("n > 0").groupBy("node").agg(F.min("rid").alias("rep"), F.min("second").alias("low"), F.max("second").alias("high"), F.first("n").alias("n")))
        if nodes.filter("low <> high").isEmpty():
            break
        discard(measured, nodes)
    else:
        raise RuntimeError("eight seeds in a row made two sets share 64 bits")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    packed, shift = frequent_table(rows, width, seed, total)
    release(spark)
    held = spark.sparkContext.broadcast(packed)
    shared = stored(shared_signatures(rows, width, percent, seed, held, shift, total), BATCH_ROWS)
    release(spark)
    wanted = shared.select("node").distinct().join(nodes.select("node", "rep"), "node").select("node", F.col("rep").alias("rid"))

    def tokens(batches):
        for batch in by_bytes(batches, "text", PIECE_BYTES):
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")), width)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    sets = stored(rows.join(wanted, "rid").select("node", "text").mapInArrow(tokens, "node bigint, tokens binary"), BATCH_ROWS)
    discard(nodes)
    release(spark)
    comps = links_between_nodes(shared, sets, percent)
    discard(shared, sets)
    named = measured.join(comps, "node", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("comp", "node")))
    least = named.filter("class is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("least"))
    return named.join(least, "class", "left").select("rid", "id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"), F.coalesce("least.rid", "rid").alias("keeper"))

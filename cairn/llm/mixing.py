"""Mixing to target weights with soft domain membership.

A softmax classifier over hashed words, fitted on rows of a labelled table, gives every document a posterior over the
domains (the label's values). Document rates r >= 0 are then fitted so that the expected tokens of each domain,
sum(r * tokens * posterior), match its target share of the token budget. The fit is projected-gradient least squares:
a rate is 1 less the row's posterior times the sum of all moves so far, projected to 0 or more, so rates are never
gathered. Distances between rates count by tokens: rows of one posterior move alike, however long they are. A move is the
residual in the metric of the rows whose rate is above 0, for which step length 1 is exact, shortened where that overshoots;
it takes one distributed sum over all documents. The fit ends where no move is left: the targets are met, or these are the
nearest shares that nonnegative rates reach, and then a warning tells them.

The classifier may see `fit_rows` labelled rows at most (by hash of the id); everything else covers all rows. Null and
empty texts have no tokens, the prior as posterior and rate 1 (nothing pulls at them). Ties and repeated rows are
documents of their own. Labels of one id that disagree are all used. More than 1024 values of the label are refused. An
empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import discard, stored
from cairn.llm.textbytes import ALNUM, LOWER, U64, by_bytes, prefix_hash, span_hash, string_bytes, words_of

FEATURES = 1024
FIT_ROWS = 8_192
#: Sums over all rows after which a fit that is not at its end is an error.
MOST_STEPS = 400
#: Weight of the distance from rate 1 against that from the targets. It only decides where the targets can't be met.
SLACK = 1e-8


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x FEATURES matrix of damped, length-normalised word counts, words of each row)."""
    data, offsets = string_bytes(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets, ALNUM)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    slot = (span_hash(prefix_hash(data), starts, ends) % U64(FEATURES)).astype(np.int64)
    x = np.bincount(row * FEATURES + slot, minlength=len(column) * FEATURES).reshape(len(column), FEATURES)
    x = np.log1p(x).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), np.diff(first)


def fit_softmax(x: np.ndarray, y: np.ndarray, n: int, ridge: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights (features + 1) x n by accelerated gradient descent; without rows, a uniform posterior."""
    w = np.zeros((x.shape[1] + 1, n))
    if not len(y):
        return w
    x = np.column_stack((x, np.ones(len(x))))
    hot = np.eye(n)[y]
    last, step = w, 1.0
    for t in range(rounds):
        ahead = w + (t / (t + 3)) * (w - last)
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        last, w = w, ahead - step * (x.T @ (p - hot) / len(y) + ridge * ahead)
    return w


def posteriors(docs: DataFrame, labelled: DataFrame, *, id_col: str, text_col: str, label_id_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list, np.ndarray]:
    """docs without the text, with n_tokens and posterior; the domains in the order of the posterior; and the classifier's weights."""
    spark = docs.sparkSession
    marks = labelled.select(F.col(f"`{label_id_col}`").alias("label_id"), F.col(f"`{label_col}`").alias("label")).filter("label_id is not null and label is not null")
    domains = [r["label"] for r in marks.select("label").distinct().orderBy("label").limit(1025).collect()]
    if len(domains) > 1024:
        raise ValueError("the label column has over 1024 values")
    chosen = marks.distinct().orderBy(F.xxhash64("label_id", "label"), "label_id", "label").limit(fit_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    names = spark.createDataFrame([(d, k) for k, d in enumerate(domains)], f"label {marks.schema['label'].dataType.simpleString()}, y int")

    def featurise(batches):
        for batch in by_bytes(batches, "text"):
            x, _ = word_features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    # an id that many rows repeat is one example for each label
    examples = rows.groupBy("id", "label").agg(F.min("text").alias("text")).join(F.broadcast(names), "label")
    sample = examples.select("text", "y").mapInArrow(featurise, "y int, x binary").toArrow()
    y = np.asarray(sample["y"]).astype(int)
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float32).reshape(len(y), FEATURES)
    weights = fit_softmax(x, y, max(1, len(domains)))
    held = spark.sparkContext.broadcast(weights)

    def predict(batches):
        for batch in by_bytes(batches, "text"):
            n, p = tokens_and_posterior(batch.column(batch.schema.get_field_index("text")), held.value)
            own = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), pa.FixedSizeListArray.from_arrays(p.reshape(-1), p.shape[1]).cast(pa.list_(pa.float64()))], names=[*(c for c in batch.schema.names if c != "text"), "n_tokens", "posterior"])

    given = docs.withColumn("text", F.col(f"`{text_col}`").cast("string")) if text_col != "text" else docs
    kept = [f for f in given.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return given.mapInArrow(predict, f"{schema}, n_tokens bigint, posterior array<double>"), domains, weights


def tokens_and_posterior(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, n = word_features(column)
    z = np.column_stack((x, np.ones(len(x)))) @ weights
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return n, p / p.sum(axis=1, keepdims=True)


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and posteriors of each row."""
    p = np.asarray(pa.compute.list_flatten(batch.column("posterior"))).reshape(batch.num_rows, -1)
    return np.asarray(batch.column("n_tokens")).astype(float), p


def rates_after(tokens: np.ndarray, p: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Rates of rows from 1 by the sum of the moves; rows without tokens stay."""
    return np.where(tokens > 0, np.maximum(0.0, 1.0 - p @ moved), 1.0)


def sums_of(tokens: np.ndarray, p: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """sum(tokens * rate * p), sum(tokens * rate^2), and sum(tokens * p p^T) over the rows whose rate is above 0."""
    r = rates_after(tokens, p, moved)
    t, q = tokens[r > 0], p[r > 0]
    return np.concatenate(((tokens * r) @ p, [(tokens * r) @ r], ((q.T * t) @ q).reshape(-1)))


def domain_sums(rows: DataFrame, moved: np.ndarray) -> np.ndarray:
    """sums_of all rows."""
    size = len(moved) + 1 + len(moved) ** 2

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += sums_of(*rows_of(batch), moved)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sums"])

    parts = rows.select("n_tokens", "posterior").mapInArrow(run, "sums array<double>")
    place = parts.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    sums = np.zeros(size)
    for r in place.collect():
        sums[r["k"]] = r["v"]
    return sums


def fit_moves(sums, shares: np.ndarray, *, steps: int = MOST_STEPS, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sum of the moves, shares of the token budget after them, and whether these meet the targets.

    sums(moved) gives what domain_sums does. The moves minimise the dual of the least squares, which is convex, so every
    end is the nearest point.
    """
    n = len(shares)
    moved = np.zeros(n)
    found = sums(moved)
    budget = float(found[:n].sum())
    wanted = shares * budget
    every = found[n + 1 :].reshape(n, n) * SLACK + 1e-12 * budget * np.eye(n)

    def height(moved, found):
        return found[n] / 2 + wanted @ moved + moved @ every @ moved / 2

    done = 1
    while True:
        off = found[:n] - wanted - every @ moved
        if np.abs(found[:n] - wanted).max() <= tolerance * budget:
            return moved, found[:n] / budget, True
        if np.abs(off).max() <= 0.1 * tolerance * budget:
            return moved, found[:n] / budget, False
        move = np.linalg.solve(found[n + 1 :].reshape(n, n) + every, off)
        now, length = height(moved, found), 1.0
        while True:
            if done >= steps:
                raise RuntimeError(f"rates not fitted after {steps} sums: shares {(found[:n] / budget).tolist()} for targets {shares.tolist()}")
            tried, done = sums(moved + length * move), done + 1
            ahead = tried[:n] - wanted - every @ (moved + length * move)
            # lower, and where rounding hides that, not past the lowest point
            if height(moved + length * move, tried) <= now - 1e-4 * length * (off @ move) or (length < 1 and abs(ahead @ move) <= 0.5 * (off @ move)):
                break
            length /= 4
        moved, found = moved + length * move, tried


def moves_to(rows: DataFrame, shares: np.ndarray, **limits) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the moves, and the expected share of each domain in the budget; rows has n_tokens and posterior.

    Where no nonnegative rates meet the targets, the nearest shares are taken, with a warning.
    """
    if not rows.agg(F.sum("n_tokens")).first()[0]:
        return np.zeros(len(shares)), np.zeros(len(shares))
    moved, reached, met = fit_moves(lambda m: domain_sums(rows, m), shares, **limits)
    if not met:
        warnings.warn(f"no rates meet the targets {shares.tolist()}; the nearest shares are {reached.tolist()}", stacklevel=4)
    return moved, reached


def with_rates(rows: DataFrame, moved: np.ndarray) -> DataFrame:
    """rows with `rate`."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_after(*rows_of(batch), moved))], names=[*batch.schema.names, "rate"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, rate double")


def fit_rates(rows: DataFrame, shares: np.ndarray, **limits) -> tuple[DataFrame, np.ndarray]:
    """rows with `rate`, and the expected share of each domain in the budget; rows has n_tokens and posterior."""
    moved, reached = moves_to(rows, shares, **limits)
    return with_rates(rows, moved), reached


def target_shares(domains: list, targets: dict) -> np.ndarray:
    """targets maps domains to weights; a domain that it leaves out gets none; without any, all get the same."""
    weights = np.array([float(targets.get(d, 0.0)) for d in domains]) if domains else np.ones(1)
    return weights / weights.sum() if weights.sum() > 0 else np.full(len(weights), 1 / len(weights))


def mixture_rates(docs: DataFrame, labelled: DataFrame, targets: dict, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list]:
    """(id, n_tokens, posterior, rate) of every row, and the domains. The rows' `shares` are those reached, by domain."""
    found, domains, _ = rows_to_fit(docs, labelled, id_col=id_col, text_col=text_col, label_id_col=label_id_col, label_col=label_col, fit_rows=fit_rows)
    rated, reached = fit_rates(found, target_shares(domains, targets))
    rated.shares = reached.tolist()
    return rated, domains


def rows_to_fit(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list, np.ndarray]:
    """Stored (id, n_tokens, posterior) of every row, the domains and the classifier's weights."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marks = labelled.select(F.col(f"`{label_id_col}`").alias("id_"), F.col(f"`{label_col}`").alias("label_"))
    found, domains, weights = posteriors(rows, marks, id_col="id", text_col="text", label_id_col="id_", label_col="label_", fit_rows=fit_rows)
    return stored(found), domains, weights


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict, *, seed: int = 29, text_col: str = "text", **columns) -> DataFrame:
    """docs with each row as often as its rate says: the whole part of it, and once more with the chance of the rest.

    A row's rate follows from its text alone (with the fitted classifier and moves), so rows and rates are never joined.
    The chance is a hash of the row's place in the scan and the seed.
    """
    found, domains, weights = rows_to_fit(docs, labelled, text_col=text_col, **columns)
    moved, _ = moves_to(found, target_shares(domains, targets))
    discard(found)
    held = docs.sparkSession.sparkContext.broadcast((weights, moved))

    @F.arrow_udf("double")
    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = by_bytes([pa.RecordBatch.from_arrays([column], names=["text"])], "text")
            done = [rates_after(*tokens_and_posterior(b.column(0), held.value[0]), held.value[1]) for b in parts]
            yield pa.array(np.concatenate([np.zeros(0), *done]))

    chance = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_doc"), rate(F.col(f"`{text_col}`").cast("string")).alias("mix_rate"), chance.alias("mix_chance"))
    times = F.floor(F.col("mix_rate") + F.col("mix_chance")).cast("int")
    return whole.withColumn("mix_times", times).filter("mix_times > 0").select("mix_doc", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("mix_doc.*")

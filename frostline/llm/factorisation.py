"""Quality classifier: a factorisation machine over hashed words and structure.

A document's features are its words (hashed, weighted by the logarithm of their count and
scaled to unit length), counts of its structure, and its recorded length. The score is a
logistic of a constant, one weight per feature and one inner product per pair of features;
by the identity 2 * sum of pairs = (sum)^2 - sum of squares, per factor, it takes time
linear in the number of features.

The model is fitted in one task on at most ``TRAIN_ROWS`` labelled documents; every document
is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.names import free_names
from frostline.llm.common import refuse_names, text_slices
from frostline.llm.shingles import shingle_sets, word_hashes

BUCKETS = 1 << 15
FACTORS = 8
TRAIN_ROWS = 10_000
EPOCHS = 6
LEAST_STEPS = 400  # of gradient, where few rows make short epochs
STEP_ROWS = 128
SCORE_CHARS = 1_000_000  # of text that a task describes at once
KEEP_FROM = 0.3
FOLDS = 5

# Byte classes whose shares describe a text.
CLASSES = ("A-Z", "a-z", "0-9", ".,;:", "!?", "#*$%&|<>", "\n", "beyond ASCII")
_CLASS = np.full(256, len(CLASSES), np.int64)
for _n, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"#*$%&|<>", b"\n")
):
    _CLASS[list(_bytes)] = _n
_CLASS[128:] = 7
STATISTICS = len(CLASSES) + 5
WIDTH = BUCKETS + STATISTICS


def statistics(texts: list[bytes], n_chars: list) -> np.ndarray:
    """Shares of byte classes, word length, words, repetition, repeated lines, length on record."""
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    kinds = len(CLASSES) + 1
    counts = np.bincount(np.repeat(np.arange(n), sizes) * kinds + _CLASS[data], minlength=n * kinds)
    shares = counts.reshape(n, kinds)[:, :-1] / np.maximum(sizes, 1)[:, None]
    _, words = word_hashes(texts)
    _, distinct = shingle_sets(texts)
    windows = np.maximum(words - 4, np.minimum(words, 1))
    lines = [t.split(b"\n") for t in texts]
    rest = [
        sizes / np.maximum(words, 1),
        np.log1p(words),
        1 - distinct / np.maximum(windows, 1),
        np.array([1 - len(set(x)) / len(x) for x in lines]),
        np.log1p(np.array([max(c or 0, 0) for c in n_chars], float)),
    ]
    return np.column_stack([shares, *rest])


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, values, number per text) of the hashed words."""
    hashes, words = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), words)
    key, times = np.unique(owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    owner, feature = key // BUCKETS, key % BUCKETS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, value**2, len(texts)))
    return feature, value / norm[owner], np.bincount(owner, minlength=len(texts))


class Model:
    """Weights, and the means and spreads by which statistics are put on one scale."""

    def __init__(self, bias, weights, factors, mean, spread):
        self.bias, self.weights, self.factors, self.mean, self.spread = bias, weights, factors, mean, spread

    def features(self, described: tuple):
        """(features, values, number per text), words and statistics together."""
        stats, feature, value, counts = described
        stats = np.clip((stats - self.mean) / self.spread, -4, 4) / 4
        at = np.repeat(np.cumsum(counts), STATISTICS)
        feature = np.insert(feature, at, np.tile(BUCKETS + np.arange(STATISTICS), len(counts)))
        return feature, np.insert(value, at, stats.reshape(-1)), counts + STATISTICS

    def margins(self, feature, value, counts) -> np.ndarray:
        first = np.cumsum(counts) - counts
        parts = value[:, None] * self.factors[feature]
        summed = np.add.reduceat(parts, first, axis=0)
        squares = np.add.reduceat(parts**2, first, axis=0)
        linear = np.add.reduceat(value * self.weights[feature], first)
        return self.bias + linear + 0.5 * (summed**2 - squares).sum(axis=1)

    def scores(self, texts: list[bytes], n_chars: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margins = self.margins(*self.features(describe(texts, n_chars)))
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def describe(texts: list[bytes], n_chars: list) -> tuple:
    """(statistics, word features, their values, number per text)."""
    feature, value, counts = word_features(texts)
    return statistics(texts, n_chars), feature.astype(np.int32), value, counts


def fit(described: list[tuple], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Logistic loss by adaptive gradient steps; the order of rows and all draws are fixed."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)), np.zeros(STATISTICS), np.ones(STATISTICS))
    rows_in_all = len(labels)
    if not rows_in_all:
        return model
    parts = tuple(np.concatenate([d[k] for d in described]) for k in range(4))
    model.mean, model.spread = parts[0].mean(axis=0), parts[0].std(axis=0) + 1e-6
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    feature, value, counts = model.features(parts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6), 1e-6
    rate, decay = 0.1, 1e-5
    epochs = max(epochs, -(-LEAST_STEPS * STEP_ROWS // rows_in_all) if rows_in_all >= STEP_ROWS else LEAST_STEPS)
    for _ in range(epochs):
        order = rng.permutation(rows_in_all)
        for at in range(0, len(order), STEP_ROWS):
            rows = order[at : at + STEP_ROWS]
            sizes = counts[rows]
            places = np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            f, x = feature[places], value[places]
            slope = 1 / (1 + np.exp(-np.clip(model.margins(f, x, sizes), -30, 30))) - labels[rows]
            owner = np.repeat(np.arange(len(rows)), sizes)
            parts = x[:, None] * model.factors[f]
            summed = np.add.reduceat(parts, np.cumsum(sizes) - sizes, axis=0)
            used, local = np.unique(f, return_inverse=True)
            step = slope[owner] * x
            grad_w = np.bincount(local, step, len(used)) / len(rows) + decay * model.weights[used]
            pull = step[:, None] * (summed[owner] - parts)
            grad_v = np.column_stack([np.bincount(local, pull[:, k], len(used)) for k in range(FACTORS)]) / len(rows)
            grad_v += decay * model.factors[used]
            grad_b = slope.mean()
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += grad_b**2
            model.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            model.factors[used] -= rate / 5 * grad_v / np.sqrt(seen_v[used])
            model.bias -= rate * grad_b / np.sqrt(seen_b)
    return model


def _to_bytes(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def train(labelled: DataFrame, epochs: int = EPOCHS) -> Model:
    """Fits on (doc_id, text, n_chars, label) rows, a bounded number, in one task."""

    def run(batches):
        seen = []  # one row at a time: (id, label, its description), so texts are let go
        for batch in text_slices(batches, chars=SCORE_CHARS):
            ids, labels = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
            stats, feature, value, counts = describe(
                _to_bytes(batch.column("text").to_pylist()), batch.column("n_chars").to_pylist()
            )
            ends = np.cumsum(counts)
            for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                own = (stats[i : i + 1], feature[a:b].copy(), value[a:b].copy(), counts[i : i + 1])
                seen.append((ids[i], labels[i], own))
        if not seen:
            return
        # rows that share id and label are ordered by what they hold
        seen.sort(key=lambda r: (r[0], r[1], r[2][1].tobytes()))
        m = fit([r[2] for r in seen], np.array([r[1] for r in seen], float), epochs)
        values = [m.weights, m.factors, m.mean, m.spread]
        yield pa.RecordBatch.from_pydict(
            {"bias": [float(m.bias)], "data": [np.concatenate([v.reshape(-1) for v in values]).astype("<f8").tobytes()]}
        )

    # a shuffle of the picked rows alone: a coalesce would read all documents in the one task
    found = labelled.repartition(1).mapInArrow(run, "bias double, data binary").collect()
    if not found:
        return fit([], np.zeros(0))
    data = np.frombuffer(found[0]["data"], "<f8")
    weights, factors, mean, spread = np.split(data, np.cumsum([WIDTH, WIDTH * FACTORS, STATISTICS]))
    return Model(found[0]["bias"], weights, factors.reshape(WIDTH, FACTORS), mean, spread)


def held_out():
    """True for the rows that are never trained on: crc32 of the id as text, one in five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, at_most: int = TRAIN_ROWS) -> DataFrame:
    """A fixed pick of at most so many labels outside the held-out fold, with their texts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    picked = known.select("doc_id", F.col("quality").cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(at_most)
    # ``at_most`` ids of eight bytes
    return docs.select("doc_id", "text", F.col("n_chars").cast("long")).join(F.broadcast(picked), "doc_id")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., score) of every document, between 0 and 1.

    Scores depend on the text and its recorded length alone. A null text counts as empty and
    is scored by its statistics; a null length counts as 0; repeated rows score alike; null
    ids are scored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    refuse_names(keep, "score")
    text, length = free_names(keep, "__text__", "__n_chars__")

    def run(batches):
        for batch in text_slices(batches, text, SCORE_CHARS):
            texts = _to_bytes(batch.column(text).to_pylist())
            scores = shared.value.scores(texts, batch.column(length).to_pylist())
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*keep, "score"])

    rows = docs.select(*keep, F.col("text").alias(text), F.col("n_chars").cast("long").alias(length))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return rows.mapInArrow(run, ", ".join([*kinds, "score double"]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, train(training_rows(docs, labels)))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= KEEP_FROM, 1).otherwise(0).cast("int").alias("predicted"),
    )

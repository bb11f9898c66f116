"""Quality: Bradley-Terry scores learned from preference pairs.

A document's strength is linear in a fixed set of text statistics (share of
capitals, digits and signs, word lengths, repetition, word shapes). A labelled
good document is preferred to a labelled bad one; the weights minimise the
logistic loss of the strength difference over such pairs. The cut between the
classes is the quantile of the training strengths that leaves the share of bad
documents below it; a score of 0.5 is that cut.

Every labelled document is learned from. Their statistics are a stored table;
mean and spread are sums over it, the weights the mean of those that shards of
bounded size learn side by side, cut and medians exact order statistics of all
strengths. Only sums, one weight vector a shard and the quantiles reach the driver.

Defined cases: a null or empty text has zero statistics and gets their score;
texts of any length are read whole; repeated rows each get their score; where
the labels hold no pair every document scores 0.5; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitae.llm.samples import held_out, labelled_documents
from vitae.llm.toxicity import score_column
from vitae.llm.words import Texts, WordHash, mix, slices, texts_of
from vitae.operators.metrics import quantiles_by
from vitae.session import materialize

#: Labelled documents of a shard, about; pairs drawn among them.
SHARD_ROWS = 8000
PAIRS = 200_000
SHAPES = 256
#: Statistics beside the word shapes.
DENSE = 21
_HASH = WordHash(seed=202, lower=True)
_U = np.uint64

_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 sentence sign, 4 other sign, 5 other byte, 6 space
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 3 if chr(_c) in ".,;:'\"-()?" else 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def statistics(t: Texts) -> np.ndarray:
    """One row of statistics per document."""
    n_docs, n_words = len(t.first) - 1, np.maximum(t.n_words, 1)
    size = np.diff(t.offsets)
    n_bytes = np.maximum(size, 1)
    kind = _CLASS[t.buf]
    doc_of_byte = np.repeat(np.arange(n_docs), size)
    by_kind = np.bincount(doc_of_byte * 7 + kind, minlength=7 * n_docs).reshape(n_docs, 7) / n_bytes[:, None]
    lines = np.bincount(doc_of_byte[t.buf == 10], minlength=n_docs)
    doc = t.doc_of_word()
    share = lambda flag: np.bincount(doc, flag, minlength=n_docs) / n_words
    length = (t.ends - t.starts).astype(float)
    h = _HASH(t.buf, t.starts, t.ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    head, last = kind[t.starts], kind[t.ends - 1]
    word_sums = np.concatenate([np.zeros((1, 2)), np.cumsum(np.c_[kind == 1, kind == 4], axis=0)])
    inner = word_sums[t.ends] - word_sums[t.starts]
    shouted = inner[:, 0] >= np.maximum(2, length / 3)
    signs = inner[:, 1] >= 2
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], new, minlength=n_docs) / n_words
    gram = np.zeros(len(h), bool)
    if len(h) > 3:
        g = h.copy()
        for k in (1, 2):
            g[:-k] = mix(g[:-k] * _U(31) + h[k:])
        order = np.lexsort((g, doc))
        gram[1:] = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        repeated = np.bincount(doc[order], gram, minlength=n_docs) / n_words
    else:
        repeated = np.zeros(n_docs)
    shape = (head.astype(np.int64) * 7 + last) * 4 + np.minimum(inner[:, 1], 3).astype(np.int64)
    shapes = np.bincount(doc * SHAPES + shape % SHAPES, minlength=SHAPES * n_docs).reshape(n_docs, SHAPES)
    dense = np.c_[np.log1p(t.n_words), np.log1p(size), by_kind, lines / n_words, share(length) / 10,
                  share(same), share(shouted), share(signs), share(length <= 2), share(length >= 16),
                  distinct, repeated, np.minimum(distinct, 0.5), np.sqrt(repeated), share(length == 1)]
    return np.c_[dense, np.sqrt(shapes / n_words[:, None])]


def _all_statistics(column: pa.Array) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    out = [statistics(texts_of(p.column(0))) for p in slices(batch, "text", 1 << 20)]
    return np.concatenate(out) if out else np.zeros((0, DENSE + SHAPES))


@dataclass
class PairModel:
    """Strength is (statistics - mean) / scale @ weights; the cut and spread map it to a score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def strength(self, stats: np.ndarray) -> np.ndarray:
        return standardise(stats, self.mean, self.scale) @ self.weights

    def scorer(self):
        def score(column: pa.Array) -> np.ndarray:
            z = (self.strength(_all_statistics(column)) - self.cut) / self.spread
            return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
        return score


def standardise(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((stats - mean) / scale, -8, 8)


def pair_weights(x: np.ndarray, labels: np.ndarray, seed: int = 11, steps: int = 1500, batch: int = 512,
                 rate: float = 0.02, decay: float = 1e-3) -> np.ndarray:
    """Weights by Adam on pairs (good, bad) drawn from labelled rows; zeros where there is no pair."""
    width = x.shape[1]
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    w = np.zeros(width)
    if len(good) and len(bad):
        rng = np.random.default_rng(seed)
        pairs = np.c_[rng.choice(good, PAIRS), rng.choice(bad, PAIRS)]
        m, v = np.zeros(width), np.zeros(width)
        for step in range(1, steps + 1):
            at = pairs[rng.integers(0, PAIRS, batch)]
            d = x[at[:, 0]] - x[at[:, 1]]
            g = -(d / (1.0 + np.exp(np.clip(d @ w, -35, 35)))[:, None]).mean(0) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def pair_model(mean, scale, w, n_good: int, n_bad: int, quantiles) -> PairModel:
    """The model of the weights; ``quantiles()`` gives the cut and the medians of good and bad strengths."""
    if not w.any():  # no pair: every text is as likely as what there was to learn from
        return PairModel(mean, scale, w, float(n_bad > 0) - float(n_good > 0), 1.0)
    cut, good, bad = quantiles()
    return PairModel(mean, scale, w, float(cut), max(abs(float(good - bad)) / 8, 1e-6))


def train(stats: np.ndarray, labels: np.ndarray, **how) -> PairModel:
    """Fit strengths to labelled rows that are at hand."""
    width = stats.shape[1]
    mean, scale = (stats.mean(0), stats.std(0) + 1e-3) if len(stats) else (np.zeros(width), np.ones(width))
    x = standardise(stats, mean, scale)
    w = pair_weights(x, labels, **how)
    s, n_bad = x @ w, int((labels == 0).sum())
    return pair_model(mean, scale, w, int((labels == 1).sum()), n_bad, lambda: (
        np.quantile(s, n_bad / len(labels)), np.median(s[labels == 1]), np.median(s[labels == 0])))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(b) for b in column.to_pylist()]).reshape(-1, DENSE + SHAPES)


def _moments(table: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(good, bad, mean, standard deviation) of the statistics, from one row of sums a task."""
    def sums(batches):
        n = good = 0
        mean, m2 = np.zeros(DENSE + SHAPES), np.zeros(DENSE + SHAPES)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("stats"))
                gap = x.mean(0) - mean
                m2 += ((x - x.mean(0)) ** 2).sum(0) + gap * gap * (n * len(x) / (n + len(x)))
                mean += gap * (len(x) / (n + len(x)))
                n, good = n + len(x), good + int(np.sum(b.column("label").to_numpy() == 1))
        yield pa.RecordBatch.from_pydict({"n": [n], "good": [good], "mean": [mean.tobytes()], "m2": [m2.tobytes()]})

    got = [r for r in table.mapInArrow(sums, "n long, good long, mean binary, m2 binary").collect() if r["n"]]
    n = sum(r["n"] for r in got)
    if not n:
        return 0, 0, np.zeros(DENSE + SHAPES), np.ones(DENSE + SHAPES)
    means = np.array([np.frombuffer(r["mean"]) for r in got])
    share = np.array([r["n"] / n for r in got])[:, None]
    mean = (share * means).sum(0)
    spread = sum(np.frombuffer(r["m2"]) for r in got) / n + (share * (means - mean) ** 2).sum(0)
    good = sum(r["good"] for r in got)
    return good, n - good, mean, np.sqrt(spread)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, rest: int = 1,
        rows: int = SHARD_ROWS) -> PairModel:
    """Learn from every labelled document; a shard of about ``rows`` of them is one task's work."""
    @F.arrow_udf("binary")
    def stats(column: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for r in _all_statistics(column)], pa.binary())

    table = materialize(labelled_documents(docs, labels, label, mod, rest, rows)
                        .select("doc_id", "label", "shard", stats("text").alias("stats")), "quality-statistics")
    good, bad, mean, std = _moments(table)
    scale = std + 1e-3 if good + bad else std

    def learn(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("doc_id")
        y = shard["label"].to_numpy()
        w = pair_weights(standardise(_matrix(shard["stats"]), mean, scale), y)
        return pa.table({"n": [len(y) if w.any() else 0], "weights": [w.tobytes()]})

    learned = table.groupBy("shard").applyInArrow(learn, "n long, weights binary").where("n > 0").collect()
    total = sum(r["n"] for r in learned)
    w = sum((np.frombuffer(r["weights"]) * (r["n"] / total) for r in learned), np.zeros(DENSE + SHAPES))

    def strengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"label": b.column("label").cast(pa.string()), "s": pa.array(
                standardise(_matrix(b.column("stats")), mean, scale) @ w, pa.float64())})

    def quantiles():
        s = materialize(table.mapInArrow(strengths, "label string, s double"), "quality-strengths")
        cut = quantiles_by(s.select(F.lit("all").alias("label"), "s"), "label", "s", ["all"], [bad / (good + bad)], ["q"]).first()["q"]
        middle = {r["label"]: r["q"] for r in quantiles_by(s, "label", "s", ["0", "1"], [0.5], ["q"]).collect()}
        return cut, middle["1"], middle["0"]

    return pair_model(mean, scale, w, good, bad, quantiles)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    model = fit(docs, labels)
    return (docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"),
                        score_column(docs.sparkSession, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))

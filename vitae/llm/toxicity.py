"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-cased words, pairs of neighbours, and pairs
one and two words apart, hashed into ``2**BITS`` coordinates with their counts.
Training (McMahan et al., "Ad Click Prediction", 2013) keeps a per-coordinate
learning rate and an L1 penalty, so few coordinates end up with a weight; only
those are shipped to the executors. Every labelled document is learned from: shards
of bounded size learn side by side and their weights are averaged (Zinkevich et al.,
"Parallelized Stochastic Gradient Descent", 2010).

Defined cases: a null or empty text has no feature and gets the bias's score;
texts of any length are read whole; repeated rows each get their score; an
empty label table gives a model without weights and a low constant score;
other columns of the documents, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitae.llm.samples import held_out, labelled_documents
from vitae.llm.words import Texts, WordHash, mix, slices, texts_of

BITS = 22
#: Labelled documents of a shard, about.
SHARD_ROWS = 12000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.7, 1.0, 5.0, 0.05
_HASH = WordHash(seed=101, lower=True)
_U = np.uint64


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every feature occurrence in the batch."""
    words = _HASH(t.buf, t.starts, t.ends)
    doc = t.doc_of_word()
    docs, coords = [doc], [words]
    for gap in (1, 2, 3):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = mix(words[:-gap] * _U(0x9E3779B97F4A7C15) + words[gap:] + _U(gap))
            docs.append(doc[gap:][same])
            coords.append(pair[same])
    return np.concatenate(docs), (np.concatenate(coords) >> _U(64 - BITS)).astype(np.int64)


@dataclass
class FtrlModel:
    """Bias, and the coordinates that have a weight."""

    bias: float
    coords: np.ndarray
    weights: np.ndarray

    def scorer(self):
        table = np.zeros(1 << BITS, np.float32)
        table[self.coords] = self.weights

        def score(column: pa.Array) -> np.ndarray:
            out = []
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            for part in slices(batch, "text"):
                t = texts_of(part.column(0))
                doc, coord = features(t)
                z = np.bincount(doc, table[coord], minlength=len(part)) + self.bias
                out.append(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))
            return np.concatenate(out) if out else np.zeros(0)
        return score


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> FtrlModel:
    """Fit on labelled texts, one example at a time, ``EPOCHS`` times in a seeded order."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        doc, coord = features(texts_of(part.column(0)))
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(len(part) + 1))
        for i in range(len(part)):
            c, n = np.unique(coord[order[cut[i]:cut[i + 1]]], return_counts=True)
            rows.append((c.astype(np.int32), n.astype(np.float32)))
    pos = float(labels.sum())
    bias = np.log((pos + 0.5) / (len(labels) - pos + 1.5))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_n = 1.0
    rng = np.random.default_rng(seed)

    def weight(zc, nc):
        w = -(zc - np.sign(zc) * L1) / ((BETA + np.sqrt(nc)) / ALPHA + L2)
        w[np.abs(zc) <= L1] = 0
        return w

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            c, x = rows[i]
            zc, nc = z[c], n[c]
            w = weight(zc, nc)
            p = 1.0 / (1.0 + np.exp(-np.clip(float(w @ x) + bias, -35, 35)))
            miss = p - labels[i]
            g = miss * x
            g2 = nc + g * g
            z[c] = zc + g - (np.sqrt(g2) - np.sqrt(nc)) / ALPHA * w
            n[c] = g2
            bias_n += miss * miss
            bias -= ALPHA * miss / np.sqrt(bias_n)
    used = np.flatnonzero(np.abs(z) > L1)
    return FtrlModel(float(bias), used.astype(np.int32), weight(z[used], n[used]).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, rest: int = 0,
        rows: int = SHARD_ROWS) -> FtrlModel:
    """Learn from every labelled document, a shard of about ``rows`` a task; the mean weights reach the driver."""
    def learn(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("doc_id").combine_chunks()
        m = train(shard["text"].combine_chunks(), shard["label"].to_numpy().astype(float))
        # the bias stands at coordinate -1
        return pa.table({"coord": np.r_[-1, m.coords].astype(np.int32), "weight": np.r_[np.float64(m.bias), m.weights.astype(np.float64)],
                         "n": np.full(len(m.coords) + 1, len(shard), np.int64)})

    learned = labelled_documents(docs, labels, label, mod, rest, rows).groupBy("shard").applyInArrow(
        learn, "coord int, weight double, n long")
    # at most 2 ** BITS coordinates, however many shards
    got = learned.groupBy("coord").agg(F.sum(F.col("weight") * F.col("n")).alias("sum"), F.sum("n").alias("n")).orderBy("coord").toArrow()
    if not got.num_rows:
        return FtrlModel(float(np.log(0.5 / 1.5)), np.zeros(0, np.int32), np.zeros(0, np.float32))
    total = got["n"][0].as_py()  # each shard has a bias
    mean = got["sum"].to_numpy() / total
    return FtrlModel(float(mean[0]), got["coord"].to_numpy()[1:].astype(np.int32), mean[1:].astype(np.float32))


def score_column(spark, model, text: str = "text"):
    """A column with the model's score of each whole text, computed over Arrow batches."""
    shared = spark.sparkContext.broadcast(model)
    made = []

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        if not made:
            made.append(shared.value.scorer())
        return pa.array(made[0](column), pa.float64())

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    model = fit(docs, labels)
    return (docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"),
                        score_column(docs.sparkSession, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))

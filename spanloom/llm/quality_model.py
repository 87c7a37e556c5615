"""Quality classifier: supervised subword embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common, learn

#: Labelled documents that are learnt from at most, a bounded sample; the rest of the training. Slots that fewer examples have get no vector.
EXAMPLES, DIM, EPOCHS, RATE, SEED, SUPPORT = 2000, 16, 6, 0.5, 11, 2
THRESHOLD = 0.3


def train(data: pd.DataFrame, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> learn.Model:
    """Learns a vector for each slot and a softmax layer over their average, by stochastic gradient descent.

    data: y, slots, counts. Without examples of both labels the model says 1 as often as the examples do. With a linear
    softmax over an average, a weight for each slot and a bias are all that scoring needs of the vectors.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    y = data["y"].to_numpy(int)
    if len(set(y.tolist())) < 2:
        p = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
        return learn.Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(p / (1 - p))), lower=False, mean=True, pairs=True)
    seen = np.zeros(learn.SLOTS, np.int32)
    for s in data["slots"]:
        seen[s] += 1
    used = np.flatnonzero(seen >= SUPPORT)
    place = np.full(learn.SLOTS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    slots, share = [], []
    for s, c in zip(data["slots"], data["counts"]):
        at = place[s]
        slots.append(at[at >= 0])
        share.append((c[at >= 0] / max(c.sum(), 1)).astype(np.float32))
    vectors = rng.random((len(used), dim), dtype=np.float32)  # in place: no copy of the largest table in the driver
    vectors -= np.float32(0.5)
    vectors *= np.float32(2 / dim)
    layer, bias = np.zeros((dim, 2), np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    done, total = 0, epochs * len(y)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            now = rate * (1 - done / total)
            done += 1
            mean = share[i] @ vectors[slots[i]]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the loss by z
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            # each slot by its share, scaled up so that rare features move: the mean of many vectors has small gradients
            vectors[slots[i]] -= (now * np.minimum(share[i] * len(share[i]), 4.0))[:, None] * back
    return learn.Model(used, vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]), lower=False, mean=True, pairs=True)


def fit(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> learn.Model:
    """A model from at most `limit` labelled documents outside the held-out fold."""
    return train(learn.examples(docs, learn.draw(learn.labelled(labels, "quality"), limit), lower=False, pairs=True))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text), learnt from `labels` (doc_id, quality).

    A document is the average of hashed vectors of its words, of its pairs of neighbouring words and of the n-grams of its
    words' characters, over its whole text; only its text is read. Null and empty texts have the score of the bias alone.
    Null doc_id: not held out. Null labels are left out; without labels of both kinds all texts have one score. Repeated
    rows have the same score. Other columns are not read. An empty table gives an empty result.
    """
    return learn.scored(docs, fit(docs, labels), THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the model doesn't reject, each by its own text, with their columns unchanged.

    Null and empty texts are kept unless bad documents are the more usual by far, as the bias alone decides. Rows without doc_id and
    rows that repeat one are judged as any other. An empty table gives an empty result.
    """
    return learn.passing(docs, fit(docs, labels), THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

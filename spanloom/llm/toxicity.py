"""Toxicity: non-negative learning from confirmed positives and unlabelled texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learn

#: Confirmed toxic and unlabelled documents that are learnt from at most, bounded samples; labelled rows that the prior is taken from are all.
POSITIVES, UNLABELLED = 4000, 8000
EPOCHS, BATCHES, RATE, DECAY, SEED = 60, 8, 0.05, 1e-3, 5
#: A slot is used if at least so many positives have it, so many times more often than negatives, and by so many standard errors; the most certain ones, at most.
SUPPORT, LIFT, Z, MOST = 4, 2.0, 3.5, 30_000
#: Tasks that count slots, and slots that are put together at once.
PARTS, SLICE = 8, 1 << 14
#: Share of the negatives in the learning sample that may pass for toxic; it sets the bias.
PASSING = 0.005
THRESHOLD = 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _rates(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Which slots are used, and by how many standard errors positives have each more often than negatives."""
    rate_p = in_p / n_p
    # the rate of a slot among negatives: that of unlabelled texts less the positives among them
    negative = np.maximum(in_u / n_u - prior * rate_p, 0) / (1 - prior)
    spread = np.sqrt(negative * (1 - negative) / n_p + (in_u + 1) / n_u**2)
    z = (rate_p - negative) / spread
    return (in_p >= SUPPORT) & (rate_p >= LIFT * (negative + 1 / n_u)) & (z >= Z), z


class _Rows:
    """Texts as lists of used slots, end to end."""

    def __init__(self, slots: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in slots], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.int32), *slots])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of some rows, and the place of each one's row."""
        sizes = self.sizes[rows]
        begin = np.repeat(self.at[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return self.flat[begin + np.arange(sizes.sum())], np.repeat(np.arange(len(rows)), sizes)


def train(y: np.ndarray, slots: list[np.ndarray], width: int, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model of the presence of `width` slots, by the non-negative estimate of the risk.

    y: 1 confirmed positive, 0 unlabelled. With l the logistic loss and p the class prior the risk is
    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]): the loss of negatives, got from unlabelled texts less the positives among
    them, can't be less than nothing. Where a batch has it under zero, a step is taken back up that part. Adam steps that shrink to nothing.
    Then the bias is set so that, by the same estimate, PASSING of the negatives pass.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    positive, rest = (_Rows([s for s, v in zip(slots, y) if v == k]) for k in (1, 0))
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    if not width or not len(positive.sizes) or not len(rest.sizes):
        return w, b
    m, v, t = np.zeros(width + 1), np.zeros(width + 1), 0
    for _ in range(epochs):
        for ip, iu in zip(np.array_split(rng.permutation(len(positive.sizes)), BATCHES), np.array_split(rng.permutation(len(rest.sizes)), BATCHES)):
            if not len(ip) or not len(iu):
                continue
            (sp, rp), (su, ru) = positive.take(ip), rest.take(iu)
            gp, gu = np.bincount(rp, w[sp], len(ip)) + b, np.bincount(ru, w[su], len(iu)) + b
            # d l(g)/dg = sigmoid(g) - 1; d l(-g)/dg = sigmoid(g)
            negatives = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            du, dp = _sigmoid(gu) / len(iu), -prior * _sigmoid(gp) / len(ip)
            if negatives < 0:
                du, dp = -du, -dp
            else:
                dp = dp + prior * (_sigmoid(gp) - 1) / len(ip)
            gradient = np.concatenate([np.bincount(su, du[ru], width) + np.bincount(sp, dp[rp], width) + DECAY * w, [du.sum() + dp.sum()]])
            t += 1
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            step = RATE * (1 - t / (epochs * BATCHES + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    gp, gu = (np.bincount(r, w[s], len(x.sizes)) for x in (positive, rest) for s, r in [x.take(np.arange(len(x.sizes)))])
    levels = np.sort(np.unique(np.concatenate([gp, gu])))
    above = lambda g: 1 - np.searchsorted(np.sort(g), levels, "left") / len(g)
    passed = (above(gu) - prior * above(gp)) / (1 - prior)
    fits = levels[(passed <= PASSING) & (levels > 0)]
    return w, float(-fits[0] + 1e-6) if len(fits) else b


def _counts(sample: DataFrame, prior: float, n_p: int, n_u: int) -> pd.DataFrame:
    """slot, z of the slots that are used: counted over the sample by a few tasks, put together and chosen slice by slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, learn.SLOTS), np.int32)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                have[y][learn.counted(text.as_py(), True, heads=True)[0]] += 1
        for k in range(0, learn.SLOTS, SLICE):
            part = have[:, k : k + SLICE]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": [k], "n": [part.tobytes()]}, pa.schema([("slice", pa.int32()), ("n", pa.binary())]))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.frombuffer(x, np.int32).reshape(2, -1).astype(np.int64) for x in pdf["n"])
        used, z = _rates(n[1], n[0], n_p, n_u, prior)
        at = np.flatnonzero(used)
        return pd.DataFrame({"slot": (at + int(pdf["slice"].iloc[0])).astype("int32"), "z": z[at]})

    chosen = sample.select("text", "y").mapInArrow(count, "slice int, n binary").groupBy("slice").applyInPandas(choose, "slot int, z double")
    return chosen.orderBy(F.desc("z"), "slot").limit(MOST).toPandas()


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> learn.Model:
    """A model from bounded samples outside the held-out fold: confirmed positives, and documents whose labels aren't looked at.

    Slots are counted where the texts are; the driver gets the slots that are used, and which of them each document of the samples has.
    """
    known = learn.labelled(labels, "toxic")
    prior = known.agg(F.avg("y")).first()[0]
    nothing = np.zeros(0, np.int32)
    if not prior:
        return learn.Model(nothing, np.zeros(0), -5.0, lower=True, mean=False, heads=True)
    prior = min(max(float(prior), 1e-3), 0.999)
    toxic = learn.draw(known.where("y = 1"), positives)
    others = docs.where(F.col("doc_id").isNotNull() & ~learn.held_out(F.col("doc_id"))).select("doc_id").distinct().withColumn("y", F.lit(0))
    chosen = toxic.unionByName(learn.draw(others, unlabelled))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(PARTS, F.xxhash64("doc_id"))
    sample = common.stored(sample.sortWithinPartitions("doc_id", "y", "text"), "sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = np.sort(_counts(sample, prior, sizes[1], sizes[0])["slot"].to_numpy()) if sizes.get(1) and sizes.get(0) else nothing
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # MOST numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(learn.SLOTS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for batch in batches:
            at = [place[learn.counted(x.as_py(), True, heads=True)[0]] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[x >= 0].tobytes() for x in at], pa.binary())], names=["doc_id", "y", "at"])

    data = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("y").cast("int").alias("y")).mapInArrow(run, "doc_id long, y int, at binary").toPandas()
    data = data.sort_values(["doc_id", "y", "at"], kind="stable")
    weights, bias = train(data["y"].to_numpy(), [np.frombuffer(x, np.int32) for x in data["at"]], len(slots), prior)
    return learn.Model(slots, weights, bias, lower=True, mean=False, heads=True)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text), learnt from `labels` (doc_id, toxic).

    Features are the words of the whole text, the n-grams of their characters and their beginnings, A-Z in lower case; only
    the text is read. Null and empty texts have the score of the bias alone. Null doc_id: not held out. Null labels are
    left out; without confirmed positives every score is low. Repeated rows have the same score. Other columns are not
    read. An empty table gives an empty result.
    """
    return learn.scored(docs, fit(docs, labels), THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

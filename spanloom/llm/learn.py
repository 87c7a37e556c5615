"""What the two classifiers share: hashed features of whole texts, bounded samples of labelled rows, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textnum import mix, runs

#: Features are hashed into so many slots, a power of two; n-grams have these sizes, in characters, with the space on either side of a word.
SLOTS, GRAMS = 1 << 20, (3, 4, 5)
#: Beginnings of words, with the space before, go up to so many characters where they are asked for.
HEAD = 10
#: Characters of text whose features are made at once.
CHUNK = 1 << 17


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _code_points(text: str, lower: bool) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((data >= 65) & (data <= 90), data + np.uint32(32), data) if lower else data


def _words(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words."""
    edge = np.diff(np.concatenate([[True], (chars == 32) | ((chars >= 9) & (chars <= 13)), [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _slots(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(16))) & np.uint32(SLOTS - 1)).astype(np.int32)


def _kind(n: int) -> np.uint32:
    return np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)


def features(text: str | None, lower: bool, pairs: bool = False, heads: bool = False) -> Iterator[np.ndarray]:
    """Slots of a text's words, of the n-grams of characters of its words, and of its pairs of neighbouring words or of the beginnings of its words, one entry for each occurrence.

    A pair is told by its two words whatever their order, so two equal words are one and the same pair for all words.
    A long text is taken part by part, cut between words; the word before a part is kept for the pair across.
    """
    chars = _code_points(text or "", lower)
    begins, ends = _words(chars)
    k, before = 0, None
    while k < len(begins):
        stop = max(k + 1, int(np.searchsorted(ends, begins[k] + CHUNK, "right")))
        low = int(begins[k])
        flat = np.concatenate([[32], chars[low : int(ends[stop - 1])], [32]]).astype(np.uint32)
        first, last = begins[k:stop] - low + 1, ends[k:stop] - low + 1
        k = stop
        whole = runs(mix(flat.astype(np.uint64)), first, last, 0)  # a word's hash wherever it stands
        yield (whole & np.uint64(SLOTS - 1)).astype(np.int32)
        if pairs:
            run = whole if before is None else np.concatenate([before, whole])
            yield _slots(((run[1:] ^ run[:-1]) >> np.uint64(32)).astype(np.uint32) ^ _kind(77))
            before = whole[-1:]
        space = (flat == 32) | ((flat >= 9) & (flat <= 13))
        flat[space] = 32
        seen = np.cumsum(space, dtype=np.int32)
        gram = flat
        for n in range(2, max(GRAMS) + 1):
            m = len(flat) - n + 1
            if m < 1:
                break
            gram = gram[:m] * np.uint32(0x01000193) + flat[n - 1 :]
            if n in GRAMS:
                inner = seen[n - 2 : n - 2 + m] - seen[:m]  # spaces that are neither its first character nor its last
                yield _slots(gram[inner == 0] ^ _kind(n))
        if heads:
            at, h = first, np.full(len(first), 32, np.uint32)
            for n in range(2, HEAD + 1):
                left = at + n - 2 < last
                at, last, h = at[left], last[left], h[left]
                h = h * np.uint32(0x01000193) + flat[at + n - 2]
                if n > max(GRAMS):
                    yield _slots(h ^ _kind(n))


def counted(text: str | None, lower: bool, pairs: bool = False, heads: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text, and how often it has each."""
    total = (np.zeros(0, np.int32), np.zeros(0, np.int64))
    parts = [np.unique(x, return_counts=True) for x in features(text, lower, pairs, heads)]
    if parts:
        slots, back = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
        total = (slots, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64))
    return total[0].astype(np.int32), total[1].astype(np.int32)


_EXAMPLE = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])


def examples(docs: DataFrame, chosen: DataFrame, lower: bool, pairs: bool = False) -> pd.DataFrame:
    """doc_id, y, slots, counts of the documents in `chosen` (doc_id, y), which has a bounded number of rows.

    Texts stay where they are; what comes to the driver are at most SLOTS counts for each chosen document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at, n = counted(text, lower, pairs)
                yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "y": [y], "slots": [at.tobytes()], "counts": [n.tobytes()]}, schema=_EXAMPLE)

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    out = rows.mapInArrow(run, "doc_id long, y int, slots binary, counts binary").toPandas().sort_values(["doc_id", "y"], kind="stable", ignore_index=True)
    for c in ("slots", "counts"):
        out[c] = [np.frombuffer(x, np.int32) for x in out[c]]
    return out


def draw(rows: DataFrame, n: int) -> DataFrame:
    """At most `n` of `rows` (doc_id, y), by a hash of doc_id: the same ones in every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: rows that may be learnt from. A document that is labelled twice counts as 1 if any row says so."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


@dataclass(frozen=True)
class Model:
    """Weights of some slots and a bias, and how a text's features are made and put together.

    mean: the mean weight over all occurrences of features counts, where slots that aren't in `slots` weigh nothing; else the sum
    over the distinct slots.
    """

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    lower: bool
    mean: bool
    pairs: bool = False
    heads: bool = False


def _scorer(spark: SparkSession, model: Model) -> Callable[[pa.Array], np.ndarray]:
    """What gives the scores of a column of texts, in a task."""
    table = np.zeros(SLOTS, np.float32)  # SLOTS numbers, whatever the input
    table[model.slots] = model.weights
    shared = spark.sparkContext.broadcast(table)
    bias, lower, mean, pairs, heads = model.bias, model.lower, model.mean, model.pairs, model.heads

    def scores(texts: pa.Array) -> np.ndarray:
        table = shared.value
        used = table != 0
        z = np.empty(len(texts))
        for k, text in enumerate(texts):
            total, count, seen = 0.0, 0, [np.zeros(0, np.int32)]
            for slots in features(text.as_py(), lower, pairs, heads):
                if mean:
                    total += float(table[slots].sum(dtype=np.float64))
                    count += len(slots)
                else:
                    seen.append(slots[used[slots]])
            if not mean:
                total, count = float(table[np.unique(np.concatenate(seen))].sum(dtype=np.float64)), 1
            z[k] = bias + total / max(count, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def passing(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of `docs` whose own text scores at least `threshold`, with their columns unchanged; nothing is joined or exchanged."""
    scores = _scorer(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted: the logistic function of the bias and of the mean weight of a text's features, or of the sum over its distinct ones."""
    scores = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

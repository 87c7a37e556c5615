"""Repeated passages by compaction of a de Bruijn graph of words."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .textnum import bytes_of, runs, spans, word_hashes

#: Words of a window (an edge of the graph), and words of the shorter runs of which the least in a window names its path.
WINDOW, SEED = 50, 8

_PATHS = pa.schema([("seed", pa.int64()), ("path", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("starts", pa.list_(pa.int32()))])


def _tag(data: bytes) -> int:
    """Tells rows with the same doc_id and different texts apart."""
    return zlib.crc32(data) - (1 << 31)


def paths(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows that share their seed: hash of the seed, hash of the words of the run, windows in it, first window.

    A window's seed is the least hash among its runs of `seed` words, the first of equals: a choice by content, so that
    equal stretches of text part into equal paths wherever they stand, but for the paths at their ends.
    """
    n = len(words) - window + 1
    at = np.arange(len(words) - seed + 1)
    order = runs(words, at, at + seed, 1)
    least = np.arange(n) + np.lib.stride_tricks.sliding_window_view(order, window - seed + 1).argmin(1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    return order[least[first]].view(np.int64), runs(words, first, first + count + window - 1, 2).view(np.int64), count.astype(np.int32), first.astype(np.int32)


def _path_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {f.name: [] for f in _PATHS}
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = bytes_of(text.as_py() or "")
                begins, ends = spans(data)
                if doc_id.as_py() is None or len(begins) < window:
                    continue
                seeds, path, n, first = paths(word_hashes(data, begins, ends), window, seed)
                _, one, group = np.unique(np.stack([seeds, path]), axis=1, return_index=True, return_inverse=True)
                order = np.argsort(group.ravel(), kind="stable")
                starts = np.split(first[order], np.cumsum(np.bincount(group.ravel()))[:-1])
                tag = _tag(data)
                out["seed"].append(seeds[one])
                out["path"].append(path[one])
                out["n"].append(n[one])
                out["doc_id"].append(np.full(len(one), doc_id.as_py()))
                out["tag"].append(np.full(len(one), tag, np.int32))
                out["starts"].extend(starts)
            if out["starts"]:
                size = np.cumsum([0, *map(len, out["starts"])])
                lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(out["starts"])))
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(out[k]), _PATHS.field(k).type) for k in _PATHS.names[:-1]], lists], schema=_PATHS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "seed long, path long, n int, doc_id long, tag int, starts array<int>")


def _squeezed(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, tag, text (compressed), rest (the columns in `carry`, if any): texts as they are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [None if x is None else x.encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_tag(x or b"") for x in data], pa.int32()), pa.array([None if x is None else press.compress(x) for x in data], pa.binary()), *batch.columns[2:]], names=["doc_id", "tag", "text", *rest]
            )

    rest = ["rest"] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.struct(*carry).alias(r) for r in rest])
    schema = StructType.fromDDL("doc_id long, tag int, text binary")
    return rows.mapInArrow(run, StructType([*schema, *[rows.schema[r] for r in rest]]))


def _edges(asked: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """seed, path, k, edge, least: the hash of the kth window of each path in `asked` (seed, path, n, least, doc_id, tag, start), taken from the text at its coordinate."""
    wanted = asked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("seed", "path", "n", "start")).alias("paths"))
    rows = _squeezed(docs).join(wanted, ["doc_id", "tag"]).select("doc_id", "text", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, asked_paths in zip(*(batch.column(i) for i in range(3))):
                data = np.frombuffer(zstandard.decompress(text.as_py()), np.uint8)
                words = word_hashes(data, *spans(data))
                part = asked_paths.values.flatten()
                seeds, path, n, start = (x.to_numpy(zero_copy_only=False) for x in part)
                begin = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                k = begin - np.repeat(start, n)
                # a window may be asked for twice; each is hashed where it stands
                edge = runs(words, begin.astype(np.int64), begin.astype(np.int64) + window, 3).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(seeds, n)), pa.array(np.repeat(path, n)), pa.array(k, pa.int32()), pa.array(edge), pa.array(np.full(len(k), doc_id.as_py()), pa.int64())], names=["seed", "path", "k", "edge", "least"])

    return rows.mapInArrow(run, "seed long, path long, k int, edge long, least long")


def repeated(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, tag, spans (begin, end in words): runs of windows of `docs` (doc_id, text) that also start in a document with a smaller doc_id.

    Edges of the graph are windows; a path is a run of edges that share their seed. A seed in one document only can't be
    part of a repeat. Where a seed has one path in the corpus, no branch leaves it, and the smallest doc_id of the path
    holds for all its edges. Paths that branch are taken apart: the edges of one occurrence of each are hashed from the text at
    its coordinate, and a join by edge gives each its smallest doc_id. Counts and least ids are taken before rows are
    exchanged; rows of a hot seed or path are joined, never gathered.
    """
    rows = common.stored(_path_rows(docs, window, seed), "paths")
    seeds = rows.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("path").alias("one"), F.max("path").alias("other"))
    shared = seeds.where("low < high").select("seed", "low", (F.col("one") != F.col("other")).alias("branches"))
    rows = common.stored(rows.join(shared, "seed"), "shared")

    span = lambda begin, stop: F.struct(begin.alias("begin"), stop.alias("stop"))
    whole = rows.where("NOT branches AND doc_id > low").select("doc_id", "tag", F.transform("starts", lambda s: span(s, s + F.col("n"))).alias("found"))

    forks = rows.where("branches")
    asked = forks.groupBy("seed", "path", "n").agg(F.min(F.struct("doc_id", "tag", F.get("starts", F.lit(0)).alias("start"))).alias("first"))
    edges = common.stored(_edges(asked.select("seed", "path", "n", "first.*"), docs, window), "edges")
    least = edges.groupBy("seed", "edge").agg(F.min("least").alias("low"))
    known = edges.select("seed", "path", "k", "edge").join(least, ["seed", "edge"]).groupBy("seed", "path").agg(F.collect_list(F.struct("k", "low")).alias("edges"))
    hits = forks.select("seed", "path", "doc_id", "tag", "starts").join(known, ["seed", "path"])
    # the edges of a path that a smaller doc_id has, as runs of neighbours; a path's occurrences stay in one row
    ks = F.array_distinct(F.transform(F.filter("edges", lambda e: e["low"] < F.col("doc_id")), lambda e: e["k"]))
    hits = hits.select("doc_id", "tag", "starts", F.array_sort(ks).alias("ks")).where(F.size("ks") > 0)
    ends = lambda step: F.filter("ks", lambda k: ~F.array_contains("ks", k + F.lit(step)))
    runs_ = F.zip_with(ends(-1), ends(1), lambda lo, hi: F.named_struct(F.lit("lo"), lo, F.lit("hi"), hi))
    found = F.flatten(F.transform(runs_, lambda r: F.transform("starts", lambda s: span(s + r["lo"], s + r["hi"] + 1))))
    both = whole.unionByName(hits.select("doc_id", "tag", found.alias("found")))
    return both.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("found")).alias("spans"))


def cut(docs: DataFrame, window: int = WINDOW, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for each row of `docs` (doc_id, text), and rest, a struct of the row's columns in `carry`, if any.

    Removes each word that a window of `window` words covers whose words also start in a document with a smaller
    doc_id; windows are judged on the input. kept_sha256 is that of the kept words joined by one space; kept_text is the
    text without the removed words and the space after each, and the text itself where nothing is removed.

    Null text: no words, null kept_text. Null doc_id: neither loses words nor makes others lose them. Rows
    that repeat a doc_id count as one document: none makes the other lose words. Other columns are not read. An
    empty table gives an empty result.
    """
    found = repeated(docs, window, seed).select(F.col("doc_id").alias("f_id"), F.col("tag").alias("f_tag"), "spans")
    rest = ["rest"] if carry else []
    rows = _squeezed(docs, carry).join(found, (F.col("doc_id") == F.col("f_id")) & (F.col("tag") == F.col("f_tag")), "left").select("doc_id", "text", "spans", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (doc_id, text, spans_) in enumerate(zip(*(batch.column(i) for i in range(3)))):
                yield _row(doc_id, text.as_py(), spans_, [c.slice(k, 1) for c in batch.columns[3:]])

    def _row(doc_id: pa.Scalar, squeezed: bytes | None, found_spans: pa.Scalar, others: list[pa.Array]) -> pa.RecordBatch:
        raw = b"" if squeezed is None else zstandard.decompress(squeezed)
        begins, ends = spans(np.frombuffer(raw, np.uint8))
        keep, text = np.ones(len(begins), bool), None if squeezed is None else raw
        if found_spans.is_valid:
            lo, hi = (x.to_numpy(zero_copy_only=False) for x in found_spans.values.flatten())
            depth = np.bincount(lo, minlength=len(begins) + 1) - np.bincount(hi + window - 1, minlength=len(begins) + 1)
            keep = np.cumsum(depth[: len(begins)]) == 0
            text = _without(raw, begins, ends, keep)
        words = b" ".join([raw[a:b] for a, b in zip(begins[keep].tolist(), ends[keep].tolist())])
        return pa.RecordBatch.from_arrays(
            [pa.array([doc_id.as_py()], pa.int64()), pa.array([len(begins)], pa.int64()), pa.array([len(begins) - int(keep.sum())], pa.int64()), pa.array([hashlib.sha256(words).hexdigest()]), pa.array([None if text is None else text.decode()], pa.string()), *others],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *rest],
        )

    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return rows.mapInArrow(run, StructType([*schema, *[rows.schema[r] for r in rest]]))


def _without(raw: bytes, begins: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """The text without the words that aren't kept and the white space after them."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
    out, at = [], 0
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(raw[at : int(begins[lo])])
        at = int(begins[hi]) if hi < len(begins) else len(raw)
    return b"".join([*out, raw[at:]]).rstrip(b" \t\n\x0b\x0c\r") if len(edges) else raw


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")

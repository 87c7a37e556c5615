"""Packing token streams into training sequences: order-preserving dynamic programming over cuts."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .units import byte_units

LENGTH = 2048
END_ID = 1
#: Cost, in padded tokens, of a cut after a sentence and of one elsewhere in a document.
SENTENCE_CUT, FREE_CUT = 1.0, 8.0
#: Where no document or sentence ends within so many tokens, a cut may be anywhere at this distance.
GAP = 24
#: Windows that are planned at once.
BLOCK = 96

SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
SPARK_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan_cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions of cuts that end windows of at most `length`, from 0 to the last of `at`, at the least padding plus cost of cuts.

    at: ascending positions, the first 0, no two neighbours further apart than `length`; cost: of a cut at each.
    best(j) = cost(j) + length - at(j) + min(best(i) + at(i)) over the i within a window of j: the least of a sliding window,
    kept in a monotone queue. Of equal choices the earlier cut, so the longer window, is taken.
    """
    pos, price = at.tolist(), cost.tolist()
    key, before = [0.0] * len(pos), [0] * len(pos)  # key: best + at
    queue = deque([0])
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        before[j] = i
        k = key[i] + length + price[j]
        key[j] = k
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = before[j]
    return cuts[::-1]


@lru_cache(maxsize=2)
def _edges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether the token ends a sentence, and whether it may begin what follows one."""
    units = byte_units(path)
    ends, begins = np.zeros(units.size, bool), np.zeros(units.size, bool)
    for i, b in units.bytes_of.items():
        ends[i] = b.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b"\n")
        begins[i] = b[:1] in (b" ", b"\n", b"\t", b"\r") or b[-1:] == b"\n"
    return ends, begins


class Lane:
    """One partition's stream of documents, packed in order with bounded memory."""

    def __init__(self, lane: int, path: str, length: int, end_id: int) -> None:
        self.next_id, self.path, self.length, self.end_id = lane << 32, path, length, end_id
        self.docs: deque = deque()  # doc_id, ids, ids that are packed already
        self.held = 0
        self.out: dict[str, list] = {f.name: [] for f in SCHEMA}

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        if self.held >= BLOCK * self.length:
            self._plan(last=False)

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        ends, begins = _edges(self.path)
        at, cost, base = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, done in self.docs:
            left = ids[done:]
            inner = np.flatnonzero(ends[left[:-2]] & begins[left[1:-1]]) + 1 if len(left) > 2 else np.zeros(0, np.int64)
            spots = np.concatenate([inner, [len(left)]])
            gaps = np.diff(spots, prepend=0)
            price = np.full(len(spots), SENTENCE_CUT)
            price[-1] = 0.0
            if gaps.max() > GAP:
                more = np.concatenate([np.arange(s - g + GAP, s, GAP) for s, g in zip(spots[gaps > GAP], gaps[gaps > GAP])])
                spots, price = np.concatenate([spots, more]), np.concatenate([price, np.full(len(more), FREE_CUT)])
                order = np.argsort(spots, kind="stable")
                spots, price = spots[order], price[order]
            at.append(spots + base)
            cost.append(price)
            base += len(left)
        return np.concatenate(at), np.concatenate(cost)

    def _plan(self, last: bool) -> None:
        if not self.held:
            return
        cuts = plan_cuts(*self._candidates(), self.length)
        begin = 0
        for cut in cuts if last else cuts[:-1]:
            self._emit(cut - begin, whole=not (last and cut == cuts[-1]))
            begin = cut

    def _emit(self, size: int, whole: bool) -> None:
        """Takes `size` tokens as a sequence; the last of a lane is parted into powers of two, which need no padding."""
        while size:
            now = size if whole or size == self.length else 1 << (size.bit_length() - 1)
            offset = 0
            while offset < now:
                doc = self.docs[0]
                doc_id, ids, start = doc
                n = min(len(ids) - start, now - offset)
                piece = ids[start : start + n]
                for k, v in zip(self.out, (doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), self.next_id, offset), strict=True):
                    self.out[k].append(v)
                doc[2] += n
                offset += n
                if doc[2] == len(ids):
                    self.docs.popleft()
            self.next_id += 1
            self.held -= now
            size -= now

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, {f.name: [] for f in SCHEMA}
        return pa.RecordBatch.from_pydict(out, SCHEMA)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all `docs` (doc_id, text) in sequences.

    A document is the ids of its whole text by the tokenizer file at `path`, its added tokens included, then `end_id`. Each partition of `docs` is a
    stream that is packed in its order, so nothing is exchanged; the order of a table's files is kept. Cuts fall after
    documents or sentences where that costs less than the padding it leaves, elsewhere in a document where no sentence
    ends for long. Sequences have at most `length` tokens and are meant to be padded to it; what is left at the end of a
    stream becomes sequences of a power of two, which need no padding. A stream is planned in blocks of windows, so
    memory holds a block and one document. A sequence_id is made of the partition and a count, the same on a retry.

    Null and empty text: the end id alone. Null doc_id: packed, with a null doc_id in its pieces. Repeated rows are packed
    each. Other columns are not read. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = byte_units(path)
        end = np.array([end_id], "<u4").tobytes()
        lane = Lane(TaskContext.get().partitionId(), path, length, end_id)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                lane.add(doc_id.as_py(), np.frombuffer(units.document(text.as_py() or "") + end, "<u4"))
            yield lane.take()
        lane._plan(last=True)
        yield lane.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPARK_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))

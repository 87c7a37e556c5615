"""SentencePiece BPE ids by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Pairs of tokens, and characters of units, that the tables of a task hold at most; emptied when full. Longer units aren't held.
LIMIT, CHARS, LONG = 500_000, 8_000_000, 200
#: Pieces under this score have the same score as others.
EQUAL = -1e8
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Units(dict):
    """Unit to the bytes of its ids and the text that these ids decode to; bounded by the characters of its units."""

    def __init__(self, model: PieceBpe, limit: int = CHARS) -> None:
        super().__init__()
        self.model, self.limit, self.held = model, limit, 0

    def __missing__(self, unit: str) -> tuple[bytes, str]:
        ids = self.model.unit(unit)
        out = array("I", ids).tobytes(), self.model.join(ids)
        if len(unit) <= LONG:
            if self.held >= self.limit:
                self.clear()
                self.held = 0
            self.held += len(unit)
            self[unit] = out
        return out


class PieceBpe:
    """A BPE model file of SentencePiece with byte fallback, a space put first and no other normalisation.

    Encoding: the encoding of a prefix of a text is unique, and so is its last token. A table holds it for each prefix:
    of the pieces that end there, which an automaton finds, it is the one that is compatible with the last token of the
    prefix before it, that is, the two alone encode to themselves. The ids are read off the table backwards. No piece has
    a space inside, so texts part before spaces, and parts are encoded once.
    """

    def __init__(self, path: str, limit: int = LIMIT, chars: int = CHARS) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.score, self.id, self.surface, self.byte = limit, {}, {}, {}, {}
        self.automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[piece], self.score[piece], self.surface[i] = i, model.get_score(i), piece
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.value = {i: b for b, i in self.byte.items()}
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        if any(SPACE in x.lstrip(SPACE) or "\n" in x for x in self.id):
            raise ValueError("the model has pieces with a space inside or a line feed")
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None | str] = {}
        self.low: dict[int, float] = {}
        self.units = Units(self, chars)

    def merge(self, text: str) -> list[str]:
        """The merges one by one: of neighbours that make a piece, the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token's own encoding joins; None for a single character. "none" for a token that doesn't encode to itself."""
        out = self.split.get(token, 0)
        if out == 0:
            text = self.surface[token]
            out = None
            if len(text) > 1:
                parts, last = list(text), None
                while len(parts) > 1:
                    scores = [self.score.get(a + b, -math.inf) for a, b in zip(parts, parts[1:])]
                    k = max(range(len(scores)), key=scores.__getitem__)
                    if scores[k] == -math.inf:
                        break
                    last = (parts[k], parts[k + 1])
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                out = (self.id[last[0]], self.id[last[1]]) if len(parts) == 1 else "none"
            self.split[token] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens alone encode to themselves. left: -1 for none; -2 for a character without a piece."""
        key = (left + 2) << 20 | right
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            out = self.pairs[key] = self.halves(right) != "none" if left < 0 else self._stays(left, right)
        return out

    def _stays(self, left: int, right: int) -> bool:
        """Undoes the later of the two tokens' merges, again and again, and asks whether a merge across would have come first.

        A part joined later than the merge across isn't there yet when that is due. Pieces of equal score, as runs of
        spaces are, are merged one by one instead.
        """
        a, b = self.surface[left], self.surface[right]
        if self.score[a] < EQUAL or self.score[b] < EQUAL or self.halves(right) == "none":
            return self.merge(a + b) == [a, b]
        due, after = -math.inf, False  # score of the merge undone last; whether it lies right of a merge across
        while True:
            across = self.score.get(self.surface[left] + self.surface[right], -math.inf)
            if across > due or across == due and after:
                return False
            x, y = self.halves(left), self.halves(right)
            if x is None and y is None:
                return True
            if self.least(left) < self.least(right):
                due, after, left = self.score[self.surface[left]], False, x[1]
            else:
                due, after, right = self.score[self.surface[right]], True, y[0]

    def least(self, token: int) -> float:
        """The least score among the merges that make a token; of two tokens side by side the one with less is made later."""
        out = self.low.get(token)
        if out is None:
            halves = self.halves(token)
            out = self.low[token] = min(self.score[self.surface[token]], *map(self.least, halves)) if halves else math.inf
        return out

    def unit(self, text: str) -> list[int]:
        """Ids of a text of which no normalisation is due."""
        n = len(text)
        last, size = [-1] * (n + 1), [1] * (n + 1)
        found = [False] * (n + 1)
        found[0] = True
        done = 0
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            while done + 1 < end:  # characters before this end that no piece ends with
                done += 1
                if not found[done]:
                    last[done], size[done], found[done] = -2, 1, True
            begin = end - length
            if not found[end] and found[begin] and self.compatible(max(last[begin], -1), token):
                last[end], size[end], found[end] = token, length, True
        while done < n:
            done += 1
            if not found[done]:
                last[done], size[done], found[done] = -2, 1, True
        out, end = [], n
        while end:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(self.byte[b] for b in reversed(text[end - 1].encode()))
            end -= size[end]
        return out[::-1]

    def parts(self, text: str) -> tuple[bytes, str]:
        """Bytes of the ids (little-endian unsigned 32 bits) of a text, and what the ids decode to, with the space that is put first.

        Both are put together of units. A run of byte ids may go on from unit to unit, but characters don't, so units decode apart.
        """
        if not text:
            return b"", ""
        spaced = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE in spaced:
            units = _RUNS.findall(spaced)
        else:  # no unit holds a space, so spaces can part them; empty ones do no harm
            units = spaced.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ")
        known = [self.units[x] for x in units if x]
        return b"".join([ids for ids, _ in known]), "".join([x for _, x in known])

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        return [self.bos, *np.frombuffer(self.parts(text)[0], "<u4").tolist(), self.eos]

    def join(self, ids: Iterable[int]) -> str:
        """The surfaces of ids, spaces restored, control ids left out; bytes that make no character become U+FFFD each."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            out.append(run.decode("utf-8", "surrogateescape"))
            run.clear()

        for i in ids:
            if i in self.value:
                run.append(self.value[i])
            elif i in self.surface:
                if run:
                    flush()
                out.append(self.surface[i])
            elif i == self.unk:
                if run:
                    flush()
                out.append(" ⁇ ")
        if run:
            flush()
        return re.sub("[\udc80-\udcff]", "�", "".join(out).replace(SPACE, " "))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        ids = [i for i in ids if i not in (self.bos, self.eos)]
        text = self.join(ids)
        return text.removeprefix(" ") if ids and self.surface.get(ids[0], "").startswith(SPACE) else text


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of `docs` (doc_id, text): whole texts to ids with begin and end, and back.

    A row is handled where it lies; nothing is exchanged. Null text: as the empty text, two ids. Null doc_id and repeated
    rows: as any other row. Other columns are not read. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (model.bos, model.eos))
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                ids, decoded = model.parts(text.as_py() or "")
                ids = b"".join([begin, ids, end])
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded.removeprefix(" ").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], schema=SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"))

"""Phrases whose words come together: candidates by upper bounds of a sketch, counted by automata, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textnum import mix, spans, word_hashes

#: Phrases are of 2 to so many words, and are candidates from so many occurrences on.
LONGEST, LEAST = 4, 30
#: The sketch has 2**BITS cells, in blocks of 2**BLOCK; what is broadcast is one bit for each cell, 16 MB.
BITS, BLOCK = 27, 17
#: Bytes of text that one automaton is made for, and phrases that are gathered before their cells are counted.
SHARD, GATHERED = 1 << 21, 1 << 21
#: Phrases of each language in the result.
TOP = 2000
#: Marks that end a piece; blanks between words.
MARKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_TABLE = bytes(10 if c in MARKS else 32 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def plain(texts: list[str]) -> bytes:
    """The pieces of texts: words parted by one space, a space, a line feed and a space between pieces and at both ends."""
    data = "\n".join(texts).encode().translate(_TABLE).replace(b"\n", b" \n ")
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return b" \n " + data.strip(b" ") + b" \n "


def shards(data: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """Shards of about `size` bytes and the bytes at their start that the one before has counted.

    They are cut between pieces; a piece that is longer is cut between words, and LONGEST - 1 words are given again.
    """
    at, skip = 0, 0
    while at < len(data):
        end = len(data)
        if end - at > size:
            cut = data.rfind(b" \n ", at + skip + 1, at + skip + size)
            if cut < 0:
                cut = data.find(b" ", at + skip + size)
                cut = len(data) - 1 if cut < 0 else cut
            end = cut + 1
        yield data[at:end], skip
        if end == len(data):
            return
        back = end - 1
        for _ in range(LONGEST - 1):
            back = max(data.rfind(b" ", 0, back), 0)
        at, skip = back, end - back


def _language(lang: str) -> np.uint64:
    return mix(word_hashes(d := np.frombuffer(f"{lang} ".encode(), np.uint8), np.array([0]), np.array([len(d)])))[0]


def phrases(data: bytes, skip: int, lang: str) -> tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """The number of words of a shard, and by length the first words, begins, ends and hashes of the phrases that end in it."""
    raw = np.frombuffer(data, np.uint8)
    begins, ends = spans(raw)
    with np.errstate(over="ignore"):
        words = mix(word_hashes(raw, begins, ends) + _language(lang))
    new = ends > skip
    out = []
    tied = np.concatenate([begins[1:] == ends[:-1] + 1, [False]]) if len(begins) else np.zeros(0, bool)
    whole, h = np.ones(len(begins), bool), words
    for n in range(1, LONGEST + 1):
        if n > 1:
            whole = whole[: max(len(begins) - n + 1, 0)] & tied[n - 2 : max(len(begins) - 1, n - 2)]
            with np.errstate(over="ignore"):
                h = mix(h[: len(whole)] * np.uint64(_ODD[0]) + words[n - 1 :] * np.uint64(_ODD[n - 1]))
        keep = np.flatnonzero(whole & new[n - 1 :]) if len(whole) else np.zeros(0, np.int64)
        out.append((keep, begins[keep], ends[keep + n - 1], h[keep]))
    return int(new.sum()), out


def _by_language(batch: pa.RecordBatch, size: int) -> Iterator[tuple[str, bytes, int]]:
    """lang, shard, skip of a batch (lang, text)."""
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0), batch.column(1)):
        texts.setdefault(lang.as_py(), []).append(text.as_py())
    for lang, own in texts.items():
        for shard, skip in shards(plain(own), size):
            yield lang, shard, skip


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or parted to about `size` bytes of text; a text of more is a batch of its own."""
    held, n = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for k in range(0, batch.num_rows, step):
            piece = batch.slice(k, step)
            held.append(piece)
            n += piece.nbytes
            if n >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _deltas(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, the four bytes of each apart: most are zeros, which Spark's compression takes out."""
    return np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def sketch(texts: DataFrame, least: int, bits: int, size: int) -> list[tuple[int, bytes]]:
    """block, bits of its cells: which cells of a counting sketch have come to `least`, over all phrases of all texts.

    Each cell holds the sum of the phrases that fall into it, so a phrase is never counted too low. Tasks send the cells they used, counts
    cut at `least`; blocks of cells are summed apart, row by row. The driver gets 2**bits bits, however large the input.
    """
    low = min(BLOCK, bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(parts: list[np.ndarray]) -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(parts), return_counts=True)
            n = np.minimum(n, least).astype("<u2")
            edges = np.searchsorted(x >> np.uint32(low), np.arange((1 << (bits - low)) + 1))
            full = np.flatnonzero(np.diff(edges))
            pieces = [(edges[b], edges[b + 1]) for b in full]
            mask = np.uint32((1 << low) - 1)
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([_deltas(x[i:j] & mask) for i, j in pieces], pa.binary()), pa.array([n[i:j].view(np.uint8).reshape(-1, 2).T.tobytes() for i, j in pieces], pa.binary())], names=["block", "cells", "counts"])

        held, n = [], 0
        for batch in _gathered(batches, size):
            for lang, shard, skip in _by_language(batch, size):
                for *_, h in phrases(shard, skip, lang)[1]:
                    held.append((h >> np.uint64(64 - bits)).astype(np.uint32))
                    n += len(h)
                if n >= GATHERED:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << low, np.uint32)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, x, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total = block, np.zeros(1 << low, np.uint32)
                counts = np.frombuffer(n.as_py(), np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
                at = _numbers(x.as_py())
                total[at] = np.minimum(total[at] + counts, least)
        if now is not None:
            yield done()

    rows = texts.mapInArrow(cells, "block int, cells binary, counts binary").repartition("block").sortWithinPartitions("block")
    return [(r.block, bytes(r.bits)) for r in rows.mapInArrow(summed, "block int, bits binary").collect()]


def counts(docs: DataFrame, least: int = LEAST, bits: int = BITS, size: int = SHARD) -> DataFrame:
    """lang, phrase, words, f: phrases of 1 to 4 words that occur `least` times or more; and lang, null, 0, n: all words of a language.

    Texts go by twice. First a sketch gives each phrase an upper bound. Then, shard by shard, the phrases of the shard whose bound is
    `least` or more become an automaton over bytes, each with a space on either side; it counts all its matches, overlapping ones too,
    and the sums over all shards are held against `least`. Single words are counted for the scores.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    low = min(BLOCK, bits)
    table = np.zeros((1 << bits) >> 3, np.uint8)
    width = max((1 << low) >> 3, 1)
    for block, own in sketch(texts, least, bits, size):
        table[block * width : (block + 1) * width] = np.frombuffer(own, np.uint8)
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in _gathered(batches, size):
            for lang, shard, skip in _by_language(batch, size):
                n, found = phrases(shard, skip, lang)
                text = shard.decode("latin-1")
                names: list[str] = []
                lengths: list[int] = []
                shorter = None
                for k, (at, begins, ends, h) in enumerate(found, 1):
                    cell = h >> np.uint64(64 - bits)
                    keep = (frequent[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
                    if shorter is not None:  # a phrase isn't frequent if its first or last words aren't; those before the shard are as frequent as they may be
                        keep &= shorter[at] & shorter[at + 1]
                    shorter = np.ones(int(found[0][0][-1]) + 2 if len(found[0][0]) else 1, bool)
                    shorter[at] = keep
                    # equal phrases are looked up once where they have one hash; those of one hash that differ are both looked up
                    own = list({text[b - 1 : e + 1] for b, e in zip(begins[keep].tolist(), ends[keep].tolist())})
                    names += own
                    lengths += [k] * len(own)
                out = np.zeros(len(names), np.int64)
                if names:
                    machine = ahocorasick.Automaton()
                    for i, name in enumerate(names):
                        machine.add_word(name, i)
                    machine.make_automaton()
                    hits = machine.iter(text)
                    hits = map(itemgetter(1), hits) if not skip else (i for e, i in hits if e > skip)
                    out = np.bincount(np.fromiter(hits, np.int64), minlength=len(names))
                decoded = [x[1:-1].encode("latin-1").decode() for x in names]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(names) + 1), pa.string()), pa.array([*decoded, None], pa.string()), pa.array([*lengths, 0], pa.int32()), pa.array([*out.tolist(), n], pa.int64())], names=["lang", "phrase", "words", "f"])

    found = texts.mapInArrow(count, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def _part(first: int, last: Column | int) -> Column:
    """Words of a phrase, from 1, as a phrase."""
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, F.lit(first) if isinstance(first, int) else first, last), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 80, bits: int = BITS, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each language with the highest scores, as the contract of op11 says.

    Null and empty texts have no words, a null lang is `und`; repeated rows count each. doc_id and other columns aren't read. A language
    without candidates, and an empty table, give no rows. Ties go to the more frequent phrase, then by bytes. `bits` only changes how
    many phrases are counted in vain, `size` the bytes that a shard has; neither changes the result.
    """
    all_ = common.stored(counts(docs, least, bits, size), "phrases")
    known = all_.where("words > 0").select("lang", "phrase", "f")
    two = all_.where("words > 1")
    cuts = two.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("cut"))
    cuts = cuts.withColumns({"first": _part(1, F.col("cut")), "rest": _part(F.col("cut") + 1, F.col("words") - F.col("cut"))})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("at"))
    # what a longer phrase has, for each phrase inside it
    within = two.where("words > 2").select("lang", "phrase", F.col("f").alias("longer"), "words", F.explode(F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> struct(i as i, n as n))))")).alias("x"))
    within = within.select("lang", _part(F.col("x.i"), F.col("x.n")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    rows = kept.select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(all_.where("words = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split(replace(p, chr(9), ' '), ' '), lambda w: w <> '') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY 1),
steps AS (SELECT lang, unnest(ws) AS w1, unnest(ws[2:] || [NULL]) AS w2, unnest(ws[3:] || [NULL, NULL]) AS w3, unnest(ws[4:] || [NULL, NULL, NULL]) AS w4 FROM words WHERE len(ws) > 0),
grams AS (SELECT lang, 1 AS k, w1 AS g FROM steps WHERE w1 IS NOT NULL UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM steps WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM steps WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM steps WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, g, string_split(g, ' ') AS ws, count(*) AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 30),
parts AS (SELECT lang, g, f, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM f)),
cuts AS (SELECT c.lang, c.g, c.f AS a, c.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score FROM parts c JOIN f l ON l.lang = c.lang AND l.g = c.lp JOIN f r ON r.lang = c.lang AND r.g = c.rp),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
spots AS (SELECT lang, ws, k, f, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM f)),
inside AS (SELECT lang, array_to_string(ws[i:i + n - 1], ' ') AS g, max(f) AS longer FROM spots GROUP BY 1, 2),
kept AS (SELECT w.lang, w.g AS phrase, w.a, w.l, w.r, w.score FROM weakest w LEFT JOIN inside s ON s.lang = w.lang AND s.g = w.g WHERE s.longer IS NULL OR 100 * s.longer < 80 * w.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""

"""Forbidden tokens in a folder of text files: one automaton, files and line numbers from the scan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def leaks(spark: SparkSession, folder: str, tokens: list[str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """file, line, token, n: where and how often each of `tokens` stands in the lines of all files below `folder`; `allowed` gives, by file name, tokens that may.

    All tokens are one automaton (overlapping ones count each) that tasks hold; files are read in splits, so a large one is many tasks'. A
    split counts its lines, and the counts of a file's splits before are added to its line numbers: a row for each split, not for each line. Letter case
    counts. Empty folders give an empty result; an empty token is an error.
    """
    import ahocorasick
    import pyarrow as pa

    if not all(tokens):
        raise ValueError("an empty token is everywhere")
    names = sorted(set(tokens))
    may = {k: set(v) for k, v in (allowed or {}).items()}
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder).select("_metadata.file_path", "_metadata.file_name", "_metadata.file_block_start", "value")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for i, name in enumerate(names):
            machine.add_word(name, i)
        machine.make_automaton()
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            out = []
            for path, name, start, value in zip(*(c.to_pylist() for c in batch.columns)):
                at = seen[path, start] = seen.get((path, start), 0) + 1
                counts: dict[int, int] = {}
                for _, i in machine.iter(value):
                    counts[i] = counts.get(i, 0) + 1
                out.extend((path, start, at, names[i], n) for i, n in counts.items() if names[i] not in may.get(name, ()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=["file", "start", "at", "token", "n"])
        if seen:
            k = len(seen)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen]), pa.array([s for _, s in seen]), pa.array(list(seen.values())), pa.nulls(k, pa.string()), pa.array([0] * k)], names=["file", "start", "at", "token", "n"])

    found = lines.mapInArrow(scan, "file string, start long, at long, token string, n long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.where("token IS NULL").groupBy("file", "start").agg(F.sum("at").alias("lines")).select("file", "start", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("offset"))
    return found.where("token IS NOT NULL").join(offsets, ["file", "start"]).select("file", (F.col("at") + F.col("offset")).alias("line"), "token", "n")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes, sha256 of all files below `folder`; a file is one row and at most 2 GB, as Spark's reader of whole files says."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

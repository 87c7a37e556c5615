"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUNS, FAN_IN = 64, 4


def exact_groups(docs: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs` (doc_id, text, ...).

    Texts are equal when identical after lower-casing A-Z. Of equal texts the largest doc_id stays.
    Digests form runs; each is sorted and reduced to one entry for a digest, and runs are merged `fan_in` at a time
    up to one. An entry is verified at every level: it merges only with entries of the same SHA-256, length and second,
    independent 64-bit hash. The winners travel down by run, so a text that a third of all rows share is never gathered.

    Null text: as the empty text. Null doc_id: smaller than any other, stays only in a group without others.
    Rows that repeat the doc_id that stays are all kept, as the identifier can't tell them apart. Other columns are not
    read. An empty table gives an empty result.
    """
    text = common.ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    prints = common.stored(
        docs.select("doc_id", text.alias("t")).select(
            "doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("bytes"), F.xxhash64("t").alias("second")
        ),
        "digests",
    )
    key = ["sha", "bytes", "second"]
    winners = common.elect(prints, key, "doc_id", runs, fan_in)
    return (
        prints.withColumn("run", common.run_of("doc_id", runs))
        .join(winners, [*key, "run"], "left")
        .select(
            "doc_id",
            F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their columns unchanged. Rows without doc_id stay unless an identified row has the same text.

    Rows are told by doc_id and digest of their text, so rows that share an identifier, or have none, stay or go each by their own text.
    """
    lost = exact_groups(docs).where("NOT kept").select(F.col("doc_id").alias("__lost"), F.col("text_sha256").alias("__lost_sha")).distinct()
    rows = docs.withColumn("__sha", F.sha2(common.ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    return rows.join(lost, rows["doc_id"].eqNullSafe(F.col("__lost")) & (F.col("__sha") == F.col("__lost_sha")), "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""

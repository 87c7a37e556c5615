"""Readers of runs: one file of results or a folder of sample files, truths, cohorts, shards. Keys that must be unique are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .records import _exists, json_lines


def checked_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows; reading them fails where `key` is null or repeats. Counts of keys are joined back, so no group is gathered."""
    counts = rows.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    bad = F.col(key).isNull() | (F.col("__n") > 1)
    ok = F.when(bad, F.raise_error(F.concat(F.lit(f"{key} repeats or lacks: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True))
    return rows.join(counts, F.col(key).eqNullSafe(F.col("__k"))).where(ok).select(rows.columns)


def run_results(spark: SparkSession, run_dir: str, schema: StructType, key: str = "sample_id") -> DataFrame:
    """results.jsonl of a run where there is one, else the JSON files of its folder `samples`, one record each; `key` is unique."""
    if _exists(spark, f"{run_dir}/results.jsonl"):
        rows = json_lines(spark, f"{run_dir}/results.jsonl", schema)
    else:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(f"{run_dir}/samples")
    return checked_unique(rows, key)


def truths(spark: SparkSession, path: str, schema: StructType, key: str = "sample_id") -> DataFrame:
    """A JSON array or JSON lines, by the file's name; `key` is unique."""
    if path.endswith((".jsonl", ".ndjson")):
        return checked_unique(json_lines(spark, path, schema), key)
    return checked_unique(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path), key)


def cohort(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file whose header is exactly the columns of `schema`, in order; a cell of another type fails."""
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.fieldNames():
        raise ValueError(f"columns {header} instead of {schema.fieldNames()}")
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)


def shards(spark: SparkSession, root: str, count: int, schema: StructType, key: str, allow_missing: bool = False) -> DataFrame:
    """The rows of shard-0000.jsonl to the last of `count` with their shard; a shard that lacks fails unless allowed, and so does a repeated `key`."""
    paths = {k: f"{root}/shard-{k:04d}.jsonl" for k in range(count)}
    found = {k: p for k, p in paths.items() if _exists(spark, p)}
    if len(found) < count and not allow_missing:
        raise FileNotFoundError(f"shards {sorted(set(paths) - set(found))} of {root} lack")
    if not found:
        return spark.createDataFrame([], StructType([*schema, *StructType.fromDDL("shard int").fields]))
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(list(found.values()))
    rows = rows.withColumn("shard", F.regexp_extract(F.input_file_name(), r"shard-(\d+)\.jsonl$", 1).cast("int"))
    return checked_unique(rows, key)

"""Readers and writers of JSON records and CSV, with positions, strictness and quarantine."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StringType, StructType


def json_lines(spark: SparkSession, path: str, schema: StructType, missing_ok: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a line that isn't an object of the schema fails. A path without files: empty with missing_ok."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(found)


def repaired(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the other lines with the file they stand in and the first 200 characters."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("row").isNotNull() & F.col("row._bad").isNull()
    return parsed.where(good).select(*[F.col("row")[f.name].alias(f.name) for f in schema]), parsed.where(~good).select("file", F.substring("value", 1, 200).alias("preview"))


def _with_corrupt(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("_bad", StringType())


def positioned(spark: SparkSession, path: str, schema: StructType, keyed: bool = False) -> DataFrame:
    """Records of one JSON document with their position: an array's order, or for an object keyed by numbers the key."""
    kind = MapType(StringType(), schema) if keyed else ArrayType(schema)
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", kind).alias("d"))
    if keyed:
        return doc.select(F.explode("d").alias("k", "record")).select(F.col("k").cast("int").alias("position"), "record.*")
    return doc.select(F.posexplode("d").alias("position", "record")).select("position", "record.*")


class StrictError(ValueError):
    pass


def strict_json(raw: str) -> object:
    """One JSON value, in a code fence or not; repeated keys and numbers that aren't finite are refused."""
    text = raw.strip()
    if (m := re.fullmatch(r"```(?:json)?\s*\n(.*)\n```", text, re.S)) is not None:
        text = m[1]

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise StrictError("DUPLICATE_KEY")
        return out

    def constant(name: str) -> float:
        raise StrictError("NON_FINITE")

    def number(x: str) -> float:
        value = float(x)
        if math.isinf(value):
            raise StrictError("NON_FINITE")
        return value

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    except json.JSONDecodeError as e:
        raise StrictError("INVALID_JSON") from e


def strict_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, error: each line that isn't blank and what strict reading refuses it for, null where it is sound."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for x in b["value"]:
                try:
                    value = strict_json(x)
                    errors.append(None if isinstance(value, dict) else "NOT_AN_OBJECT")
                except StrictError as e:
                    errors.append(str(e))
            yield b.assign(error=errors)

    return spark.read.text(path).where(F.trim("value") != "").mapInPandas(check, "value string, error string")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with nulls written out; numbers that aren't are nulls."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    clean = df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df
    clean.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; nested cells as JSON."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (StructType, ArrayType, MapType))]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    flat.write.mode(mode).option("header", True).csv(path)


def put_immutable(rows: DataFrame, store: str, payload: str) -> DataFrame:
    """Adds payloads under their SHA-256; those that are there already are left, and a different payload under an address fails. Returns what was added."""
    spark = rows.sparkSession
    new = rows.select(F.sha2(payload, 256).alias("address"), F.col(payload).alias("payload")).dropDuplicates(["address"])
    if _exists(spark, store):
        have = spark.read.parquet(store).select("address", F.col("payload").alias("kept"))
        both = new.join(have, "address", "left")
        clash = both.where("kept IS NOT NULL AND kept != payload").limit(1).count()
        if clash:
            raise ValueError("IMMUTABLE_COLLISION")
        new = both.where("kept IS NULL").drop("kept")
    new.write.mode("append").parquet(store)
    return new


def attested(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """The lines of a file whose SHA-256 is `digest`; reading fails where it isn't."""
    files = spark.read.format("binaryFile").load(path).select(F.when(F.sha2("content", 256) == digest, F.decode("content", "utf-8")).otherwise(F.raise_error(F.lit("SHA_MISMATCH"))).alias("text"))
    return files.select(F.posexplode(F.split("text", "\n")).alias("position", "value")).where(F.trim("value") != "")


def submission(results: DataFrame) -> DataFrame:
    """id, qa_type, prediction: id of four fields joined by &&, the answer or else the prediction."""
    return results.select(F.concat_ws("&&", "video_id", "start", "end", "fps").alias("id"), "qa_type", F.coalesce(F.nullif(F.col("answer"), F.lit("")), "prediction").alias("prediction"))

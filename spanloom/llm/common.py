"""What the operators of this subpackage share: scratch tables, words, elections among copies."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: One or more of the bytes that part words: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent, as in tests on one machine, is a temporary folder made and set.
    The path is deleted when the JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/spanloom/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def window(key: str, *order) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def elect(rows: DataFrame, key: list[str], ident: str, runs: int = 64, fan_in: int = 4, smallest: bool = False) -> DataFrame:
    """Largest (or `smallest`) `ident` and number of rows of each `key`, given back for each pair of key and run.

    Every row belongs to one of `runs` runs, by a hash of its identifier. A run is sorted by key and reduced
    to one entry for each key; `fan_in` runs are merged at a time until one is left, so that no merge sees more than
    `fan_in` entries for a key and task however many rows share it. Returns key, run, keep, size for keys with two or
    more rows; rows join it on key and `run_of(ident)`, which parts the rows of a hot key over all runs.
    """
    pick = F.min if smallest else F.max
    level = rows.groupBy(*key, run_of(ident, runs).alias("run")).agg(
        pick(F.struct(F.col(ident).alias("keep"))).alias("best"), F.count(F.lit(1)).alias("size")
    )
    first, left = level.select(*key, "run"), runs
    while left > 1:
        level = level.groupBy(*key, F.expr(f"run div {fan_in}").alias("run")).agg(pick("best").alias("best"), F.sum("size").alias("size"))
        left = -(-left // fan_in)
    top = level.where("size > 1").select(*key, F.col("best.keep").alias("keep"), "size")
    return first.join(top, key)


def run_of(ident: str, runs: int = 64) -> Column:
    return F.pmod(F.xxhash64(F.col(ident)), F.lit(runs))

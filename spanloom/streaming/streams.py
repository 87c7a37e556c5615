"""Structured Streaming twins: windows of events, first and latest records, resumable copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spanloom.operators import audits
from spanloom.operators.joins import latest


def source(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int = 64) -> DataFrame:
    """A stream of the files of a folder, so many at a time; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a time zone and a watermark: rows later than `late` are left out of windows that have closed."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """start, event_type, n, v: counts and sums by window; the same for a table and a stream."""
    w = F.window(F.col("ts").cast("timestamp"), size, slide) if slide else F.window(F.col("ts").cast("timestamp"), size)
    if events.isStreaming:
        w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark: replays of a log change nothing."""
    return events.dropDuplicatesWithinWatermark(keys)


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """Writes what there is now and ends; a later run goes on where this one stopped."""
    return df.writeStream.outputMode(mode).format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(df: DataFrame, store: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keeps the latest row of each key: each batch is reduced and written under its number; `current` reads the latest over all.

    A batch that is replayed writes the same folder again, so the result is exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str, keys: list[str], order: str) -> DataFrame:
    return latest(spark.read.parquet(store), keys, order, "batch").drop("batch")


class _Chain:
    """The attempts of a key by index, kept until no new one has come for `idle` of event time."""

    def __init__(self, key: str, limit: int, idle_ms: int) -> None:
        self.key, self.limit, self.idle = key, limit, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "index long", "status string, retryable boolean, differs boolean")
        self.deadline = handle.getValueState("deadline", "ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        import pandas as pd

        newest = 0
        for pdf in rows:
            for index, status, retryable, ms in zip(pdf["attempt"], pdf["status"], pdf["retryable"], pdf["ms"]):
                newest = max(newest, int(ms))
                record = (str(status), bool(retryable), False)
                if self.records.containsKey((int(index),)):
                    old = self.records.getValue((int(index),))
                    record = (old[0], old[1], bool(old[2]) or tuple(old[:2]) != record[:2])
                self.records.updateValue((int(index),), record)
        due = newest + self.idle
        before = self.deadline.get()[0] if self.deadline.exists() else 0
        if due > before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.deadline.update((due,))
        n, state = chain_state([(k[0], *v) for k, v in self.records.iterator()], self.limit)
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "state": [state], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        import pandas as pd

        n, state = chain_state([(k[0], *v) for k, v in self.records.iterator()], self.limit)
        self.records.clear()
        self.deadline.clear()
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "state": [state], "expired": [True]})

    def close(self) -> None:
        pass


def chain_state(records: list[tuple[int, str, bool, bool]], limit: int) -> tuple[int, str]:
    """Number and state of the attempts (index, status, retryable, differs) of one key, in any order; as `attempt_chains` says of a table."""
    at = sorted(records)
    top, end = at[-1][0], next((r[0] for r in at if r[1] == "OK" or not r[2]), at[-1][0] + 1)
    faults = [(any(r[3] for r in at), audits.CONFLICT), ([r[0] for r in at] != list(range(len(at))), audits.GAP), (end < top, audits.AFTER_END), (len(at) > limit, audits.OVER_LIMIT), (end == top or len(at) == limit, audits.COMPLETE)]
    return len(at), next((name for found, name in faults if found), audits.OPEN)


def attempt_chains(df: DataFrame, key: str, limit: int, late: str = "1 hour", idle: float = 86400.0) -> DataFrame:
    """key, n, state, expired: the chain of attempts (key, ts, attempt, status, retryable) of each key after each batch; the last row of a key is what a table gives.

    Attempts are kept by index, so they may come in any order and again; a chain is judged whole. A key without a new attempt for `idle` seconds of event time
    beyond the watermark gives its last state with `expired`, and leaves the store. Rows later than `late` are dropped by the watermark. State is kept in
    RocksDB, which the session must name as its provider; a key's state grows with its distinct indexes alone.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    kind = df.schema[key].dataType.simpleString()
    processor = type("AttemptChain", (_Chain, StatefulProcessor), {})(key, limit, round(idle * 1000))
    rows = df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, "ts", F.col("attempt").cast("long").alias("attempt"), "status", F.coalesce("retryable", F.lit(False)).alias("retryable"), F.unix_millis("ts").alias("ms"))
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, n long, state string, expired boolean", "update", "eventTime")

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from spanloom.sources import records
from spanloom.streaming import streams

SCHEMA = StructType().add("id", StringType()).add("n", IntegerType())


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y", "n": 2}]))
    (tmp_path / "k.json").write_text(json.dumps({"0": {"id": "x", "n": 1}, "10": {"id": "y", "n": 2}}))
    assert [tuple(r) for r in records.positioned(spark, str(tmp_path / "a.json"), SCHEMA).orderBy("position").collect()] == [(0, "x", 1), (1, "y", 2)]
    assert [tuple(r) for r in records.positioned(spark, str(tmp_path / "k.json"), SCHEMA, keyed=True).orderBy("position").collect()] == [(0, "x", 1), (10, "y", 2)]
    assert records.json_lines(spark, str(tmp_path / "none"), SCHEMA, missing_ok=True).count() == 0


def test_repair_and_strictness(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    path.write_text('{"id": "x", "n": 1}\n\n{"id": \n{"id": "y", "id": "z"}\n{"id": "w", "n": NaN}\n[1]\n')
    good, bad = records.repaired(spark, str(path), SCHEMA)
    assert "x" in {r.id for r in good.collect()} and bad.count() >= 1
    got = {r.value[:10]: r.error for r in records.strict_lines(spark, str(path)).collect()}
    assert got['{"id": "x"'] is None and got['{"id": "y"'] == "DUPLICATE_KEY" and got['{"id": "w"'] == "NON_FINITE" and got["[1]"] == "NOT_AN_OBJECT"
    assert records.strict_json('```json\n{"a": 1}\n```') == {"a": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1, 2])], "k int, v double, xs array<int>")
    records.write_json_lines(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"k": 1, "v": None, "xs": [1, 2]}
    with pytest.raises(Exception, match="exists"):
        records.write_json_lines(df, str(tmp_path / "j"))
    records.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["xs"] == "[1,2]"


def test_immutable_store(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "p string")
    assert records.put_immutable(df, str(tmp_path / "s"), "p").count() >= 2
    records.put_immutable(df, str(tmp_path / "s"), "p")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:00", i % 3, "view", float(i)) for i in range(48)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    src = lambda: streams.timed(streams.source(spark, str(tmp_path / "in"), df.schema), "1 hour")
    q = streams.tumbling(src(), "1 day").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM tumbled").first()[0] == 48
    q = streams.run(streams.deduplicated(src(), ["event_id"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 48
    streams.run(streams.deduplicated(src(), ["event_id"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 48
    streams.upsert(src(), str(tmp_path / "up"), str(tmp_path / "ck2"), ["user_id"], "event_id").awaitTermination()
    assert {r.user_id: r.event_id for r in streams.current(spark, str(tmp_path / "up"), ["user_id"], "event_id").collect()} == {0: 45, 1: 46, 2: 47}

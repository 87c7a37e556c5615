"""Routes, audits of several sources, parsers and the leak scan: known values and plain Python."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import answers, routes
from spanloom.operators import audits
from spanloom.sources import leaks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def results(*rows):
    return F.array(*[F.struct(F.lit(c).alias("claim"), F.lit(x).cast("string").alias("execution"), F.lit(s).cast("string").alias("semantic")) for c, x, s in rows])


def test_contrasts(spark):
    yes, no = ("a", "OK", "SUPPORTED"), ("b", "OK", "CONTRADICTED")
    ask = lambda r, ex, strict=True: one(spark, routes.contrast(r, F.lit(ex), F.lit("a"), F.lit(strict)))
    x = ask(results(yes, no), "DECLARED_EXCLUSIVE")
    assert x["pass"] and x.status == "EXCLUSIVE_CONTRAST_PASS" and x.reasons == [] and x.supported == ["a"]
    x = ask(results(yes, ("b", "OK", "UNCERTAIN")), "DECLARED_EXCLUSIVE")
    assert not x["pass"] and x.reasons == ["ALTERNATIVES_NOT_CONTRADICTED"]
    assert ask(results(yes, ("b", "OK", "UNCERTAIN")), "DECLARED_EXCLUSIVE", False)["pass"]
    x = ask(results(yes, ("b", None, None)), "NONEXCLUSIVE")
    assert x.status == "NONEXCLUSIVE_TARGET_UNRESOLVED" and x.reasons == ["CONTRAST_TECHNICAL_FAILURE_OR_MISSING_RESULT"]
    assert ask(results(yes), None).reasons == ["INVALID_CONTRAST_GROUP", "INVALID_EXCLUSIVITY_STATUS"]
    x = ask(results(yes, ("b", "OK", "SUPPORTED")), "DECLARED_EXCLUSIVE")
    assert x.reasons == ["MULTIPLE_EXCLUSIVE_CLAIMS_SUPPORTED", "ALTERNATIVES_NOT_CONTRADICTED"] and not x.unique_supported


def test_transitions(spark):
    budget = F.create_map(F.lit("temporal_jumps"), F.lit(0), F.lit("spatial_regrounds"), F.lit(1))
    allowed = F.array(*[F.lit(a) for a, _ in routes.TRANSITIONS.values()], F.lit("STOP_DIAGNOSTIC"))
    ask = lambda outcome, failure, sw=True: one(spark, routes.transition(F.lit(outcome), F.lit(failure).cast("string"), allowed, F.lit(sw), budget))
    assert tuple(ask("FAILED", "ORIGINAL_INSUFFICIENT")) == ("STOP_ABSTAIN", "ORIGINAL_INSUFFICIENT", None, "BUDGET_TEMPORAL_JUMPS_EXHAUSTED")
    assert tuple(ask("FAILED", "KEEP_SUPPORT_LOST")) == ("SPATIAL_RECOMPOSE", "KEEP_SUPPORT_LOST", "spatial_regrounds", None)
    assert ask("FAILED", "DROP_SUPPORT_PERSISTS_WITH_FULL_GRAY_SUPPORT", False).termination == "VERIFIER_SWITCH_NOT_PREDECLARED"
    assert tuple(ask("DIAGNOSTIC_COMPLETE", None)) == ("STOP_DIAGNOSTIC", "DIAGNOSTIC_COMPLETE", None, None)
    with pytest.raises(Exception, match="UNROUTABLE"):
        ask("FAILED", "NEVER_SEEN")


def test_line_and_span_segments(spark):
    text = "\n  Start (Time) 1.5 - 3 seconds **Description:** one - two..\r\n2–4 second x - three\nTime Range: 5-6 seconds\nno\n7 - 8 seconds - \n"
    assert [tuple(s) for s in one(spark, answers.line_segments(F.lit(text)))] == [(1.5, 3.0, "one - two"), (2.0, 4.0, "three")]
    text = "head 1-2 seconds: a\nb 3-4 seconds: in\n5.5-6 second:  c\n\n5.5-6 seconds: c"
    assert [tuple(s) for s in one(spark, answers.span_segments(F.lit(text)))] == [(1.0, 2.0, "a\nb 3-4 seconds: in"), (5.5, 6.0, "c"), (5.5, 6.0, "c")]
    for none in (None, "", "text"):
        assert one(spark, answers.line_segments(F.lit(none).cast("string"))) == [] == one(spark, answers.span_segments(F.lit(none).cast("string")))


def test_three_sources_at_once(spark):
    schema = "k int, v string"
    sides = {"a": [(1, "x"), (2, "x"), (3, "x"), (None, "n")], "b": [(1, "x"), (2, "y"), (2, "y"), (4, "z")], "c": [(1, "x"), (2, "x"), (3, None), (None, "n")]}
    got = {x.k: x.errors for x in audits.reconciled({n: spark.createDataFrame(r, schema) for n, r in sides.items()}, ["k"], ["v"]).collect()}
    assert got == {1: [], 2: ["DUPLICATE_B", "V_MISMATCH"], 3: ["MISSING_B", "V_MISMATCH"], 4: ["MISSING_A", "MISSING_C"], None: ["MISSING_B"]}


def test_prediction_audit_of_a_manifest_with_repeated_keys(spark):
    p = spark.createDataFrame([(1, "YES"), (9, "x")], "id int, a string")
    e = spark.createDataFrame([(2,)], "id int")
    ask = lambda rows: audits.prediction_audit(spark.createDataFrame(rows, "id int, ok boolean"), p, e, "id", "ok", "a").first()
    x = ask([(1, True), (2, True), (3, None)])
    assert (x.n_total, x.n_valid, x.n_invalid, x.missing, x.extra, x.unresolved, x.invalid_predictions) == (3, 2, 1, 1, 1, 1, 1)
    x = ask([(1, True), (1, True), (2, True)])
    assert (x.duplicate_manifest, x.n_valid, x.missing, x.extra, x.unresolved) == (1, 0, 0, 2, 0)


def test_bound_timestamps(spark):
    schema = "c string, frame_order int, reference string, seconds double"
    rows = [("good", i, f"f{i}", float(i)) for i in range(3)] + [("one", 0, "f0", 1.0)] + [("falls", i, f"f{i}", 5.0 - i) for i in range(3)] + [("other", i, f"g{i}", float(i)) for i in range(3)] + [("twice", i % 2, f"f{i % 2}", float(i)) for i in range(3)]
    frames = spark.createDataFrame([(c, i, f"f{i}") for c in ("good", "falls", "other") for i in range(3)] + [("one", 0, "f0"), ("twice", 0, "f0"), ("twice", 1, "f1"), ("none", 0, "f0")], "c string, frame_order int, reference string")
    got = {x.c: x.errors for x in audits.bound_timestamps(spark.createDataFrame(rows, schema), frames, "c").collect()}
    assert got["good"] == [] and got["one"] == ["DURATION_NOT_POSITIVE"] and got["falls"] == ["TIMESTAMP_NONMONOTONIC"] and got["other"] == ["BINDING_MISMATCH"]
    assert got["twice"][:2] == ["FRAME_COUNT_MISMATCH", "BINDING_MISMATCH"] and got["none"] == ["FRAME_COUNT_MISMATCH", "BINDING_MISMATCH", "DURATION_NOT_POSITIVE"]


def test_leaks_over_files_splits_and_batches(spark, tmp_path):
    r = random.Random(3)
    tokens = ["gt_spans", "spans", "answer\"", "é|ü"]
    want = []
    for f in range(3):
        lines = [r.choice(["plain words", "", "x gt_spans y", "spansspans", "the answer\" é|ü", "Spans"]) + " " * r.randint(0, 20) for _ in range(3000)]
        (tmp_path / f"d{f}").mkdir()
        path = tmp_path / f"d{f}" / f"m{f}.jsonl"
        path.write_text("\n".join(lines) + ("\n" if f else ""))
        for n, line in enumerate(lines, 1):
            want += [(path.name, n, t, line.count(t)) for t in tokens if t in line and not (f == 1 and t == "spans")]
    before, batch = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        got = [(os.path.basename(x.file), x.line, x.token, x.n) for x in leaks.leaks(spark, str(tmp_path), tokens, {"m1.jsonl": ["spans"]}).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert sorted(got) == sorted(want)
    files = {os.path.basename(x.file): (x.bytes, x.sha256) for x in leaks.inventory(spark, str(tmp_path)).collect()}
    assert files == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*.jsonl")}
    with pytest.raises(ValueError):
        leaks.leaks(spark, str(tmp_path), [""])

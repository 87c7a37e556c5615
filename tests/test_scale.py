"""What keeps queries within their limits on large tables: work done once, spread over tasks, and bounded rows."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import answers, claims, permutations, scopes
from spanloom.operators import aggregates, audits, matching, nested
from spanloom.plans.catalog import QUERIES
from spanloom.plans.joining import KEY_PARTS
from spanloom.sources import samples

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signed_rank_calls_python_by_batches_of_groups(spark):
    rows = spark.createDataFrame([(g, float(v)) for g in range(50) for v in (1, -2, 3, 0)] + [(99, float(v)) for v in range(1, 30)], "g long, v double")
    out = aggregates.signed_rank(rows, ["g"], "v")
    assert "ArrowEvalPython" in physical(out) and "Aggregate" in physical(out) and "ArrowAggregatePython" not in physical(out) and "AggregateInPandas" not in physical(out)
    got = {r.g: (r.n, r.n_zero, r.w_plus, r.w_minus, r.p_value, r.status) for r in out.collect()}
    assert got[0] == (4, 1, 4.0, 2.0, 0.75, "OK") and got[99] == (29, 0, None, None, None, "TOO_MANY") and len(got) == 51


def test_permutation_is_drawn_once_an_attempt(spark):
    shuffled = spark.range(20).select(permutations.full_shuffle(F.col("id"), F.lit(16)).alias("x"))
    assert plan(shuffled).count("md5(") <= 2
    none = spark.range(3).select(permutations.full_shuffle(F.col("id"), F.lit(16), moved=17, retries=0).alias("x")).select("x.*").collect()
    assert {r.reason for r in none} == {"FULL_SHUFFLE_CONSTRAINTS_UNSATISFIED"}


def test_claim_is_stripped_once(spark):
    made = spark.createDataFrame([(" There is  a TOOL ",), (" ",), (None,)], "t string").select(scopes.claim_scope(F.col("t")).alias("x"))
    assert plan(made).count("regexp_replace(") <= 2
    assert [r.x and r.x.claim_scope for r in made.collect()] == ["MULTI_SUPPORT_POSSIBLE", None, None]


def test_statuses_are_walked_within_the_row(spark):
    docs = spark.createDataFrame([('{"a":{"status":"x","l":[{"b_status":"y"},["status"],{"status":7}]},"status":{"status":"z"}}',), ("no",), (None,), ('"status"',)], "d string")
    out = nested.statuses(docs, "d")
    assert plan(out).count("Generate") == 1
    assert {(r.path, r.status, r.n) for r in out.collect()} == {("a.status", "x", 1), ("a.l.b_status", "y", 1), ("status.status", "z", 1)}


def test_hits_have_no_distinct_counts(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.4), (1, 1, 2, 0.8), (1, 2, 2, 0.6), (2, 1, 1, 0.2)], "k int, p int, g int, iou double")
    out = matching.hits(pairs, ["k"], (0.3, 0.7, 0.9))
    assert "Expand" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(0.3, 2, 2, 3), (0.7, 1, 1, 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["g20_flatten_overlaps", "j20_threshold_pairs", "v26_v80_cache_keys"])
def test_rows_are_dealt_to_many_tasks(spark, name):
    assert "RepartitionByExpression" in plan(QUERIES[name](spark, SF)) and f", {KEY_PARTS}" in plan(QUERIES[name](spark, SF))


def test_claims_are_read_once(spark):
    out = spark.createDataFrame([('{"claims": [{"text": " a "}, {"text": "b"}]}',), ('{"claims": [{"text": " "}]}',)], "t string").select(claims.parse_claims(F.col("t"), F.lit("s"), 5).alias("x"))
    assert plan(out).count("$.claims") == 1
    assert [(r.x.claims and [c.text for c in r.x.claims], r.x.reason) for r in out.collect()] == [(["a", "b"], None), (None, "CLAIM_TEXT")]


def test_paths_are_rewritten_once(spark):
    out = spark.createDataFrame([("/old\\a/b",), ("/else/b",), ("a/../b",)], "p string").select(samples._below(F.col("p"), "/new", ("/old",)).alias("x"))
    assert plan(out).count("replace(") == 1
    assert [r.x for r in out.collect()] == ["/new/a/b", None, None]


def test_bound_timestamps_are_not_sorted_by_references(spark):
    frames = [(c, i, 10 + i) for c in ("good", "falls", "other", "less") for i in range(3)]
    listed = [(c, i, 10 + i + (c == "other"), 5.0 - i if c == "falls" else float(i)) for c, i, _ in frames if (c, i) != ("less", 1)] + [("alone", 0, None, None)]
    out = audits.bound_timestamps(spark.createDataFrame(listed, "c string, frame_order int, reference long, seconds double"), spark.createDataFrame(frames, "c string, frame_order int, reference int"), "c")
    assert "SortAggregate" not in executed(out)
    assert {x.c: x.errors for x in out.collect()} == {
        "good": [], "falls": ["TIMESTAMP_NONMONOTONIC"], "other": ["BINDING_MISMATCH"], "less": ["FRAME_COUNT_MISMATCH", "BINDING_MISMATCH"],
        "alone": ["FRAME_COUNT_MISMATCH", "BINDING_MISMATCH", "TIMESTAMP_NONFINITE", "DURATION_NOT_POSITIVE"],
    }


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_lines_are_exchanged_once_for_timestamps(spark):
    out = executed(QUERIES["j30_timestamp_binding"](spark, SF))
    assert out.count("Exchange ") == 1 and f", {KEY_PARTS})" in out and "SortAggregate" not in out and out.count("FileScan") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize(("name", "step"), [("v07_span_captions", "regexp_extract_all("), ("x04_line_captions", "split(")])
def test_captions_are_read_once(spark, name, step):
    out = plan(QUERIES[name](spark, SF))
    assert out.count(step) == 1 and "RepartitionByExpression" in out and f", {KEY_PARTS}" in out


def test_spans_are_those_of_one_pattern(spark):
    r = random.Random(7)
    parts = ["1-2 seconds:", "3.5-4 second:", "10-11  seconds:", "5-6 seconds", "7.-8 seconds:", " ", "\n", "\n", "\t", "a", "b c", "-", "é", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    blanks = " \t\r\n\x0b\x0c"
    want = [[(float(m[1]), float(m[2]), m[3].strip(blanks)) for m in re.finditer(r"(?s)(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)\s+seconds?:\s+(.*?)(?=\n\d+(?:\.\d+)?-\d+(?:\.\d+)?\s+seconds?:|\Z)", t.strip(blanks)) if m[3].strip(blanks)] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", answers.span_segments(F.col("t")).alias("x"))
    assert plan(rows).count("regexp_extract_all(") == 1
    assert [[tuple(s) for s in x.x] for x in sorted(rows.collect())] == want and sum(map(len, want)) > 300

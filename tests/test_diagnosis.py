"""Margins by class, differences, fingerprints, windows against the truth, similarities and candidates: known values, plain Python, nulls and empty tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from spanloom.operators import diagnosis

MARGINS = ", ".join(f"{m} double" for m in diagnosis.MARGINS)


def test_case_classes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, 0.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 0.0, 1.0), (1.0, 1.0, 1.0, 1.0, 0.5, 1.0),
        (1.0, 1.0, 0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0, 1.0, nan), (1.0, 1.0, 0.0, 1.0, -inf, 1.0), (None, 1.0, 0.0, 1.0, 1.0, 1.0),
    ]
    cases = spark.createDataFrame(rows, MARGINS)
    got = {(r.case_class, r.code): (r.allowed, r.n) for r in diagnosis.case_classes(cases).collect()}
    assert got == {
        ("ORIGINAL_LIKELIHOOD_INSUFFICIENT", "ORIGINAL_INSUFFICIENT"): ("TEMPORAL_REACQUIRE", 1), ("KEEP_PRESERVATION_FAILURE", "KEEP_SUPPORT_LOST"): ("RECOMPOSE_SPATIAL_EVIDENCE", 1),
        ("DROP_SUPPORT_PERSISTS", "DROP_SUPPORT_PERSISTS"): ("LOCALIZE_RESIDUAL_COMPONENT", 1), ("DROP_SUPPORT_PERSISTS", "VERIFIER_INSENSITIVITY_UNRESOLVED"): ("STOP_OR_PREDECLARED_VERIFIER_SWITCH", 1),
        ("CONTROL_SUPPORT_LOST", "CONTROL_SUPPORT_LOST"): ("INTERVENTION_DIAGNOSTIC", 1), ("FULL_LOCAL_DEPENDENCE_PATTERN", "NO_FAILURE_DIAGNOSTIC_COMPLETE"): ("STOP_DIAGNOSTIC", 1), ("MARGIN_NOT_FINITE", None): (None, 3),
    }
    assert diagnosis.case_classes(cases.limit(0)).count() == 0 == diagnosis.delta_statistics(cases.limit(0)).count()


@pytest.mark.parametrize("limits", [None, [], [0.0], [-1.0, 0.5, 3.0]])
@pytest.mark.parametrize("n", [1, 2, 31, 40])
def test_delta_statistics_against_plain_python(spark, n, limits):
    rng = random.Random(n)
    rows = [tuple(float(rng.randrange(-3, 4)) for _ in diagnosis.MARGINS) for _ in range(n)]
    got = {r.delta: tuple(r)[1:] for r in diagnosis.delta_statistics(spark.createDataFrame(rows, MARGINS), limits).collect()}
    named = [dict(zip(diagnosis.MARGINS, r)) for r in rows]
    values = {"delta_drop": [r["original"] - r["drop"] for r in named], "delta_full_gray": [r["original"] - r["gray"] for r in named], "delta_mismatch": [r["original"] - r["mismatch"] for r in named], "delta_specificity": [r["control"] - r["drop"] for r in named]}
    assert got == {k: (n, sum(x > 0 for x in v), pytest.approx(statistics.fmean(v)), statistics.median(v), min(v), max(v)) for k, v in values.items()}


def test_fingerprints(spark):
    schema = "run int, field string, value string"
    old = [(1, "a", "x"), (1, "b", "y"), (1, "z", "1"), (2, "a", "x"), (3, "b", None), (4, "a", "x")]
    new = [(1, "a", "x"), (1, "b", "n"), (1, "z", "2"), (2, "a", "x"), (3, "z", None)]
    ask = lambda o, n: {r.run: (r.core_matches, r.environment_matches, r.n_fields, [tuple(d) for d in r.differences]) for r in diagnosis.compare_fingerprints(spark.createDataFrame(o, schema), spark.createDataFrame(n, schema), ["a"], ["b"]).collect()}
    assert ask(old, new) == {
        1: (True, False, 3, [("ENVIRONMENT", "b", "y", "n"), ("RUNTIME", "z", "1", "2")]), 2: (True, True, 1, []), 3: (True, True, 2, []), 4: (False, True, 1, [("CORE", "a", "x", None)]),
    }
    assert ask([], []) == {}


def test_window_alignment(spark):
    schema = "k int, eligible boolean, cells array<struct<start:double,end:double>>, spans array<struct<start:double,end:double>>"
    cells = [(float(i), i + 1.0) for i in range(6)]
    samples = spark.createDataFrame([(1, True, cells, [(1.0, 2.5)]), (2, True, cells, None), (3, None, cells, [(0.0, 6.0)]), (4, True, None, [(0.0, 1.0)])], schema)
    windows = spark.createDataFrame([(1, 0, 1), (1, 2, 5), (1, 4, 5), (2, 0, 1), (3, 0, 5), (4, 0, 1), (9, 0, 1)], "k int, start_pos int, end_pos int")
    got = {tuple(r)[:2]: tuple(r)[3:] for r in diagnosis.window_alignment(samples, windows, "k").collect()}
    assert got == {(1, 0): (2, 2, 1, 0.5, 0.5, True), (1, 2): (4, 2, 1, 0.25, 0.5, True), (1, 4): (2, 2, 0, 0.0, 0.0, False), (2, 0): (2, 0, 0, 0.0, None, False), (3, 0): (6, 6, 6, 1.0, 1.0, False), (4, 0): (0, 0, 0, None, None, False)}


def test_mean_similarity(spark):
    rows = [("a", [1.0, 0.0], [1.0, 0.0]), ("a", [1.0, 0.0], [0.0, 2.0]), ("a", [], [1.0]), ("a", [1.0], None), ("a", [1.0, 2.0], [1.0]), ("b", None, None), ("c", [0.0], [1.0]), ("c", [None], [1.0]), (None, [2.0], [-3.0])]
    got = {r.t: (r.n, r.similarity) for r in diagnosis.mean_similarity(spark.createDataFrame(rows, "t string, p array<double>, q array<double>"), ["t"], "p", "q").collect()}
    assert got == {"a": (2, 0.5), "b": (0, 0.0), "c": (1, 0.0), None: (1, -1.0)}


def test_candidates_against_plain_python(spark):
    samples = [(k, [(f"f{k}-{i}", f"p{i}", None if k == 3 and i == 2 else i * 0.5) for i in range(k)]) for k in range(8)] + [(99, None)]
    frames = spark.createDataFrame(samples, "k int, frames array<struct<frame_id:string,path:string,at:double>>")
    want = []
    for k, f in samples:
        for rank, start in enumerate(range(0, len(f or []), 2)):
            w = f[start : start + 3]
            timed = all(x[2] is not None for x in w)
            want.append((k, rank, [x[0] for x in w], [x[1] for x in w], w[0][2] if timed else start, w[-1][2] if timed else start + len(w) - 1, "public_timestamp" if timed else "frame_order", len(w), len(w) < 3))
            if start + 3 >= len(f):
                break
    assert sorted(tuple(r) for r in diagnosis.candidate_rows(frames, "k", 3, 2).collect()) == sorted(want)
    assert diagnosis.candidate_rows(frames.where(F.lit(False)), "k", 3, 2).count() == 0


def test_diagnoses(spark):
    certificates = [("a", ["CONTROL_RESULT_COUNT_MISMATCH"], 2, 2, None), ("b", ["CONTROL_RESULT_COUNT_MISMATCH", "ORIGINAL_INSUFFICIENT"], 2, 1, True), ("c", ["INTERVENTION_NO_EFFECT"], 1, 1, None), ("d", ["CONTROL_UNAVAILABLE"], 1, 1, True), ("e", ["CONTROL_UNAVAILABLE"], 1, 1, None), ("f", None, None, None, None), ("g", ["CONTROL_RESULT_COUNT_MISMATCH"], 2, 2, None)]
    controls = [("a", "OK"), ("b", "CONTROL_UNAVAILABLE"), ("c", None), ("x", "OK")]
    pixels = [("c", 2, "ARTIFACT_NOT_APPLIED"), ("c", 1, "UNIFORM_REGION"), ("x", 1, "UNIFORM_REGION")]
    frames = (spark.createDataFrame(certificates, "certificate_id string, reasons array<string>, expected int, generated int, geometry_refinable boolean"), spark.createDataFrame(controls, "certificate_id string, status string"), spark.createDataFrame(pixels, "certificate_id string, position int, effect string"))
    made = diagnosis.diagnose(*frames)
    got = {r.certificate_id: (r.root_cause, r.eligible, r.mismatch and r.mismatch["class"], r.n_results, r.effect) for r in made.collect()}
    assert got == {
        "a": ("TECHNICAL_DIAGNOSTIC", False, "A_IMPLEMENTATION_OR_ARTIFACT_BUG", 1, None), "b": ("TECHNICAL_DIAGNOSTIC", False, "B_LEGITIMATE_PROTOCOL_UNAVAILABLE", 1, None),
        "c": ("SPATIAL_PROPOSAL_OR_ROI_FAILURE", True, None, 1, "UNIFORM_REGION"), "d": ("SPATIAL_PROPOSAL_GEOMETRY", True, None, None, None), "e": ("PROTOCOL_UNAVAILABLE", False, None, None, None),
        "f": ("UNRESOLVED", False, None, None, None), "g": ("TECHNICAL_DIAGNOSTIC", False, "C_UNRESOLVED", None, None),
    }
    totals = {(r.kind, r.name): r.n for r in diagnosis.diagnosis_totals(made).collect()}
    assert totals["total", "candidates"] == 7 and totals["total", "technical_or_protocol_failures"] == 4 and totals["total", "spatial_refinable_failures"] == 2 and totals["mismatch", "C_UNRESOLVED"] == 1
    assert diagnosis.diagnosis_totals(diagnosis.diagnose(*[f.limit(0) for f in frames])).count() == 0

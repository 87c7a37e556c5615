import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import aggregates, audits, joins, matching, ranking, timeline


def hull(a, b):
    h = max(a[1], b[1]) - min(a[0], b[0])
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / h if h > 0 else 0.0


def test_greedy_against_python(spark):
    rng = random.Random(4)
    groups = []
    for k in range(40):
        make = lambda: sorted(float(rng.randint(0, 30)) for _ in range(2))
        groups.append((k, [make() for _ in range(rng.randint(0, 6))], [make() for _ in range(rng.randint(0, 6))]))
    df = spark.createDataFrame([(k, [{"start": a, "end": b} for a, b in p], [{"start": a, "end": b} for a, b in g]) for k, p, g in groups], "k int, p array<struct<start:double,end:double>>, g array<struct<start:double,end:double>>")
    got = {r.k: [(m.g, m.p) for m in r.m] for r in df.select("k", matching.greedy(F.col("p"), F.col("g"), 0.3).alias("m")).collect()}
    for k, p, g in groups:
        used, want = set(), []
        for j, t in enumerate(g):
            best, at = 0.0, -1
            for i, q in enumerate(p):
                if i not in used and hull(q, t) > best:
                    best, at = hull(q, t), i
            if at >= 0 and best >= 0.3:
                used.add(at)
                want.append((j, at))
        assert got[k] == want


def test_suppression_against_python(spark):
    rng = random.Random(9)
    rows = [(k, f"w{i:02d}", rng.choice([0.1, 0.5, 0.9]), rng.choice([8.0, 16.0]), float(rng.randint(0, 20))) for k in range(5) for i in range(12)]
    data = [(k, i, m, s, a, a + s) for k, i, m, s, a in rows]
    df = spark.createDataFrame(data, "k int, id string, margin double, scale double, start double, end double")
    got = {(r.k, r.id): (r["rank"], r.status, r.suppressor) for r in matching.suppress(df, "k", 0.5, 3).collect()}
    for k in range(5):
        kept = []
        for n, (_, i, m, s, a, b) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (-r[2], r[3], r[4], r[1])), 1):
            by = next((x for x in kept if hull((x[4], x[5]), (a, b)) >= 0.5), None)
            if by:
                want = (n, "SUPPRESSED", by[1])
            elif len(kept) < 3:
                kept.append((k, i, m, s, a, b))
                want = (n, "SELECTED", None)
            else:
                want = (n, "NOT_SELECTED_BUDGET", None)
            assert got[k, i] == want


def test_wilcoxon_known_values():
    assert aggregates.wilcoxon([1, 2, 3]) == (3, 0, 6.0, 0.0, 1.0, 0.25)
    n, zeros, plus, minus, _, _ = aggregates.wilcoxon([0, 1, -2])
    assert (n, zeros, plus, minus) == (3, 1, 1.0, 2.0)
    with pytest.raises(ValueError):
        aggregates.wilcoxon([float(x) for x in range(1, 22)])
    assert aggregates.wilcoxon([])[5] == 1.0


def test_signed_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 0.0), ("b", 1.0), ("b", -2.0)], "g string, v double")
    got = {r.g: (r.w_plus, r.w_minus, r.p_value) for r in aggregates.signed_rank(df, ["g"], "v").collect()}
    assert got["a"] == (6.0, 0.0, 0.25) and got["b"][:2] == (1.0, 2.0)


def test_family_scores_known_example(spark):
    """Y N | Y Y, context left out: .5 and 1.0, micro and macro .75."""
    rows = [("shift", "Y", True), ("shift", "N", True), ("resample", "Y", True), ("resample", "Y", True), ("context", "N", False)]
    df = spark.createDataFrame([("c", *r) for r in rows], "c string, family string, pred string, ok boolean")
    r = aggregates.family_scores(df, ["c"], "family", F.col("ok"), F.col("pred") == "Y").first()
    assert (r.micro, r.macro, r.n_included) == (0.75, 0.75, 4)


def test_claims_and_coverage(spark):
    certs = spark.createDataFrame([("a", "s1", "VERIFIED"), ("a", "s1", "REJECTED"), ("b", "s1", "VERIFIED"), ("b", "s2", "REJECTED"), ("c", "s1", "REJECTED"), ("d", "s2", "REJECTED"), ("e", None, "VERIFIED")], "claim_id string, c_scope string, final_status string")
    claims = spark.createDataFrame([(x, "s1") for x in "abcdef"], "claim_id string, scope string")
    got = {r.claim_id: r.status for r in aggregates.claim_status(certs, claims).collect()}
    assert got == {"a": "CONFLICT", "b": "SUPPORTED", "c": "CONTRADICTED", "d": "INSUFFICIENT", "e": "SUPPORTED", "f": "INSUFFICIENT"}


def test_flattening(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 10.0, "long"), (1, 1, 5.0, 8.0, "in"), (1, 2, 9.0, 25.0, "longest"), (1, 3, 30.0, 31.0, "alone")], "k int, ordinal int, start double, end double, caption string")
    got = sorted(tuple(r) for r in timeline.flattened(df, "k").collect())
    assert got == [(1, 0.0, 5.0, "long"), (1, 5.0, 8.0, "long"), (1, 8.0, 9.0, "long"), (1, 9.0, 10.0, "longest"), (1, 10.0, 25.0, "longest"), (1, 30.0, 31.0, "alone")]


def test_queue_fallback(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "z")], "p int, k string")
    right = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "c")], "p int, k string")
    got = sorted((r.p, r.r_p, r.how) for r in joins.keyed_or_next(left, right, ["k"], "p").collect())
    assert got == [(0, 0, "position"), (1, 2, "key"), (2, 0, "key")]


def test_bucketed_join_is_whole(spark):
    rng = random.Random(2)
    a = [(rng.randint(0, 2), i, float(rng.randint(0, 60)), rng.randint(0, 25)) for i in range(80)]
    b = [(rng.randint(0, 2), i, float(rng.randint(0, 60)), rng.randint(0, 25)) for i in range(80)]
    left = spark.createDataFrame([(k, i, s, s + d) for k, i, s, d in a], "k int, i int, start double, end double")
    right = spark.createDataFrame([(k, j, s, s + d) for k, j, s, d in b], "s_k int, j int, s_start double, s_end double")
    got = sorted((r.i, r.j) for r in joins.bucketed_overlaps(left, right, "k", 7.0).collect())
    want = sorted((i, j) for k, i, s, d in a for m, j, u, e in b if k == m and max(s, u) <= min(s + d, u + e))
    assert got == want


def test_unique_and_positional_fail(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        joins.unique(twice, ["k"]).collect()
    with pytest.raises(Exception, match="lengths differ"):
        joins.positional(twice.limit(1), twice.limit(1).withColumn("k", F.lit(2)), "k").collect()


def test_leaderboard_missing_scores(spark):
    df = spark.createDataFrame([("x", 1.0, None), ("y", 1.0, 2.0), ("z", 0.5, 2.0)], "name string, a double, b double")
    got = {r["name"]: (r.avg_rank, r["rank"]) for r in ranking.leaderboard(df, "name", ["a", "b"]).collect()}
    assert got == {"y": (1.0, 1), "x": (1.5, 3), "z": (1.5, 2)}


def test_forbidden_fields(spark):
    df = spark.sql("SELECT 1 AS qa_id, named_struct('gt_span', 1, 'x', array(named_struct('label', 2))) AS s")
    assert audits.forbidden_fields(df.schema) == ["$.s.gt_span", "$.s.x[*].label"]


def test_signed_rank_of_large_groups(spark):
    """A group of 21 values has a status instead of a test; zeros don't count, and no row is left out."""
    rows = [("big", float(i)) for i in range(1, 22)] + [("fits", float(i)) for i in range(21)] + [(None, 1.0), (None, None)]
    got = {r.g: (r.n, r.n_zero, r.p_value, r.status) for r in aggregates.signed_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {"big": (21.0, 0.0, None, "TOO_MANY"), "fits": (21.0, 1.0, 2 / 2**20, "OK"), None: (1.0, 0.0, 1.0, "OK")}

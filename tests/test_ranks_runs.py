"""Places in parted orders against sorting, verdicts and parsers by known values, readers of runs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.functions import parsing, verdicts
from spanloom.operators import ranking
from spanloom.sources import runs


@pytest.mark.parametrize("limits", [[], [3.0], [0.5, 2.0, 2.5, 7.0]])
def test_placed(spark, limits):
    rng = random.Random(2)
    data = [(k, rng.choice([None, "a", "b"]), rng.choice([None, 1.0, 2.0, 2.5, 3.0, 9.0])) for k in range(200)]
    df = spark.createDataFrame(data, "k int, g string, v double").repartition(3)
    got = {r.k: r.place for r in ranking.placed(df, ["g"], F.col("v"), limits, "k").collect()}
    tied = {r.k: r.place for r in ranking.placed(df, ["g"], F.col("v"), limits, ties=True).collect()}
    for g in (None, "a", "b"):
        rows = sorted((x for x in data if x[1] == g), key=lambda x: (x[2] is None, x[2] or 0, x[0]))
        for place, (k, _, v) in enumerate(rows, 1):
            assert got[k] == place
            assert tied[k] == 1 + next(i for i, x in enumerate(rows) if x[2] == v)
    assert ranking.placed(df.where("false"), ["g"], F.col("v"), limits, "k").count() == 0


def test_bounds_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert ranking.bounds(df, F.col("v")) == [[]]


def test_leaderboard_against_sorting(spark):
    rng = random.Random(3)
    data = [(f"n{k:03d}", rng.choice([None, 1.0, 2.0, 3.0]), float(rng.randint(0, 50))) for k in range(120)]
    got = {r["name"]: r["rank"] for r in ranking.leaderboard(spark.createDataFrame(data, "name string, a double, b double"), "name", ["a", "b"]).collect()}
    dense = lambda i: {v: p for p, v in enumerate(sorted({x[i] for x in data}, key=lambda v: (v is None, -(v or 0))), 1)}
    da, db = dense(1), dense(2)
    order = lambda x: ((da[x[1]] + db[x[2]]) / 2, -((da[x[1]] == 1) + (db[x[2]] == 1)), da[x[1]] + db[x[2]], -((x[1] or 0) / 3 + x[2] / max(y[2] for y in data)), x[0])
    assert got == {x[0]: p for p, x in enumerate(sorted(data, key=order), 1)}


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_verdicts(spark):
    s = lambda x: F.lit(x)
    assert one(spark, verdicts.candidate_label(s("YES"), s("WEAK_GT_ALIGNED")), verdicts.candidate_label(s("NO"), s("X")), verdicts.candidate_label(s(None).cast("string"), s("X"))) == ("WEAK_TRUE_SUPPORT", "OTHER", "OTHER")
    assert one(spark, verdicts.validity(s("TRUE_SUPPORT"), s(0), s("NO_GT_OVERLAP")), verdicts.validity(s("OTHER"), s(0), s("X"))) == ((False, False, "GT_EVIDENCE_REMOVED"), None)
    assert one(spark, verdicts.spatial_class(s(True), s(0.0), 0.3), verdicts.spatial_class(s(None).cast("boolean"), s(1.0), 0.3)) == ("SPURIOUS_SPATIAL_SUPPORT", "NOT_TEMPORALLY_ELIGIBLE")
    r = lambda *names, effect=None, geometry=False: one(spark, verdicts.refinement(F.array(*map(s, names)), s(effect).cast("string"), s(geometry)))[0]
    assert tuple(r("KEEP_SUPPORT_LOST", "CONTROL_UNAVAILABLE")) == ("PROTOCOL_UNAVAILABLE", False, "DIAGNOSE_CONTROL_GEOMETRY")
    assert tuple(r("INTERVENTION_NO_EFFECT", effect="UNIFORM_REGION")) == ("SPATIAL_PROPOSAL_OR_ROI_FAILURE", True, "SPATIAL_REFINE")
    assert r("NOTHING_KNOWN") is None


def test_parsers(spark):
    s = F.lit
    assert one(spark, *[parsing.level_of(s(x)) for x in ("Expert", " quite good ", "zzz", "unknown")]) == ("expert", "intermediate", "zzz", "novice")
    assert one(spark, *[parsing.wrapped_box(s(x)) for x in ("```json\n[[1, 2, 3, 4]]\n```", "[1,2,3.0,4]", '"[1,2,3,4]"', "at [1,2,3,4]", "[1,2,3]")]) == ([1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4], None, None)
    assert one(spark, *[parsing.wrapped_box(s(x)) for x in ('{"bbox": [1, 2, 3, 4]}', '["[1,2,3,4]"]', "`JSON [[[[0,0,1000,1000]]]]`", '{"bbox": [1, 2, 3, 4.0]}')]) == ([1, 2, 3, 4], [1, 2, 3, 4], [0, 0, 1000, 1000], [1, 2, 3, 4])
    refused = ("[1,2,3.5,4]", "[3,2,1,4]", "[-1,2,3,4]", "[1,2,3,1001]", '["1",2,3,4]', '{"bbox": [1,2,3,4], "why": 1}', "[[[[[1,2,3,4]]]]]", "[[1,2,3,4],[1,2,3,4]]", "````json [1,2,3,4]", "", "null", '{"bbox": null}')
    assert one(spark, *[parsing.wrapped_box(s(x)) for x in refused]) == (None,) * len(refused)
    assert one(spark, parsing.box_list(s("[1, 2, 3, 4] and [5,6,7,8.5]"))) == ([[1, 2, 3, 4], [5, 6, 7, 8.5]],)
    assert one(spark, parsing.schedule(s(0.0), s(1.0), s(0.25)), parsing.schedule(s(2.0), s(1.0), s(0.5)), parsing.schedule(s(0.0), s(1.0), s(0.0))) == ([0, 0.25, 0.5, 0.75, 1], None, None)
    assert one(spark, *[parsing.query_type(s(x)) for x in ('{"isGlobal": true}', '{"isGlobal": "False"}', '{"isGlobal": 1}', "x")]) == ("global", "local", None, None)
    assert one(spark, parsing.aspect_score(s("Detail - 4"), "detail"), parsing.aspect_score(s("none"), "detail")) == (4.0, None)
    assert one(spark, *[parsing.safe_relative(s(x)) for x in ("a/b", "/a", "a/../b", "..", "a..b", "")]) == (True, False, False, False, True, False)


def test_readers_of_runs(spark, tmp_path):
    schema = StructType.fromDDL("sample_id string, v int")
    (tmp_path / "a" / "samples").mkdir(parents=True)
    for k in range(3):
        (tmp_path / "a" / "samples" / f"{k}.json").write_text('{"sample_id": "s%d",\n "v": %d}' % (k, k))
    assert sorted(tuple(r) for r in runs.run_results(spark, str(tmp_path / "a"), schema).collect()) == [("s0", 0), ("s1", 1), ("s2", 2)]
    (tmp_path / "a" / "results.jsonl").write_text('{"sample_id": "x", "v": 1}\n{"sample_id": "x", "v": 2}\n')
    with pytest.raises(Exception, match="repeats"):
        runs.run_results(spark, str(tmp_path / "a"), schema).collect()
    (tmp_path / "t.json").write_text('[{"sample_id": "a", "v": 1}, {"sample_id": "b", "v": 2}]')
    assert runs.truths(spark, str(tmp_path / "t.json"), schema).count() == 2
    (tmp_path / "c.csv").write_text("sample_id,v\na,1\n")
    assert runs.cohort(spark, str(tmp_path / "c.csv"), schema).collect()[0].v == 1
    with pytest.raises(ValueError):
        runs.cohort(spark, str(tmp_path / "c.csv"), StructType.fromDDL("v int, sample_id string"))
    for k in (0, 2):
        (tmp_path / f"shard-{k:04d}.jsonl").write_text('{"sample_id": "s%d", "v": %d}\n' % (k, k))
    assert sorted(tuple(r) for r in runs.shards(spark, str(tmp_path), 3, schema, "sample_id", allow_missing=True).collect()) == [("s0", 0, 0), ("s2", 2, 2)]
    with pytest.raises(FileNotFoundError):
        runs.shards(spark, str(tmp_path), 3, schema, "sample_id")

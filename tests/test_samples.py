"""Samples in several layouts: known values, every reason, files, and rows that aren't samples."""

import json

import pytest

from spanloom.sources import samples

PATHS = [f"/root/data/v/{i}.jpg" for i in range(6)]


def tal_sample(**change):
    out = {
        "id": "clip", "qa_type": "tal", "dataset_name": "AVOS", "metadata": {"fps": "1.0"}, "video": PATHS, "sampled_video_frames": [0, 15, 30, 45, 60, 75],
        "conversations": [{"from": "human", "value": "when?"}, {"from": "gpt", "value": "1.0-2.0 seconds."}], "struc_info": [{"action": "cut", "spans": [{"start": 1.0, "end": 2.0}]}],
    }
    return {k: v for k, v in (out | change).items() if v != "-"}


def stg_sample(**change):
    out = {
        "id": "clip", "qa_type": "stg", "dataset_name": "CoPESD", "metadata": {"fps": 2}, "video": ["a/1", "a/2"], "sampled_video_frames": [0, "4"], "question": "where?",
        "struc_info": [{"object": "hook", "start": 0, "end": 3, "stride": 1, "bbox_dict": {"0.0": [1, 2, 3, 4]}}],
    }
    return {k: v for k, v in (out | change).items() if v != "-"}


def variants(spark, *rows):
    return samples.of_json(spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "position int, t string"), "position", "t")


def run(f, spark, *rows, **options):
    return f(variants(spark, *rows), **options).orderBy("position").collect()


def test_tal_known_values(spark):
    x = run(samples.tal, spark, tal_sample(), root="/frames/")[0]
    assert (x.qa_id, x.reason, x.temporal_status, x.analysis_eligible, x.gt_boundary_clipped) == ("0000::clip", None, "OK", True, False)
    assert x.clip_duration == 5 and x.visible == [15, 30] and x.paths[0] == "/frames/v/0.jpg" and (x.target, x.target_field, x.parse_source) == ("cut", "action", "struc_info")
    assert [(c.start, c.end) for c in x.cells] == [(0, 0.5), (0.5, 1.5), (1.5, 2.5), (2.5, 3.5), (3.5, 4.5), (4.5, 5)]


def known(spans, frames, last, **more):
    return tal_sample(data_source="NurViD", dataset_name="-", metadata={"fps": "1.0", "input_video_start_time": 0, "input_video_end_time": last}, video=["p"] * len(frames), sampled_video_frames=frames, struc_info=[{"phase": "cut", "spans": [{"start": a, "end": b} for a, b in spans]}], **more)


def test_stated_times(spark):
    got = run(
        samples.tal, spark, known([(1, 1)], [10, 10, 20], 2), known([(1, 1)], [0, 10, 20], 2), known([(0, 0), (3, 3)], [0, 10, 20, 30], 3), known([(-0.5, 2.5)], [0, 10, 20], 2),
        known([(0, 5)], [0, 10, 20], 2), known([(185, 185)], [0, 10], 184), known([(2, 1)], [0, 10, 20], 2), known([(0.2, 0.3)], [7, 7, 7], 2), known([(1, 1)], [7], 2), known([(0, 1)], [20, 10], 2),
    )
    assert [len(x.cells) for x in got[:1]] == [2] and got[0].cells[0].positions == [0, 1] and got[0].duplicate_count == 1 and got[0].frame_delta_median == 5
    assert got[1].visible == [10] and got[2].visible == [0, 30]
    assert got[3].temporal_status == "OK" and got[3].gt_boundary_clipped and [tuple(s) for s in got[3].spans] == [(0, 2)]
    assert got[4].temporal_status == "GT_OUT_OF_RANGE" and not got[4].analysis_eligible
    assert got[5].temporal_status == "GT_NEAR_BOUNDARY_NOT_VISIBLE" and got[5].spans == [] and got[5].clipped[0].reason == "OUTSIDE_CLIP_NEAR_BOUNDARY"
    assert got[6].temporal_status == "GT_INVALID"
    assert [(c.start, c.end, c.positions) for c in got[7].cells] == [(0, 2, [0, 1, 2])] and got[7].source_timebase_hz is None
    assert [(c.start, c.end) for c in got[8].cells] == [(0, 2)] and got[8].frame_delta_median is None
    assert [(c.frame, c.time) for c in got[9].cells] == [(20, 0), (10, 1)] and got[9].nonmonotonic_count == 1


def test_spans_of_answers(spark):
    said = lambda a: tal_sample(conversations=[{"from": "human", "value": ""}, {"from": "human", "value": "q"}, {"from": "gpt", "value": a}], struc_info=[{"phase": "p"}])
    got = run(samples.tal, spark, said("Start: 1 End 1.5; 1 – 1.5, 2 TO 3, 3—4"), said("none here"), said("-0.5 to 1"))
    assert [tuple(s) for s in got[0].raw_spans] == [(1, 1.5), (2, 3), (3, 4)] and got[0].parse_source == "gt_answer" and got[0].question == "q"
    assert got[1].reason == "MISSING_GT_SPANS" and got[1].raw_spans is None
    assert [tuple(s) for s in got[2].raw_spans] == [(-0.5, 1)]


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"qa_type": "stg"}, "NOT_TAL"), ({"qa_type": "-"}, "NOT_TAL"), ({"id": "-"}, "MISSING_CLIP_ID"), ({"conversations": None}, "MISSING_QUESTION;MISSING_GT_ANSWER"), ({"struc_info": []}, "MISSING_TARGET"),
        ({"video": []}, "MISSING_FRAMES;LEN_VIDEO_NE_SAMPLED_FRAMES"), ({"video": PATHS[1:]}, "LEN_VIDEO_NE_SAMPLED_FRAMES"), ({"sampled_video_frames": ["x"] * 6}, "MALFORMED_SAMPLED_VIDEO_FRAMES"), ({"metadata": {}}, "MISSING_METADATA_FPS"),
        ({"metadata": {"fps": "0"}}, "BAD_METADATA_FPS"), ({"metadata": {"fps": "fast"}}, "BAD_METADATA_FPS"), ({"dataset_name": ""}, "MISSING_DATASET_NAME"), ({"dataset_name": "Other"}, "UNSUPPORTED_DATASET"), ({"dataset_name": "NurViD"}, "MISSING_CLIP_TIMES"),
    ],
)
def test_tal_reasons(spark, change, reason):
    x = run(samples.tal, spark, tal_sample(**change))[0]
    assert x.reason == reason and x.cells is None and x.temporal_status is None and x.paths is None


def test_fallback_to_the_samples_own_rate(spark):
    x = run(samples.tal, spark, tal_sample(dataset_name="Other", metadata={"fps": 15}), fallback=True)[0]
    assert (x.reason, x.time_mapping_method, x.clip_duration, x.source_timebase_hz) == (None, "metadata_fps_source_frame_rate", 5, 15)
    x = run(samples.tal, spark, tal_sample(dataset_name="NurViD", metadata={"fps": 15}), fallback=True)[0]
    assert (x.reason, x.clip_duration) == (None, 5)


def test_stg(spark):
    got = run(samples.stg, spark, stg_sample(), stg_sample(qa_type="STG", struc_info=stg_sample()["struc_info"][0], video=["/old/a", "/old/b"]), root="/new", prefixes=("/old",))
    assert got[0].reason is None and got[0].boxes == {"0.0": [1, 2, 3, 4]} and got[0].clip_duration == 4 and got[0].visible == [0, 4] and (got[0].object, got[0].stride) == ("hook", 1)
    assert got[0].paths == ["/new/a/1", "/new/a/2"] and got[1].paths == ["/new/a", "/new/b"] and got[1].source_paths == ["/old/a", "/old/b"]
    for bad in ("/else/a", "/old", "../a"):
        assert run(samples.stg, spark, stg_sample(video=[bad, "b"]), root="/new", prefixes=("/old",))[0].reason == "FRAME_PATH_REMAP_FAILED"


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"qa_type": "tal"}, "NOT_STG"), ({"question": "-"}, "MISSING_QUESTION"), ({"conversations": [{"from": "user", "value": ""}]}, "MISSING_QUESTION"), ({"struc_info": None}, "MISSING_STRUC_INFO;MISSING_BBOX_DICT"),
        ({"struc_info": [{"start": 0, "end": 1, "bbox_dict": {}}]}, "MISSING_BBOX_DICT"), ({"struc_info": [{"bbox_dict": {"0": [1, 2, 3, 4]}}]}, "MISSING_SPAN"), ({"dataset_name": "AVOS"}, "UNSUPPORTED_STG_DATASET_TIMEBASE"),
        ({"sampled_video_frames": []}, "MISSING_SAMPLED_VIDEO_FRAMES;LEN_VIDEO_NE_SAMPLED_FRAMES"), ({"sampled_video_frames": [0, "x"]}, "MALFORMED_SAMPLED_VIDEO_FRAMES;MISSING_SAMPLED_VIDEO_FRAMES;LEN_VIDEO_NE_SAMPLED_FRAMES"),
    ],
)
def test_stg_reasons(spark, change, reason):
    assert run(samples.stg, spark, stg_sample(**change))[0].reason == reason


def test_segments(spark):
    s = [{"start": 0, "end": 1.5, "caption": "a"}, {"start": "2", "end": 3, "caption": None}, "no segment"]
    got = run(samples.segments, spark, {"struc_info": s}, {"struc_info": [s]}, {"struc_info": [{"dc_segments": s}]}, {"struc_info": []}, {}, {"struc_info": "x"})
    want = [(0, 1.5, "a"), (2, 3, None)]
    assert [(x.layout, [tuple(y) for y in x.segments]) for x in got] == [("FLAT", want), ("NESTED", want), ("DC_SEGMENTS", want), ("NONE", []), ("NONE", []), ("NONE", [])]


def test_files_and_rows_that_are_none(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([tal_sample(), stg_sample(), 5, None]))
    rows = samples.read(spark, str(tmp_path))
    assert [x.reason for x in samples.tal(rows).orderBy("position").collect()] == [None, "NOT_TAL", "NOT_TAL", "NOT_TAL"]
    assert [x.reason for x in samples.stg(rows).orderBy("position").collect()] == ["NOT_STG", None, "NOT_STG", "NOT_STG"]
    for f in (samples.tal, samples.stg):
        assert [x.reason[:4] for x in run(f, spark, "not JSON", "[]", "null")] == ["NOT_"] * 3
        assert f(rows.limit(0)).collect() == []
    big = tal_sample(video=["p"] * 20000, sampled_video_frames=[15 * (i // 2) for i in range(20000)])
    x = run(samples.tal, spark, big, big)
    assert [(len(y.cells), y.duplicate_count, len(y.visible)) for y in x] == [(10000, 10000, 2)] * 2


def test_judged(spark):
    nested = {"0.3": [{"x": 1}, {"llm_judge": {"R2": 4, "api_success": True, "raw_response": 7}}, {"llm_judge": {"R2": 1, "api_success": True}}], "0.5": [{"llm_judge": {"R2": 2.0, "R4": "3"}}], "0.7": 5}
    rows = variants(spark, {"qa_type": "region_caption_gpt", "llm_judge_scores": {"R2": 5, "R3": 1, "api_success": 1}, "evaluations": nested}, {"qa_type": "region_caption", "evaluations": nested}, {"qa_type": "region_caption"}, {"qa_type": "other"}, {"qa_type": "video_summary"}, "5", "null", "no JSON")
    got = {x.task: x for x in samples.judged(rows, ("region_caption", "video_summary", "dense_captioning")).collect()}
    assert sorted(got) == ["region_caption", "video_summary"]
    x = got["region_caption"]
    assert (x.num_samples, x.samples_with_scores, x.has_llm_judge) == (3, 2, True) and x.aspect_scores == {"R2": pytest.approx(11 / 3), "R3": 1} and x.average_score == pytest.approx((11 / 3 + 1) / 2)
    assert tuple(got["video_summary"]) == ("video_summary", 1, 0, False, None, None)
    assert samples.judged(rows.limit(0), ("video_summary",)).collect() == []

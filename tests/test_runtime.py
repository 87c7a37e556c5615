"""Claims, metrics, clip times, packets, decisions and bound claims: known values, empty tables, nulls and a key that holds a large share."""

import hashlib
import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from spanloom.functions import claims as fc
from spanloom.operators import runtime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def parsed(spark, raw, maximum=3):
    return one(spark, fc.parse_claims(F.lit(raw).cast("string"), F.lit("s1"), maximum))


def test_claims(spark):
    x = parsed(spark, '{"claims": [{"text": " one "}, {"text": "\\u0438\\n"}]}')
    name = lambda t: "claim_" + hashlib.sha256(json.dumps(["s1", t], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24]
    assert x.reason is None and [tuple(c) for c in x.claims] == [(name("one"), "one"), (name("и"), "и")]
    assert tuple(parsed(spark, '{"claims": []}')) == ([], None)
    cases = {
        None: "NOT_JSON", "": "NOT_JSON", "{": "NOT_JSON", "null": "EXPECTED_CLAIMS_ARRAY", "[]": "EXPECTED_CLAIMS_ARRAY", '{"claims": null}': "EXPECTED_CLAIMS_ARRAY",
        '{"claims": [], "x": 1}': "EXPECTED_CLAIMS_ARRAY", '{"claims": [1, 2, 3, 4]}': "TOO_MANY_CLAIMS", '{"claims": [null]}': "CLAIM_FORM", '{"claims": [{"text": "a", "b": 1}]}': "CLAIM_FORM",
        '{"claims": [{"text": 7}]}': "CLAIM_TEXT", '{"claims": [{"text": null}]}': "CLAIM_TEXT", '{"claims": [{"text": " "}]}': "CLAIM_TEXT",
        '{"claims": [{"text": "a"}, {"text": "a "}]}': "DUPLICATE_CLAIM", json.dumps({"claims": [{"text": "a" * 2001}]}): "CLAIM_TEXT",
    }
    assert {k: parsed(spark, k).reason for k in cases} == cases
    assert parsed(spark, json.dumps({"claims": [{"text": "a" * 2000}]})).reason is None


def test_metrics_of_outputs(spark):
    overall = lambda **f: {"overall": f}
    full = {
        "TAL": overall(**{"meanIoU@0.3": 0.5, "meanIoU@0.5": 0.25}), "stg": overall(mean_iou=1), "NEXT_ACTION": overall(accuracy=0.75), "dense_captioning": overall(caption_score=2), "vs": overall(average_score=3, caption_score=9),
        "rc": overall(score=4), "skill_assessment": overall(accuracy=0.125), "CVS": overall(component_balanced_accuracy=0.0625, accuracy=1),
    }
    read = lambda x: one(spark, fc.reported_metrics(F.lit(x if x is None or isinstance(x, str) else json.dumps({"aggregated_results": x})).cast("string")))
    x = read(full).asDict()
    assert x.pop("success") and x.pop("missing") == []
    assert x == {"cvs_acc": 0.0625, "nap_acc": 0.75, "sa_acc": 0.125, "stg_miou": 1, "tag_miou_03": 0.5, "tag_miou_05": 0.25, "dvc_llm": 2, "dvc_f1": 0, "vs_llm": 3, "rc_llm": 4}
    x = read(full | {"tal": {}})
    assert not x.success and x.missing == ["tag_miou_03", "tag_miou_05"]
    for nothing in (None, "", "{", "[]", "{}", {}):
        assert len(read(nothing).missing) == 10


def test_clip_times(spark):
    def told(refs, start, end, fps):
        return one(spark, fc.native_times(F.lit(refs).cast("array<int>") if refs is None else F.array(*map(F.lit, refs)).cast("array<int>"), F.lit(start), F.lit(end), F.lit(fps).cast("double")))

    x = told([10, 11, 11, 13], 1.0, 3.0, 2)
    assert x.reason is None and x.times == [Decimal(0), Decimal("0.5"), Decimal("0.5"), Decimal("1.5")] and (x.span, x.tail, x.allowed, x.repeated) == (Decimal("1.5"), Decimal("0.5"), Decimal(1), 1)
    assert told([10, 13], 1.0, 2.0, 2).reason == "SPAN_EXCEEDS_DURATION" == told([13, 10], 1.0, 2.0, 2).reason
    assert told([10, 11], 1.0, 2.75, 2).reason == "TAIL_GAP_EXCEEDS_BOUND"
    assert told([], 1.0, 2.0, 2).reason == "NO_FRAMES" == told(None, 1.0, 2.0, 2).reason
    assert told([1], 1.0, 2.0, 0).reason == "NO_RATE" == told([1], 1.0, 2.0, None).reason


def test_identifiers_of_submissions(spark):
    s = lambda x: F.lit(x).cast("string")
    ask = lambda given, video, starts, ends, fps: one(spark, fc.submission_id(s(given), s(video), [s(x) for x in starts], [s(x) for x in ends], F.lit(fps)))
    assert ask("a", "v", ["1"], ["2"], 2) == "a"
    assert ask("", "v", ["", "1"], [None, "2"], 2) == "v&&1&&2&&2"
    assert ask(None, None, [None], [""], None) == "&&&&&&"
    rows = spark.createDataFrame([("1", 0, "i", "region_caption_gpt", "p", "d", "extra"), ("2", 1, "j", None, None, None, None)], "sample_id string, original_index int, id string, qa_type string, prediction string, data_source string, n string")
    assert [tuple(r) for r in runtime.submission_rows(rows).collect()] == [("2", 1, "j", "", "", None)]
    assert runtime.submission_rows(rows, True).count() == 2


def test_packets_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(p, rng.randrange(90), rng.choice([None, *range(40)]), rng.random() < 0.7) for p in range(12) for _ in range(rng.randrange(1, 60))]
    got = {(r.p, r.slot): (r.order, r.aliases) for r in runtime.packet_frames(spark.createDataFrame(rows, "p int, o int, v int, shown boolean"), "p", "o", ["v"], "shown").collect()}
    want = {}
    for p in range(12):
        mine = [r for r in rows if r[0] == p]
        firsts = {}
        for _, o, v, shown in mine:
            if shown:
                firsts[v] = min(firsts.get(v, o), o)
        frames = sorted((o, hashlib.sha256(json.dumps({"v": v}, separators=(",", ":")).encode()).hexdigest(), v) for v, o in firsts.items())
        if len(frames) > 8:
            frames = [frames[(i * (len(frames) - 1) + 3) // 7] for i in range(8)]
        want |= {(p, i): (o, sorted({r[1] for r in mine if r[2] == v})) for i, (o, _, v) in enumerate(frames)}
    assert got == want


def test_decisions(spark):
    schema = "k int, candidate_id string, position int, route string, required array<string>, contextual array<string>"
    yes, no = "ACCEPTED", "UNRESOLVED"
    rows = [
        (1, "a", 0, "ABSTAIN", [yes, yes], [yes]), (1, "b", 5, "ELIGIBLE_SPATIAL_ANCHOR", [no], None),
        (2, "a", 1, "ABSTAIN", [yes], [yes, no]), (2, "b", 2, "ABSTAIN", [yes], [yes]),
        (3, "b", 1, None, None, None), (3, "a", 1, None, [], []),
    ]
    got = {r.k: tuple(r)[1:] for r in runtime.decide(spark.createDataFrame(rows, schema), "k").collect()}
    assert got == {1: ("b", "ELIGIBLE_SPATIAL_ANCHOR", 0, 0, 2), 2: ("b", "ABSTAIN", 1, 0, 2), 3: ("a", None, 0, 0, 2)}
    assert runtime.decide(spark.createDataFrame([], schema), "k").count() == 0


CLAIM, WINDOW, RECORD = "source_record_index int, digest string, claim_id string, text string", "claim_id string, orders array<int>, confirmed boolean, note string", "source_record_index int, digest string, sample_id string, n_frames int"


def bound(spark, claims, windows, records, excluded=()):
    made = runtime.bind_claims(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(windows, WINDOW), spark.createDataFrame(records, RECORD), list(excluded))
    return sorted(((r.claim_id, r.reasons, r.frame_ids) for r in made.collect()), key=repr)


def test_bound_claims(spark):
    d = [c * 64 for c in "abcdef"]
    text = "the forceps grasps tissue %d"
    claims = [(i, d[i], f"c{i}", text % i) for i in range(6)]
    records = [(i, d[i], f"s{i}", 4) for i in range(6)]
    windows = [("c0", [2, 3], True, "seen"), ("c1", [1, 1], True, "seen"), ("c2", [3, 4], False, "the ROI"), ("c3", [0], True, " "), ("c3", [0], True, "seen"), ("c4", [0, 1, 2, 3], None, None), ("zz", [0], True, "seen")]
    assert bound(spark, claims, windows, records, [5]) == sorted([
        ("c0", [], ["s0:frame:000002", "s0:frame:000003"]), ("c1", ["WINDOW_ORDERS"], None), ("c2", ["WINDOW_BEYOND_RECORD", "NOT_CONFIRMED", "NOTE_FORBIDDEN"], None),
        ("c3", ["WINDOW_COUNT", "NOTE_FORM"], None), ("c4", ["WINDOW_ORDERS", "NOT_CONFIRMED", "NOTE_FORM", "NOTE_FORBIDDEN"], None),
        ("c5", ["EXCLUDED_INDEX", "WINDOW_COUNT", "WINDOW_ORDERS", "WINDOW_BEYOND_RECORD", "NOT_CONFIRMED", "NOTE_FORM", "NOTE_FORBIDDEN"], None), ("zz", ["WINDOW_WITHOUT_CLAIM"], None),
    ], key=repr)
    assert bound(spark, [], windows[:1], records) == [("c0", ["WINDOW_WITHOUT_CLAIM"], None)]
    assert bound(spark, [], [], []) == []
    (nulls,) = bound(spark, [(None, None, None, None)], [], [])
    assert nulls[1][:3] == ["EXCLUDED_INDEX", "DIGEST_FORM", "CLAIM_FORM"] and nulls[2] is None


def test_one_text_of_many_claims(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    claims = [(i, digest(i), f"c{i}", "the forceps grasps it" if i % 3 == 0 else f"the forceps grasps {i}") for i in range(600)]
    got = bound(spark, claims, [(f"c{i}", [0], True, "seen") for i in range(600)], [(i, digest(i), f"s{i}", 1) for i in range(600)])
    assert len(got) == 600 and sum(r == ["REPEATED_TEXT"] for _, r, _ in got) == 200 and sum(r == [] for _, r, _ in got) == 400


def test_region_audit(spark):
    schema = "qa_type string, anchor string, box array<int>, frames array<string>"
    rows = [("region_caption_x", "a", [1], ["a"]), ("region_caption", "a", [1], ["b"]), ("region_caption", None, [1], None), ("region_caption", "a", None, ["a"]), ("tal", None, None, None), (None, "a", [1], ["a"])]
    assert [tuple(r) for r in runtime.region_audit(spark.createDataFrame(rows, schema)).collect()] == [("RC_SELECTOR_ADAPTATION_REQUIRED", 4, 3)]
    assert [tuple(r) for r in runtime.region_audit(spark.createDataFrame([], schema)).collect()] == [("NO_RC_SAMPLES", 0, 0)]

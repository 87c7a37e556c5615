from pyspark.sql import functions as F

from spanloom.functions import boxes, intervals, labels, picks, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_interval_definitions(spark):
    d = [F.lit(float(x)) for x in (0, 10, 5, 15)]
    r = one(spark, intervals.iou_hull(*d), intervals.iou_ordered(*d), intervals.iou_union(*d))
    assert r[0] == 5 / 15 and abs(r[1] - 5 / 15) < 1e-8 and r[2] == 5 / 15
    point = [F.lit(float(x)) for x in (3, 3, 3, 3)]
    assert tuple(one(spark, intervals.iou_hull(*point), intervals.iou_union(*point))) == (0.0, 0.0)
    swapped = [F.lit(float(x)) for x in (10, 0, 5, 15)]
    assert abs(one(spark, intervals.iou_ordered(*swapped))[0] - 5 / 15) < 1e-8


def test_spans_against_a_clip(spark):
    """The known cases: partly outside, far outside, near the boundary, reversed."""
    cases = [((-0.5, 2.5), 2.0, "OK", (0.0, 2.0)), ((0.0, 5.0), 2.0, "GT_OUT_OF_RANGE", None), ((185.0, 185.0), 184.0, "GT_NEAR_BOUNDARY_NOT_VISIBLE", None), ((3.0, 1.0), 10.0, "GT_INVALID", None)]
    for (a, b), clip, status, span in cases:
        c = intervals.clip_span(F.lit(a), F.lit(b), F.lit(clip), intervals.tolerance(F.lit(1.0)))
        r = one(spark, c.alias("c"), intervals.clip_status(F.array(c)).alias("s"))
        assert r["s"] == status
        assert (r["c"]["start"], r["c"]["end"]) == (span or (None, None))
    far = intervals.clip_span(F.lit(185.0), F.lit(185.0), F.lit(184.0), F.lit(1.0))
    assert one(spark, far)[0]["reason"] == "OUTSIDE_CLIP_NEAR_BOUNDARY"


def test_windows_of_positions(spark):
    starts = lambda n, size, stride, drop: one(spark, picks.window_starts(F.lit(n), size, stride, drop))[0]
    assert starts(6, 4, 2, True) == [0, 2]
    assert starts(6, 4, 3, False) == [0, 3]
    assert starts(6, 4, 2, False) == [0, 2]
    assert starts(3, 4, 2, True) == [] and starts(3, 4, 2, False) == [0] and starts(0, 4, 2, False) == []


def test_positions_against_python(spark):
    for n in (1, 2, 5, 8, 9, 31, 100):
        k = min(n, 8)
        r = one(spark, picks.centred(F.lit(n), 8), picks.endpoints(F.lit(n), 8), picks.floored(F.lit(n), 8))
        assert r[0] == [round((i + 1) * n / k - 1) for i in range(k)]
        assert r[1] == list(dict.fromkeys(round(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)))
        assert r[2] == [int(i * (n - 1) / 7) for i in range(8)]


def test_pyramid_against_python(spark):
    for last in (5.0, 8.0, 20.0, 33.0):
        want = []
        for s in (8.0, 16.0):
            starts = [0.0]
            if last > s:
                starts, at = [], 0.0
                while at + s < last:
                    starts.append(at)
                    at += s / 2
                starts.append(last - s)
            want += [(s, x, min(last, x + s)) for x in starts]
        assert [tuple(w) for w in one(spark, picks.pyramid(F.lit(last), [8.0, 16.0]))[0]] == want


def test_boxes(spark):
    a, b = F.array(*[F.lit(float(x)) for x in (0, 0, 10, 10)]), F.array(*[F.lit(float(x)) for x in (5, 5, 15, 15)])
    r = one(spark, boxes.iou_floor(a, b), boxes.iou_clamped(a, b), boxes.to_pixels(F.array(*[F.lit(float(x)) for x in (1, 1, 999, 1001)]), F.lit(100), F.lit(50)), boxes.is_strict_box(b, True), boxes.is_box(F.array(F.lit(1.0))))
    assert abs(r[0] - 25 / 175) < 1e-12 and abs(r[1] - 25 / 175) < 1e-12
    assert r[2] == [0, 0, 100, 50] and r[3] is False and r[4] is False
    c = one(spark, boxes.corner_control(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.3, 0.3)])))[0]
    assert c["iou"] == 0 and c["corner"] == 1


def test_text_parsers(spark):
    seg = lambda s: [(x["start"], x["end"]) for x in one(spark, text.segments(F.lit(s)))[0]]
    assert seg("22.0-78.0, 89.0-94.0 seconds.") == [(22.0, 78.0), (89.0, 94.0)]
    assert seg("from 12.1 to 117.0") == [(12.1, 117.0)]
    assert seg("00:00:00 to 00:00:08") == [(0.0, 0.0), (0.0, 8.0)]
    assert seg("nothing") == []
    lines = one(spark, text.caption_lines(F.lit("0.0-5.0 seconds: cut\n5.0-9.0 seconds: tie\nknot")))[0]
    assert [tuple(x) for x in lines] == [(0.0, 5.0, "cut"), (5.0, 9.0, "tie\nknot")]
    boxes = lambda s: [(x["t"], x["box"]) for x in one(spark, text.box_series(F.lit(s)))[0]]
    assert boxes("8.0 seconds: [445, 107, 582, 262] 9.0 seconds: [0,0,0,0] 10 seconds: [1,2,3,4]") == [(8.0, [445, 107, 582, 262]), (9.0, [0, 0, 0, 0]), (10.0, [1, 2, 3, 4])]
    assert boxes("1 seconds: [x] 2 seconds: [1, -2, .5, 1e2] 3 seconds: [1, 2, 3] 4 seconds: [1,2,3,4,] 2.0 seconds: [[5,6,7,8]]") == [(2.0, [5, 6, 7, 8]), (3.0, [1, -2, 0.5, 100]), (4.0, [1, -2, 0.5, 100])]
    assert boxes("") == boxes("3 seconds: [] 4seconds: [1,2,3,4] [1,2,3,4]") == []
    assert one(spark, text.box_series(F.lit(None).cast("string")))[0] is None
    r = one(spark, text.yes_no(F.lit("YES")), text.yes_no(F.lit(" no. ")), text.yes_no(F.lit("yes it is")), text.yes_no(F.lit(None).cast("string")), text.answer_letter(F.lit("answer: (c)")))
    assert tuple(r) == ("YES", "NO", "INVALID", "INVALID", "C")
    p = one(spark, text.id_parts(F.lit("v&&1&&2&&1.0")), text.id_parts(F.lit("1.0$v$1$2")))
    assert tuple(p[0]) == ("v", 1, 2, 1.0) and p[1] is None
    scores = one(spark, text.component_scores(F.lit("Two structures: 0, Cystic plate: 1, Hepatocystic triangle: 2")))[0]
    assert [tuple(s) for s in scores] == [("Two structures", 0), ("Cystic plate", 1), ("Hepatocystic triangle", 2)]
    assert one(spark, text.mean_out_of_five(F.lit("Respect for tissue: 2/5, Suture/needle handling: 1/5")))[0] == 1.5


def test_labels(spark):
    a = lambda n, v, d, r: labels.alignment_class(F.lit(True), F.lit(n), F.lit(v), F.lit(d), F.lit(r))
    r = one(spark, a(2, 2, 1.0, 1.0), labels.support_label(F.lit("YES"), a(2, 2, 1.0, 1.0)), a(2, 0, 0.0, 0.0), labels.support_label(F.lit("YES"), a(2, 0, 0.0, 0.0)), labels.support_label(F.lit("NO"), a(2, 2, 1.0, 1.0)), a(9, 1, 0.1, 0.1))
    assert tuple(r) == ("STRONG_GT_ALIGNED", "STRONG_GT_SUPPORT", "NO_GT_OVERLAP", "SPURIOUS_SUPPORT", "NOT_SUPPORT_CANDIDATE", "WEAK_GT_ALIGNED")
    r = one(spark, labels.best_label({"A": F.lit(1.0), "B": F.lit(1.0), "C": F.lit(0.0)}), labels.retention(F.lit(True), F.lit("YES")), labels.retention(F.lit(False), F.lit("YES")), labels.first_reason([("x", F.lit(False)), ("y", F.lit(True))]), labels.human_bytes(F.lit(2048)))
    assert tuple(r) == ("A", 1, None, "y", "2.00 KiB")


def test_claim_scope(spark):
    import hashlib

    from spanloom.functions.scopes import claim_scope

    claims = [" At least ONE  small tool is used ", "There are some cuts", "The device is visibly present", "The overall scene is calm", "Supplied frames visibly depict a long procedure", "The forceps grasp tissue", "The stoma is identifiable", "A contactless step", "", "\n ", None]
    got = [x.x for x in spark.createDataFrame([(i, c) for i, c in enumerate(claims)], "i int, c string").select("i", claim_scope(F.col("c")).alias("x")).orderBy("i").collect()]
    m, g, a, u = "MULTI_SUPPORT_POSSIBLE", "GLOBAL_DISTRIBUTED", "LOCAL_ATOMIC", "UNRESOLVED_SCOPE"
    assert [x and x.claim_scope for x in got] == [m, m, m, g, g, a, a, u, None, None, None]
    assert [x.single_roi_certificate_applicable for x in got[5:8]] == [True, True, False]
    assert got[0].claim_text_sha256 == hashlib.sha256(claims[0].strip().encode()).hexdigest()


def test_terminal_query(spark):
    from spanloom.functions.scopes import terminal_query

    asked = ["Step one. When does  the Cut happen?! ", "what is the time span of x?", "When is x performed? When does y happen?", "When does x happen", "When does x. y happen?", "find the segment(s) where x happens.", "When can I see x in the video??", "", None, "When does   happen?"]
    got = [x.x and tuple(x.x) for x in spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").select("i", terminal_query(F.col("q")).alias("x")).orderBy("i").collect()]
    assert got == [("when_does_happen", "the cut"), ("what_is_time_span_of", "x"), None, None, None, ("find_segments_where_happens", "x"), ("when_can_i_see_in_video", "x"), None, None, None]

"""Samples of questions about clips, of several layouts, as VARIANT: each is accepted or told a reason, in one pass without an exchange.

Every function takes rows with a position and a VARIANT and returns each of them once. Where `reason` is null the sample is accepted and its columns are
filled; otherwise `reason` holds all codes that apply, joined by `;`, and the other columns are null. Missing keys, JSON nulls and values of another type
count as absent; null samples and such as aren't objects have no kind and are told so. Blanks and digits in texts are ASCII ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import intervals
from spanloom.functions.claims import bound

# Frames a second of the sources' indices, by data set.
TAL_HZ = {"AVOS": 15.0, "CholecT50": 1.0, "CoPESD": 1.0, "EgoSurgery": 0.5}
STG_HZ = {"CholecTrack20": 25.0, "CoPESD": 1.0, "EgoSurgery": 0.5}
#: Fixed value: the data set whose clips state their times.
STATED = "NurViD"

NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"
# How answers write spans.
START_END = rf"(?i)start\s*:?\s*{NUMBER}\s*,?\s*end\s*:?\s*{NUMBER}"
RANGE = rf"(?i){NUMBER}\s*(?:-|–|—|to)\s*{NUMBER}"

SPAN = "start double, end double"
TURNS = "array<struct<from: string, value: string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """position, sample: the elements of each JSON document that is an array, as they stand in it. A file is one row, and one that isn't an array an error."""
    docs = spark.read.option("wholetext", True).text(path).select(F.expr("variant_get(parse_json(value), '$', 'array<variant>')").alias("d"))
    return docs.select(F.posexplode("d").alias("position", "sample"))


def of_json(rows: DataFrame, position: str, text: str) -> DataFrame:
    """position, sample: a column of JSON texts; those that aren't JSON have a null sample."""
    return rows.select(F.col(position).alias("position"), F.try_parse_json(F.col(text)).alias("sample"))


def _at(path: str, kind: str, source: str = "sample") -> Column:
    return F.expr(f"try_variant_get({source}, '$.{path}', '{kind}')")


def _text(path: str) -> Column:
    """A text or a number as text; empty where there is none."""
    return F.coalesce(_at(path, "string"), F.lit(""))


def _first(turns: Column, *roles: str, empty: bool = False) -> Column:
    """The value of the first turn of one of `roles`; of the first that isn't empty, unless `empty`."""
    found = F.filter(turns, lambda t: t["from"].isin(*roles) & (F.lit(empty) | (F.coalesce(t["value"], F.lit("")) != "")))
    return F.get(found, F.lit(0))["value"]


def _objects(array: Column) -> Column:
    return F.filter(F.coalesce(array, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def _member(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _codes(*pairs: tuple[Column, str]) -> Column:
    """All codes whose condition holds, joined by `;`; null where none does."""
    return F.nullif(F.concat_ws(";", *[F.when(c, F.lit(code)) for c, code in pairs]), F.lit(""))


def spans_of_answer(answer: Column) -> Column:
    """array of start, end: the spans that a text writes, `start .. end ..` before ranges, each once."""

    def found(pattern: str) -> Column:
        ends = [F.regexp_extract_all(answer, F.lit(pattern), F.lit(k)) for k in (1, 2)]
        return F.transform(F.arrays_zip(ends[0].alias("a"), ends[1].alias("b")), lambda x: F.struct(x["a"].cast("double").alias("start"), x["b"].cast("double").alias("end")))

    return F.coalesce(F.array_distinct(F.concat(found(START_END), found(RANGE))), F.array().cast(f"array<struct<{SPAN}>>"))


def _hz(table: dict[str, float]) -> Column:
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), lambda k, _: k == F.col("dataset_name"))), F.lit(0))


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def _mapped(rows: DataFrame) -> DataFrame:
    """Times, cells, clipped spans and what can be seen, of rows with reason, frames, raw_spans, fps, hz, known (the stated duration or null).

    Cells are made in the row: frames in order, the first of each run of equal ones, halfway points between neighbours; linear but for the sort.
    """
    ok = F.col("reason").isNull()
    rows = rows.withColumn("frames", F.when(ok, F.col("frames"))).withColumn("raw_spans", F.when(ok, F.col("raw_spans")))
    rows = rows.withColumns({"first": F.get("frames", F.lit(0)), "last": F.element_at("frames", -1)})
    range_ = F.col("last") - F.col("first")
    stated = F.col("known").isNotNull()
    duration = F.when(stated, F.col("known")).otherwise(F.greatest(range_, F.lit(0)) / F.col("hz"))
    rate = F.when(stated, F.when((F.col("known") > 0) & (range_ > 0), range_ / F.col("known"))).otherwise(F.col("hz"))
    rows = rows.withColumns({"clip_duration": F.when(ok, duration), "source_timebase_hz": F.when(ok, rate)})

    def time(f: Column, i: Column) -> Column:
        even = F.when(range_ > 0, (f - F.col("first")) / range_ * F.col("clip_duration")).otherwise(i / F.col("fps"))
        return F.when(stated, even).otherwise((f - F.col("first")) / F.col("hz"))

    seen = F.transform("frames", lambda f, i: F.struct(f.alias("frame"), time(f, i).alias("time"), i.alias("at")))
    rows = rows.withColumn("seen", F.array_sort(seen))
    at = lambda name, i: F.get(name, i)
    new = lambda x, i: (i == 0) | (at("seen", i - 1)["frame"] != x["frame"])
    rows = rows.withColumn("starts", F.filter(F.transform("seen", lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull()))
    stop = lambda k: F.coalesce(at("starts", k + 1), F.size("seen"))
    unique = F.transform(
        "starts",
        lambda s, k: F.struct(at("seen", s)["time"].alias("time"), at("seen", s)["frame"].alias("frame"), F.transform(F.slice("seen", s + 1, stop(k) - s), lambda x: x["at"]).alias("positions")),
    )
    rows = rows.withColumn("unique", F.array_sort(unique))
    cell = lambda x, i: F.struct(
        x["frame"].alias("frame"),
        x["time"].alias("time"),
        F.when(i == 0, F.lit(0.0)).otherwise((at("unique", i - 1)["time"] + x["time"]) / 2).alias("start"),
        F.when(i == F.size("unique") - 1, F.col("clip_duration")).otherwise((x["time"] + at("unique", i + 1)["time"]) / 2).alias("end"),
        x["positions"].alias("positions"),
    )
    clipped = F.transform("raw_spans", lambda s: intervals.clip_span(s["start"], s["end"], F.col("clip_duration"), intervals.tolerance(F.col("fps"))))
    rows = rows.withColumns({"cells": F.transform("unique", cell), "clipped": clipped})
    kept = F.transform(F.filter("clipped", lambda s: s["start"].isNotNull()), lambda s: F.struct(s["start"], s["end"]))
    rows = rows.withColumn("spans", kept)
    visible = F.filter("cells", lambda c: F.exists("spans", lambda s: intervals.touches(c["start"], c["end"], s["start"], s["end"])))
    rows = rows.withColumn("visible", F.array_sort(F.transform(visible, lambda c: c["frame"])))
    status = intervals.clip_status(F.col("clipped"))
    status = F.when(ok, F.when((status == "OK") & (F.size("visible") == 0), F.lit("NO_VISIBLE_GT_FRAME")).otherwise(status))
    deltas = F.transform(F.slice("frames", 2, F.greatest(F.size("frames") - 1, F.lit(0))), lambda f, i: f - at("frames", i))
    rows = rows.withColumns({"temporal_status": status, "deltas": deltas})
    return rows.withColumns(
        {
            "analysis_eligible": F.col("temporal_status") == "OK",
            "gt_boundary_clipped": F.exists("clipped", lambda s: s["reason"].eqNullSafe("PARTIAL_BOUNDARY_CLIPPED")),
            "gt_duration_total": F.when(ok, F.aggregate("spans", F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), s["end"] - s["start"]))),
            "time_mapping_method": F.when(ok, F.col("method")),
            "n_unique_frames": F.when(ok, F.size("unique")),
            "duplicate_count": F.when(ok, F.size("frames") - F.size("unique")),
            "nonmonotonic_count": F.when(ok, F.size(F.filter("deltas", lambda d: d < 0))),
            "frame_delta_median": _median(F.col("deltas")),
            "positive_frame_delta_median": _median(F.filter("deltas", lambda d: d > 0)),
        }
    )


_OUT = (
    "clip_duration time_mapping_method source_timebase_hz paths frames raw_spans clipped spans cells visible temporal_status analysis_eligible gt_boundary_clipped "
    "gt_duration_total n_unique_frames duplicate_count nonmonotonic_count frame_delta_median positive_frame_delta_median"
).split()


def _common(rows: DataFrame, base: dict[str, float], dataset: Column, asked: Column) -> DataFrame:
    """What both kinds share: identity, data set, paths, frames and rates. Of samples of another kind only the identity is read; their sample is null from here on."""
    own = rows.select("position", "sample", F.coalesce(asked, F.lit(False)).alias("asked"), _text("id").alias("clip_id"))
    raw = own.select("position", F.when(F.col("asked"), F.col("sample")).alias("sample"), "asked", "clip_id").withColumns(
        {
            "paths": F.coalesce(_at("video", "array<string>"), F.array().cast("array<string>")),
            "frames": _at("sampled_video_frames", "array<bigint>"),
            "has_frames": F.size(F.coalesce(_at("sampled_video_frames", "array<variant>"), F.array().cast("array<variant>"))) > 0,
            "has_fps": _at("metadata.fps", "variant").isNotNull(),
            "fps": _at("metadata.fps", "double"),
            "dataset_name": dataset,
        }
    )
    raw = raw.withColumn("malformed", F.col("has_frames") & F.coalesce(F.exists("frames", lambda f: f.isNull()), F.lit(True)))
    raw = raw.withColumn("frames", F.when(F.col("malformed") | F.col("frames").isNull(), F.array().cast("array<bigint>")).otherwise(F.col("frames")))
    return raw.withColumns({"hz": _hz(base), "qa_id": F.format_string("%04d::%s", F.col("position"), F.col("clip_id"))})


def _bad_fps() -> Column:
    return F.col("has_fps") & ~F.coalesce(F.col("fps") > 0, F.lit(False))


def tal(rows: DataFrame, root: str | None = None, old_root: str = "/root/data", fallback: bool = False) -> DataFrame:
    """Samples that ask when something happens: position, qa_id, clip_id, reason, question, answer, target and its field, where spans come from, and the timeline.

    Reasons: NOT_TAL alone, or MISSING_CLIP_ID, MISSING_QUESTION, MISSING_GT_ANSWER, MISSING_TARGET, MISSING_GT_SPANS, MISSING_FRAMES,
    LEN_VIDEO_NE_SAMPLED_FRAMES, MALFORMED_SAMPLED_VIDEO_FRAMES, MISSING_METADATA_FPS, BAD_METADATA_FPS, MISSING_DATASET_NAME, UNSUPPORTED_DATASET,
    MISSING_CLIP_TIMES. Spans are those of `struc_info`, else those that the answer writes. Paths below `old_root` move below `root`. With `fallback`, a
    data set without a known rate is timed by the sample's own frames a second instead of being refused.
    """
    named = F.coalesce(F.nullif(_at("dataset_name", "string"), F.lit("")), F.nullif(_at("data_source", "string"), F.lit("")))
    turns = _at("conversations", TURNS)
    df = _common(rows, TAL_HZ, named, _at("qa_type", "string") == "tal").withColumns({"question": _first(turns, "human"), "answer": _first(turns, "gpt"), "items": _objects(_at("struc_info", "array<variant>"))})
    aimed = F.filter(F.transform("items", lambda v: F.struct(_member(v, "action", "string").alias("action"), _member(v, "phase", "string").alias("phase"))), lambda t: F.coalesce(t["action"], t["phase"]).isNotNull())
    df = df.withColumn("aim", F.get(aimed, F.lit(0)))
    told = F.flatten(F.transform("items", lambda v: _objects(_member(v, "spans", "array<variant>"))))
    told = F.filter(F.transform(told, lambda v: F.struct(_member(v, "start", "double").alias("start"), _member(v, "end", "double").alias("end"))), lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    df = df.withColumn("told", told).withColumn("written", F.when(F.col("asked") & (F.coalesce(F.size("told"), F.lit(0)) <= 0), spans_of_answer(F.col("answer"))))
    df = df.withColumns(
        {
            "raw_spans": F.when(F.size("told") > 0, F.col("told")).otherwise(F.col("written")),
            "parse_source": F.when(F.size("told") > 0, "struc_info").when(F.size("written") > 0, "gt_answer").otherwise("none"),
            "target": F.coalesce("aim.action", "aim.phase"),
            "target_field": F.when(F.col("aim.action").isNotNull(), "action").when(F.col("aim.phase").isNotNull(), "phase"),
            "is_stated": F.coalesce(F.col("dataset_name") == STATED, F.lit(False)),
            "known": _at("metadata.input_video_end_time", "double") - _at("metadata.input_video_start_time", "double"),
        }
    )
    codes = _codes(
        (F.col("clip_id") == "", "MISSING_CLIP_ID"),
        (F.col("question").isNull(), "MISSING_QUESTION"),
        (F.col("answer").isNull(), "MISSING_GT_ANSWER"),
        (F.col("target").isNull(), "MISSING_TARGET"),
        (F.size("raw_spans") == 0, "MISSING_GT_SPANS"),
        ((F.size("paths") == 0) | ~F.col("has_frames"), "MISSING_FRAMES"),
        (~F.col("malformed") & (F.size("paths") != F.size("frames")), "LEN_VIDEO_NE_SAMPLED_FRAMES"),
        (F.col("malformed"), "MALFORMED_SAMPLED_VIDEO_FRAMES"),
        (~F.col("has_fps"), "MISSING_METADATA_FPS"),
        (_bad_fps(), "BAD_METADATA_FPS"),
        (F.col("dataset_name").isNull(), "MISSING_DATASET_NAME"),
        (F.lit(not fallback) & F.col("dataset_name").isNotNull() & ~F.col("is_stated") & F.col("hz").isNull(), "UNSUPPORTED_DATASET"),
        (F.col("is_stated") & F.col("known").isNull() & F.lit(not fallback), "MISSING_CLIP_TIMES"),
    )
    stated = F.col("is_stated") & F.col("known").isNotNull()
    df = df.withColumns(
        {
            "reason": F.when(~F.col("asked"), "NOT_TAL").otherwise(codes),
            "method": F.when(stated, "known_duration_endpoint_interpolation").when(F.col("hz").isNotNull(), "source_frame_rate").otherwise("metadata_fps_source_frame_rate"),
            "hz": F.coalesce("hz", F.when(F.lit(fallback), F.col("fps"))),
            "known": F.when(stated, F.col("known")),
            "paths": F.transform("paths", lambda p: _moved(p, root, old_root)),
        }
    )
    df = _mapped(df)
    ok = F.col("reason").isNull()
    own = ("dataset_name", "question", "answer", "target", "target_field", "parse_source", "fps")
    return df.select("position", "qa_id", "clip_id", "reason", *[F.when(ok, F.col(c)).alias(c) for c in (*own, *_OUT)])


def _moved(path: Column, root: str | None, old_root: str) -> Column:
    if not root:
        return path
    old = old_root.rstrip("/")
    return F.when(path.startswith(old + "/"), F.concat(F.lit(root.rstrip("/")), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def _below(path: Column, root: str, prefixes: tuple[str, ...]) -> Column:
    """A path put below `root`; null where it is absolute and under none of `prefixes`, is one of them, or climbs."""

    def rest(slashes: Column) -> Column:
        out = F.when(~slashes.startswith("/"), slashes)
        for p in (*prefixes, root):
            p = p.rstrip("/")
            out = F.coalesce(out, F.when(slashes.startswith(p + "/"), F.substring(slashes, F.lit(len(p) + 2), F.length(slashes))))
        return out

    sound = lambda r: (r != "") & ~F.array_contains(F.split(r, "/"), "..")
    return bound(bound(F.replace(path, F.lit("\\"), F.lit("/")), rest), lambda r: F.when(sound(r), F.concat(F.lit(root.rstrip("/") + "/"), r)))


def stg(rows: DataFrame, root: str | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Samples that ask where something is: position, qa_id, clip_id, reason, question, the object, its boxes by time, start, end and stride, and the timeline.

    Reasons: NOT_STG or FRAME_PATH_REMAP_FAILED alone, or MISSING_CLIP_ID, MISSING_QUESTION, MISSING_STRUC_INFO, MISSING_METADATA_FPS, BAD_METADATA_FPS,
    MISSING_VIDEO_FRAMES, MALFORMED_SAMPLED_VIDEO_FRAMES, MISSING_SAMPLED_VIDEO_FRAMES, LEN_VIDEO_NE_SAMPLED_FRAMES,
    UNSUPPORTED_STG_DATASET_TIMEBASE, MISSING_BBOX_DICT, MISSING_SPAN. `struc_info` is an object or an array whose first element is one. With `root`, paths are
    put below it: relative ones, and those below one of `prefixes`.
    """
    named = F.coalesce(F.nullif(_at("dataset_name", "string"), F.lit("")), F.nullif(_at("data_source", "string"), F.lit("")), F.lit("Unknown"))
    turns = F.filter(_at("conversations", TURNS), lambda t: t["from"].isin("human", "user"))
    whole, first = _at("struc_info", "variant"), _at("struc_info[0]", "variant")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    df = _common(rows, STG_HZ, named, F.lower(_at("qa_type", "string")) == "stg").withColumns({"turns": turns, "info": F.when(is_object(whole), whole).when(is_object(first), first)})
    asked = F.when(F.size(F.coalesce("turns", F.array().cast(TURNS))) > 0, F.get("turns", F.lit(0))["value"]).otherwise(_at("question", "string"))
    df = df.withColumns(
        {
            "question": F.nullif(asked, F.lit("")),
            "boxes": _at("bbox_dict", "map<string, array<double>>", "info"),
            "object": _at("object", "string", "info"),
            "start": _at("start", "double", "info"),
            "end": _at("end", "double", "info"),
            "stride": F.coalesce(_at("stride", "double", "info"), F.lit(0.0)),
            "moved": F.transform("paths", lambda p: _below(p, root, prefixes)) if root else F.col("paths"),
        }
    )
    empty = F.coalesce(F.schema_of_variant("info").isin("OBJECT<>", "OBJECT"), F.lit(True))
    codes = _codes(
        (F.col("clip_id") == "", "MISSING_CLIP_ID"),
        (F.col("question").isNull(), "MISSING_QUESTION"),
        (empty, "MISSING_STRUC_INFO"),
        (~F.col("has_fps"), "MISSING_METADATA_FPS"),
        (_bad_fps(), "BAD_METADATA_FPS"),
        (F.size("paths") == 0, "MISSING_VIDEO_FRAMES"),
        (F.col("malformed"), "MALFORMED_SAMPLED_VIDEO_FRAMES"),
        (~F.col("has_frames") | F.col("malformed"), "MISSING_SAMPLED_VIDEO_FRAMES"),
        (F.size("paths") != F.size("frames"), "LEN_VIDEO_NE_SAMPLED_FRAMES"),
        (F.col("hz").isNull(), "UNSUPPORTED_STG_DATASET_TIMEBASE"),
        (F.coalesce(F.size("boxes"), F.lit(0)) <= 0, "MISSING_BBOX_DICT"),
        (~empty & (F.col("start").isNull() | F.col("end").isNull()), "MISSING_SPAN"),
    )
    lost = F.exists("moved", lambda p: p.isNull()) if root else F.lit(False)
    df = df.withColumns(
        {
            "reason": F.when(~F.col("asked"), "NOT_STG").when(lost, "FRAME_PATH_REMAP_FAILED").otherwise(codes),
            "raw_spans": F.array(F.struct("start", "end")),
            "method": F.lit("source_frame_rate"),
            "known": F.lit(None).cast("double"),
            "source_paths": F.col("paths"),
            "paths": F.col("moved"),
        }
    )
    df = _mapped(df)
    ok = F.col("reason").isNull()
    own = ("dataset_name", "question", "object", "boxes", "start", "end", "stride", "fps", "source_paths")
    return df.select("position", "qa_id", "clip_id", "reason", *[F.when(ok, F.col(c)).alias(c) for c in (*own, *_OUT)])


def segments(rows: DataFrame) -> DataFrame:
    """position, layout, segments: dense captions of a sample, from a list, a list in a list or a list under `dc_segments`; else layout NONE and no segments."""
    df = rows.select("position", F.coalesce(_at("struc_info", "array<variant>"), F.array().cast("array<variant>")).alias("all"))
    df = df.withColumn("shape", F.schema_of_variant(F.get("all", F.lit(0))))
    inner, under = F.try_variant_get(F.get("all", F.lit(0)), "$", "array<variant>"), F.try_variant_get(F.get("all", F.lit(0)), "$.dc_segments", "array<variant>")
    df = df.withColumns({"layout": F.when(F.col("shape").startswith("ARRAY"), "NESTED").when(under.isNotNull(), "DC_SEGMENTS").when(F.col("shape").startswith("OBJECT"), "FLAT").otherwise("NONE")})
    items = F.when(F.col("layout") == "NESTED", inner).when(F.col("layout") == "DC_SEGMENTS", under).when(F.col("layout") == "FLAT", F.col("all"))
    made = lambda v: F.struct(_member(v, "start", "double").alias("start"), _member(v, "end", "double").alias("end"), _member(v, "caption", "string").alias("caption"))
    return df.select("position", "layout", F.transform(_objects(items), made).alias("segments"))


def judged(rows: DataFrame, tasks: tuple[str, ...]) -> DataFrame:
    """task, num_samples, samples_with_scores, has_llm_judge, average_score, aspect_scores of judged records, for each of `tasks` that a record's qa_type contains.

    Scores are the numbers under `llm_judge_scores`; without such an object, those of the first judged element of each list under `evaluations`. There a
    list counts as scored where the judge says `api_success`, otherwise a record with any key does. An average is that of the aspects' means; it and the
    scores are null where nothing was scored. Tasks without records have no row. Sums meet before the exchange; aspects of a task are one row.
    """
    numbers = lambda m: F.filter(F.map_entries(m), lambda e: ~e["key"].isin("api_success", "raw_response") & ~F.schema_of_variant(e["value"]).rlike("^(STRING|OBJECT|ARRAY|VOID)"))
    parts = lambda v: F.try_variant_get(v, "$", "map<string, variant>")
    df = rows.select(F.explode(F.filter(F.array(*map(F.lit, tasks)), lambda t: F.contains(_text("qa_type"), t))).alias("task"), _at("llm_judge_scores", "map<string, variant>").alias("direct"), _at("evaluations", "map<string, variant>").alias("evaluations"))
    lists = F.transform(F.map_values("evaluations"), lambda v: _objects(F.try_variant_get(v, "$", "array<variant>")))
    first = F.transform(lists, lambda items: F.get(F.filter(F.transform(items, lambda v: parts(F.try_variant_get(v, "$.llm_judge", "variant"))), lambda m: m.isNotNull()), F.lit(0)))
    df = df.withColumn("judges", F.when(F.col("direct").isNotNull(), F.array("direct")).otherwise(F.filter(first, lambda m: m.isNotNull())))
    said = lambda m: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit("api_success")), "$", "boolean"), F.lit(False))
    scored = F.when(F.col("direct").isNotNull(), F.when(F.size("direct") > 0, 1).otherwise(0)).otherwise(F.size(F.filter(F.coalesce("judges", F.array().cast("array<map<string, variant>>")), said)))
    entry = lambda e: F.struct(e["key"].alias("aspect"), F.try_variant_get(e["value"], "$", "double").alias("value"), F.lit(0).alias("sample"), F.lit(0).alias("scored"))
    own = F.struct(F.lit(None).cast("string").alias("aspect"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("sample"), scored.alias("scored"))
    found = F.transform(F.flatten(F.transform("judges", numbers)), entry)
    flat = df.select("task", F.explode(F.concat(F.array(own), F.coalesce(found, F.array().cast("array<struct<aspect: string, value: double, sample: int, scored: int>>")))).alias("x")).select("task", "x.*")
    means = flat.groupBy("task", "aspect").agg(F.avg("value").alias("mean"), F.sum("sample").alias("samples"), F.sum("scored").alias("scored"))
    out = means.groupBy("task").agg(F.sum("samples").alias("num_samples"), F.sum("scored").alias("samples_with_scores"), F.avg("mean").alias("average_score"), F.array_sort(F.collect_list(F.when(F.col("aspect").isNotNull(), F.struct("aspect", "mean")))).alias("all"))
    has = (F.col("samples_with_scores") > 0) & (F.size("all") > 0)
    return out.select("task", "num_samples", "samples_with_scores", has.alias("has_llm_judge"), F.when(has, F.col("average_score")).alias("average_score"), F.when(has, F.map_from_entries("all")).alias("aspect_scores"))

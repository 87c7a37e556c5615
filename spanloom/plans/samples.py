"""Queries of samples in several layouts: orders and their lines as JSON, accepted or told a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import scopes
from spanloom.operators import ranking
from spanloom.sources import samples

from .registry import Tables, query

DATASETS = ("AVOS", "CoPESD", "EgoSurgery", "NurViD", "CholecTrack20")


def _documents(t: Tables) -> DataFrame:
    """o_orderkey, text: each order with lines as a sample, its lines as frames and spans; every kind, layout and fault is there."""
    k, n = F.col("o_orderkey"), F.size("lines")
    line = F.struct("l_linenumber", F.round(F.col("l_quantity") / 10 - 1, 2).alias("start"), F.round(F.col("l_quantity") / 10 - 2 + F.col("l_tax") * 50, 2).alias("end"), "l_partkey", F.col("l_returnflag").alias("caption"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = t.orders.join(lines, "o_orderkey")
    folder = F.when(F.col("o_custkey") % 37 == 0, "/elsewhere/").otherwise("/root/data/")
    video = F.transform("lines", lambda x: F.concat(folder, x["l_partkey"].cast("string")))
    spans = F.transform("lines", lambda x: F.struct(x["start"], x["end"]))
    answer = F.concat_ws(", ", F.transform("lines", lambda x: F.concat_ws(" to ", x["start"].cast("string"), x["end"].cast("string"))))
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    aim = F.when(k % 2 == 0, F.to_json(F.struct(F.col("o_orderpriority").alias("action"), F.when(k % 3 > 0, spans).alias("spans")))).otherwise(F.to_json(F.struct(F.col("o_orderpriority").alias("phase"), F.when(k % 3 > 0, spans).alias("spans"))))
    place = F.to_json(
        F.struct(
            F.col("o_orderpriority").alias("object"), F.array_min(F.transform("lines", lambda x: x["start"])).alias("start"), F.array_max(F.transform("lines", lambda x: x["end"])).alias("end"),
            F.when(k % 7 > 0, F.create_map(F.lit("0.0"), F.array(*map(F.lit, (1, 2, 3, 4))))).alias("bbox_dict"),
        )
    )
    dense = F.to_json(F.transform("lines", lambda x: F.struct(x["start"], x["end"], x["caption"])))
    info = (
        F.when(k % 29 == 0, "[]").when((k % 5).isin(0, 2), F.concat(F.lit("["), aim, F.lit("]"))).when(k % 5 == 1, F.concat(F.lit("["), place, F.lit("]"))).when(k % 5 == 3, place)
        .when(k % 3 == 0, F.concat(F.lit("["), dense, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit('[{"dc_segments":'), dense, F.lit("}]"))).otherwise(dense)
    )
    rest = F.struct(
        F.when(k % 11 > 0, F.concat(F.lit("c"), k)).alias("id"),
        F.element_at(F.array(*map(F.lit, ("tal", "stg", "tal", "STG", "dense"))), (k % 5 + 1).cast("int")).alias("qa_type"),
        F.get(F.array(*map(F.lit, DATASETS)), (F.col("o_custkey") % 6).cast("int")).alias("dataset_name"),
        F.struct(F.when(k % 13 > 0, "2.0").alias("fps"), F.when(k % 31 > 0, 10.0).alias("input_video_start_time"), (10 + 3 * n).alias("input_video_end_time")).alias("metadata"),
        F.when(k % 17 > 0, video).otherwise(F.slice(video, 1, n - 1)).alias("video"),
        F.transform("lines", lambda x: 15 * (x["l_linenumber"] * 5 % 7)).alias("sampled_video_frames"),
        F.array(turn("human", F.when(k % 19 > 0, F.col("o_orderpriority")).otherwise("")), turn("gpt", F.when(k % 23 > 0, answer).otherwise(""))).alias("conversations"),
    )
    return rows.select("o_orderkey", F.concat(F.lit('{"struc_info":'), info, F.lit(","), F.substr(F.to_json(rest), F.lit(2))).alias("text"))


# What the documents hold, as relations: orders, their frames with times at `hz` frames a second, cells, spans and what can be seen.
_RELATIONS = """l AS (SELECT l_orderkey AS k, l_linenumber AS ln, 15 * (l_linenumber * 5 % 7) AS f, round(l_quantity / 10 - 1, 2) AS s, round(l_quantity / 10 - 2 + l_tax * 50, 2) AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM lineitem),
o AS (SELECT o_orderkey AS k, o_custkey AS c, ['AVOS', 'CoPESD', 'EgoSurgery', 'NurViD', 'CholecTrack20'][1 + o_custkey % 6] AS dataset, count(*) AS n, arg_min(f, ln) AS f1, arg_max(f, ln) AS f2, min(s) AS low, max(e) AS high FROM orders JOIN l ON o_orderkey = l.k GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN stated THEN 3 * n ELSE greatest(f2 - f1, 0) / hz END AS dur FROM (SELECT *, {hz} AS hz, {stated} AS stated, {reason} AS reason FROM o WHERE {kind})),
p AS (SELECT m.k, f, min(CASE WHEN NOT stated THEN (f - f1) / hz WHEN f2 > f1 THEN (f - f1) / (f2 - f1) * dur ELSE i / 2.0 END) AS t FROM m JOIN l USING (k) WHERE reason IS NULL GROUP BY 1, 2),
c AS (SELECT p.k, f, CASE WHEN lag(t) OVER w IS NULL THEN 0 ELSE (lag(t) OVER w + t) / 2 END AS a, CASE WHEN lead(t) OVER w IS NULL THEN dur ELSE (t + lead(t) OVER w) / 2 END AS b FROM p JOIN m USING (k) WINDOW w AS (PARTITION BY p.k ORDER BY t, f)),
r AS ({spans}),
x AS (SELECT k, CASE WHEN e < s THEN 'GT_END_BEFORE_START' WHEN (e < 0 OR s > dur) AND (CASE WHEN e < 0 THEN abs(e) ELSE s - dur END) <= 1 THEN 'OUTSIDE_CLIP_NEAR_BOUNDARY' WHEN e < 0 OR s > dur OR greatest(0, -s, e - dur) > 1 THEN 'GT_OUT_OF_RANGE' WHEN s < 0 OR e > dur THEN 'PARTIAL_BOUNDARY_CLIPPED' END AS why, greatest(s, 0) AS a, least(e, dur) AS b FROM r JOIN m USING (k) WHERE reason IS NULL),
y AS (SELECT k, count(*) FILTER (why IS NULL OR why = 'PARTIAL_BOUNDARY_CLIPPED') AS kept, bool_or(coalesce(why, '') = 'PARTIAL_BOUNDARY_CLIPPED') AS clipped, bool_or(coalesce(why, '') = 'GT_END_BEFORE_START') AS bad, bool_or(coalesce(why, '') = 'GT_OUT_OF_RANGE') AS far, coalesce(sum(b - a) FILTER (why IS NULL OR why = 'PARTIAL_BOUNDARY_CLIPPED'), 0) AS total FROM x GROUP BY 1),
v AS (SELECT c.k, count(DISTINCT c.f) AS seen FROM c JOIN x ON c.k = x.k AND (why IS NULL OR why = 'PARTIAL_BOUNDARY_CLIPPED') AND greatest(c.a, x.a) <= least(c.b, x.b) GROUP BY 1),
q AS (SELECT k, count(*) AS cells, round(max(b), 6) AS last_end, round(sum(a), 6) AS starts FROM c GROUP BY 1),
d AS (SELECT k, count(*) FILTER (f < g) AS falls FROM (SELECT k, f, lag(f) OVER (PARTITION BY k ORDER BY i) AS g FROM l) GROUP BY 1)"""

_COLUMNS = """CASE WHEN reason IS NULL THEN round(dur, 6) END AS clip_duration, CASE WHEN reason IS NULL THEN cells END::INT AS cells, last_end, starts, CASE WHEN reason IS NULL THEN coalesce(seen, 0) END::INT AS visible,
CASE WHEN reason IS NULL THEN CASE WHEN bad THEN 'GT_INVALID' WHEN far THEN 'GT_OUT_OF_RANGE' WHEN kept = 0 THEN 'GT_NEAR_BOUNDARY_NOT_VISIBLE' WHEN coalesce(seen, 0) = 0 THEN 'NO_VISIBLE_GT_FRAME' ELSE 'OK' END END AS temporal_status,
CASE WHEN reason IS NULL THEN clipped END AS clipped, CASE WHEN reason IS NULL THEN round(total, 4) END AS total, CASE WHEN reason IS NULL THEN n - cells END::INT AS duplicates, CASE WHEN reason IS NULL THEN falls END::INT AS falls"""
_JOINED = "FROM m LEFT JOIN q USING (k) LEFT JOIN y USING (k) LEFT JOIN v USING (k) LEFT JOIN d USING (k)"


def _told() -> list[Column]:
    cells = lambda part: F.transform("cells", lambda x: x[part])
    return [
        F.round("clip_duration", 6).alias("clip_duration"), F.size("cells").alias("cells"), F.round(F.array_max(cells("end")), 6).alias("last_end"),
        F.round(F.aggregate(cells("start"), F.lit(0.0), lambda acc, x: acc + x), 6).alias("starts"), F.size("visible").alias("visible"), "temporal_status", F.col("gt_boundary_clipped").alias("clipped"),
        F.round("gt_duration_total", 4).alias("total"), F.col("duplicate_count").alias("duplicates"), F.col("nonmonotonic_count").alias("falls"),
    ]


_TAL_REASON = """nullif(concat_ws(';', CASE WHEN k % 11 = 0 THEN 'MISSING_CLIP_ID' END, CASE WHEN k % 19 = 0 THEN 'MISSING_QUESTION' END, CASE WHEN k % 23 = 0 THEN 'MISSING_GT_ANSWER' END, CASE WHEN k % 29 = 0 THEN 'MISSING_TARGET' END,
CASE WHEN k % 23 = 0 AND (k % 29 = 0 OR k % 3 = 0) THEN 'MISSING_GT_SPANS' END, CASE WHEN k % 17 = 0 AND n = 1 THEN 'MISSING_FRAMES' END, CASE WHEN k % 17 = 0 THEN 'LEN_VIDEO_NE_SAMPLED_FRAMES' END, CASE WHEN k % 13 = 0 THEN 'MISSING_METADATA_FPS' END,
CASE WHEN dataset IS NULL THEN 'MISSING_DATASET_NAME' END, CASE WHEN dataset = 'CholecTrack20' THEN 'UNSUPPORTED_DATASET' END, CASE WHEN dataset = 'NurViD' AND k % 31 = 0 THEN 'MISSING_CLIP_TIMES' END), '')"""
_TAL = {
    "hz": "CASE dataset WHEN 'AVOS' THEN 15.0 WHEN 'CoPESD' THEN 1.0 WHEN 'EgoSurgery' THEN 0.5 END::DOUBLE", "stated": "coalesce(dataset = 'NurViD', false)", "reason": _TAL_REASON, "kind": "k % 5 IN (0, 2)",
    "spans": "SELECT k, s, e FROM l WHERE k % 3 > 0 AND k % 29 > 0 UNION ALL SELECT DISTINCT k, s, e FROM l WHERE k % 3 = 0 OR k % 29 = 0",
}


@query(
    "p18_tal_samples",
    f"""WITH {_RELATIONS.format(**_TAL)} SELECT k AS o_orderkey, reason, CASE WHEN reason IS NULL THEN CASE WHEN k % 2 = 0 THEN 'action' ELSE 'phase' END END AS target_field, CASE WHEN reason IS NULL THEN CASE WHEN k % 3 > 0 THEN 'struc_info' ELSE 'gt_answer' END END AS parse_source,
CASE WHEN reason IS NULL THEN CASE WHEN stated THEN 'known_duration_endpoint_interpolation' ELSE 'source_frame_rate' END END AS method, {_COLUMNS} {_JOINED} UNION ALL SELECT k, 'NOT_TAL', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o WHERE k % 5 NOT IN (0, 2)""",
)
def tal_samples(t: Tables) -> DataFrame:
    out = samples.tal(samples.of_json(_documents(t), "o_orderkey", "text"))
    return out.select(F.col("position").alias("o_orderkey"), "reason", "target_field", "parse_source", F.col("time_mapping_method").alias("method"), *_told())


_STG_REASON = """CASE WHEN c % 37 = 0 AND (k % 17 > 0 OR n > 1) THEN 'FRAME_PATH_REMAP_FAILED' ELSE nullif(concat_ws(';', CASE WHEN k % 11 = 0 THEN 'MISSING_CLIP_ID' END, CASE WHEN k % 19 = 0 THEN 'MISSING_QUESTION' END, CASE WHEN k % 29 = 0 THEN 'MISSING_STRUC_INFO' END,
CASE WHEN k % 13 = 0 THEN 'MISSING_METADATA_FPS' END, CASE WHEN k % 17 = 0 AND n = 1 THEN 'MISSING_VIDEO_FRAMES' END, CASE WHEN k % 17 = 0 THEN 'LEN_VIDEO_NE_SAMPLED_FRAMES' END, CASE WHEN coalesce(dataset NOT IN ('CholecTrack20', 'CoPESD', 'EgoSurgery'), true) THEN 'UNSUPPORTED_STG_DATASET_TIMEBASE' END,
CASE WHEN k % 7 = 0 OR k % 29 = 0 THEN 'MISSING_BBOX_DICT' END), '') END"""
_STG = {
    "hz": "CASE dataset WHEN 'CholecTrack20' THEN 25.0 WHEN 'CoPESD' THEN 1.0 WHEN 'EgoSurgery' THEN 0.5 END::DOUBLE", "stated": "false", "reason": _STG_REASON, "kind": "k % 5 IN (1, 3)", "spans": "SELECT k, low AS s, high AS e FROM o",
}


@query(
    "p19_stg_samples",
    f"""WITH {_RELATIONS.format(**_STG)} SELECT k AS o_orderkey, reason, CASE WHEN reason IS NULL THEN low END AS "start", CASE WHEN reason IS NULL THEN high END AS "end", CASE WHEN reason IS NULL THEN '/frames/' || first_part END AS first_path, {_COLUMNS}
{_JOINED} JOIN (SELECT l_orderkey AS k, arg_min(l_partkey, {{'a': l_linenumber, 'b': round(l_quantity / 10 - 1, 2), 'c': round(l_quantity / 10 - 2 + l_tax * 50, 2), 'd': l_partkey}}) AS first_part FROM lineitem GROUP BY 1) USING (k) UNION ALL SELECT k, 'NOT_STG', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o WHERE k % 5 NOT IN (1, 3)""",
)
def stg_samples(t: Tables) -> DataFrame:
    out = samples.stg(samples.of_json(_documents(t), "o_orderkey", "text"), "/frames", ("/root/data",))
    return out.select(F.col("position").alias("o_orderkey"), "reason", "start", "end", F.get("paths", F.lit(0)).alias("first_path"), *_told())


@query(
    "p06_segment_layouts",
    """SELECT l_orderkey AS o_orderkey, CASE l_orderkey % 3 WHEN 0 THEN 'NESTED' WHEN 1 THEN 'DC_SEGMENTS' ELSE 'FLAT' END AS layout, round(l_quantity / 10 - 1, 2) AS "start", round(l_quantity / 10 - 2 + l_tax * 50, 2) AS "end", l_returnflag AS caption
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 5 = 4 AND l_orderkey % 29 > 0""",
)
def segment_layouts(t: Tables) -> DataFrame:
    docs = samples.of_json(_documents(t), "o_orderkey", "text").where("try_variant_get(sample, '$.qa_type', 'string') = 'dense'")
    # explode_outer: explode would infer a filter on the segments and push it, and with it the parsing, below every step.
    return samples.segments(docs).select(F.col("position").alias("o_orderkey"), "layout", F.explode_outer("segments").alias("s")).where("s IS NOT NULL").select("o_orderkey", "layout", "s.*")


@query(
    "a14_judge_scores",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, ['dense_captioning', 'video_summary', 'region_caption'][1 + o_orderkey % 3] AS task FROM orders),
s AS (SELECT task, 'R2' AS aspect, 1 + c % 5 AS v FROM o WHERE k % 2 = 0 AND k % 8 <> 4 UNION ALL SELECT task, 'R3', 1 + k % 4 FROM o WHERE k % 2 = 0 AND k % 8 <> 4 UNION ALL SELECT task, 'R2', 1 + k % 5 FROM o WHERE k % 4 = 1 UNION ALL SELECT task, 'R4', 2 + k % 7 FROM o WHERE k % 4 = 1),
m AS (SELECT task, aspect, avg(v) AS mean FROM s GROUP BY 1, 2), a AS (SELECT task, avg(mean) AS average FROM m GROUP BY 1),
n AS (SELECT task, count(*) AS num_samples, sum(CASE WHEN k % 2 = 0 AND k % 8 <> 4 THEN 1 WHEN k % 4 = 1 THEN 1 + (k % 7 > 0)::INT ELSE 0 END)::BIGINT AS samples_with_scores FROM o GROUP BY 1)
SELECT task, num_samples, samples_with_scores, samples_with_scores > 0 AS has_llm_judge, round(average, 9) AS average_score, aspect, round(mean, 9) AS mean FROM m JOIN a USING (task) JOIN n USING (task)""",
)
def judge_scores(t: Tables) -> DataFrame:
    """Orders as judged records: scores of their own, of lists by threshold, of both (then their own), empty ones and none."""
    k = F.col("o_orderkey")
    own = F.when(k % 8 == 4, F.lit("{}")).otherwise(F.to_json(F.struct((1 + F.col("o_custkey") % 5).alias("R2"), (1 + k % 4).alias("R3"), F.lit(True).alias("api_success"), F.lit("5").alias("note"))))
    judge = lambda **scores: F.struct(F.struct(*[v.alias(n) for n, v in scores.items()]).alias("llm_judge"))
    low = F.to_json(F.array(judge(R2=1 + k % 5, api_success=k % 7 > 0, raw_response=F.lit("R2")), judge(R2=F.lit(99).cast("long"), api_success=F.lit(True), raw_response=F.lit(""))))
    high = F.to_json(F.array(judge(R4=2 + k % 7, api_success=F.lit(True))))
    lists = F.concat(F.lit('{"0.3":'), low, F.lit(',"0.5":'), high, F.lit(',"0.7":"none"}'))
    task = F.element_at(F.array(*map(F.lit, ("dense_captioning_gpt", "x_video_summary", "region_caption"))), (k % 3 + 1).cast("int"))
    text = F.concat(F.lit('{"qa_type":"'), task, F.lit('"'), F.when(k % 2 == 0, F.concat(F.lit(',"llm_judge_scores":'), own)).otherwise(""), F.when((k % 4).isin(1, 2), F.concat(F.lit(',"evaluations":'), lists)).otherwise(""), F.lit("}"))
    out = samples.judged(samples.of_json(t.orders.select(k, text.alias("text")), "o_orderkey", "text"), ("dense_captioning", "video_summary", "region_caption"))
    one = out.select("task", "num_samples", "samples_with_scores", "has_llm_judge", F.round("average_score", 9).alias("average_score"), F.explode_outer("aspect_scores").alias("aspect", "mean"))
    return one.withColumn("mean", F.round("mean", 9))


CLAIMS = ("At least one {} tool moves", "There is a {}", "the {} device is visible", "An entire  scene of {}", "provided frames depict {} and a scene", "{} touches the part", "{} is open", "a catheter with {} is identifiable", "{}", "any {}", "  The {} jaw enters ", " ")
_CLAIM = "replace([" + ", ".join(f"'{c}'" for c in CLAIMS) + "][1 + (p_partkey % 12)::INT], '{}', p_name)"
_CLEAN = r"regexp_replace(lower(regexp_replace(claim, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


@query(
    "x25_claim_scopes",
    f"""WITH c AS (SELECT p_partkey, {_CLAIM} AS claim FROM part), d AS (SELECT *, {_CLEAN} AS plain FROM c), s AS (SELECT *, CASE {" ".join("WHEN " + " OR ".join(f"regexp_matches(plain, '{p}')" for p in ps) + f" THEN '{scope}'" for scope, _, ps in scopes.SCOPES)} ELSE '{scopes.UNRESOLVED[0]}' END AS scope FROM d)
SELECT p_partkey, CASE WHEN plain <> '' THEN scope END AS claim_scope, CASE WHEN plain <> '' THEN CASE scope {" ".join(f"WHEN '{scope}' THEN '{reason}'" for scope, reason, _ in scopes.SCOPES)} ELSE '{scopes.UNRESOLVED[1]}' END END AS reason_code, CASE WHEN plain <> '' THEN scope = 'LOCAL_ATOMIC' END AS single_roi_certificate_applicable,
CASE WHEN plain <> '' THEN sha256(trim(claim)) END AS claim_text_sha256 FROM s""",
)
def claim_scopes(t: Tables) -> DataFrame:
    """Names of parts in claims of every scope, with a blank one."""
    claim = F.replace(F.get(F.array(*map(F.lit, CLAIMS)), (F.col("p_partkey") % 12).cast("int")), F.lit("{}"), F.col("p_name"))
    parts = t.part.select("p_partkey", "p_name").repartition(ranking.PARTS, "p_partkey")  # patterns take long, and a file may be one task
    return parts.select("p_partkey", scopes.claim_scope(claim).alias("x")).select("p_partkey", "x.*")


QUESTIONS = (
    "When does {} happen?", "A list. when is  {} performed ?!", "In this clip, during what interval does {} occur!", "Find the segment(s) where {} happens.", "what is the time span of {}??  ", "When can I see {} in the video?",
    "When does {} happen? When is it performed?", "When does a happen. {}", "{}", "When is {} performed?!",
)
_QUESTION = "replace([" + ", ".join(f"'{q}'" for q in QUESTIONS) + "][1 + (p_partkey % 10)::INT], '{}', p_name)"
_ENDS = [f"regexp_matches(q, '{p}\\s*$')" for _, p in scopes.TERMINAL]


@query(
    "x26_terminal_queries",
    f"""WITH q AS (SELECT p_partkey, trim(regexp_replace(lower({_QUESTION}), '\\s+', ' ', 'g')) AS q FROM part), c AS (SELECT *, {" + ".join(f"({e})::INT" for e in _ENDS)} AS ends, {" + ".join(f"len(regexp_extract_all(q, '{p}'))" for _, p in scopes.TERMINAL)} AS all_ FROM q)
SELECT p_partkey, CASE WHEN ends = 1 AND all_ = 1 THEN CASE {" ".join(f"WHEN {e} THEN '{name}'" for e, (name, _) in zip(_ENDS, scopes.TERMINAL))} END END AS template,
CASE WHEN ends = 1 AND all_ = 1 THEN CASE {" ".join(f"WHEN {e} THEN trim(regexp_extract(q, '{p}\\s*$', 1))" for e, (_, p) in zip(_ENDS, scopes.TERMINAL))} END END AS event FROM c""",
)
def terminal_queries(t: Tables) -> DataFrame:
    """Names of parts in questions of every form, with two clauses, with none and with one that doesn't end the question."""
    asked = F.replace(F.get(F.array(*map(F.lit, QUESTIONS)), (F.col("p_partkey") % 10).cast("int")), F.lit("{}"), F.col("p_name"))
    parts = t.part.select("p_partkey", "p_name").repartition(ranking.PARTS, "p_partkey")
    return parts.select("p_partkey", scopes.terminal_query(asked).alias("x")).select("p_partkey", "x.*")

"""Queries of claims, metrics and submissions, fresh claims bound to windows, clip times, packets of frames, decisions and audits of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import claims as fc
from spanloom.operators import runtime

from .registry import Tables, query


def _string(name: str) -> Column:
    return F.col(name).cast("string")


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), index.cast("int"))


@query(
    "x24_claims",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
t AS (SELECT k, i, CASE WHEN q < 3 THEN '' ELSE 'holds part ' || p % 40 END AS text FROM l),
g AS (SELECT k, count(*) AS n, count(DISTINCT text) AS d, bool_or(text = '') AS blank, list(text ORDER BY i) AS texts FROM t GROUP BY k),
r AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'NOT_JSON' WHEN k % 11 = 1 THEN 'EXPECTED_CLAIMS_ARRAY' WHEN n > 5 THEN 'TOO_MANY_CLAIMS' WHEN k % 11 = 2 THEN 'CLAIM_FORM' WHEN blank THEN 'CLAIM_TEXT' WHEN d < n THEN 'DUPLICATE_CLAIM' END AS reason FROM g)
SELECT k AS l_orderkey, reason, CASE WHEN reason IS NULL THEN list_transform(texts, lambda x: {'claim_id': 'claim_' || left(sha256('["' || k || '","' || x || '"]'), 24), 'text': x}) END AS claims FROM r""",
)
def claims(t: Tables) -> DataFrame:
    """The lines of an order as the claims of an answer: some cut off, with another key, with other forms of claims, too many, blank or repeated."""
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    text = F.when(F.col("q") < 3, "  ").otherwise(F.concat(F.lit(" holds part "), F.col("p") % 40))
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("text")))).alias("c"))
    kind = F.col("l_orderkey") % 11
    item = lambda c: F.when(kind == 2, F.to_json(F.struct(c["text"].alias("text"), F.lit(1).alias("score")))).otherwise(F.to_json(F.struct(c["text"].alias("text"))))
    body = F.concat(F.lit('{"claims": ['), F.array_join(F.transform("c", item), ", "), F.lit("]"), F.when(kind == 0, "").when(kind == 1, ', "note": null}').otherwise("}"))
    return lists.select("l_orderkey", fc.parse_claims(body, _string("l_orderkey"), 5).alias("x")).select("l_orderkey", "x.*")


@query(
    "v12_reported_metrics",
    """WITH g AS (SELECT user_id AS u, count(*) AS n, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1),
m AS (SELECT u, CASE WHEN u % 7 > 0 THEN n / 4.0 END AS cvs_acc, n / 2.0 AS nap_acc, CASE WHEN u % 3 = 0 THEN 0.0 ELSE c / 2.0 END AS sa_acc, CASE WHEN u % 5 > 0 THEN e / 2.0 END AS stg_miou, c / 4.0 AS tag_miou_03, e / 4.0 AS tag_miou_05, n * 1.0 AS dvc_llm, 0.0 AS dvc_f1, e * 1.0 AS vs_llm, c * 1.0 AS rc_llm FROM g WHERE u % 13 > 0
UNION ALL SELECT u, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE u % 13 = 0)
SELECT u AS user_id, len(missing) = 0 AS success, * EXCLUDE (u) FROM (SELECT *, list_filter([CASE WHEN cvs_acc IS NULL THEN 'cvs_acc' END, CASE WHEN nap_acc IS NULL THEN 'nap_acc' END, CASE WHEN sa_acc IS NULL THEN 'sa_acc' END, CASE WHEN stg_miou IS NULL THEN 'stg_miou' END, CASE WHEN tag_miou_03 IS NULL THEN 'tag_miou_03' END, CASE WHEN tag_miou_05 IS NULL THEN 'tag_miou_05' END,
CASE WHEN dvc_llm IS NULL THEN 'dvc_llm' END, CASE WHEN dvc_f1 IS NULL THEN 'dvc_f1' END, CASE WHEN vs_llm IS NULL THEN 'vs_llm' END, CASE WHEN rc_llm IS NULL THEN 'rc_llm' END], lambda x: x IS NOT NULL) AS missing FROM (SELECT u, cvs_acc::DOUBLE AS cvs_acc, nap_acc::DOUBLE AS nap_acc, sa_acc::DOUBLE AS sa_acc, stg_miou::DOUBLE AS stg_miou, tag_miou_03::DOUBLE AS tag_miou_03, tag_miou_05::DOUBLE AS tag_miou_05, dvc_llm::DOUBLE AS dvc_llm, dvc_f1::DOUBLE AS dvc_f1, vs_llm::DOUBLE AS vs_llm, rc_llm::DOUBLE AS rc_llm FROM m))""",
)
def reported_metrics(t: Tables) -> DataFrame:
    """Evaluation outputs of users: tasks under either name, some missing or without an overall, fields under each of their names or none, texts cut off."""
    u = F.col("user_id")
    counts = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "error").alias("e"))
    task = lambda name, *fields: F.concat(name, F.lit(': {"overall": {'), F.concat_ws(", ", *[F.concat(F.lit(f'"{f}": '), v) for f, v in fields]), F.lit("}}"))
    either = lambda low, high, odd: F.when(odd, f'"{high}"').otherwise(f'"{low}"')
    n, c, e = (F.col(x) for x in "nce")
    odd = u % 2 == 1
    tasks = [
        F.when(u % 7 > 0, task(either("cvs_assessment", "CVS", odd), ("accuracy", F.lit(0) + n), ("component_balanced_accuracy", n / 4))),
        task(either("next_action", "NEXT_ACTION", u % 4 > 1), ("accuracy", n / 2)),
        F.when(u % 3 == 0, task(F.lit('"SKILL"'), ("other", c))).otherwise(task(F.lit('"skill_assessment"'), ("accuracy", c / 2))),
        F.when(u % 5 > 0, task(either("stg", "STG", odd), ("mean_iou", e / 2))).otherwise('"stg": {"per_video": []}, "STG": {"overall": {"mean_iou": 1}}'),
        task(either("tal", "TAL", odd), ("meanIoU@0.3", c / 4), ("meanIoU@0.5", e / 4)),
        task(either("dvc", "dense_captioning", odd), ("caption_score", n)),
        task(either("VS", "video_summary", odd), ("average_score", e), ("caption_score", n)),
        task(either("rc", "region_caption", odd), ("score", c), ("average_score", n)),
    ]
    text = F.concat(F.lit('{"aggregated_results": {'), F.concat_ws(", ", *tasks), F.when(u % 13 == 0, "}").otherwise("}}"))
    return counts.select("user_id", fc.reported_metrics(text).alias("x")).select("user_id", "x.*")


@query(
    "s32_v78_submission",
    """SELECT o_orderkey AS sample_id, o_orderkey AS original_idx, CASE WHEN o_orderkey % 3 = 0 THEN 'id' || o_orderkey ELSE 'v' || o_custkey || '&&' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE (o_orderkey % 100)::VARCHAR END || '&&' || CASE WHEN o_orderkey % 7 = 0 THEN 'e' ELSE '' END || '&&2' END AS id,
coalesce(['tal', 'region_caption_gpt', 'stg', 'region_caption_gemini', 'region_caption', NULL][1 + o_custkey % 6], '') AS qa_type, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS prediction, NULL::VARCHAR AS data_source FROM orders WHERE ['tal', 'region_caption_gpt', 'stg', 'region_caption_gemini', 'region_caption', ''][1 + o_custkey % 6] NOT IN ('region_caption_gpt', 'region_caption_gemini')""",
)
def submission(t: Tables) -> DataFrame:
    """Orders as results: given identifiers, composed ones with parts missing, null tasks and predictions, region captions left out."""
    k = F.col("o_orderkey")
    start = F.when(k % 5 > 0, (k % 100).cast("string"))
    late = k % 2 == 0
    made = fc.submission_id(F.when(k % 3 == 0, F.concat(F.lit("id"), k)), F.concat(F.lit("v"), F.col("o_custkey")), [F.when(late, "").otherwise(start), F.when(late, start)], [F.when(k % 7 == 0, "e"), F.lit("")], F.lit(2))
    task = _pick(("tal", "region_caption_gpt", "stg", "region_caption_gemini", "region_caption"), F.col("o_custkey") % 6)
    rows = t.orders.select(k.alias("sample_id"), k.alias("original_index"), made.alias("id"), task.alias("qa_type"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("prediction"), F.lit(None).cast("string").alias("data_source"))
    return runtime.submission_rows(rows)


SAID = ("the forceps grasps tissue ", "the catheter enters duct ", "at least one tool near ", "the overall scene of ", "the clamp holds vessel ", "mood of ")
NOTES = ("seen at once", "clear", " ", "see the BBox", "clear", "seen")


@query(
    "v72_fresh_claims",
    f"""WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 19 = 0 THEN 'changed' ELSE sha256('r' || o_orderkey) END AS digest, 'c' || CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS claim_id, {list(SAID)}[1 + o_orderkey % 6] || CASE WHEN o_orderkey % 37 = 0 THEN 7 ELSE o_orderkey END AS text, o_orderkey % 6 AS said, 2 + o_custkey % 6 AS n_frames FROM orders),
r AS (SELECT *, count(*) OVER (PARTITION BY digest) AS nd, count(*) OVER (PARTITION BY claim_id) AS ni, count(*) OVER (PARTITION BY text) AS nt FROM c),
l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), w AS (SELECT 'c' || l.l_orderkey AS claim_id, list(DISTINCT l.l_linenumber ORDER BY l.l_linenumber) AS orders, (SELECT bool_and(l_discount < 0.1) FROM lineitem i WHERE i.l_orderkey = l.l_orderkey) AS confirmed, {list(NOTES)}[1 + l.l_orderkey // 6 % 6] AS note FROM l GROUP BY l.l_orderkey),
j AS (SELECT *, coalesce(len(orders) BETWEEN 1 AND 3 AND orders[-1] - orders[1] = len(orders) - 1, false) AS consecutive FROM r FULL JOIN w USING (claim_id)),
t AS (SELECT claim_id, k AS source_record_index, CASE WHEN k IS NULL THEN NULL WHEN said IN (0, 1, 4) THEN 'LOCAL_ATOMIC' WHEN said = 2 THEN 'MULTI_SUPPORT_POSSIBLE' WHEN said = 3 THEN 'GLOBAL_DISTRIBUTED' ELSE 'UNRESOLVED_SCOPE' END AS claim_scope, CASE WHEN k IS NULL THEN ['WINDOW_WITHOUT_CLAIM'] ELSE list_filter([CASE WHEN k IN (3, 8) THEN 'EXCLUDED_INDEX' END, CASE WHEN digest = 'changed' THEN 'DIGEST_FORM' END, CASE WHEN nd > 1 THEN 'REPEATED_DIGEST' END, CASE WHEN ni > 1 THEN 'REPEATED_CLAIM_ID' END, CASE WHEN nt > 1 THEN 'REPEATED_TEXT' END, CASE WHEN digest = 'changed' THEN 'RECORD_MISMATCH' END,
CASE WHEN said NOT IN (0, 1, 4) THEN 'SCOPE_NOT_LOCAL' END, CASE WHEN orders IS NULL THEN 'WINDOW_COUNT' END, CASE WHEN NOT consecutive THEN 'WINDOW_ORDERS' END, CASE WHEN NOT coalesce(orders[-1] < n_frames, false) THEN 'WINDOW_BEYOND_RECORD' END, CASE WHEN NOT coalesce(confirmed, false) THEN 'NOT_CONFIRMED' END, CASE WHEN coalesce(note, ' ') = ' ' THEN 'NOTE_FORM' END, CASE WHEN coalesce(note, 'gt') IN ('gt', 'see the BBox') THEN 'NOTE_FORBIDDEN' END], lambda x: x IS NOT NULL) END AS reasons, orders FROM j)
SELECT claim_id, source_record_index, claim_scope, reasons, CASE WHEN len(reasons) = 0 THEN list_transform(orders, lambda o: 's' || source_record_index || ':frame:' || lpad(o::VARCHAR, 6, '0')) END AS frame_ids FROM t""",
)
def fresh_claims(t: Tables) -> DataFrame:
    """Orders as records with one claim each, their lines as windows: digests changed, identifiers and texts repeated, windows broken, missing or too late."""
    k = F.col("o_orderkey")
    digest = F.sha2(F.concat(F.lit("r"), k), 256)
    text = F.concat(_pick(SAID, k % 6), F.when(k % 37 == 0, 7).otherwise(k))
    claims = t.orders.select(k.alias("source_record_index"), F.when(k % 19 == 0, "changed").otherwise(digest).alias("digest"), F.concat(F.lit("c"), F.when(k % 31 == 0, k + 1).otherwise(k)).alias("claim_id"), text.alias("text"))
    records = t.orders.select(k.alias("source_record_index"), digest.alias("digest"), F.concat(F.lit("s"), k).alias("sample_id"), (2 + F.col("o_custkey") % 6).alias("n_frames"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("orders"), F.bool_and(F.col("l_discount") < 0.1).alias("confirmed"))
    windows = lines.select(F.concat(F.lit("c"), "l_orderkey").alias("claim_id"), "orders", "confirmed", _pick(NOTES, F.floor(F.col("l_orderkey") / 6) % 6).alias("note"))
    return runtime.bind_claims(claims, windows, records, [3, 8])


@query(
    "v71_native_times",
    """WITH g AS (SELECT l_orderkey AS k, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS refs, 2 * (l_orderkey % 4) AS fps FROM lineitem GROUP BY 1),
s AS (SELECT *, list_transform(refs, lambda r: ((r - refs[1]) / 2.0)::DECIMAL(18, 6)) AS t, ((refs[-1] - refs[1]) / 2.0)::DECIMAL(18, 6) AS span, 2.5::DECIMAL(18, 6) AS duration, CASE WHEN fps > 0 THEN round(1.0 / fps + 0.5, 6)::DECIMAL(18, 6) END AS allowed FROM g),
r AS (SELECT *, (duration - span)::DECIMAL(18, 6) AS tail, CASE WHEN fps = 0 THEN 'NO_RATE' WHEN span > duration THEN 'SPAN_EXCEEDS_DURATION' WHEN duration - span > allowed THEN 'TAIL_GAP_EXCEEDS_BOUND' END AS reason FROM s)
SELECT k AS l_orderkey, CASE WHEN reason IS NULL THEN t::DOUBLE[] END AS times, span::DOUBLE AS span, tail::DOUBLE AS tail, allowed::DOUBLE AS allowed, 0 AS repeated, reason FROM r""",
)
def native_times(t: Tables) -> DataFrame:
    """The line numbers of an order as references of a clip of 2.5 seconds at several rates."""
    clips = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("refs"))
    made = fc.native_times(F.col("refs"), F.lit(10), F.lit(12.5), (2 * (F.col("l_orderkey") % 4)).cast("int"))
    out = clips.select("l_orderkey", made.alias("x")).select("l_orderkey", "x.*")
    return out.withColumns({c: F.col(c).cast("double") for c in ("span", "tail", "allowed")} | {"times": F.col("times").cast("array<double>")})


@query(
    "v53_packet_frames",
    """WITH f AS (SELECT l_partkey AS p, l_orderkey AS o, l_linenumber AS i, l_quantity::INT % 15 AS q, l_returnflag <> 'R' AS shown FROM lineitem),
g AS (SELECT p, q, i % 2 AS i, list(DISTINCT o ORDER BY o) AS aliases, min(o) FILTER (shown) AS o FROM f GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o, sha256('{"q":' || q || ',"i":' || i || '}')) - 1 AS i8, count(*) OVER (PARTITION BY p) AS n FROM g WHERE o IS NOT NULL),
s AS (SELECT p, o, aliases, CASE WHEN n <= 8 THEN i8 ELSE list_position(list_transform(range(8), lambda s: (s * (n - 1) + 3) // 7), i8) - 1 END AS slot FROM r)
SELECT p AS l_partkey, slot, o AS "order", aliases FROM s WHERE slot IS NOT NULL""",
)
def packet_frames(t: Tables) -> DataFrame:
    """Parts as packets, their lines as frames that show one of thirty pictures; returned lines aren't shown."""
    frames = t.lineitem.select("l_partkey", "l_orderkey", (F.col("l_quantity").cast("int") % 15).alias("q"), (F.col("l_linenumber") % 2).alias("i"), (F.col("l_returnflag") != "R").alias("shown"))
    return runtime.packet_frames(frames, "l_partkey", "l_orderkey", ["q", "i"], "shown")


MARKS = ("ACCEPTED", "ACCEPTED", "BOX_TOO_TIGHT", "UNRESOLVED")


@query(
    "a64_observation_decisions",
    f"""WITH c AS (SELECT l_partkey AS p, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS id, l_linenumber AS pos, CASE WHEN l_returnflag = 'N' THEN 'ELIGIBLE_SPATIAL_ANCHOR' ELSE 'ABSTAIN' END AS route, [{list(MARKS)}[1 + l_orderkey % 4], {list(MARKS)}[1 + l_suppkey % 4]] AS req, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE [{list(MARKS)}[1 + l_quantity::INT % 4]] END AS ctx FROM lineitem),
n AS (SELECT *, len(list_filter(req, lambda x: x = 'ACCEPTED')) AS a, len(list_filter(coalesce(ctx, []), lambda x: x = 'ACCEPTED')) AS b, len(list_filter(coalesce(ctx, []), lambda x: x <> 'ACCEPTED')) AS w FROM c)
SELECT p AS l_partkey, id AS candidate_id, route, a AS accepted, w AS warnings, count(*) OVER (PARTITION BY p) AS candidates FROM n QUALIFY row_number() OVER (PARTITION BY p ORDER BY CASE WHEN route = 'ABSTAIN' THEN 1 ELSE 0 END, a DESC, b DESC, w, pos, id) = 1""",
)
def observation_decisions(t: Tables) -> DataFrame:
    """Lines of a part as candidates with reviewed parts of an anchor."""
    mark = lambda name: _pick(MARKS, F.col(name).cast("int") % 4)
    candidates = t.lineitem.select(
        "l_partkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("candidate_id"), F.col("l_linenumber").alias("position"),
        F.when(F.col("l_returnflag") == "N", "ELIGIBLE_SPATIAL_ANCHOR").otherwise("ABSTAIN").alias("route"),
        F.array(mark("l_orderkey"), mark("l_suppkey")).alias("required"), F.when(F.col("l_orderkey") % 3 != 0, F.array(mark("l_quantity"))).alias("contextual"),
    )
    return runtime.decide(candidates, "l_partkey")


@query(
    "v43_v44_region_audit",
    """WITH l AS (SELECT l_orderkey AS k, list(DISTINCT 'f' || l_linenumber) AS frames FROM lineitem GROUP BY 1), r AS (SELECT o_custkey % 6 IN (0, 2) AS region, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'f' || (1 + o_orderkey % 4) END AS anchor, o_orderkey % 7 > 0 AS box, frames FROM orders LEFT JOIN l ON k = o_orderkey)
SELECT 'RC_SELECTOR_ADAPTATION_REQUIRED' AS status, count(*) FILTER (region) AS rc_samples, count(*) FILTER (region AND NOT coalesce(anchor <> '' AND box AND list_contains(frames, anchor), false)) AS missing_or_unmatched FROM r""",
)
def region_audit(t: Tables) -> DataFrame:
    """Orders as samples, a third of them of regions, whose anchors are looked for among their lines."""
    k = F.col("o_orderkey")
    frames = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat(F.lit("f"), "l_linenumber")).alias("frames"))
    task = _pick(("region_caption_gpt", "tal", "region_caption", "stg"), F.col("o_custkey") % 6)
    anchor = F.when(k % 9 == 0, "").when(k % 9 > 1, F.concat(F.lit("f"), 1 + k % 4))
    box = F.when(k % 7 > 0, F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).otherwise(F.array().cast("array<int>"))
    return runtime.region_audit(t.orders.join(frames, "o_orderkey", "left").select(task.alias("qa_type"), anchor.alias("anchor"), box.alias("box"), "frames"))

"""Queries of verdicts: labels, validity, routes, and the states they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import verdicts as V

from .registry import Tables, query


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


_ANSWER = "CASE l_returnflag WHEN 'A' THEN 'YES' WHEN 'N' THEN 'NO' ELSE CASE WHEN l_linenumber < 4 THEN 'INVALID' ELSE 'ERROR' END END"
_ALIGN = "CASE WHEN l_discount >= 0.07 THEN 'STRONG_GT_ALIGNED' WHEN l_discount >= 0.03 THEN 'WEAK_GT_ALIGNED' ELSE 'NO_GT_OVERLAP' END"
_LABEL = "CASE WHEN l_returnflag = 'R' THEN 'SPURIOUS_SUPPORT' ELSE 'TRUE_SUPPORT' END"


def _lines(t: Tables) -> DataFrame:
    """Lines as answers: prediction, alignment, label and number of visible truths."""
    return t.lineitem.selectExpr("*", f"{_ANSWER} AS answer", f"{_ALIGN} AS alignment", f"{_LABEL} AS label", "greatest(0, l_linenumber - 3) AS visible")


_LINES = f"l AS (SELECT *, {_ANSWER} AS answer, {_ALIGN} AS alignment, {_LABEL} AS label, greatest(0, l_linenumber - 3) AS visible FROM lineitem)"


@query(
    "x39_x40_candidate_labels",
    f"""WITH {_LINES} SELECT answer, alignment, label2 AS label, CASE label2 WHEN 'NO_ON_STRONG_GT_ALIGNED' THEN 'NO_STRONG_GT' WHEN 'NO_ON_WEAK_GT_ALIGNED' THEN 'NO_WEAK_GT' ELSE label2 END AS short, count(*) AS n FROM
  (SELECT *, CASE answer WHEN 'YES' THEN CASE alignment WHEN 'STRONG_GT_ALIGNED' THEN 'TRUE_SUPPORT' WHEN 'WEAK_GT_ALIGNED' THEN 'WEAK_TRUE_SUPPORT' ELSE 'SPURIOUS_SUPPORT' END WHEN 'NO' THEN CASE alignment WHEN 'STRONG_GT_ALIGNED' THEN 'NO_ON_STRONG_GT_ALIGNED' WHEN 'WEAK_GT_ALIGNED' THEN 'NO_ON_WEAK_GT_ALIGNED' ELSE 'TRUE_NEGATIVE_CONTROL' END WHEN 'INVALID' THEN 'INVALID_RESPONSE' ELSE answer END AS label2 FROM l) GROUP BY ALL""",
)
def candidate_labels(t: Tables) -> DataFrame:
    rows = _lines(t).select("answer", "alignment", V.candidate_label(F.col("answer"), F.col("alignment")).alias("label"))
    return rows.groupBy("answer", "alignment", "label", V.short_label(F.col("label")).alias("short")).agg(_n())


_VALID = """SELECT *, CASE label WHEN 'TRUE_SUPPORT' THEN alignment = 'STRONG_GT_ALIGNED' ELSE visible = 0 AND alignment = 'NO_GT_OVERLAP' END AS strict_valid,
  CASE label WHEN 'TRUE_SUPPORT' THEN visible > 0 ELSE visible = 0 AND alignment = 'NO_GT_OVERLAP' END AS any_gt_valid,
  CASE label WHEN 'TRUE_SUPPORT' THEN CASE WHEN alignment = 'STRONG_GT_ALIGNED' THEN 'STRICT_VALID_STRONG_GT_ALIGNED' WHEN visible > 0 THEN 'WEAKENED_GT_SUPPORT' ELSE 'GT_EVIDENCE_REMOVED' END
    ELSE CASE WHEN visible = 0 AND alignment = 'NO_GT_OVERLAP' THEN 'STRICT_VALID_NO_GT_OVERLAP' ELSE 'GT_CONTAMINATED' END END AS validity_reason FROM l"""


def _valid(t: Tables) -> DataFrame:
    return _lines(t).withColumn("v", V.validity(F.col("label"), F.col("visible"), F.col("alignment"))).select("*", "v.*")


@query("x43_intervention_validity", f"WITH {_LINES} SELECT label, alignment, strict_valid, any_gt_valid, validity_reason, count(*) AS n FROM ({_VALID}) GROUP BY ALL")
def intervention_validity(t: Tables) -> DataFrame:
    return _valid(t).groupBy("label", "alignment", "strict_valid", "any_gt_valid", "validity_reason").agg(_n())


@query(
    "f08_denominators",
    f"""WITH {_LINES}, v AS ({_VALID}) SELECT label, count(*) FILTER (l_tax < 0.06 AND strict_valid) AS strict, count(*) FILTER (l_tax < 0.06 AND CASE label WHEN 'TRUE_SUPPORT' THEN any_gt_valid ELSE strict_valid END) AS any_gt, count(*) AS n FROM v GROUP BY 1""",
)
def denominators(t: Tables) -> DataFrame:
    within = lambda strict: F.count_if(V.in_denominator(F.col("l_tax") < 0.06, F.col("label"), F.col("strict_valid"), F.col("any_gt_valid"), strict))
    return _valid(t).groupBy("label").agg(within(True).alias("strict"), within(False).alias("any_gt"), _n())


@query("f07_generation_valid", f"WITH {_LINES}, v AS ({_VALID}) SELECT l_orderkey, l_linenumber, l_partkey, validity_reason FROM v WHERE strict_valid AND l_tax < 0.02")
def generation_valid(t: Tables) -> DataFrame:
    return _valid(t).where("strict_valid AND l_tax < 0.02").select("l_orderkey", "l_linenumber", "l_partkey", "validity_reason")


@query(
    "a45_validity_by_label_and_type",
    f"""WITH {_LINES}, v AS ({_VALID}), d AS (SELECT * FROM (VALUES ('TRUE_SUPPORT'), ('SPURIOUS_SUPPORT'), ('WEAK_TRUE_SUPPORT')) a(label), (VALUES (1), (2), (8)) b(kind))
SELECT d.label, d.kind, count(v.label) AS n, count(*) FILTER (strict_valid) AS strict, count(*) FILTER (any_gt_valid) AS any_gt, round(count(*) FILTER (strict_valid) / nullif(count(v.label), 0), 6) AS strict_rate FROM d LEFT JOIN v ON d.label = v.label AND d.kind = v.l_linenumber GROUP BY 1, 2""",
)
def validity_by_label(t: Tables) -> DataFrame:
    """Counts and rates by label and type; the fixed cells that no row falls in are there with zeros. Rows are counted before they meet the cells."""
    cells = t.spark.createDataFrame([(a, b) for a in ("TRUE_SUPPORT", "SPURIOUS_SUPPORT", "WEAK_TRUE_SUPPORT") for b in (1, 2, 8)], "label string, kind int")
    counts = _valid(t).groupBy("label", F.col("l_linenumber").alias("kind")).agg(_n(), F.count_if("strict_valid").alias("strict"), F.count_if("any_gt_valid").alias("any_gt"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(cells).join(counts, ["label", "kind"], "left").select("label", "kind", zero("n"), zero("strict"), zero("any_gt"), F.round(F.try_divide("strict", "n"), 6).alias("strict_rate"))


@query(
    "a46_validity_stratified",
    f"""WITH {_LINES}, v AS ({_VALID}) SELECT o_orderpriority, label, count(*) AS n, round(avg(strict_valid::INT), 6) AS strict_rate, round(avg(any_gt_valid::INT), 6) AS any_rate FROM v JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def validity_stratified(t: Tables) -> DataFrame:
    rows = _valid(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    rate = lambda c, name: F.round(F.avg(F.col(c).cast("int")), 6).alias(name)
    return rows.groupBy("o_orderpriority", "label").agg(_n(), rate("strict_valid", "strict_rate"), rate("any_gt_valid", "any_rate"))


@query(
    "a47_usability_by_family",
    f"""WITH {_LINES}, v AS ({_VALID}) SELECT l_orderkey, bool_or(strict_valid AND label = 'TRUE_SUPPORT') AS has_true, bool_or(strict_valid AND label = 'SPURIOUS_SUPPORT') AS has_spurious,
  bool_or(strict_valid AND label = 'TRUE_SUPPORT') AND bool_or(strict_valid AND label = 'SPURIOUS_SUPPORT') AS usable FROM v GROUP BY 1""",
)
def usability(t: Tables) -> DataFrame:
    of = lambda label: F.bool_or(F.col("strict_valid") & (F.col("label") == label))
    return _valid(t).groupBy("l_orderkey").agg(of("TRUE_SUPPORT").alias("has_true"), of("SPURIOUS_SUPPORT").alias("has_spurious")).withColumn("usable", F.col("has_true") & F.col("has_spurious"))


@query(
    "q02_label_consistency",
    f"""WITH {_LINES}, v AS ({_VALID}) SELECT 'strict_needs_class' AS rule, count(*) FILTER (strict_valid AND NOT (alignment IN ('STRONG_GT_ALIGNED', 'NO_GT_OVERLAP'))) AS broken FROM v
UNION ALL SELECT 'visible_iff_overlap', count(*) FILTER ((visible > 0) = (alignment = 'NO_GT_OVERLAP')) FROM v UNION ALL SELECT 'spurious_not_visible', count(*) FILTER (label = 'SPURIOUS_SUPPORT' AND strict_valid AND visible > 0) FROM v""",
)
def label_consistency(t: Tables) -> DataFrame:
    """Rows that break each rule, in one pass over the table."""
    none = F.col("alignment") == "NO_GT_OVERLAP"
    rules = {
        "strict_needs_class": F.col("strict_valid") & ~(none | (F.col("alignment") == "STRONG_GT_ALIGNED")),
        "visible_iff_overlap": (F.col("visible") > 0) == none,
        "spurious_not_visible": (F.col("label") == "SPURIOUS_SUPPORT") & F.col("strict_valid") & (F.col("visible") > 0),
    }
    one = _valid(t).agg(*[F.struct(F.lit(r).alias("rule"), F.count_if(c).alias("broken")).alias(r) for r, c in rules.items()])
    return one.select(F.explode(F.array(*rules)).alias("x")).select("x.*")


_SCORE = "CASE WHEN l_tax >= 0.07 THEN NULL WHEN l_tax < 0.005 THEN 0.0::DOUBLE ELSE l_tax * 10 END"


@query(
    "x44_x45_spatial_classes",
    f"""WITH s AS (SELECT l_linestatus = 'O' AS ok, {_SCORE} AS score FROM lineitem) SELECT CASE WHEN NOT ok THEN 'NOT_TEMPORALLY_ELIGIBLE' WHEN score IS NULL THEN 'NO_SPATIAL_GT_EVALUATED' WHEN score >= 0.35 THEN 'TRUE_SPATIAL_SUPPORT' WHEN score = 0 THEN 'SPURIOUS_SPATIAL_SUPPORT' ELSE 'WEAK_SPATIAL_SUPPORT' END AS class,
  CASE WHEN NOT ok THEN 'EXCLUDED_NOT_TEMPORALLY_ELIGIBLE' WHEN score IS NULL THEN 'EXCLUDED_NO_SPATIAL_SCORE' WHEN score >= 0.25 THEN 'ALIGNED_SPATIAL_SUPPORT' WHEN score > 0 THEN 'MISALIGNED_SPATIAL_SUPPORT' ELSE 'ZERO_OVERLAP_SPATIAL_SUPPORT' END AS label, count(*) AS n FROM s GROUP BY 1, 2""",
)
def spatial_classes(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_linestatus") == "O").alias("ok"), F.when(F.col("l_tax") < 0.07, F.when(F.col("l_tax") < 0.005, 0.0).otherwise(F.col("l_tax") * 10)).alias("score"))
    return rows.groupBy(V.spatial_class(F.col("ok"), F.col("score"), 0.35).alias("class"), V.spatial_label(F.col("ok"), F.col("score"), 0.25).alias("label")).agg(_n())


@query(
    "v18_persistence_by_class",
    """SELECT d.class, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'A') AS kept, round(count(*) FILTER (l_returnflag = 'A') / nullif(count(l_orderkey), 0), 6) AS rate
FROM (VALUES ('O'), ('F'), ('X')) d(class) LEFT JOIN lineitem ON l_linestatus = d.class GROUP BY 1""",
)
def persistence(t: Tables) -> DataFrame:
    """A row for each class of a fixed list, those without rows too."""
    classes = t.spark.createDataFrame([("O",), ("F",), ("X",)], "class string")
    counts = t.lineitem.groupBy(F.col("l_linestatus").alias("class")).agg(_n(), F.count_if(F.col("l_returnflag") == "A").alias("kept"))
    return F.broadcast(classes).join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"), F.round(F.try_divide("kept", "n"), 6).alias("rate"))


def _margins() -> dict[str, Column]:
    return {"o": F.col("l_linenumber") - 2, "k": F.col("l_suppkey") % 5 - 1, "d": F.col("l_partkey") % 5 - 3, "c": F.col("l_orderkey") % 3 - 1}


_MARGINS = "m AS (SELECT l_linenumber - 2 AS o, l_suppkey % 5 - 1 AS k, l_partkey % 5 - 3 AS d, l_orderkey % 3 - 1 AS c, l_returnflag AS f FROM lineitem)"


@query(
    "x46_v58_margins",
    f"""WITH {_MARGINS} SELECT CASE WHEN o <= 0 THEN 'ORIGINAL_LIKELIHOOD_INSUFFICIENT' WHEN k <= 0 THEN 'KEEP_PRESERVATION_FAILURE' WHEN d > 0 THEN 'DROP_SUPPORT_PERSISTS' WHEN c <= 0 THEN 'CONTROL_SUPPORT_LOST' ELSE 'FULL_LOCAL_DEPENDENCE_PATTERN' END AS class,
  CASE WHEN o = d AND d = k AND k = c THEN 'VISUAL_INPUT_INSENSITIVITY' WHEN f = 'A' AND o <> d THEN 'MARGIN_SENSITIVE_LABEL_INVARIANT' WHEN c <= d THEN 'INTERVENTION_NONSPECIFIC' WHEN k > d THEN 'AUTOMATIC_LOCALIZATION_FAILURE' ELSE 'UNRESOLVED' END AS explanation, count(*) AS n FROM m GROUP BY 1, 2""",
)
def margins(t: Tables) -> DataFrame:
    m = _margins()
    generated = F.when(F.col("l_returnflag") == "A", "SUPPORTED").otherwise("OTHER")
    explanation = V.margin_explanation(m["o"], m["d"], m["c"], m["k"], m["c"], generated)
    return t.lineitem.groupBy(V.margin_case(m["o"], m["k"], m["d"], m["c"]).alias("class"), explanation.alias("explanation")).agg(_n())


@query(
    "x47_count_mismatch",
    """WITH c AS (SELECT CASE WHEN l_linenumber < 7 THEN l_linenumber END AS e, l_suppkey % 7 AS g, l_partkey % 7 AS r, CASE l_returnflag WHEN 'A' THEN 'CONTROL_UNAVAILABLE' WHEN 'N' THEN 'OK' END AS s FROM lineitem),
k AS (SELECT CASE WHEN e IS NULL THEN 0 WHEN s = 'CONTROL_UNAVAILABLE' AND g < e AND r = g THEN 1 WHEN g = e AND r <> g THEN 2 WHEN g <> e AND s IS DISTINCT FROM 'CONTROL_UNAVAILABLE' THEN 3 ELSE 4 END AS k FROM c)
SELECT ['C_UNRESOLVED', 'B_LEGITIMATE_PROTOCOL_UNAVAILABLE', 'A_IMPLEMENTATION_OR_ARTIFACT_BUG', 'A_IMPLEMENTATION_OR_ARTIFACT_BUG', 'C_UNRESOLVED'][k + 1] AS class,
  ['MISSING_CONTROL_ARTIFACT_OR_COUNT', 'GEOMETRY_GENERATED_FEWER_THAN_FROZEN_REQUIRED_CONTROLS', 'GENERATED_CONTROLS_LACK_MATCHING_INFERENCE_RESULTS', 'CONTROL_ARTIFACT_AVAILABILITY_INCONSISTENT_WITH_COUNTS', 'CONTROL_COUNTS_DO_NOT_IDENTIFY_A_SINGLE_CAUSE'][k + 1] AS reason, count(*) AS n FROM k GROUP BY k""",
)
def mismatches(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "CONTROL_UNAVAILABLE").when(F.col("l_returnflag") == "N", "OK")
    c = V.count_mismatch(F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")), F.col("l_suppkey") % 7, F.col("l_partkey") % 7, status)
    return t.lineitem.groupBy(c.alias("c")).agg(_n()).select("c.*", "n")


_REASONS = ["KEEP_SUPPORT_LOST", "CONTROL_UNAVAILABLE", "INTERVENTION_NO_EFFECT", "ORIGINAL_INSUFFICIENT", "TECHNICAL_FAILURE", "CONTROL_RESULT_COUNT_MISMATCH", "OTHER_REASON"]
_EFFECTS = ["UNIFORM_REGION", "ARTIFACT_NOT_APPLIED", "UNRESOLVED"]


@query(
    "x48_refinement_routes",
    f"""WITH r AS (SELECT l_orderkey AS k, list(DISTINCT {_REASONS}[least(l_suppkey % 16, 6) + 1]) AS rs FROM lineitem GROUP BY 1), o AS (SELECT *, {_EFFECTS}[k % 3 + 1] AS e FROM r),
c AS (SELECT CASE WHEN list_contains(rs, 'CONTROL_RESULT_COUNT_MISMATCH') THEN 1 WHEN list_contains(rs, 'TECHNICAL_FAILURE') THEN 2 WHEN list_contains(rs, 'ORIGINAL_INSUFFICIENT') THEN 3 WHEN list_contains(rs, 'INTERVENTION_NO_EFFECT') THEN CASE e WHEN 'UNIFORM_REGION' THEN 4 WHEN 'ARTIFACT_NOT_APPLIED' THEN 2 ELSE 5 END
  WHEN list_contains(rs, 'CONTROL_UNAVAILABLE') THEN CASE WHEN k % 2 = 0 THEN 6 ELSE 7 END WHEN list_contains(rs, 'KEEP_SUPPORT_LOST') THEN 8 ELSE 9 END AS c FROM o)
SELECT ['TECHNICAL_DIAGNOSTIC', 'TECHNICAL_ERROR', 'TEMPORAL_OR_SEMANTIC_INSUFFICIENT', 'SPATIAL_PROPOSAL_OR_ROI_FAILURE', 'UNRESOLVED', 'SPATIAL_PROPOSAL_GEOMETRY', 'PROTOCOL_UNAVAILABLE', 'SPATIAL_DEPENDENCE_OR_SUFFICIENCY', NULL][c] AS root_cause,
  CASE WHEN c < 9 THEN c IN (4, 6, 8) END AS eligible, count(*) AS n FROM c GROUP BY 1, 2""",
)
def refinement_routes(t: Tables) -> DataFrame:
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(at(_REASONS, F.least(F.col("l_suppkey") % 16, F.lit(6)))).alias("rs"))
    r = V.refinement(F.col("rs"), at(_EFFECTS, F.col("l_orderkey") % 3), F.col("l_orderkey") % 2 == 0)
    return orders.groupBy(r["root_cause"].alias("root_cause"), r["eligible"].alias("eligible")).agg(_n())


@query(
    "x52_adjudications",
    "SELECT * FROM (SELECT " + str([x[0] for x in V.ADJUDICATIONS]) + "[l_suppkey % 9 + 1] AS label, " + str([x[1] for x in V.ADJUDICATIONS]) + "[l_suppkey % 9 + 1] AS status, l_suppkey % 9 = 0 AS usable, " + str([x[3] for x in V.ADJUDICATIONS]) + "[l_suppkey % 9 + 1] AS route, count(*) AS n FROM lineitem GROUP BY ALL)",
)
def adjudications(t: Tables) -> DataFrame:
    """Labels of reviews to status and route by a small fixed table."""
    table = t.spark.createDataFrame(V.ADJUDICATIONS, "label string, status string, usable boolean, route string")
    label = F.get(F.array(*[F.lit(x[0]) for x in V.ADJUDICATIONS]), (F.col("l_suppkey") % 9).cast("int"))
    return t.lineitem.groupBy(label.alias("label")).agg(_n()).join(F.broadcast(table), "label").select("label", "status", "usable", "route", "n")


@query(
    "x56_next_actions",
    """WITH c AS (SELECT CASE l_returnflag WHEN 'A' THEN 'VERIFIED' WHEN 'N' THEN 'REJECTED' ELSE 'UNCERTAIN' END AS s, l_linenumber <> 1 AS en, l_suppkey % 2 = 0 AS lost, l_partkey % 2 = 0 AS ex, l_linenumber % 2 = 0 AS alt, l_orderkey % 3 > 0 AS nx FROM lineitem)
SELECT CASE WHEN s = 'VERIFIED' THEN 'STOP:CLAIM_VERIFIED' WHEN s = 'REJECTED' THEN CASE WHEN nx THEN 'NEXT_CANDIDATE:PAIR_REJECTED_TRY_NEXT_CANDIDATE' ELSE 'STOP:CANDIDATES_EXHAUSTED_AFTER_PAIR_REJECTION' END WHEN NOT en THEN 'STOP:ADAPTATION_DISABLED'
  WHEN lost THEN CASE WHEN alt THEN 'TRY_ALTERNATE_SUPPORT_REGION:SYNTHETIC_PRECONFIGURED_REGION' ELSE 'STOP:RE_GROUNDING_NOT_IMPLEMENTED' END WHEN ex THEN 'EXPAND_TEMPORAL_CONTEXT:FIXED_NEIGHBOR_CONTEXT' WHEN nx THEN 'NEXT_CANDIDATE:ACQUISITION_ORDER' ELSE 'STOP:CANDIDATES_EXHAUSTED' END AS action, count(*) AS n FROM c GROUP BY 1""",
)
def next_actions(t: Tables) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "VERIFIED").when(F.col("l_returnflag") == "N", "REJECTED").otherwise("UNCERTAIN")
    flags = [F.col("l_linenumber") != 1, F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 2 == 0, F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") % 3 > 0]
    return t.lineitem.groupBy(V.next_action(status, *flags).alias("action")).agg(_n())


@query(
    "f19_bound_results",
    """SELECT count(*) AS results, count(*) FILTER (e.user_id = u.user_id AND e.event_type = u.last_type AND (e.value < 250 OR e.event_id = u.last_id)) AS bound
FROM events e JOIN (SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY 1) u ON e.user_id = u.user_id""",
)
def bound_results(t: Tables) -> DataFrame:
    """Results that refer to the pair they are held against: the keys are equal, nulls never, and frames are compared where given."""
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_id"))
    frames = F.when(F.col("value") >= 250, F.col("event_id"))
    bound = (F.col("event_type") == F.col("last_type")) & (frames.isNull() | (frames == F.col("last_id")))
    return t.events.join(last, "user_id").agg(F.count(F.lit(1)).alias("results"), F.count_if(bound).alias("bound"))


@query(
    "f20_scope_selection",
    """WITH ids AS (SELECT unnest([1, 5, 7, 9999999]) AS k) SELECT k, o_orderkey IS NOT NULL AS found, o_orderstatus FROM ids LEFT JOIN orders ON o_orderkey = k""",
)
def scope_selection(t: Tables) -> DataFrame:
    """Rows of a short list of ids; ids that aren't there are told, so that a caller can fail."""
    ids = t.spark.createDataFrame([(1,), (5,), (7,), (9999999,)], "k int")
    rows = t.orders.join(F.broadcast(ids), F.col("o_orderkey") == F.col("k"), "left_semi").select(F.col("o_orderkey").cast("int").alias("k"), "o_orderstatus")
    return F.broadcast(ids).join(rows, "k", "left").select("k", F.col("o_orderstatus").isNotNull().alias("found"), "o_orderstatus")


@query(
    "r04_attempt_budget",
    "SELECT user_id, count(DISTINCT (event_type, event_id % 5)) AS attempts, greatest(0, 8 - count(DISTINCT (event_type, event_id % 5))) AS remaining, count(*) AS rows FROM events GROUP BY 1",
)
def attempt_budget(t: Tables) -> DataFrame:
    """Budgets count distinct attempts of a key, so a replayed row costs nothing."""
    attempts = F.countDistinct("event_type", F.col("event_id") % 5)
    return t.events.groupBy("user_id").agg(attempts.alias("attempts"), F.greatest(F.lit(0), 8 - attempts).alias("remaining"), F.count(F.lit(1)).alias("rows"))


@query(
    "q23_cycle_guard",
    """WITH s AS (SELECT user_id, event_id, event_type || ':' || (floor(value)::BIGINT % 3) AS state FROM events), f AS (SELECT user_id, state, min(event_id) AS first_id FROM s GROUP BY 1, 2)
SELECT count(*) AS proposed, count(*) FILTER (event_id > first_id) AS cycles FROM s JOIN f USING (user_id, state)""",
)
def cycle_guard(t: Tables) -> DataFrame:
    """A proposed state that the same key has visited before is a cycle; states are compared by their digests, first visits are an aggregate."""
    state = F.sha2(F.concat_ws(":", "event_type", (F.floor("value") % 3).cast("string")), 256)
    rows = t.events.select("user_id", "event_id", state.alias("state"))
    seen = rows.groupBy("user_id", "state").agg(F.count(F.lit(1)).alias("n"))
    return seen.agg(F.sum("n").alias("proposed"), F.sum(F.col("n") - 1).alias("cycles"))

"""Queries of contrasts, anchors, transitions, strict answers, refinement routes, audits of several sources and answers in free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import answers, routes
from spanloom.operators import audits

from .joining import KEY_PARTS
from .registry import Tables, query


def _pick(names: tuple[str | None, ...], index: str) -> F.Column:
    return F.get(F.array(*map(F.lit, names)), F.expr(f"cast({index} as int)"))


def _list(names: tuple[str | None, ...]) -> str:
    return "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in names) + "]"


EXECUTION = "CASE WHEN l_discount = 0.1 THEN NULL WHEN l_tax = 0.08 THEN 'INFERENCE_ERROR' ELSE 'OK' END"
SEMANTIC = "CASE WHEN l_discount = 0.1 THEN NULL WHEN l_returnflag = 'R' THEN 'SUPPORTED' WHEN l_returnflag = 'A' OR l_quantity < 30 THEN 'CONTRADICTED' ELSE 'UNCERTAIN' END"
EXCLUSIVE = "CASE WHEN l_orderkey % 7 = 0 THEN 'UNRESOLVED' WHEN l_orderkey % 7 = 1 THEN 'OTHER' WHEN l_orderkey % 2 = 0 THEN 'DECLARED_EXCLUSIVE' ELSE 'NONEXCLUSIVE' END"


@query(
    "x50_contrasts",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber AS c, {EXECUTION} AS x, {SEMANTIC} AS s, l_suppkey, l_partkey FROM lineitem),
g AS (SELECT l_orderkey, {EXCLUSIVE} AS ex, 1 + l_orderkey % 3 AS target, l_orderkey % 5 > 0 AS strict, count(*) AS n, count(DISTINCT c) AS d, count(*) FILTER (c = 1 + l_orderkey % 3) AS t, count(*) FILTER (x = 'OK') AS ok, list(c ORDER BY c, l_suppkey, l_partkey) FILTER (x = 'OK' AND s = 'SUPPORTED') AS sup,
count(*) FILTER (x = 'OK' AND s = 'SUPPORTED' AND c = 1 + l_orderkey % 3) AS tsup, count(*) FILTER (c <> 1 + l_orderkey % 3) AS o, count(*) FILTER (c <> 1 + l_orderkey % 3 AND x = 'OK' AND s = 'CONTRADICTED') AS oc FROM l GROUP BY l_orderkey),
v AS (SELECT *, n >= 2 AND d = n AND t > 0 AS valid, ok = n AS complete, coalesce(len(sup), 0) AS ns, o > 0 AND oc = o AS contra FROM g),
p AS (SELECT *, CASE ex WHEN 'NONEXCLUSIVE' THEN valid AND complete AND tsup > 0 WHEN 'DECLARED_EXCLUSIVE' THEN valid AND complete AND tsup > 0 AND ns = 1 AND (contra OR NOT strict) ELSE false END AS pass FROM v)
SELECT l_orderkey, pass, CASE ex WHEN 'NONEXCLUSIVE' THEN CASE WHEN pass THEN 'NONEXCLUSIVE_TARGET_SUPPORTED' ELSE 'NONEXCLUSIVE_TARGET_UNRESOLVED' END WHEN 'DECLARED_EXCLUSIVE' THEN CASE WHEN pass THEN 'EXCLUSIVE_CONTRAST_PASS' ELSE 'EXCLUSIVE_CONTRAST_UNRESOLVED' END ELSE 'CONTRAST_UNRESOLVED' END AS status,
list_filter([CASE WHEN NOT valid THEN 'INVALID_CONTRAST_GROUP' END, CASE WHEN NOT complete THEN 'CONTRAST_TECHNICAL_FAILURE_OR_MISSING_RESULT' END, CASE WHEN ex = 'UNRESOLVED' THEN 'EXCLUSIVITY_UNRESOLVED' END] || CASE WHEN ex = 'DECLARED_EXCLUSIVE' THEN [CASE WHEN ns = 0 THEN 'NO_SUPPORTED_CLAIM' WHEN ns > 1 THEN 'MULTIPLE_EXCLUSIVE_CLAIMS_SUPPORTED' END, CASE WHEN tsup = 0 THEN 'TARGET_NOT_SUPPORTED' END, CASE WHEN strict AND NOT contra THEN 'ALTERNATIVES_NOT_CONTRADICTED' END] ELSE [] END || CASE WHEN ex = 'OTHER' THEN ['INVALID_EXCLUSIVITY_STATUS'] ELSE [] END, lambda r: r IS NOT NULL) AS reasons,
coalesce(sup, []) AS supported, complete AND ns = 1 AS unique_supported, contra AS alternatives_contradicted FROM p""",
)
def contrasts(t: Tables) -> DataFrame:
    """The lines of an order as claims of a group, some without a result, some failed; all kinds of exclusivity."""
    claims = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("claim"), "l_suppkey", "l_partkey", F.expr(EXECUTION).alias("execution"), F.expr(SEMANTIC).alias("semantic")))).alias("results"))
    made = routes.contrast(F.col("results"), F.expr(EXCLUSIVE), (1 + F.col("l_orderkey") % 3).cast("int"), F.col("l_orderkey") % 5 > 0)
    return claims.select("l_orderkey", made.alias("x")).select("l_orderkey", "x.*")


LABELS = ("ACCEPTED", "ACCEPTED", "ACCEPTED", "INTERFACE_NOT_LOCALIZED", "BOX_TOO_TIGHT", "WRONG_OBJECT", "NOT_VISIBLE_CONFIRMED", "UNRESOLVED")
ROLES = ("TOOL", "TOOL_INTERFACE", "TARGET", "OPERATOR_HAND_NOT_REQUIRED_INSIDE_TARGET_REGION")
OBSERVED = ("MAIN", "PRECONDITION_ALIGNMENT", "MAIN", "POSTCONDITION_ATTACHMENT", "MAIN")


@query(
    "x53_anchor_routes",
    f"""WITH c AS (SELECT DISTINCT l_orderkey, {_list(ROLES)}[least(l_linenumber, 4)] AS role, first_value({_list(LABELS)}[1 + l_partkey % 8]) OVER (PARTITION BY l_orderkey, least(l_linenumber, 4) ORDER BY l_linenumber, l_partkey, l_suppkey) AS label FROM lineitem),
r AS (SELECT l_orderkey, {_list(OBSERVED)}[1 + l_orderkey % 5] AS seen, list(DISTINCT label) FILTER (role IN ('TOOL', 'TOOL_INTERFACE')) AS ls, bool_or(role = 'TOOL_INTERFACE' AND label = 'INTERFACE_NOT_LOCALIZED') AS iface, bool_or(role = 'OPERATOR_HAND_NOT_REQUIRED_INSIDE_TARGET_REGION' AND label = 'UNRESOLVED') AS wait FROM c GROUP BY 1),
s AS (SELECT *, CASE WHEN ls = ['ACCEPTED'] THEN 'SPATIAL_COMPONENTS_VALID' WHEN iface THEN 'RELATIONAL_RELOCALIZATION_REQUIRED' WHEN list_has_any(ls, ['BOX_TOO_TIGHT', 'WRONG_OBJECT']) THEN 'RELOCALIZE_REQUIRED' WHEN list_contains(ls, 'NOT_VISIBLE_CONFIRMED') THEN 'REACQUIRE_REQUIRED' ELSE 'UNRESOLVED_REQUIRED_COMPONENT' END AS status FROM r)
SELECT status, CASE WHEN wait THEN 'TEMPORAL_REACQUIRE' WHEN seen <> 'MAIN' THEN 'RELATIONAL_COMPOSITE_REQUIRED' WHEN status = 'SPATIAL_COMPONENTS_VALID' THEN 'ELIGIBLE_SPATIAL_ANCHOR' WHEN status = 'UNRESOLVED_REQUIRED_COMPONENT' THEN 'ABSTAIN' ELSE status END AS route, ['APPARENT_2D_ONLY'] AS flags, count(*) AS n FROM s GROUP BY 1, 2""",
)
def anchor_routes(t: Tables) -> DataFrame:
    """Orders as anchors with reviewed components: one for each role, the first line's label."""
    role = F.get(F.array(*map(F.lit, ROLES)), F.least("l_linenumber", F.lit(4)) - 1)
    first = t.lineitem.groupBy("l_orderkey", role.alias("role")).agg(F.min_by(_pick(LABELS, "l_partkey % 8"), F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("label"))
    anchors = first.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("role", "label"))).alias("c"))
    required = F.array(F.lit("TOOL"), F.lit("TOOL_INTERFACE"))
    anchors = anchors.withColumn("status", routes.anchor_status(F.col("c"), required))
    x = routes.anchor_route(F.col("status"), _pick(OBSERVED, "l_orderkey % 5"), F.col("c"), required)
    return anchors.select("status", x.alias("x")).groupBy("status", "x.route", "x.flags").agg(F.count(F.lit(1)).alias("n"))


FAILURES = tuple(routes.TRANSITIONS)
ACTIONS = tuple(a for a, _ in routes.TRANSITIONS.values())
DIMENSIONS = tuple(d for _, d in routes.TRANSITIONS.values())


@query(
    "x54_transitions",
    f"""WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'TECHNICAL_FAILURE' WHEN 'purchase' THEN 'DIAGNOSTIC_COMPLETE' ELSE 'FAILED' END AS outcome, {_list(FAILURES)}[1 + event_id % 9] AS failure, {_list(ACTIONS)}[1 + event_id % 9] AS a, {_list(DIMENSIONS)}[1 + event_id % 9] AS d, user_id % 2 = 0 AS sw, event_id % 4 AS left_ FROM events),
r AS (SELECT *, CASE outcome WHEN 'TECHNICAL_FAILURE' THEN 'TECHNICAL_DIAGNOSTIC' WHEN 'DIAGNOSTIC_COMPLETE' THEN 'STOP_DIAGNOSTIC' ELSE a END AS action, CASE WHEN outcome = 'FAILED' THEN failure ELSE outcome END AS reason, CASE WHEN outcome = 'FAILED' THEN d END AS dim FROM e),
s AS (SELECT *, CASE WHEN action = 'VERIFIER_SWITCH' AND NOT sw THEN 'VERIFIER_SWITCH_NOT_PREDECLARED' WHEN action = 'INTERVENTION_DIAGNOSTIC' THEN 'POLICY_ACTION_NOT_ALLOWED' WHEN dim IS NOT NULL AND left_ = 0 THEN 'BUDGET_' || upper(dim) || '_EXHAUSTED' END AS stop FROM r)
SELECT event_id, CASE WHEN stop IS NULL THEN action ELSE 'STOP_ABSTAIN' END AS action, reason, CASE WHEN stop IS NULL THEN dim END AS consumed, stop AS termination FROM s""",
)
def transitions(t: Tables) -> DataFrame:
    """Events as diagnoses: every failure, with budgets that are spent for some, a switch that half of the policies declare, one action that none allows."""
    outcome = F.when(F.col("event_type") == "error", "TECHNICAL_FAILURE").when(F.col("event_type") == "purchase", "DIAGNOSTIC_COMPLETE").otherwise("FAILED")
    allowed = F.array(*map(F.lit, sorted({*ACTIONS, "STOP_DIAGNOSTIC"} - {"INTERVENTION_DIAGNOSTIC"})))
    budget = F.create_map(*[x for d in sorted({d for d in DIMENSIONS if d}) for x in (F.lit(d), F.col("event_id") % 4)])
    made = routes.transition(outcome, _pick(FAILURES, "event_id % 9"), allowed, F.col("user_id") % 2 == 0, budget)
    return t.events.select("event_id", made.alias("x")).select("event_id", "x.*")


@query(
    "x55_strict_answers",
    """WITH l AS (SELECT l_orderkey, l_linenumber, min('c' || l_partkey) AS claim, bool_or(l_quantity > 4 OR l_orderkey % 3 = 0) AS good, bool_or(l_returnflag = 'A') AS against FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_orderkey, list(claim ORDER BY l_linenumber) AS claims, string_agg('t ' || claim, ' ' ORDER BY l_linenumber) AS txt, bool_and(good) AND l_orderkey % 4 > 0 AS covered, bool_or(against AND l_linenumber = 1) AS against FROM l GROUP BY 1)
SELECT l_orderkey, CASE WHEN covered THEN 'ANSWERED' ELSE 'ABSTAIN' END AS status, CASE WHEN covered THEN CASE WHEN l_orderkey % 5 = 0 THEN 'SUPPORTED' ELSE txt END END AS answer, CASE WHEN covered THEN 'VERIFIED' WHEN against THEN 'CONTRADICTED' ELSE 'UNCERTAIN' END AS judgment, CASE WHEN covered THEN claims ELSE [] END AS claims FROM g""",
)
def strict_answers(t: Tables) -> DataFrame:
    """Orders as samples: their lines are required claims, most of them verified."""
    claims = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat(F.lit("c"), F.col("l_partkey").cast("string"))).alias("claim"), F.bool_or((F.col("l_quantity") > 4) | (F.col("l_orderkey") % 3 == 0)).alias("good"), F.bool_or(F.col("l_returnflag") == "A").alias("against"))
    claims = claims.withColumn("key", F.concat_ws("/", "l_linenumber", "claim"))
    each = F.struct("l_linenumber", F.col("key").alias("claim"), F.concat(F.lit("t "), F.col("claim")).alias("text"))
    orders = claims.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(each)).alias("r"), F.collect_list(F.when(F.col("good"), F.col("key"))).alias("v"), F.bool_or(F.col("against") & (F.col("l_linenumber") == 1)).alias("against"))
    made = routes.strict_answer(F.col("r"), F.col("v"), F.col("l_orderkey") % 4 > 0, F.when(F.col("against"), "CONTRADICTED").otherwise("SUPPORTED"), F.col("l_orderkey") % 5 == 0)
    out = orders.select("l_orderkey", made.alias("x")).select("l_orderkey", "x.*")
    return out.withColumn("claims", F.transform("claims", lambda c: F.substring_index(c, "/", -1)))


REASONS = ("CONTROL_RESULT_COUNT_MISMATCH", "ORIGINAL_INSUFFICIENT", "TECHNICAL_FAILURE", "DEPENDENCE_UNRESOLVED", "KEEP_SUPPORT_LOST", "OTHER", "OTHER", "OTHER")
ROOTS = (None, "SPATIAL_PROPOSAL_OR_ROI_FAILURE", "TECHNICAL_ERROR", "TEMPORAL_OR_SEMANTIC_INSUFFICIENT", "SPATIAL_PROPOSAL_OR_ROI_FAILURE", None, None)
EFFECT = ("UNIFORM_REGION", None, "ARTIFACT_NOT_APPLIED")
ROUTED = f"""SELECT event_id, CASE WHEN r = 'CONTROL_RESULT_COUNT_MISMATCH' THEN CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END WHEN r = 'ORIGINAL_INSUFFICIENT' OR root = 'TEMPORAL_OR_SEMANTIC_INSUFFICIENT' THEN 3 WHEN r = 'TECHNICAL_FAILURE' OR root = 'TECHNICAL_ERROR' THEN 4
WHEN root = 'SPATIAL_PROPOSAL_OR_ROI_FAILURE' AND effect = 'UNIFORM_REGION' THEN 5 WHEN r = 'DEPENDENCE_UNRESOLVED' THEN 6 WHEN r = 'KEEP_SUPPORT_LOST' THEN 7 ELSE 8 END AS c FROM (SELECT event_id, user_id, {_list(REASONS)}[1 + event_id % 8] AS r, {_list(ROOTS)}[1 + event_id % 7] AS root, {_list(EFFECT)}[1 + event_id % 3] AS effect FROM events)"""


@query(
    "v62_v63_refinement_routes",
    f"""WITH r AS ({ROUTED}), v AS (SELECT *, unnest([1, 2]) AS version FROM r), s AS (SELECT *, ['control-geometry', NULL, NULL, NULL, 'intervention-effect', 'dependence', 'sufficiency', NULL][c] AS p FROM v)
SELECT version, p IS NOT NULL AS allowed, ['CONTROL_GEOMETRY_UNAVAILABLE', 'UNRESOLVED_CONTROL_RESULT_COUNT_MISMATCH', 'ORIGINAL_INSUFFICIENT', 'TECHNICAL_DIAGNOSTIC', 'OVERBROAD_OR_DEGENERATE_ROI', 'DEPENDENCE_UNRESOLVED', 'SUFFICIENCY_UNRESOLVED', 'UNRESOLVED_FAILURE_MODE'][c] AS routing_reason,
['SPATIAL_REFINE_OVERBROAD_ROI', 'SPATIAL_UNRESOLVED', 'TEMPORAL_REACQUIRE', 'SPATIAL_UNRESOLVED', 'SPATIAL_REFINE_VISUALLY_GROUNDED_ROI', 'SPATIAL_REFINE_RESIDUAL_SUPPORT', 'SPATIAL_REFINE_CLAIM_SUFFICIENCY', 'SPATIAL_UNRESOLVED'][c] AS action,
'spatial_refine_' || replace(p, '-', '_') || CASE WHEN version = 2 THEN '_v2' ELSE '' END AS stage, 'relive-spatial-refine-' || p || '-v' || version AS prompt_version, count(*) AS n FROM s GROUP BY ALL""",
)
def refinement_routes(t: Tables) -> DataFrame:
    """Events as diagnoses under both versions of the routes."""
    args = (F.array(_pick(REASONS, "event_id % 8")), F.when(F.col("user_id") % 2 == 0, "B_LEGITIMATE_PROTOCOL_UNAVAILABLE").otherwise("A_OTHER"), _pick(ROOTS, "event_id % 7"), _pick(EFFECT, "event_id % 3"))
    both = F.array(*[F.struct(F.lit(v).alias("version"), routes.refinement_route(*args, version=v).alias("x")) for v in (1, 2)])
    rows = t.events.select(F.explode(both).alias("r")).select("r.version", "r.x.*")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j09_prediction_audit",
    """WITH m AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS valid FROM orders),
p AS (SELECT CASE WHEN l_partkey % 97 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS id, CASE WHEN l_quantity = 50 THEN 'MAYBE' WHEN l_returnflag = 'R' THEN 'YES' WHEN l_quantity <> 49 THEN 'NO' END AS a FROM lineitem WHERE l_linenumber = 1 OR l_linenumber = 2 AND l_orderkey % 50 = 0), e AS (SELECT l_orderkey AS id FROM lineitem WHERE l_tax = 0.08),
pi AS (SELECT DISTINCT id FROM p), ei AS (SELECT DISTINCT id FROM e), v AS (SELECT id FROM m WHERE valid), i AS (SELECT id FROM m WHERE NOT valid)
SELECT (SELECT count(*) FROM m) AS n_total, (SELECT count(*) FROM v) AS n_valid, (SELECT count(*) FROM i) AS n_invalid, (SELECT count(*) FROM p) AS n_final_predictions, (SELECT count(*) FROM v ANTI JOIN pi USING (id)) AS missing, (SELECT count(*) FROM pi ANTI JOIN v USING (id)) AS extra, (SELECT count(*) FROM pi SEMI JOIN i USING (id)) AS for_invalid,
(SELECT count(*) FROM (SELECT id FROM p GROUP BY 1 HAVING count(*) > 1)) AS duplicate_predictions, 0 AS duplicate_manifest, (SELECT count(*) FROM p WHERE a IS NULL OR a NOT IN ('YES', 'NO')) AS invalid_predictions, (SELECT count(*) FROM e) AS n_errors, (SELECT count(*) FROM ei SEMI JOIN pi USING (id)) AS errors_resolved, (SELECT count(*) FROM (SELECT * FROM ei SEMI JOIN v USING (id)) x ANTI JOIN pi USING (id)) AS unresolved""",
)
def prediction_audit(t: Tables) -> DataFrame:
    """Orders as a manifest, first lines as predictions (some of unknown orders, some twice, some with no legal answer), lines of high tax as errors."""
    manifest = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("valid"))
    first = t.lineitem.where("l_linenumber = 1 OR l_linenumber = 2 AND l_orderkey % 50 = 0")
    predictions = first.select(F.expr("CASE WHEN l_partkey % 97 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END").alias("id"), F.expr("CASE WHEN l_quantity = 50 THEN 'MAYBE' WHEN l_returnflag = 'R' THEN 'YES' WHEN l_quantity <> 49 THEN 'NO' END").alias("a"))
    return audits.prediction_audit(manifest, predictions, t.lineitem.where("l_tax = 0.08").select(F.col("l_orderkey").alias("id")), "id", "valid", "a")


EXPECTED = "SELECT l_orderkey, l_linenumber, min(l_returnflag) AS visibility FROM lineitem WHERE l_partkey % 31 > 0 GROUP BY 1, 2"
REVIEWED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 23 = 0 THEN 'X' ELSE l_returnflag END AS visibility FROM lineitem WHERE l_partkey % 29 > 0"


@query(
    "j25_review_index",
    f"""WITH e AS ({EXPECTED}), r AS ({REVIEWED}), k AS (SELECT l_orderkey, l_linenumber FROM e UNION SELECT l_orderkey, l_linenumber FROM r),
c AS (SELECT k.*, (SELECT count(*) FROM e WHERE e.l_orderkey = k.l_orderkey AND e.l_linenumber = k.l_linenumber) AS ne, (SELECT count(*) FROM r WHERE r.l_orderkey = k.l_orderkey AND r.l_linenumber = k.l_linenumber) AS nr, (SELECT count(DISTINCT visibility) FROM (SELECT * FROM e UNION ALL SELECT * FROM r) u WHERE u.l_orderkey = k.l_orderkey AND u.l_linenumber = k.l_linenumber) AS nv FROM k)
SELECT l_orderkey, l_linenumber, ne AS n_expected, nr AS n_review, list_filter([CASE WHEN ne = 0 THEN 'MISSING_EXPECTED' END, CASE WHEN nr = 0 THEN 'MISSING_REVIEW' END, CASE WHEN nr > 1 THEN 'DUPLICATE_REVIEW' END, CASE WHEN nv > 1 THEN 'VISIBILITY_MISMATCH' END], lambda x: x IS NOT NULL) AS errors FROM c""",
)
def review_index(t: Tables) -> DataFrame:
    """Expected components and their reviews: unknown, missing, repeated and differing ones as errors of a key."""
    expected = t.lineitem.where("l_partkey % 31 > 0").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("visibility"))
    review = t.lineitem.where("l_partkey % 29 > 0").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_suppkey % 23 = 0 THEN 'X' ELSE l_returnflag END").alias("visibility"))
    return audits.reconciled({"expected": expected, "review": review}, ["l_orderkey", "l_linenumber"], ["visibility"])


@query(
    "j30_timestamp_binding",
    """WITH f AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k, l_partkey AS ref, l_suppkey FROM lineitem),
m AS (SELECT l_orderkey, k, CASE WHEN l_suppkey % 41 = 0 THEN -ref ELSE ref END AS ref, CASE WHEN ref % 43 = 0 THEN NULL WHEN ref % 47 = 0 THEN -1.0 WHEN ref % 37 = 0 THEN 0.5 ELSE k * 2.0 END AS s FROM f WHERE NOT (k > 0 AND ref % 53 = 0)),
o AS (SELECT *, lag(s) OVER (PARTITION BY l_orderkey ORDER BY k) AS b, lag(k) OVER (PARTITION BY l_orderkey ORDER BY k) AS bk FROM m),
x AS (SELECT f.l_orderkey, count(m.k) AS nm, count(*) AS nf, bool_or(m.ref IS DISTINCT FROM f.ref) AS unbound FROM f LEFT JOIN m ON m.l_orderkey = f.l_orderkey AND m.k = f.k GROUP BY 1),
y AS (SELECT l_orderkey, bool_or(s IS NULL) AS inf, coalesce(bool_or(s < 0), false) AS neg, coalesce(bool_or(s < b AND bk = k - 1), false) AS falls, min(s) AS low, max(s) AS high FROM o GROUP BY 1)
SELECT l_orderkey, list_filter([CASE WHEN nm <> nf THEN 'FRAME_COUNT_MISMATCH' END, CASE WHEN unbound THEN 'BINDING_MISMATCH' END, CASE WHEN inf THEN 'TIMESTAMP_NONFINITE' END, CASE WHEN neg THEN 'TIMESTAMP_NEGATIVE' END, CASE WHEN falls THEN 'TIMESTAMP_NONMONOTONIC' END, CASE WHEN NOT coalesce(nm >= 2 AND high > low, false) THEN 'DURATION_NOT_POSITIVE' END], lambda e: e IS NOT NULL) AS errors FROM x JOIN y USING (l_orderkey)""",
)
def timestamp_binding(t: Tables) -> DataFrame:
    """The lines of orders as frames, a manifest of them with wrong references, lost rows and bad times."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(KEY_PARTS, "l_orderkey")  # the one exchange
    place = Window.partitionBy("l_orderkey").orderBy(*map(F.asc_nulls_last, ("l_linenumber", "l_partkey", "l_suppkey")))  # the few lines of an order
    frames = lines.withColumn("frame_order", F.row_number().over(place) - 1)
    sides = F.when(F.expr("NOT (frame_order > 0 AND l_partkey % 53 = 0)"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    reference = F.expr("CASE WHEN listed AND l_suppkey % 41 = 0 THEN -l_partkey ELSE l_partkey END")
    seconds = F.expr("CASE WHEN l_partkey % 43 = 0 THEN NULL WHEN l_partkey % 47 = 0 THEN -1.0D WHEN l_partkey % 37 = 0 THEN 0.5D ELSE frame_order * 2.0D END")
    rows = frames.withColumn("listed", F.explode(sides)).select("l_orderkey", "frame_order", "listed", reference.alias("reference"), seconds.alias("seconds"))
    return audits.bound_rows(rows, "l_orderkey")


LINES = (
    "'**Start Time:** ' || l_linenumber || '.5 - ' || (l_linenumber + 2) || ' seconds **Description:** part ' || l_partkey || '...'",
    "l_linenumber || '-' || (l_linenumber + 3) || '.25 seconds - part ' || l_partkey",
    "'Time Range: ' || l_linenumber || ' – ' || (l_linenumber + 1) || ' second, then - a-b. part ' || l_partkey || ' .'",
    "'no times in line ' || l_partkey",
    "'Time Interval:  ' || l_linenumber || '. - 77 seconds'",
)
SPANS = ("l_linenumber || '-' || (l_linenumber + 2) || '.5 seconds: part ' || l_partkey || chr(10) || 'goes on'", "l_linenumber || '.25-' || (l_linenumber + 3) || ' second:  ' || l_partkey || ' 4-5 seconds: inside'", "l_linenumber || '-9 seconds:  ' || chr(10) || 'below'", "'text before'")
ORDERED = "SELECT l_orderkey, string_agg({0}, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS txt FROM lineitem GROUP BY 1"


def _case(forms: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN l_partkey % {len(forms)} = {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def _captions(t: Tables, forms: tuple[str, ...], segments: Callable[[Column], Column]) -> DataFrame:
    """Orders with segments in their text. Keys alone are exchanged, and segments are made by the aggregate itself, as they would be made again for the filter."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(KEY_PARTS, "l_orderkey")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(_case(forms)).alias("line"))))
    return lines.groupBy("l_orderkey").agg(segments(F.array_join(ordered["line"], "\n")).alias("segments")).where(F.size("segments") > 0)


@query(
    "x04_line_captions",
    """SELECT l_orderkey, list({'start': a, 'end': b, 'caption': c} ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (c IS NOT NULL) AS segments FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber + CASE l_partkey % 5 WHEN 0 THEN 0.5 ELSE 0 END::DOUBLE AS a, CASE l_partkey % 5 WHEN 0 THEN l_linenumber + 2 WHEN 1 THEN l_linenumber + 3.25 ELSE l_linenumber + 1 END::DOUBLE AS b,
CASE l_partkey % 5 WHEN 0 THEN 'part ' || l_partkey WHEN 1 THEN 'part ' || l_partkey WHEN 2 THEN 'a-b. part ' || l_partkey || ' ' END AS c FROM lineitem) GROUP BY 1 HAVING count(c) > 0""",
)
def line_captions(t: Tables) -> DataFrame:
    """Captions in the forms that a line may have, among lines without times or without a caption."""
    return _captions(t, LINES, answers.line_segments)


@query(
    "v07_span_captions",
    f"""WITH x AS ({ORDERED.format(_case(SPANS))}), l AS (SELECT l_orderkey, unnest(string_split(txt, chr(10))) AS line, generate_subscripts(string_split(txt, chr(10)), 1) AS i FROM x),
h AS (SELECT *, regexp_matches(line, '^[0-9]+(\\.[0-9]+)?-[0-9]+(\\.[0-9]+)?[ ]+seconds?:') AS head FROM l), g AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY l_orderkey ORDER BY i) AS s FROM h),
s AS (SELECT l_orderkey, s, string_agg(line, chr(10) ORDER BY i) AS t FROM g WHERE s > 0 GROUP BY 1, 2), m AS (SELECT *, regexp_extract(t, '^([0-9.]+)-', 1)::DOUBLE AS a, regexp_extract(t, '^[0-9.]+-([0-9.]+)', 1)::DOUBLE AS b, trim(regexp_replace(t, '^[0-9.]+-[0-9.]+[ ]+seconds?:', ''), ' ' || chr(10)) AS c FROM s)
SELECT l_orderkey, list({{'start': a, 'end': b, 'caption': c}} ORDER BY s) AS segments FROM m WHERE c <> '' GROUP BY 1""",
)
def span_captions(t: Tables) -> DataFrame:
    """Segments over several lines, with ranges inside captions, captions on the next line and text before the first."""
    return _captions(t, SPANS, answers.span_segments)

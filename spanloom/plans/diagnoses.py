"""Queries of margins by class, differences of margins, fingerprints of two runs, windows against the truth, similarities and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import diagnosis, timeline

from .registry import Tables, query

# margins of an order from the sums of its lines, as whole numbers
CASES = "SELECT l_orderkey AS k, sum(l_quantity::INT) AS q, sum(l_partkey) AS p, sum(l_suppkey) AS s FROM lineitem GROUP BY 1"
MARGIN_SQL = {"original": "(q % 11 - 2)", "keep": "(p % 9 - 2)", "drop_": "(s % 7 - 4)", "control": "((q + p) % 9 - 3)", "gray": "((p + s) % 7 - 3)", "mismatch": "((q + s) % 13 - 6)"}
_NAMED = ", ".join(f"{v} AS {k}" for k, v in MARGIN_SQL.items())


def _cases(t: Tables) -> DataFrame:
    """The orders of lines as cases; one in 23 has a margin that isn't a number, one in 29 none."""
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("int")).alias("q"), F.sum("l_partkey").alias("p"), F.sum("l_suppkey").alias("s"))
    margins = {k.rstrip("_"): F.expr(v).cast("double") for k, v in MARGIN_SQL.items()}
    margins["keep"] = F.when(F.col("k") % 23 == 0, float("nan")).when(F.col("k") % 29 > 0, margins["keep"])
    return sums.select("k", *[v.alias(k) for k, v in margins.items()])


@query(
    "a63_case_classes",
    f"""WITH m AS (SELECT k, {_NAMED} FROM ({CASES})), c AS (SELECT *, CASE WHEN k % 23 = 0 OR k % 29 = 0 THEN 'MARGIN_NOT_FINITE' WHEN original <= 0 THEN 'ORIGINAL_LIKELIHOOD_INSUFFICIENT' WHEN keep <= 0 THEN 'KEEP_PRESERVATION_FAILURE' WHEN drop_ > 0 THEN 'DROP_SUPPORT_PERSISTS' WHEN control <= 0 THEN 'CONTROL_SUPPORT_LOST' ELSE 'FULL_LOCAL_DEPENDENCE_PATTERN' END AS case_class FROM m),
a AS (SELECT case_class, CASE WHEN case_class = 'DROP_SUPPORT_PERSISTS' THEN CASE WHEN gray > 0 THEN 'DROP_SUPPORT_PERSISTS_WITH_FULL_GRAY_SUPPORT' ELSE 'DROP_SUPPORT_PERSISTS_WITH_VISUAL_SENSITIVITY_RETAINED' END END AS auxiliary FROM c),
r AS (SELECT *, CASE WHEN auxiliary LIKE '%GRAY%' THEN ['VERIFIER_INSENSITIVITY_UNRESOLVED', 'STOP_OR_PREDECLARED_VERIFIER_SWITCH', 'UNBOUNDED_R2_R3'] WHEN auxiliary IS NOT NULL THEN ['DROP_SUPPORT_PERSISTS', 'LOCALIZE_RESIDUAL_COMPONENT', 'CREATE_VERIFIED'] WHEN case_class LIKE 'FULL%' THEN ['NO_FAILURE_DIAGNOSTIC_COMPLETE', 'STOP_DIAGNOSTIC', 'CREATE_VERIFIED'] WHEN case_class LIKE 'ORIG%' THEN ['ORIGINAL_INSUFFICIENT', 'TEMPORAL_REACQUIRE', 'SPATIAL_REGROUND_ON_SAME_WINDOW']
WHEN case_class LIKE 'KEEP%' THEN ['KEEP_SUPPORT_LOST', 'RECOMPOSE_SPATIAL_EVIDENCE', 'LOWER_KEEP_STANDARD'] WHEN case_class LIKE 'CONTROL%' THEN ['CONTROL_SUPPORT_LOST', 'INTERVENTION_DIAGNOSTIC', 'EXPAND_ROI_BLINDLY'] END AS t FROM a)
SELECT case_class, auxiliary, t[1] AS code, t[2] AS allowed, t[3] AS forbidden, count(*) AS n FROM r GROUP BY ALL""",
)
def case_classes(t: Tables) -> DataFrame:
    return diagnosis.case_classes(_cases(t))


@query(
    "a63_delta_statistics",
    f"""WITH m AS (SELECT k, {_NAMED} FROM ({CASES}) WHERE k % 23 > 0 AND k % 29 > 0), d AS (SELECT 'delta_drop' AS delta, original - drop_ AS v FROM m UNION ALL SELECT 'delta_full_gray', original - gray FROM m UNION ALL SELECT 'delta_mismatch', original - mismatch FROM m UNION ALL SELECT 'delta_specificity', control - drop_ FROM m)
SELECT delta, count(*) AS n, count(*) FILTER (v > 0) AS positive, round(avg(v), 6) AS mean, median(v)::DOUBLE AS median, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max FROM d GROUP BY 1""",
)
def delta_statistics(t: Tables) -> DataFrame:
    return diagnosis.delta_statistics(_cases(t)).withColumn("mean", F.round("mean", 6))


@query(
    "q20_fingerprints",
    """WITH l AS (SELECT l_orderkey AS k, 'f' || l_linenumber AS f, l_linenumber AS i, min(l_partkey) AS old, min(l_partkey) + max((l_returnflag = 'R')::INT) AS new FROM lineitem GROUP BY 1, 2, 3),
v AS (SELECT k, f, CASE WHEN i <> 4 THEN old::VARCHAR END AS old, CASE WHEN i <> 5 THEN new::VARCHAR END AS new, CASE WHEN i <= 2 THEN 'CORE' WHEN i = 3 THEN 'ENVIRONMENT' ELSE 'RUNTIME' END AS scope FROM l)
SELECT k AS run, coalesce(bool_and(old = new) FILTER (scope = 'CORE'), true) AS core_matches, coalesce(bool_and(old = new) FILTER (scope = 'ENVIRONMENT'), true) AS environment_matches, count(*) AS n_fields,
coalesce(list({'scope': scope, 'field': f, 'old': old, 'new': new} ORDER BY scope, f) FILTER (old IS DISTINCT FROM new), []) AS differences FROM v GROUP BY 1""",
)
def fingerprints(t: Tables) -> DataFrame:
    """Orders as runs, their lines as fields; the fourth is new, the fifth gone, returned ones differ."""
    fields = t.lineitem.groupBy(F.col("l_orderkey").alias("run"), F.concat(F.lit("f"), "l_linenumber").alias("field"), "l_linenumber").agg(F.min("l_partkey").alias("old"), (F.min("l_partkey") + F.max((F.col("l_returnflag") == "R").cast("int"))).alias("new"))
    return diagnosis.compare_fingerprints(fields.where("l_linenumber != 4").withColumnRenamed("old", "value"), fields.where("l_linenumber != 5").withColumnRenamed("new", "value"), ["f1", "f2"], ["f3"])


@query(
    "v33_window_alignment",
    """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS i, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY 1, 2), n AS (SELECT k, i, a, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY k) AS n, count(*) FILTER (a) OVER (PARTITION BY k) AS total FROM c),
w AS (SELECT DISTINCT k, n, total, unnest(range(0, n - 1, 1)) AS s FROM n WHERE n >= 2), j AS (SELECT w.k, s, count(*) FILTER (a) AS visible, any_value(w.total) AS total FROM w JOIN n ON n.k = w.k AND n.p IN (s, s + 1) GROUP BY 1, 2)
SELECT k, s AS start_pos, s + 1 AS end_pos, 2 AS window_cells, total AS total_visible, visible, visible / 2 AS density, CASE WHEN total > 0 THEN round(visible / total, 6) END AS recall, k % 5 > 0 AND visible > 0 AS temporally_eligible FROM j""",
)
def window_alignment(t: Tables) -> DataFrame:
    """The lines of an order as cells of a clip, those of one flag as its spans, in windows of two."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("double").alias("i")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    cell = lambda low, high: F.struct((F.col("i") + low).alias("start"), (F.col("i") + high).alias("end"))
    samples = lines.groupBy("k").agg(F.array_sort(F.collect_list(cell(-0.5, 0.5))).alias("cells"), F.collect_list(F.when(F.col("a"), cell(-0.25, 0.25))).alias("spans"), F.count(F.lit(1)).alias("n"))
    samples = samples.withColumn("eligible", F.col("k") % 5 > 0)
    windows = timeline.position_windows(samples, "k", "n", 2, 1)
    return diagnosis.window_alignment(samples, windows, "k").withColumn("recall", F.round("recall", 6))


@query(
    "x30_mean_similarity",
    """WITH p AS (SELECT a.label % 4 AS task, CASE WHEN a.label % 4 < 3 AND a.vec_id % 7 > 0 THEN list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) END AS c FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT task, count(c) AS n, round(coalesce(avg(c), 0), 6) AS similarity FROM p GROUP BY 1""",
)
def mean_similarity(t: Tables) -> DataFrame:
    """Each vector as an answer, the next one as its truth; some answers are empty, one task has none at all."""
    truth = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("truth"))
    task: Column = F.col("label") % 4
    answer = F.when((task < 3) & (F.col("vec_id") % 7 > 0), F.col("embedding")).otherwise(F.array().cast("array<float>"))
    rows = t.embeddings.join(truth, "vec_id", "left").select(task.alias("task"), answer.alias("answer"), "truth")
    return diagnosis.mean_similarity(rows, ["task"], "answer", "truth").withColumn("similarity", F.round("similarity", 6))


@query(
    "v66_candidate_rows",
    """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem), n AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY k) AS n FROM c),
w AS (SELECT DISTINCT k, n, unnest(list_filter(range(0, n, 2), lambda s: s = 0 OR s + 1 < n)) AS s FROM n), j AS (SELECT w.k, s, list('f' || i ORDER BY i) AS frame_ids, list('p/' || i ORDER BY i) AS paths, bool_and(w.k % 3 > 0 OR i <> 2) AS timed, min(i) / 2 AS a, max(i) / 2 AS b, min(p) AS p1, max(p) AS p2 FROM w JOIN n ON n.k = w.k AND p BETWEEN s AND s + 2 GROUP BY 1, 2)
SELECT k, s // 2 AS candidate_rank, frame_ids, paths, CASE WHEN timed THEN a ELSE p1 END AS start, CASE WHEN timed THEN b ELSE p2 END AS "end", CASE WHEN timed THEN 'public_timestamp' ELSE 'frame_order' END AS coordinates, len(frame_ids) AS frame_count, len(frame_ids) < 3 AS tail_short FROM j""",
)
def candidate_rows(t: Tables) -> DataFrame:
    """The lines of an order as frames, the second without a time in a third of the orders, in windows of three."""
    frames = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber").distinct()
    at = F.when((F.col("k") % 3 > 0) | (F.col("l_linenumber") != 2), F.col("l_linenumber") / 2)
    each = F.struct("l_linenumber", F.concat(F.lit("f"), "l_linenumber").alias("frame_id"), F.concat(F.lit("p/"), "l_linenumber").alias("path"), at.alias("at"))
    return diagnosis.candidate_rows(frames.groupBy("k").agg(F.array_sort(F.collect_list(each)).alias("frames")), "k", 3, 2)


REASONS = ("KEEP_SUPPORT_LOST", "CONTROL_UNAVAILABLE", "INTERVENTION_NO_EFFECT", "ORIGINAL_INSUFFICIENT", "TECHNICAL_FAILURE", "CONTROL_RESULT_COUNT_MISMATCH", "OTHER_REASON")
EFFECTS = ("UNIFORM_REGION", "ARTIFACT_NOT_APPLIED", "OTHER")


@query(
    "v64_failure_diagnosis",
    f"""WITH r AS (SELECT l_orderkey AS k, list(DISTINCT {list(REASONS)}[1 + least(l_partkey % 18, 6)]) AS rs FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS k, count(*) AS r, bool_or(l_linenumber = 2) AS gone FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), p AS (SELECT l_orderkey AS k, list({list(EFFECTS)}[1 + l_suppkey % 3] ORDER BY l_linenumber, {list(EFFECTS)}[1 + l_suppkey % 3])[1] AS effect FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
j AS (SELECT k, rs, r, coalesce(gone, false) AS gone, effect, 1 + k % 4 AS e, 1 + k % 3 AS g FROM r LEFT JOIN c USING (k) LEFT JOIN p USING (k)),
d AS (SELECT CASE WHEN list_contains(rs, 'CONTROL_RESULT_COUNT_MISMATCH') THEN 'TECHNICAL_DIAGNOSTIC' WHEN list_contains(rs, 'TECHNICAL_FAILURE') THEN 'TECHNICAL_ERROR' WHEN list_contains(rs, 'ORIGINAL_INSUFFICIENT') THEN 'TEMPORAL_OR_SEMANTIC_INSUFFICIENT' WHEN list_contains(rs, 'INTERVENTION_NO_EFFECT') THEN CASE effect WHEN 'UNIFORM_REGION' THEN 'SPATIAL_PROPOSAL_OR_ROI_FAILURE' WHEN 'ARTIFACT_NOT_APPLIED' THEN 'TECHNICAL_ERROR' ELSE 'UNRESOLVED' END
WHEN list_contains(rs, 'CONTROL_UNAVAILABLE') THEN CASE WHEN k % 2 = 0 THEN 'SPATIAL_PROPOSAL_GEOMETRY' ELSE 'PROTOCOL_UNAVAILABLE' END WHEN list_contains(rs, 'KEEP_SUPPORT_LOST') THEN 'SPATIAL_DEPENDENCE_OR_SUFFICIENCY' ELSE 'UNRESOLVED' END AS root,
CASE WHEN list_contains(rs, 'CONTROL_RESULT_COUNT_MISMATCH') THEN CASE WHEN r IS NULL THEN 'C_UNRESOLVED' WHEN gone AND g < e AND r = g THEN 'B_LEGITIMATE_PROTOCOL_UNAVAILABLE' WHEN g = e AND r <> g THEN 'A_IMPLEMENTATION_OR_ARTIFACT_BUG' WHEN g <> e AND NOT gone THEN 'A_IMPLEMENTATION_OR_ARTIFACT_BUG' ELSE 'C_UNRESOLVED' END END AS mismatch FROM j),
u AS (SELECT 'root_cause' AS kind, root AS name FROM d UNION ALL SELECT 'mismatch', mismatch FROM d WHERE mismatch IS NOT NULL UNION ALL SELECT 'total', 'candidates' FROM d UNION ALL SELECT 'total', 'spatial_refinable_failures' FROM d WHERE root LIKE 'SPATIAL%' UNION ALL SELECT 'total', 'technical_or_protocol_failures' FROM d WHERE root IN ('TECHNICAL_DIAGNOSTIC', 'TECHNICAL_ERROR', 'PROTOCOL_UNAVAILABLE')
UNION ALL SELECT 'total', 'temporal_or_semantic_failures' FROM d WHERE root LIKE 'TEMPORAL%' UNION ALL SELECT 'total', 'unresolved_failures' FROM d WHERE root = 'UNRESOLVED') SELECT kind, name, count(*) AS n FROM u GROUP BY 1, 2""",
)
def failure_diagnosis(t: Tables) -> DataFrame:
    """Orders as certificates: their lines tell the reasons, most of them are results of controls, the first two pixel audits."""
    at = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    k = F.col("l_orderkey").alias("certificate_id")
    certificates = t.lineitem.groupBy(k).agg(F.collect_set(at(REASONS, F.least(F.col("l_partkey") % 18, F.lit(6)))).alias("reasons"))
    certificates = certificates.withColumns({"expected": 1 + F.col("certificate_id") % 4, "generated": 1 + F.col("certificate_id") % 3, "geometry_refinable": F.col("certificate_id") % 2 == 0})
    controls = t.lineitem.where("l_returnflag != 'R'").select(k, F.when(F.col("l_linenumber") == 2, "CONTROL_UNAVAILABLE").otherwise("OK").alias("status"))
    pixels = t.lineitem.where("l_linenumber <= 2").select(k, F.col("l_linenumber").alias("position"), at(EFFECTS, F.col("l_suppkey") % 3).alias("effect"))
    return diagnosis.diagnosis_totals(diagnosis.diagnose(certificates, controls, pixels))

"""Diagnoses over completed runs: margins of changed inputs by class, fingerprints of two runs, windows against the truth, similarities, rows of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import labels, verdicts
from spanloom.operators import ranking, timeline

MARGINS = ("original", "keep", "drop", "control", "gray", "mismatch")

#: Code of a failure, allowed and forbidden actions by the class of a case; the last class by whether support outlives the gray input.
ROUTES = {
    "FULL_LOCAL_DEPENDENCE_PATTERN": ("NO_FAILURE_DIAGNOSTIC_COMPLETE", "STOP_DIAGNOSTIC", "CREATE_VERIFIED"),
    "ORIGINAL_LIKELIHOOD_INSUFFICIENT": ("ORIGINAL_INSUFFICIENT", "TEMPORAL_REACQUIRE", "SPATIAL_REGROUND_ON_SAME_WINDOW"),
    "KEEP_PRESERVATION_FAILURE": ("KEEP_SUPPORT_LOST", "RECOMPOSE_SPATIAL_EVIDENCE", "LOWER_KEEP_STANDARD"),
    "CONTROL_SUPPORT_LOST": ("CONTROL_SUPPORT_LOST", "INTERVENTION_DIAGNOSTIC", "EXPAND_ROI_BLINDLY"),
}
GRAY_LOST = ("DROP_SUPPORT_PERSISTS", "LOCALIZE_RESIDUAL_COMPONENT", "CREATE_VERIFIED")
GRAY_KEPT = ("VERIFIER_INSENSITIVITY_UNRESOLVED", "STOP_OR_PREDECLARED_VERIFIER_SWITCH", "UNBOUNDED_R2_R3")


def _finite(value: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _sound() -> Column:
    return F.forall(F.array(*[F.col(m).cast("double") for m in MARGINS]), _finite)


def case_classes(cases: DataFrame) -> DataFrame:
    """case_class, auxiliary, code, allowed, forbidden, n: the cases (one of MARGINS a column) counted by class and by the route that follows from it.

    Cases with a margin that is null or not finite are a class of their own, MARGIN_NOT_FINITE, without a route. Empty tables give no rows.
    """
    made = F.when(_sound(), verdicts.margin_case(F.col("original"), F.col("keep"), F.col("drop"), F.col("control"))).otherwise("MARGIN_NOT_FINITE")
    told = lambda names: F.struct(*[F.lit(x).alias(c) for x, c in zip(names, ("code", "allowed", "forbidden"))])
    persists = F.col("case_class") == "DROP_SUPPORT_PERSISTS"
    route = F.when(persists & (F.col("gray") <= 0), told(GRAY_LOST)).when(persists, told(GRAY_KEPT))
    for name, names in ROUTES.items():
        route = route.when(F.col("case_class") == name, told(names))
    auxiliary = F.when(persists & (F.col("gray") > 0), "DROP_SUPPORT_PERSISTS_WITH_FULL_GRAY_SUPPORT").when(persists, "DROP_SUPPORT_PERSISTS_WITH_VISUAL_SENSITIVITY_RETAINED")
    rows = cases.withColumn("case_class", made).select("case_class", auxiliary.alias("auxiliary"), route.alias("r")).select("case_class", "auxiliary", "r.*")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def delta_statistics(cases: DataFrame, limits: list[float] | None = None) -> DataFrame:
    """delta, n, positive, mean, median, min, max of four differences of margins; cases with a margin that isn't finite are left out.

    The medians are exact: rows get their places part by part of the order, so no task holds all of a difference's values.
    """
    o, d = F.col("original").cast("double"), F.col("drop").cast("double")
    deltas = {"delta_drop": o - d, "delta_full_gray": o - F.col("gray"), "delta_mismatch": o - F.col("mismatch"), "delta_specificity": F.col("control") - d}
    rows = cases.where(_sound()).select(F.explode(F.array(*[F.struct(F.lit(k).alias("delta"), v.cast("double").alias("v")) for k, v in deltas.items()])).alias("r")).select("r.*")
    limits = ranking.bounds(rows, F.col("v"))[0] if limits is None else limits
    figures = rows.groupBy("delta").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > 0).alias("positive"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    places = ranking.placed(rows, ["delta"], F.col("v"), limits)
    middle = places.join(F.broadcast(figures.select(F.col("delta"), "n")), "delta").where((2 * F.col("place")).between(F.col("n"), F.col("n") + 2))  # four rows of figures
    return figures.join(middle.groupBy("delta").agg(F.avg("v").alias("median")), "delta").select("delta", "n", "positive", "mean", "median", "min", "max")


def compare_fingerprints(old: DataFrame, new: DataFrame, core: list[str], environment: list[str]) -> DataFrame:
    """run, core_matches, environment_matches, n_fields, differences: two sides of (run, field, value) held against each other by field.

    A field of one side alone differs, unless its value is null, which is the same as no field. Repeated fields count by their largest value. differences: sorted structs (scope, field, old,
    new), scope CORE, ENVIRONMENT or RUNTIME; the last ones decide nothing. Both sides meet in one union, aggregated once by field and once by run.
    """
    side = lambda rows, name: rows.select("run", "field", F.lit(name).alias("side"), F.col("value").cast("string").alias("value"))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("value")))
    fields = side(old, "old").unionByName(side(new, "new")).groupBy("run", "field").agg(of("old").alias("old"), of("new").alias("new"))
    scope = F.when(F.col("field").isin(*core), "CORE").when(F.col("field").isin(*environment), "ENVIRONMENT").otherwise("RUNTIME")
    same = F.col("old").eqNullSafe(F.col("new"))
    matches = lambda name: F.coalesce(F.bool_and(F.when(F.col("scope") == name, F.col("same"))), F.lit(True))
    rows = fields.select("run", "field", "old", "new", scope.alias("scope"), same.alias("same"))
    differing = F.array_sort(F.collect_list(F.when(~F.col("same"), F.struct("scope", "field", "old", "new"))))
    return rows.groupBy("run").agg(matches("CORE").alias("core_matches"), matches("ENVIRONMENT").alias("environment_matches"), F.count(F.lit(1)).alias("n_fields"), differing.alias("differences"))


def window_alignment(samples: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """key, start_pos, end_pos, window_cells, total_visible, visible, density, recall, temporally_eligible of windows (key, start_pos, end_pos; both ends within) over the cells of samples.

    samples: key, eligible, cells (array of structs start and end, in order), spans (likewise); one row a key. A cell is visible where it has a positive overlap with a
    span. Density: visible cells of the window over its cells; recall: over all visible ones; null where there is nothing to divide by. Null cells or spans count as none; windows of unknown keys have no rows.
    """
    none = F.array().cast("array<boolean>")
    shown = F.transform("cells", lambda c: F.exists(F.coalesce(F.col("spans"), F.array().cast("array<struct<start:double,end:double>>")), lambda s: F.least(c["end"], s["end"]) > F.greatest(c["start"], s["start"])))
    flags = samples.select(key, "eligible", F.coalesce(shown, none).alias("shown"))
    count = lambda flags: F.size(F.filter(flags, lambda f: f))
    rows = windows.join(flags, key)
    inside = F.slice("shown", (F.col("start_pos") + 1).cast("int"), F.greatest(F.col("end_pos") - F.col("start_pos") + 1, F.lit(0)).cast("int"))
    rows = rows.select(key, "start_pos", "end_pos", "eligible", F.size(inside).alias("window_cells"), count(F.col("shown")).alias("total_visible"), count(inside).alias("visible"))
    rows = rows.withColumns({"density": F.try_divide("visible", "window_cells"), "recall": F.try_divide("visible", "total_visible")})
    good = F.coalesce(F.col("eligible"), F.lit(False)) & labels.temporally_eligible(F.col("density"), F.col("recall"), F.col("visible"))
    return rows.withColumn("temporally_eligible", good).drop("eligible")


def mean_similarity(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, similarity: the mean cosine of two arrays of numbers, over rows that have both; 0 where no row has, and for arrays without length.

    Arrays of different lengths, and such with nulls in them, count as missing.
    """
    real = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = real(F.col(a)), real(F.col(b))
    length = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    cosine = F.when((F.size(x) > 0) & (F.size(x) == F.size(y)) & length.isNotNull(), F.coalesce(F.try_divide(dot(x, y), length), F.lit(0.0)))
    return rows.select(*keys, cosine.alias("c")).groupBy(*keys).agg(F.count("c").alias("n"), F.coalesce(F.avg("c"), F.lit(0.0)).alias("similarity"))


def candidate_rows(samples: DataFrame, key: str, size: int, stride: int) -> DataFrame:
    """Sliding windows over the frames of samples as candidates: key, candidate_rank, frame_ids, paths, start, end, coordinates, frame_count, tail_short.

    samples: key, frames (array of structs frame_id, path, at, in order). The extent is by time where all frames of the window have one (public_timestamp), else by the
    positions of the frames (frame_order). Samples without frames have no rows.
    """
    n = samples.select(key, F.coalesce(F.size("frames"), F.lit(0)).alias("n")).where("n > 0")
    windows = timeline.position_windows(n, key, "n", size, stride, drop_last=False)
    rows = windows.join(samples.select(key, "frames"), key)
    inside = F.slice("frames", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos") + 1).cast("int"))
    rows = rows.select(key, "start_pos", inside.alias("f"))
    timed = F.forall("f", lambda x: x["at"].isNotNull())
    first, last = F.get("f", F.lit(0)), F.element_at("f", -1)
    return rows.select(
        key, F.floor(F.col("start_pos") / stride).alias("candidate_rank"), F.col("f.frame_id").alias("frame_ids"), F.col("f.path").alias("paths"),
        F.when(timed, first["at"]).otherwise(F.col("start_pos")).alias("start"), F.when(timed, last["at"]).otherwise(F.col("start_pos") + F.size("f") - 1).alias("end"),
        F.when(timed, "public_timestamp").otherwise("frame_order").alias("coordinates"), F.size("f").alias("frame_count"), (F.size("f") < size).alias("tail_short"),
    )


#: Totals of a diagnosis by the root causes that they count.
TOTALS = {
    "technical_or_protocol_failures": ("TECHNICAL_DIAGNOSTIC", "TECHNICAL_ERROR", "PROTOCOL_UNAVAILABLE"),
    "temporal_or_semantic_failures": ("TEMPORAL_OR_SEMANTIC_INSUFFICIENT",),
    "unresolved_failures": ("UNRESOLVED",),
}


def diagnose(certificates: DataFrame, controls: DataFrame, pixels: DataFrame) -> DataFrame:
    """certificate_id, root_cause, eligible, action, mismatch (struct class, reason), n_results, effect of each certificate of a completed run.

    certificates: certificate_id (one row each), reasons, expected, generated, geometry_refinable. controls: certificate_id, status, one row for each result; a certificate
    counts as unavailable where any of its rows says so. pixels: certificate_id, position, effect; the earliest counts, the smaller one of equals. Events are aggregated before they meet
    the certificates, so one certificate may hold any share of them; events of unknown certificates are left out. Certificates without events have null counts. `mismatch` is null
    unless the reasons tell of one. Null reasons count as none; reasons that no rule knows are UNRESOLVED and not eligible.
    """
    counted = controls.groupBy("certificate_id").agg(F.count(F.lit(1)).alias("n_results"), F.when(F.bool_or(F.col("status") == "CONTROL_UNAVAILABLE"), "CONTROL_UNAVAILABLE").otherwise("OK").alias("status"))
    first = pixels.groupBy("certificate_id").agg(F.min(F.struct("position", "effect"))["effect"].alias("effect"))
    rows = certificates.join(counted, "certificate_id", "left").join(first, "certificate_id", "left")
    rows = rows.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    unresolved = F.struct(F.lit("UNRESOLVED").alias("root_cause"), F.lit(False).alias("eligible"), F.lit("DIAGNOSE_UNRESOLVED_FAILURE").alias("action"))
    route = F.coalesce(verdicts.refinement(F.col("reasons"), F.col("effect"), F.coalesce("geometry_refinable", F.lit(False))), unresolved)
    mismatch = F.when(F.array_contains("reasons", "CONTROL_RESULT_COUNT_MISMATCH"), verdicts.count_mismatch(F.col("expected"), F.col("generated"), F.col("n_results"), F.col("status")))
    return rows.select("certificate_id", route.alias("r"), mismatch.alias("mismatch"), "n_results", "effect").select("certificate_id", "r.*", "mismatch", "n_results", "effect")


def diagnosis_totals(diagnoses: DataFrame) -> DataFrame:
    """kind, name, n: certificates by root cause and by class of mismatch, and the totals of TOTALS, of those that can be refined and of all that are above nothing; one aggregate."""
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    totals = [F.when(F.col("root_cause").isin(*causes), one("total", F.lit(name))) for name, causes in TOTALS.items()]
    kinds = [one("root_cause", F.col("root_cause")), F.when(F.col("mismatch").isNotNull(), one("mismatch", F.col("mismatch.class"))), F.when(F.col("eligible"), one("total", F.lit("spatial_refinable_failures"))), one("total", F.lit("candidates"))]
    return diagnoses.select(F.explode(F.array_compact(F.array(*kinds, *totals))).alias("k")).groupBy("k.kind", "k.name").agg(F.count(F.lit(1)).alias("n"))

"""Verdicts as Columns: the first rule that holds gives the class, the reason or the action."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cases(rules: list[tuple[Column, str | None]], otherwise: str | None = None) -> Column:
    """The value of the first condition that is true."""
    out = F
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def candidate_label(prediction: Column, alignment: Column) -> Column:
    """Label of an answer by how its window is aligned with the truth."""
    yes, no = prediction == "YES", prediction == "NO"
    strong, weak, none = (alignment == x for x in ("STRONG_GT_ALIGNED", "WEAK_GT_ALIGNED", "NO_GT_OVERLAP"))
    return cases(
        [(yes & strong, "TRUE_SUPPORT"), (yes & weak, "WEAK_TRUE_SUPPORT"), (yes & none, "SPURIOUS_SUPPORT"), (no & none, "TRUE_NEGATIVE_CONTROL"),
         (no & strong, "NO_ON_STRONG_GT_ALIGNED"), (no & weak, "NO_ON_WEAK_GT_ALIGNED"), (prediction == "INVALID", "INVALID_RESPONSE"), (prediction == "ERROR", "ERROR")],
        "OTHER",
    )


def short_label(label: Column) -> Column:
    """The second vocabulary of labels in terms of the first."""
    return F.when(label == "NO_ON_STRONG_GT_ALIGNED", "NO_STRONG_GT").when(label == "NO_ON_WEAK_GT_ALIGNED", "NO_WEAK_GT").otherwise(label)


def validity(label: Column, visible: Column, alignment: Column) -> Column:
    """strict_valid, any_gt_valid, validity_reason of a changed window; null for labels other than the two."""
    true, strong = label == "TRUE_SUPPORT", alignment == "STRONG_GT_ALIGNED"
    clean = (visible == 0) & (alignment == "NO_GT_OVERLAP")
    for_true = F.struct(strong.alias("strict_valid"), (visible > 0).alias("any_gt_valid"), cases([(strong, "STRICT_VALID_STRONG_GT_ALIGNED"), (visible > 0, "WEAKENED_GT_SUPPORT")], "GT_EVIDENCE_REMOVED").alias("validity_reason"))
    for_spurious = F.struct(clean.alias("strict_valid"), clean.alias("any_gt_valid"), cases([(clean, "STRICT_VALID_NO_GT_OVERLAP")], "GT_CONTAMINATED").alias("validity_reason"))
    return F.when(true, for_true).when(label == "SPURIOUS_SUPPORT", for_spurious)


def in_denominator(valid: Column, label: Column, strict_valid: Column, any_valid: Column, strict: bool) -> Column:
    """Whether a row counts: valid ones, by the strict flag, or for true support by the looser one."""
    chosen = strict_valid if strict else F.when(label == "TRUE_SUPPORT", any_valid).when(label == "SPURIOUS_SUPPORT", strict_valid)
    return F.coalesce(valid, F.lit(False)) & F.coalesce(chosen, F.lit(False))


def spatial_class(eligible: Column, score: Column, threshold: float) -> Column:
    """A score of exactly nothing is spurious, a missing one wasn't evaluated."""
    return cases([(~F.coalesce(eligible, F.lit(False)), "NOT_TEMPORALLY_ELIGIBLE"), (score.isNull(), "NO_SPATIAL_GT_EVALUATED"), (score >= threshold, "TRUE_SPATIAL_SUPPORT"), (score == 0, "SPURIOUS_SPATIAL_SUPPORT")], "WEAK_SPATIAL_SUPPORT")


def spatial_label(eligible: Column, score: Column, threshold: float) -> Column:
    return cases([(~F.coalesce(eligible, F.lit(False)), "EXCLUDED_NOT_TEMPORALLY_ELIGIBLE"), (score.isNull(), "EXCLUDED_NO_SPATIAL_SCORE"), (score >= threshold, "ALIGNED_SPATIAL_SUPPORT"), (score > 0, "MISALIGNED_SPATIAL_SUPPORT")], "ZERO_OVERLAP_SPATIAL_SUPPORT")


def margin_case(original: Column, keep: Column, drop: Column, control: Column) -> Column:
    return cases([(original <= 0, "ORIGINAL_LIKELIHOOD_INSUFFICIENT"), (keep <= 0, "KEEP_PRESERVATION_FAILURE"), (drop > 0, "DROP_SUPPORT_PERSISTS"), (control <= 0, "CONTROL_SUPPORT_LOST")], "FULL_LOCAL_DEPENDENCE_PATTERN")


def margin_explanation(original: Column, drop: Column, control: Column, gray: Column, mismatch: Column, generated: Column) -> Column:
    same = (original == drop) & (drop == gray) & (gray == mismatch)
    return cases([(same, "VISUAL_INPUT_INSENSITIVITY"), ((generated == "SUPPORTED") & (original != drop), "MARGIN_SENSITIVE_LABEL_INVARIANT"), (control <= drop, "INTERVENTION_NONSPECIFIC"), (gray > drop, "AUTOMATIC_LOCALIZATION_FAILURE")], "UNRESOLVED")


def count_mismatch(expected: Column, generated: Column, results: Column, status: Column) -> Column:
    """class and reason for counts of controls that differ."""
    gone = F.coalesce(status == "CONTROL_UNAVAILABLE", F.lit(False))
    missing = expected.isNull() | generated.isNull() | results.isNull()
    fewer = gone & (generated < expected) & (results == generated)
    lacking = (generated == expected) & (results != generated)
    odd = (generated != expected) & ~gone
    rules = [(missing, "C_UNRESOLVED", "MISSING_CONTROL_ARTIFACT_OR_COUNT"), (fewer, "B_LEGITIMATE_PROTOCOL_UNAVAILABLE", "GEOMETRY_GENERATED_FEWER_THAN_FROZEN_REQUIRED_CONTROLS"),
             (lacking, "A_IMPLEMENTATION_OR_ARTIFACT_BUG", "GENERATED_CONTROLS_LACK_MATCHING_INFERENCE_RESULTS"), (odd, "A_IMPLEMENTATION_OR_ARTIFACT_BUG", "CONTROL_ARTIFACT_AVAILABILITY_INCONSISTENT_WITH_COUNTS")]
    return F.struct(cases([(c, k) for c, k, _ in rules], "C_UNRESOLVED").alias("class"), cases([(c, r) for c, _, r in rules], "CONTROL_COUNTS_DO_NOT_IDENTIFY_A_SINGLE_CAUSE").alias("reason"))


def refinement(reasons: Column, no_effect: Column, geometry_refinable: Column) -> Column:
    """root_cause, eligible, action by the reasons of a failure, the graver ones first."""
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    untouched, within = has("INTERVENTION_NO_EFFECT"), lambda *names: F.coalesce(no_effect.isin(*names), F.lit(False))
    unavailable = has("CONTROL_UNAVAILABLE")
    rules = [
        (has("CONTROL_RESULT_COUNT_MISMATCH"), "TECHNICAL_DIAGNOSTIC", False, "TECHNICAL_DIAGNOSTIC_RESOLVE_CONTROL_COUNT_MISMATCH"),
        (has("TECHNICAL_FAILURE", "SPATIAL_PROPOSAL_FAILURE", "INTERVENTION_PIXEL_AUDIT_FAILED", "SPATIAL_REFERENCE_BINDING_MISMATCH"), "TECHNICAL_ERROR", False, "TECHNICAL_DIAGNOSTIC"),
        (has("ORIGINAL_INSUFFICIENT", "ORIGINAL_NOT_SUPPORTED"), "TEMPORAL_OR_SEMANTIC_INSUFFICIENT", False, "TEMPORAL_REACQUIRE"),
        (untouched & within("CLIPPED_TO_ZERO_AREA", "FULL_FRAME_OR_NO_COMPLEMENT_ROI", "UNIFORM_REGION"), "SPATIAL_PROPOSAL_OR_ROI_FAILURE", True, "SPATIAL_REFINE"),
        (untouched & within("ARTIFACT_NOT_APPLIED", "OPERATOR_OR_AUDIT_BUG"), "TECHNICAL_ERROR", False, "TECHNICAL_DIAGNOSTIC"),
        (untouched, "UNRESOLVED", False, "DIAGNOSE_INTERVENTION_NO_EFFECT"),
        (unavailable & geometry_refinable, "SPATIAL_PROPOSAL_GEOMETRY", True, "SPATIAL_REFINE"),
        (unavailable, "PROTOCOL_UNAVAILABLE", False, "DIAGNOSE_CONTROL_GEOMETRY"),
        (has("DEPENDENCE_UNRESOLVED", "KEEP_SUPPORT_LOST", "CONTROL_SUPPORT_LOST", "NONSPECIFIC_INTERVENTION_RESPONSE"), "SPATIAL_DEPENDENCE_OR_SUFFICIENCY", True, "SPATIAL_REFINE"),
    ]
    out = F
    for c, root, eligible, action in rules:
        out = out.when(c, F.struct(F.lit(root).alias("root_cause"), F.lit(eligible).alias("eligible"), F.lit(action).alias("action")))
    return out


def next_action(status: Column, enabled: Column, support_lost: Column, can_expand: Column, can_alternate: Column, can_next: Column) -> Column:
    """What to do after a certificate; the last flags say that an action is both allowed and possible."""
    return cases(
        [(status == "VERIFIED", "STOP:CLAIM_VERIFIED"), ((status == "REJECTED") & can_next, "NEXT_CANDIDATE:PAIR_REJECTED_TRY_NEXT_CANDIDATE"), (status == "REJECTED", "STOP:CANDIDATES_EXHAUSTED_AFTER_PAIR_REJECTION"),
         (~enabled, "STOP:ADAPTATION_DISABLED"), (support_lost & can_alternate, "TRY_ALTERNATE_SUPPORT_REGION:SYNTHETIC_PRECONFIGURED_REGION"), (support_lost, "STOP:RE_GROUNDING_NOT_IMPLEMENTED"),
         (can_expand, "EXPAND_TEMPORAL_CONTEXT:FIXED_NEIGHBOR_CONTEXT"), (can_next, "NEXT_CANDIDATE:ACQUISITION_ORDER")],
        "STOP:CANDIDATES_EXHAUSTED",
    )


#: Label of a review, status, usable as a box, route.
ADJUDICATIONS = [
    ("ACCEPTED", "VALID_VISIBLE_LOCALIZATION", True, "SPATIAL_COMPONENT_VALID"),
    ("BOX_TOO_BROAD", "INVALID_GEOMETRY", False, "RELOCALIZE_REQUIRED"),
    ("BOX_TOO_TIGHT", "INVALID_GEOMETRY", False, "RELOCALIZE_REQUIRED"),
    ("WRONG_OBJECT", "INVALID_OBJECT", False, "RELOCALIZE_REQUIRED"),
    ("INTERFACE_NOT_LOCALIZED", "INVALID_INTERFACE", False, "RELATIONAL_RELOCALIZATION_REQUIRED"),
    ("SHOULD_BE_NOT_VISIBLE", "VISIBILITY_FALSE_POSITIVE", False, "REACQUIRE_REQUIRED"),
    ("NOT_VISIBLE_CONFIRMED", "VALID_NONVISIBLE", False, "NOT_VISIBLE_CONFIRMED"),
    ("AMBIGUOUS_CONFIRMED", "VALID_AMBIGUOUS", False, "AMBIGUOUS_CONFIRMED"),
    ("UNRESOLVED", "UNRESOLVED", False, "ABSTAIN"),
]

"""Contrasts, anchors, transitions, strict answers and refinement routes as Columns: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .verdicts import cases

# Roles, dimensions of a budget, versions of prompts.
TEMPORAL_ROLES = ("BASE_REMAINS_ALIGNED_OR_ATTACHED_AFTER_INTERACTION", "OPERATOR_HAND_NOT_REQUIRED_INSIDE_TARGET_REGION")
RELATIONAL_ROLES = ("PRECONDITION_ALIGNMENT", "POSTCONDITION_ATTACHMENT")
#: failure: action, dimension of the budget that the action consumes.
TRANSITIONS = {
    "ORIGINAL_INSUFFICIENT": ("TEMPORAL_REACQUIRE", "temporal_jumps"),
    "TEMPORAL_ORDER_UNRESOLVED": ("TEMPORAL_EXPAND_CONTEXT", "boundary_refinements"),
    "KEEP_SUPPORT_LOST": ("SPATIAL_RECOMPOSE", "spatial_regrounds"),
    "DROP_SUPPORT_PERSISTS": ("RESIDUAL_LOCALIZE", "residual_components"),
    "DROP_SUPPORT_PERSISTS_WITH_FULL_GRAY_SUPPORT": ("VERIFIER_SWITCH", "verifier_switches"),
    "CONTROL_UNAVAILABLE": ("SPATIAL_RECOMPOSE_CONTROL_GEOMETRY", "spatial_regrounds"),
    "CONTROL_SUPPORT_LOST": ("INTERVENTION_DIAGNOSTIC", None),
    "HYPOTHESES_NOT_DISCRIMINATED": ("TEMPORAL_DISCRIMINATIVE_RETRIEVAL", "temporal_jumps"),
    "TECHNICAL_EXECUTION_FAILURE": ("TECHNICAL_DIAGNOSTIC", None),
}
PROMPT = "relive-spatial-refine-{0}-v{1}"


def contrast(results: Column, exclusivity: Column, target: Column, strict: Column) -> Column:
    """pass, status, reasons, supported, unique_supported, alternatives_contradicted of a group of claims.

    `results` is array<struct<claim, execution, semantic>> in the group's order; a null execution is a missing result. A group needs two distinct
    claims or more and the target among them; an exclusive one passes if the target alone is supported and, where `strict`, all others are contradicted.
    """
    ok = lambda x: F.coalesce(x["execution"] == "OK", F.lit(False))
    said = lambda x, what: ok(x) & F.coalesce(x["semantic"] == what, F.lit(False))
    claims = F.transform(results, lambda x: x["claim"])
    valid = (F.size(claims) >= 2) & (F.size(F.array_distinct(claims)) == F.size(claims)) & F.coalesce(F.array_contains(claims, target), F.lit(False))
    complete = F.forall(results, ok)
    supported = F.transform(F.filter(results, lambda x: said(x, "SUPPORTED")), lambda x: x["claim"])
    others = F.filter(results, lambda x: x["claim"] != target)
    contradicted = (F.size(others) > 0) & F.forall(others, lambda x: said(x, "CONTRADICTED"))
    on_target = F.coalesce(F.array_contains(supported, target), F.lit(False))
    exclusive, open_, both = (F.coalesce(exclusivity == x, F.lit(False)) for x in ("DECLARED_EXCLUSIVE", "UNRESOLVED", "NONEXCLUSIVE"))
    unique = complete & (F.size(supported) == 1)
    passed = F.when(both, valid & complete & on_target).when(exclusive, valid & complete & on_target & unique & (contradicted | ~strict)).otherwise(F.lit(False))
    status = F.when(both, F.when(passed, "NONEXCLUSIVE_TARGET_SUPPORTED").otherwise("NONEXCLUSIVE_TARGET_UNRESOLVED")).when(exclusive, F.when(passed, "EXCLUSIVE_CONTRAST_PASS").otherwise("EXCLUSIVE_CONTRAST_UNRESOLVED")).otherwise("CONTRAST_UNRESOLVED")
    reasons = [
        (~valid, "INVALID_CONTRAST_GROUP"), (~complete, "CONTRAST_TECHNICAL_FAILURE_OR_MISSING_RESULT"), (open_, "EXCLUSIVITY_UNRESOLVED"),
        (exclusive & (F.size(supported) == 0), "NO_SUPPORTED_CLAIM"), (exclusive & (F.size(supported) > 1), "MULTIPLE_EXCLUSIVE_CLAIMS_SUPPORTED"),
        (exclusive & ~on_target, "TARGET_NOT_SUPPORTED"), (exclusive & strict & ~contradicted, "ALTERNATIVES_NOT_CONTRADICTED"), (~(exclusive | open_ | both), "INVALID_EXCLUSIVITY_STATUS"),
    ]
    return F.struct(passed.alias("pass"), status.alias("status"), F.array_compact(F.array(*[F.when(c, n) for c, n in reasons])).alias("reasons"), supported.alias("supported"), unique.alias("unique_supported"), contradicted.alias("alternatives_contradicted"))


def anchor_status(components: Column, required: Column) -> Column:
    """Status of an anchor by the review labels of its required components; components is array<struct<role, label>>."""
    own = F.filter(components, lambda c: F.array_contains(required, c["role"]))
    labels = F.array_distinct(F.transform(own, lambda c: c["label"]))
    any_of = lambda *names: F.arrays_overlap(labels, F.array(*map(F.lit, names)))
    return cases(
        [(labels == F.array(F.lit("ACCEPTED")), "SPATIAL_COMPONENTS_VALID"), (F.exists(own, lambda c: (c["label"] == "INTERFACE_NOT_LOCALIZED") & F.contains(c["role"], F.lit("INTERFACE"))), "RELATIONAL_RELOCALIZATION_REQUIRED"),
         (any_of("BOX_TOO_BROAD", "BOX_TOO_TIGHT", "WRONG_OBJECT"), "RELOCALIZE_REQUIRED"), (any_of("SHOULD_BE_NOT_VISIBLE", "NOT_VISIBLE_CONFIRMED", "AMBIGUOUS_CONFIRMED"), "REACQUIRE_REQUIRED")],
        "UNRESOLVED_REQUIRED_COMPONENT",
    )


def anchor_route(status: Column, observation: Column, components: Column, required: Column) -> Column:
    """route, flags: time before relations before space."""
    waiting = F.exists(components, lambda c: c["role"].isin(*TEMPORAL_ROLES) & (c["label"] == "UNRESOLVED"))
    relational = F.coalesce(observation.isin(*RELATIONAL_ROLES), F.lit(False))
    route = F.when(waiting, "TEMPORAL_REACQUIRE").when(relational, "RELATIONAL_COMPOSITE_REQUIRED").when(status == "SPATIAL_COMPONENTS_VALID", "ELIGIBLE_SPATIAL_ANCHOR").when(status == "UNRESOLVED_REQUIRED_COMPONENT", "ABSTAIN").otherwise(status)
    flat = relational | F.exists(required, lambda r: F.contains(r, F.lit("INTERFACE")))
    return F.struct(route.alias("route"), F.when(flat, F.array(F.lit("APPARENT_2D_ONLY"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def transition(outcome: Column, failure: Column, allowed: Column, switch_enabled: Column, budget: Column) -> Column:
    """action, reason, consumed, termination of a diagnosis under a policy and a budget (map of dimension to what is left).

    A switch that wasn't declared, an action that the policy doesn't allow and a spent budget stop. A failure that no rule routes is an error.
    """
    table = F.create_map(*[F.lit(x) for k, (a, _) in TRANSITIONS.items() for x in (k, a)])
    uses = F.create_map(*[F.lit(x) for a, d in sorted({(a, d) for a, d in TRANSITIONS.values() if d}) for x in (a, d)])
    routed = F.coalesce(F.try_element_at(table, failure), F.raise_error(F.lit("UNROUTABLE_DIAGNOSIS")).cast("string"))
    action = F.when(outcome == "DIAGNOSTIC_COMPLETE", "STOP_DIAGNOSTIC").when(outcome == "TECHNICAL_FAILURE", "TECHNICAL_DIAGNOSTIC").otherwise(routed)
    reason = F.when(outcome.isin("DIAGNOSTIC_COMPLETE", "TECHNICAL_FAILURE"), outcome).otherwise(failure)
    dimension = F.try_element_at(uses, action)
    spent = F.coalesce(F.try_element_at(budget, dimension) == 0, F.lit(False))
    stop = F.when((action == "VERIFIER_SWITCH") & ~switch_enabled, "VERIFIER_SWITCH_NOT_PREDECLARED").when(~F.array_contains(allowed, action), "POLICY_ACTION_NOT_ALLOWED").when(spent, F.concat(F.lit("BUDGET_"), F.upper(dimension), F.lit("_EXHAUSTED")))
    return F.struct(F.when(stop.isNull(), action).otherwise("STOP_ABSTAIN").alias("action"), reason.alias("reason"), F.when(stop.isNull(), dimension).alias("consumed"), stop.alias("termination"))


def strict_answer(required: Column, verified: Column, complete: Column, aggregated: Column, verification: Column) -> Column:
    """status, answer, judgment, claims: an answer only of verified claims, all that are required, in their order.

    `required` is array<struct<claim, text>>, `verified` array of claims that are supported and certified, `aggregated` what the target's claims come to.
    """
    covered = complete & F.forall(required, lambda c: F.array_contains(verified, c["claim"]))
    text = F.when(verification, "SUPPORTED").otherwise(F.array_join(F.transform(required, lambda c: c["text"]), " "))
    claims = F.transform(required, lambda c: c["claim"])
    judged = F.when(covered, "VERIFIED").when(aggregated == "CONTRADICTED", "CONTRADICTED").otherwise("UNCERTAIN")
    return F.struct(F.when(covered, "ANSWERED").otherwise("ABSTAIN").alias("status"), F.when(covered, text).alias("answer"), judged.alias("judgment"), F.when(covered, claims).otherwise(F.slice(claims, 1, 0)).alias("claims"))


def refinement_route(reasons: Column, mismatch: Column, root: Column, effect: Column, version: int = 1) -> Column:
    """allowed, routing_reason, action, stage, prompt_version of a diagnosed failure; version 2 has its own stages and prompts."""
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    is_ = lambda c, *names: F.coalesce(c.isin(*names), F.lit(False))
    counts = has("CONTROL_RESULT_COUNT_MISMATCH")
    rules = [
        (counts & is_(mismatch, "B_LEGITIMATE_PROTOCOL_UNAVAILABLE"), "CONTROL_GEOMETRY_UNAVAILABLE", "SPATIAL_REFINE_OVERBROAD_ROI", "control_geometry"),
        (counts, "UNRESOLVED_CONTROL_RESULT_COUNT_MISMATCH", "SPATIAL_UNRESOLVED", None),
        (has("ORIGINAL_INSUFFICIENT") | is_(root, "TEMPORAL_OR_SEMANTIC_INSUFFICIENT"), "ORIGINAL_INSUFFICIENT", "TEMPORAL_REACQUIRE", None),
        (has("TECHNICAL_FAILURE") | is_(root, "TECHNICAL_ERROR"), "TECHNICAL_DIAGNOSTIC", "SPATIAL_UNRESOLVED", None),
        (is_(root, "SPATIAL_PROPOSAL_OR_ROI_FAILURE") & is_(effect, "CLIPPED_TO_ZERO_AREA", "FULL_FRAME_OR_NO_COMPLEMENT_ROI", "UNIFORM_REGION"), "OVERBROAD_OR_DEGENERATE_ROI", "SPATIAL_REFINE_VISUALLY_GROUNDED_ROI", "intervention_effect"),
        (has("DEPENDENCE_UNRESOLVED"), "DEPENDENCE_UNRESOLVED", "SPATIAL_REFINE_RESIDUAL_SUPPORT", "dependence"),
        (has("KEEP_SUPPORT_LOST", "CONTROL_SUPPORT_LOST", "NONSPECIFIC_INTERVENTION_RESPONSE"), "SUFFICIENCY_UNRESOLVED", "SPATIAL_REFINE_CLAIM_SUFFICIENCY", "sufficiency"),
        (F.lit(True), "UNRESOLVED_FAILURE_MODE", "SPATIAL_UNRESOLVED", None),
    ]
    out = F
    for condition, reason, action, stage in rules:
        name = f"spatial_refine_{stage}" + "_v2" * (version == 2) if stage else None
        prompt = PROMPT.format(stage.replace("_", "-"), version) if stage else None
        values = {"allowed": F.lit(stage is not None), "routing_reason": F.lit(reason), "action": F.lit(action), "stage": F.lit(name).cast("string"), "prompt_version": F.lit(prompt).cast("string")}
        out = out.when(condition, F.struct(*[v.alias(k) for k, v in values.items()]))
    return out

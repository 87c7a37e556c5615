"""Column expressions over time intervals. An interval is a pair of columns: start, end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_length(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def iou_hull(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap over the hull of both intervals; 0 where the hull has no length."""
    hull = F.greatest(a2, b2) - F.least(a1, b1)
    return F.when(hull > 0, overlap_length(a1, a2, b1, b2) / hull).otherwise(0.0)


def iou_ordered(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of intervals whose ends may be swapped, over the lesser of hull and summed lengths, plus 1e-8."""
    lo_a, hi_a, lo_b, hi_b = F.least(a1, a2), F.greatest(a1, a2), F.least(b1, b2), F.greatest(b1, b2)
    union = F.least(F.greatest(hi_a, hi_b) - F.least(lo_a, lo_b), hi_a - lo_a + hi_b - lo_b)
    return overlap_length(lo_a, hi_a, lo_b, hi_b) / (union + F.lit(1e-8))


def iou_union(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap over summed lengths less the overlap; 0 where that is not positive."""
    both = overlap_length(a1, a2, b1, b2)
    union = (a2 - a1) + (b2 - b1) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def touches(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether closed intervals share a point."""
    return F.greatest(a1, b1) <= F.least(a2, b2)


def within(t: Column, times: Column, eps: float = 1e-6) -> Column:
    """Whether a time lies within the extent of an array of times, give or take eps."""
    return t.between(F.array_min(times) - eps, F.array_max(times) + eps)


def clip_span(start: Column, end: Column, duration: Column, tolerance: Column) -> Column:
    """Struct (start, end, reason) of a span against a clip [0, duration]; start and end null where the span is left out.

    Reasons: GT_END_BEFORE_START, OUTSIDE_CLIP_NEAR_BOUNDARY, GT_OUT_OF_RANGE, PARTIAL_BOUNDARY_CLIPPED, or null.
    """
    left, right = end < 0, start > duration
    distance = F.when(left, F.abs(end)).otherwise(start - duration)
    overflow = F.greatest(F.lit(0.0), -start, end - duration)
    partial = (start < 0) | (end > duration)
    reason = (
        F.when(end < start, F.lit("GT_END_BEFORE_START"))
        .when((left | right) & (distance <= tolerance), F.lit("OUTSIDE_CLIP_NEAR_BOUNDARY"))
        .when(left | right | (overflow > tolerance), F.lit("GT_OUT_OF_RANGE"))
        .when(partial, F.lit("PARTIAL_BOUNDARY_CLIPPED"))
    )
    kept = reason.isNull() | (reason == "PARTIAL_BOUNDARY_CLIPPED")
    return F.struct(F.when(kept, F.greatest(start, F.lit(0.0))).alias("start"), F.when(kept, F.least(end, duration)).alias("end"), reason.alias("reason"))


def clip_status(clipped: Column) -> Column:
    """Status of a record from the array of its clipped spans."""
    has = lambda r: F.exists(clipped, lambda s: s["reason"] == r)
    return (
        F.when(has("GT_END_BEFORE_START"), F.lit("GT_INVALID"))
        .when(has("GT_OUT_OF_RANGE"), F.lit("GT_OUT_OF_RANGE"))
        .when(F.exists(clipped, lambda s: s["start"].isNotNull()), F.lit("OK"))
        .otherwise("GT_NEAR_BOUNDARY_NOT_VISIBLE")
    )


def tolerance(fps: Column) -> Column:
    return F.greatest(F.lit(1.0), F.lit(1.0) / fps)


def endpoint_times(n: Column, duration: Column) -> Column:
    """Array of n times from 0 to duration, evenly spaced."""
    return F.when(n <= 1, F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * duration / (n - 1)))

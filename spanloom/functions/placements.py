"""Ordered placements of a box as Column expressions, and which of them are taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import intersection_area, side

#: States of a placement: fixed values.
SATISFIED, OUTSIDE, ON_TARGET, ON_PREVIOUS, TAKEN = "NOT_EVALUATED_AFTER_REQUEST_SATISFIED", "OUT_OF_BOUNDS", "OVERLAPS_TARGET", "OVERLAPS_PREVIOUS_CONTROL", "SELECTED"


def placements(box: Column) -> Column:
    """Twelve boxes of the size of `box` in the unit square: corners, middles of edges (top, bottom, left, right), and beside the box (left, right, above, below)."""
    x, y = side(box, 0), side(box, 1)
    w, h = side(box, 2) - x, side(box, 3) - y
    zero, right, low = F.lit(0.0), 1.0 - w, 1.0 - h
    corners = [(zero, zero), (right, zero), (zero, low), (right, low), (right / 2, zero), (right / 2, low), (zero, low / 2), (right, low / 2)]
    beside = [(x - w, y), (side(box, 2), y), (x, y - h), (x, side(box, 3))]
    return F.array(*[F.array(a, b, a + w, b + h) for a, b in corners + beside])


def chosen(box: Column, places: Column, count: int) -> Column:
    """regions, states: the first `count` of `places` that lie in the unit square and meet neither `box` nor an earlier one, and what became of each place.

    One pass that carries what is chosen so far. A null box gives null.
    """
    empty = F.struct(F.array().cast("array<array<double>>").alias("regions"), F.array().cast("array<string>").alias("states"))

    def step(acc: Column, p: Column) -> Column:
        inside = (side(p, 0) >= 0) & (side(p, 0) < side(p, 2)) & (side(p, 2) <= 1) & (side(p, 1) >= 0) & (side(p, 1) < side(p, 3)) & (side(p, 3) <= 1)
        state = (
            F.when(F.size(acc["regions"]) >= count, SATISFIED).when(~inside, OUTSIDE).when(intersection_area(box, p) > 0, ON_TARGET)
            .when(F.exists(acc["regions"], lambda q: intersection_area(q, p) > 0), ON_PREVIOUS).otherwise(TAKEN)
        )
        return F.struct(F.when(state == TAKEN, F.array_append(acc["regions"], p)).otherwise(acc["regions"]).alias("regions"), F.array_append(acc["states"], state).alias("states"))

    return F.when(box.isNotNull(), F.aggregate(places, empty, step))


def availability(regions: Column, count: int) -> Column:
    return F.when(F.size(regions) == count, "CONTROL_AVAILABLE").otherwise("CONTROL_UNAVAILABLE")

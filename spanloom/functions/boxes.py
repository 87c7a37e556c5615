"""Column expressions over boxes: arrays [x1, y1, x2, y2]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def side(box: Column, k: int) -> Column:
    return F.get(box, F.lit(k))


def area(box: Column) -> Column:
    return (side(box, 2) - side(box, 0)) * (side(box, 3) - side(box, 1))


def clamped_area(box: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, side(box, 2) - side(box, 0)) * F.greatest(zero, side(box, 3) - side(box, 1))


def intersection_area(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.least(side(a, 2), side(b, 2)) - F.greatest(side(a, 0), side(b, 0))
    h = F.least(side(a, 3), side(b, 3)) - F.greatest(side(a, 1), side(b, 1))
    return F.greatest(zero, w) * F.greatest(zero, h)


def iou_floor(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """Intersection over union, the union at least `floor`."""
    both = intersection_area(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(floor))


def iou_clamped(a: Column, b: Column) -> Column:
    """Intersection over union of areas that are never negative; 0 where the union is."""
    both = intersection_area(a, b)
    union = clamped_area(a) + clamped_area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def is_box(box: Column) -> Column:
    return F.coalesce((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()), F.lit(False))


def is_strict_box(box: Column, normalized: bool) -> Column:
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= 0) & (F.lit(not normalized) | (x <= 1)))
    return F.coalesce(is_box(box) & finite & (side(box, 2) > side(box, 0)) & (side(box, 3) > side(box, 1)), F.lit(False))


def area_fraction_1000(box: Column) -> Column:
    return clamped_area(box) / F.lit(1_000_000.0)


def to_pixels(box: Column, width: Column, height: Column, scale: float = 1000.0, clamp: bool = True) -> Column:
    """Boxes in units of 1/scale to pixels: minima floored, maxima ceiled; with `clamp` within the image."""
    x = [F.floor(side(box, 0) / scale * width), F.floor(side(box, 1) / scale * height), F.ceil(side(box, 2) / scale * width), F.ceil(side(box, 3) / scale * height)]
    if clamp:
        x = [F.greatest(F.lit(0), F.least(v, limit)) for v, limit in zip(x, (width, height, width, height))]
    return F.array(*[v.cast("long") for v in x])


def to_unit(box: Column) -> Column:
    return F.transform(box, lambda x: x / F.lit(1000.0))


def to_1000(box: Column) -> Column:
    return F.array(F.floor(side(box, 0) * 1000), F.floor(side(box, 1) * 1000), F.ceil(side(box, 2) * 1000), F.ceil(side(box, 3) * 1000))


def corner_control(box: Column) -> Column:
    """Of the four corner boxes of the same extent, within the unit square, the one with the least overlap; ties go to the first."""
    w, h = side(box, 2) - side(box, 0), side(box, 3) - side(box, 1)
    zero, one = F.lit(0.0), F.lit(1.0)
    corners = [F.array(zero, zero, w, h), F.array(one - w, zero, one, h), F.array(zero, one - h, w, one), F.array(one - w, one - h, one, one)]
    return F.array_min(F.array(*[F.struct(iou_clamped(box, c).alias("iou"), F.lit(k).alias("corner"), c.alias("box")) for k, c in enumerate(corners)]))

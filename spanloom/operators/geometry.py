"""Areas of unions of boxes, and audits of pairs of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import boxes


def union_area(rows: DataFrame, keys: list[str], box: str) -> DataFrame:
    """keys, area: the exact area of the union of the boxes of each key.

    The left and right edges of a key's boxes part the plane into strips; in each strip the boxes' heights are merged in one sorted
    pass. Boxes without area, and null ones, add nothing; a key that has only such has area 0.
    """
    sized = rows.select(*keys, *[boxes.side(F.col(box), k).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])
    solid = sized.where("x2 > x1 AND y2 > y1").distinct()
    edges = solid.select(*keys, F.explode(F.array("x1", "x2")).alias("a")).distinct()
    strips = edges.withColumn("b", F.lead("a").over(Window.partitionBy(*keys).orderBy("a"))).where("b IS NOT NULL")
    inside = strips.join(solid, keys).where("x1 <= a AND x2 >= b")
    before = Window.partitionBy(*keys, "a", "b").orderBy("y1", "y2").rowsBetween(Window.unboundedPreceding, -1)
    high = F.coalesce(F.max("y2").over(before), F.col("y1"))
    added = inside.select(*keys, (F.greatest(F.lit(0.0), F.col("y2") - F.greatest(F.col("y1"), high)) * (F.col("b") - F.col("a"))).alias("part"))
    area = added.groupBy(*keys).agg(F.sum("part").alias("area"))
    return rows.select(*keys).distinct().join(area, keys, "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def residual_audit(first: Column, residual: Column, width: Column, height: Column) -> Column:
    """Overlap of two boxes in the unit square, exactly and in pixels: intersection, iou, residual_area, pixel_overlap, valid, invalid_code.

    A residual box is valid if it shares no pixel with the first; pixels begin at the floor and end at the ceiling of an edge.
    """
    both = boxes.intersection_area(first, residual)
    union = boxes.area(first) + boxes.area(residual) - both
    p, q = (boxes.to_pixels(b, width, height, 1.0, clamp=False) for b in (first, residual))
    shared = boxes.intersection_area(p, q).cast("long")
    code = F.when(shared != 0, "RESIDUAL_PROPOSAL_INVALID_MASK_OVERLAP")
    return F.struct(both.alias("intersection"), F.when(union != 0, both / union).otherwise(0.0).alias("iou"), boxes.area(residual).alias("residual_area"), shared.alias("pixel_overlap"), (shared == 0).alias("valid"), code.alias("invalid_code"))

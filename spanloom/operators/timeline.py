"""Timelines: cells around points, windows, overlaps taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import picks
from spanloom.operators.joins import nearest


def cells(points: DataFrame, key: str, at: str, last: str) -> DataFrame:
    """Points (key, at, last) with cell_start, cell_end: halfway to the neighbours, 0 and `last` at the ends."""
    w = Window.partitionBy(key).orderBy(at)
    before, after = F.lag(at).over(w), F.lead(at).over(w)
    return points.withColumn("cell_start", F.when(before.isNull(), F.lit(0.0)).otherwise((before + F.col(at)) / 2)).withColumn("cell_end", F.when(after.isNull(), F.col(last)).otherwise((F.col(at) + after) / 2))


def position_windows(rows: DataFrame, key: str, n: str, size: int, stride: int, drop_last: bool = True) -> DataFrame:
    """key, start_pos, end_pos: windows over the n positions of each key."""
    out = rows.select(key, n, F.explode(picks.window_starts(F.col(n), size, stride, drop_last)).alias("start_pos"))
    return out.select(key, "start_pos", F.least(F.col("start_pos") + size - 1, F.col(n) - 1).alias("end_pos"))


def pyramid_windows(rows: DataFrame, key: str, last: str, scales: list[float]) -> DataFrame:
    """key, role, scale, start, end: windows of several scales over [0, last], and the whole."""
    parts = rows.select(key, F.explode(picks.pyramid(F.col(last), scales)).alias("w")).select(key, F.lit("PYRAMID").alias("role"), "w.*")
    whole = rows.select(key, F.lit("FULL_CLIP").alias("role"), F.col(last).alias("scale"), F.lit(0.0).alias("start"), F.col(last).alias("end"))
    return parts.unionByName(whole)


def flattened(segments: DataFrame, key: str) -> DataFrame:
    """key, start, end, caption: elementary intervals of overlapping segments (key, ordinal, start, end, caption), each with the longest one over it, the first among equals."""
    points = segments.select(key, F.explode(F.array("start", "end")).alias("t")).distinct()
    parts = points.select(key, F.col("t").alias("a"), F.lead("t").over(Window.partitionBy(key).orderBy("t")).alias("b")).where("b IS NOT NULL")
    hit = parts.join(segments, key).where((F.col("start") < F.col("b")) & (F.col("end") > F.col("a")))
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("len"), (-F.col("ordinal")).alias("o"), F.col("caption").alias("caption")))
    return hit.groupBy(key, "a", "b").agg(best.alias("x")).select(key, F.col("a").alias("start"), F.col("b").alias("end"), F.col("x.caption").alias("caption"))


def aligned(frames: DataFrame, schedules: DataFrame, key: str, at: str, index: str, limits: list[float] | None = None) -> DataFrame:
    """key, target, index, at, error, status: for each target of a schedule (key, start, end, step) the nearest frame (key, at, index) and how far off it is.

    Targets are start, start + step, ... up to end. A schedule that leaves the frames' time by more than a millionth has one row with the status
    OUTSIDE_RANGE, one without frames NO_FRAMES, a step that isn't positive or an end before the start BAD_SCHEDULE; neither has targets.
    """
    range_ = frames.groupBy(key).agg(F.min(at).alias("__low"), F.max(at).alias("__high"))
    rows = schedules.join(range_, key, "left")
    bad = (F.col("step") <= 0) | (F.col("end") < F.col("start")) | F.col("start").isNull() | F.col("end").isNull() | F.col("step").isNull()
    status = F.when(bad, "BAD_SCHEDULE").when(F.col("__low").isNull(), "NO_FRAMES").when((F.col("start") < F.col("__low") - 1e-6) | (F.col("end") > F.col("__high") + 1e-6), "OUTSIDE_RANGE").otherwise("OK")
    rows = rows.withColumn("status", status)
    count = F.floor((F.col("end") - F.col("start")) / F.col("step") + 1e-9)
    asked = rows.where("status = 'OK'").select(key, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count), lambda i: F.col("start") + i * F.col("step"))).alias("target"))
    out = nearest(asked, frames, key, "target", at, index, limits)
    kind = frames.schema
    none = rows.where("status <> 'OK'").select(key, F.lit(None).cast("double").alias("target"), F.lit(None).cast(kind[index].dataType).alias(index), F.lit(None).cast(kind[at].dataType).alias(at), F.lit(None).cast("double").alias("error"), "status")
    return out.select(key, "target", index, at, F.col("gap").alias("error"), F.lit("OK").alias("status")).unionByName(none)


def sampled(frames: DataFrame, clips: DataFrame, key: str, at: str, index: str, fps: float, most: int, limits: list[float] | None = None) -> DataFrame:
    """key, target, index, at: the frames that a model sees of each clip (key, duration): fps a second, `most` at most, at least one, evenly from 0 on, each the nearest frame.

    Where that is as many as the clip has frames or more, all frames are taken, at their own times. Clips without frames have none.
    """
    sized = clips.join(frames.groupBy(key).agg(F.count(F.lit(1)).alias("__total")), key)
    n = F.greatest(F.lit(1).cast("long"), F.least((F.col("duration") * fps).cast("long"), F.lit(most).cast("long"), F.col("__total")))
    sized = sized.withColumn("__n", n)
    whole = frames.join(sized.where("__n >= __total").select(key), key, "left_semi").select(key, F.col(at).cast("double").alias("target"), index, at)
    asked = sized.where("__n < __total").select(key, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda i: i * (F.col("duration") / F.col("__n")))).alias("target"))
    return nearest(asked, frames, key, "target", at, index, limits).select(key, "target", index, at).unionByName(whole)

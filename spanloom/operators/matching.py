"""Matching of intervals within a group, and suppression of near ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import intervals

Iou = intervals.iou_hull


def pairs(preds: DataFrame, truths: DataFrame, keys: list[str], iou=Iou) -> DataFrame:
    """keys, p, g, iou for each prediction (keys, p, p_start, p_end) and truth (keys, g, g_start, g_end) of a group that overlap or touch."""
    both = preds.join(truths, keys).where(intervals.touches(F.col("p_start"), F.col("p_end"), F.col("g_start"), F.col("g_end")))
    return both.select(*keys, "p", "g", iou(F.col("p_start"), F.col("p_end"), F.col("g_start"), F.col("g_end")).alias("iou"))


def best(pairs_: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """For each prediction the truth of the largest IoU that reaches the threshold, the first among equals; a truth may serve again."""
    ranked = F.struct("iou", (-F.col("g")).alias("o"))
    return pairs_.where(F.col("iou") >= threshold).groupBy(*keys, "p").agg(F.max(ranked).alias("b")).select(*keys, "p", (-F.col("b.o")).alias("g"), F.col("b.iou").alias("iou"))


def hits(pairs_: DataFrame, keys: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    """threshold, preds_hit, truths_hit, pairs: predictions and truths with a pair of an IoU above it, and such pairs, for each threshold that any pair passes.

    Each prediction and each truth is one group with its largest IoU, whatever the thresholds; no distinct counts.
    """
    sides = F.explode(F.array(F.struct(F.lit(True).alias("pred"), F.col("p").alias("id")), F.struct(F.lit(False).alias("pred"), F.col("g").alias("id")))).alias("s")
    above = [F.count_if(F.col("iou") > x).alias(f"n{i}") for i, x in enumerate(thresholds)]
    each = pairs_.where(F.col("iou") > min(thresholds)).select(*keys, "iou", sides).groupBy(*keys, "s").agg(F.max("iou").alias("best"), *above)
    pred = F.col("s.pred")
    told = [F.struct(F.lit(x).alias("threshold"), F.count_if(pred & (F.col("best") > x)).alias("preds_hit"), F.count_if(~pred & (F.col("best") > x)).alias("truths_hit"), F.sum(F.when(pred, F.col(f"n{i}"))).alias("pairs")) for i, x in enumerate(thresholds)]
    return each.agg(F.array(*told).alias("t")).select(F.explode("t").alias("t")).select("t.*").where("pairs > 0")


def greedy(preds: Column, truths: Column, threshold: float, iou=Iou) -> Column:
    """Array of (g, p, iou): truths in order, each taking the free prediction of the largest IoU, the first among equals, if it reaches the threshold.

    preds, truths: arrays of (start, end) of one group. The state is the array of pairs so far, so the match is one
    expression; a truth whose best free prediction is too far takes none.
    """
    index = lambda xs: F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)))
    kind = "array<struct<g:int,p:int,iou:double>>"
    empty = F.array().cast(kind)

    def step(done: Column, g: Column) -> Column:
        t = F.get(truths, g)
        free = F.filter(index(preds), lambda p: ~F.exists(done, lambda d: d["p"] == p))
        scored = F.transform(free, lambda p: F.struct(iou(F.get(preds, p)["start"], F.get(preds, p)["end"], t["start"], t["end"]).alias("iou"), (-p).alias("o")))
        top = F.array_max(scored)
        hit = F.coalesce((top["iou"] >= threshold) & (top["iou"] > 0), F.lit(False))
        return F.when(hit, F.concat(done, F.array(F.struct(g.alias("g"), (-top["o"]).alias("p"), top["iou"].alias("iou"))))).otherwise(done)

    return F.when((F.size(preds) == 0) | (F.size(truths) == 0), empty).otherwise(F.aggregate(index(truths), empty, step))


def scores(matched: Column, n_preds: Column, n_truths: Column) -> dict[str, Column]:
    """Recall, precision, F1 and the mean IoU of matched pairs, 0 where there is nothing to divide by."""
    n = F.size(matched)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r, p = zero(F.try_divide(n, n_truths)), zero(F.try_divide(n, n_preds))
    return {"recall": r, "precision": p, "f1": zero(F.try_divide(2 * p * r, p + r)), "mean_iou": zero(F.try_divide(F.aggregate(matched, F.lit(0.0), lambda a, m: a + m["iou"]), n))}


def suppress(rows: DataFrame, key: str, threshold: float, budget: int, iou=Iou) -> DataFrame:
    """Temporal suppression within each key: rank, status and suppressor of each row (key, id, margin, scale, start, end).

    In the order of margin (largest first), scale, start and id a row is suppressed by the first selected one it overlaps
    by the threshold; else it is selected while fewer than `budget` are, else left for the budget. Only selected rows are
    state, at most `budget`, so a group is one pass over its sorted rows.
    """
    row = F.struct((-F.col("margin")).alias("m"), F.col("scale"), F.col("start"), F.col("id"), F.col("end"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    item = "struct<id:string,status:string,by:string>"
    state = F.struct(F.array().cast("array<struct<id:string,start:double,end:double>>").alias("kept"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        near = F.filter(acc["kept"], lambda k: iou(k["start"], k["end"], r["start"], r["end"]) >= threshold)
        by = F.get(near, F.lit(0))["id"]
        room = F.size(acc["kept"]) < budget
        status = F.when(by.isNotNull(), F.lit("SUPPRESSED")).when(room, F.lit("SELECTED")).otherwise("NOT_SELECTED_BUDGET")
        kept = F.when(by.isNull() & room, F.concat(acc["kept"], F.array(F.struct(r["id"].alias("id"), r["start"].alias("start"), r["end"].alias("end"))))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), F.concat(acc["out"], F.array(F.struct(r["id"].alias("id"), status.alias("status"), by.alias("by")))).alias("out"))

    out = grouped.select(key, F.posexplode(F.aggregate("rows", state, step, lambda a: a["out"])).alias("pos", "r"))
    return out.select(key, F.col("r.id").alias("id"), (F.col("pos") + 1).alias("rank"), F.col("r.status").alias("status"), F.col("r.by").alias("suppressor"))

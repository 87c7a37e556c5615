"""Labels and states as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names and bounds.
DENSITY, RECALL = 0.25, 0.50


def duration_bin(duration: Column, missing: str = "unknown") -> Column:
    return (
        F.when(duration.isNull(), F.lit(missing)).when(duration < 2, F.lit("<2 sec")).when(duration < 4, F.lit("2-4 sec"))
        .when(duration < 10, F.lit("4-10 sec")).when(duration < 30, F.lit("10-30 sec")).otherwise(">=30 sec")
    )


def iou_bin(score: Column) -> Column:
    return F.when(score.isNull(), F.lit("MISSING")).when(score == 0, F.lit("0")).when(score < 0.5, F.lit("(0,0.5)")).otherwise(">=0.5")


def alignment_class(eligible: Column, total_visible: Column, visible: Column, density: Column, recall: Column) -> Column:
    strong = (F.coalesce(density, F.lit(0.0)) >= DENSITY) | (F.coalesce(recall, F.lit(0.0)) >= RECALL)
    return (
        F.when(~eligible, F.lit("INVALID_TEMPORAL")).when(total_visible == 0, F.lit("NO_VISIBLE_GT")).when(visible == 0, F.lit("NO_GT_OVERLAP"))
        .when(strong, F.lit("STRONG_GT_ALIGNED")).otherwise("WEAK_GT_ALIGNED")
    )


def support_label(prediction: Column, alignment: Column) -> Column:
    names = {"NO_VISIBLE_GT": "NO_VISIBLE_GT_FRAME", "NO_GT_OVERLAP": "SPURIOUS_SUPPORT", "STRONG_GT_ALIGNED": "STRONG_GT_SUPPORT", "WEAK_GT_ALIGNED": "WEAK_GT_SUPPORT"}
    out = F.when(prediction.isNull() | (prediction != "YES"), F.lit("NOT_SUPPORT_CANDIDATE"))
    for k, v in names.items():
        out = out.when(alignment == k, F.lit(v))
    return out.otherwise(alignment)


def temporally_eligible(density: Column, recall: Column, visible: Column) -> Column:
    return F.coalesce((visible > 0) & ((F.coalesce(density, F.lit(0.0)) >= DENSITY) | (F.coalesce(recall, F.lit(0.0)) >= RECALL)), F.lit(False))


def retention(included: Column, prediction: Column) -> Column:
    """1 or 0 for an included YES or NO; null otherwise."""
    return F.when(included & (prediction == "YES"), F.lit(1)).when(included & (prediction == "NO"), F.lit(0))


def support_margin(target: Column, others: list[Column]) -> Column:
    """log p of the target less the log of the summed probabilities of the others."""
    top = F.greatest(*others)
    return target - (top + F.log(sum((F.exp(x - top) for x in others), F.lit(0.0))))


def best_label(scores: dict[str, Column]) -> Column:
    """Label of the largest score; ties go to the first label in order."""
    order = sorted(scores)
    ranked = F.array(*[F.struct(scores[k].alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("label")) for i, k in enumerate(order)])
    return F.array_max(ranked)["label"]


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds, in order of priority."""
    return F.get(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in reasons])), F.lit(0))


def human_bytes(n: Column) -> Column:
    """Bytes in the largest unit that fits, two decimals, ties to even."""
    out = F.concat(F.format_string("%d", n.cast("long")), F.lit(" B"))
    for unit, power in (("KiB", 1), ("MiB", 2), ("GiB", 3), ("TiB", 4)):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.2f", F.bround(n / float(1024**power), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def stable_hash(*columns: str) -> Column:
    """SHA-256 of the JSON of columns in the order of their names, nulls written out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def stable_id(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(stable_hash(*columns), 1, 24))


def int_seed(digest: Column) -> Column:
    """The first 16 hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")

"""Windows of positions changed in known ways, as array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import permutations


def shifted(start: Column, end: Column, n: Column, by: int) -> Column:
    """Positions start..end moved by `by`; null where they leave 0..n-1."""
    return F.when((start + by >= 0) & (end + by < n), F.sequence(start + by, end + by))


def resampled(start: Column, end: Column, k: int) -> Column:
    """k positions of start..end from first to last, evenly spaced, halves to even."""
    length = end - start + 1
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (start + F.bround(i * (length - 1) / F.lit(float(max(k - 1, 1))))).cast("int"))


def widened(start: Column, end: Column, n: Column, target: int) -> Column:
    """The positions of a window of `target` around start..end; what one side lacks the other gives."""
    extra = F.lit(target) - (end - start + 1)
    low = F.greatest(F.lit(0), start - F.floor(extra / 2).cast("int"))
    low = F.greatest(F.lit(0), F.least(low, n - target))
    return F.sequence(low, F.least(n - 1, low + target - 1))


def block_shuffled(xs: Column, order: tuple[int, ...] = (2, 0, 3, 1)) -> Column:
    """Equal blocks of an array in another order."""
    size = (F.size(xs) / len(order)).cast("int")
    return F.flatten(F.array(*[F.slice(xs, k * size + 1, size) for k in order]))


def frozen(xs: Column) -> Column:
    """The middle element (the earlier of two), as often as the array is long."""
    return F.array_repeat(F.get(xs, ((F.size(xs) - 1) / 2).cast("int")), F.size(xs))


def moved(a: Column, b: Column) -> Column:
    """How many elements stand elsewhere."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))


def dynamic(candidates: DataFrame, key: str, frames: str) -> DataFrame:
    """For each candidate (key, frames) three rows: a full shuffle, a shuffle of four blocks and a freeze of the middle, each with its invariants.

    key, kind, reason, attempt, frames, family, and as columns what must hold: same_length, same_frames (with their numbers), moved_enough, blocks_kept,
    frozen; null where a kind doesn't ask for it. Candidates of other than 16 frames, and shuffles that can't be drawn, have the reason and no frames.
    """
    n = F.size(frames)
    whole = F.when(n == permutations.PLACES, F.sequence(F.lit(0), F.lit(permutations.PLACES - 1)))
    size = permutations.PLACES // len(permutations.BLOCKS)
    order = [b * size + i for b in permutations.BLOCKS for i in range(size)]
    shuffled = permutations.full_shuffle(F.col(key), n)
    wrong = lambda kind: F.when(n == permutations.PLACES, "OK").otherwise(F.concat(F.lit(f"{kind}_EXPECTED_16_FRAMES_GOT_"), n.cast("string")))
    fixed = lambda kind, places: F.struct(F.lit(kind).alias("kind"), wrong(kind).alias("reason"), F.lit(-1).alias("attempt"), F.when(n == permutations.PLACES, F.array(*map(F.lit, places))).alias("permutation"))
    rows = candidates.select(key, frames, whole.alias("__whole"), shuffled.alias("__s"))
    full = F.struct(F.lit("FULL_SHUFFLE").alias("kind"), F.col("__s.reason").alias("reason"), F.col("__s.attempt").alias("attempt"), F.col("__s.permutation").alias("permutation"))
    rows = rows.select(key, frames, "__whole", F.explode(F.array(full, fixed("BLOCK_SHUFFLE", order), fixed("FREEZE_MID", [permutations.MIDDLE] * permutations.PLACES))).alias("x")).select(key, frames, "__whole", "x.*")
    out = rows.withColumn("__out", F.transform("permutation", lambda i: F.get(F.col(frames), i)))
    is_, p = (lambda kind: F.col("kind") == kind), F.col("permutation")
    return out.select(
        key, "kind", F.when(is_("FREEZE_MID"), "FREEZE").otherwise("ORDER").alias("family"), "reason", "attempt", F.col("__out").alias(frames),
        (F.size("__out") == n).alias("same_length"), F.when(~is_("FREEZE_MID"), F.sort_array("__out") == F.sort_array(frames)).alias("same_frames"),
        F.when(is_("FULL_SHUFFLE"), (p != F.col("__whole")) & (permutations.changed(p) >= permutations.MOVED)).alias("moved_enough"),
        F.when(is_("BLOCK_SHUFFLE"), reduce(lambda a, b: a & b, [F.slice("__out", k * size + 1, size) == F.slice(frames, b * size + 1, size) for k, b in enumerate(permutations.BLOCKS)])).alias("blocks_kept"),
        F.when(is_("FREEZE_MID"), F.forall("__out", lambda x: x == F.get(F.col(frames), F.lit(permutations.MIDDLE)))).alias("frozen"),
    )

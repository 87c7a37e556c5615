"""Permutations by orders of hashes, drawn again until they meet their constraints, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.claims import bound

#: Limits of a full shuffle of 16 places: fixed values.
PLACES, MOVED, PARTED, RETRIES = 16, 12, 8, 100
#: The order of the four blocks of a block shuffle, and the place that a freeze repeats: fixed values.
BLOCKS, MIDDLE = (2, 0, 3, 1), 7


def drawn(seed: Column, attempt: Column, n: int) -> Column:
    """0..n-1 in the order of the hashes of seed, attempt and number."""
    places = F.sequence(F.lit(0), F.lit(n - 1))
    keyed = F.transform(places, lambda i: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), attempt.cast("string"), i.cast("string"))).alias("h"), i.alias("i")))
    return F.transform(F.sort_array(keyed), lambda x: x["i"])


def changed(p: Column) -> Column:
    """How many places of a permutation hold another number."""
    return F.size(F.filter(F.transform(p, lambda x, i: x != i), lambda d: d))


def neighbours(p: Column) -> Column:
    """How many pairs of neighbours are left as they were. `p` is read at every place, so it should be a name, not what makes it."""
    return F.size(F.filter(F.transform(p, lambda x, i: F.coalesce(F.get(p, i + 1) == x + 1, F.lit(False))), lambda d: d))


def full_shuffle(seed: Column, n: Column, moved: int = MOVED, parted: int = PARTED, retries: int = RETRIES) -> Column:
    """reason, attempt, permutation: the first drawn permutation of 16 that moves `moved` numbers and parts `parted` neighbours or more.

    Later attempts aren't drawn once one is found. Another n, and constraints that no attempt meets, are told as the reason, with a null permutation.
    """
    kind = "struct<attempt: int, permutation: array<int>>"
    none = F.struct(F.lit(-1).alias("attempt"), F.lit(None).cast("array<int>").alias("permutation")).cast(kind)

    def tried(k: Column) -> Column:
        meets = lambda p: (changed(p) >= moved) & (PLACES - 1 - neighbours(p) >= parted)
        return bound(drawn(seed, k, PLACES), lambda p: F.when(meets(p), F.struct(k.alias("attempt"), p.alias("permutation")).cast(kind)).otherwise(none))

    again = lambda first: F.aggregate(F.sequence(F.lit(1), F.lit(retries)), first, lambda acc, k: F.when(acc["attempt"] >= 0, acc).otherwise(tried(k)))
    found = bound(tried(F.lit(0)), lambda first: F.when((first["attempt"] >= 0) | F.lit(retries < 1), first).otherwise(again(first)))
    wrong = F.concat(F.lit("FULL_SHUFFLE_EXPECTED_16_FRAMES_GOT_"), n.cast("string"))
    missing = F.struct(F.lit("FULL_SHUFFLE_CONSTRAINTS_UNSATISFIED").alias("reason"), F.lit(-1).alias("attempt"), F.lit(None).cast("array<int>").alias("permutation"))
    got = bound(found, lambda x: F.when(x["attempt"] >= 0, F.struct(F.lit("OK").alias("reason"), x["attempt"].alias("attempt"), x["permutation"].alias("permutation"))).otherwise(missing))
    return F.when(n == PLACES, got).otherwise(F.struct(wrong.alias("reason"), F.lit(-1).alias("attempt"), F.lit(None).cast("array<int>").alias("permutation")))

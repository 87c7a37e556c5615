"""Which positions of a sequence are taken: arrays of zero-based indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(n: Column, value) -> Column:
    empty = F.array().cast("array<int>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: value(i).cast("int"))).otherwise(empty)


def centred(n: Column, limit: int) -> Column:
    """At most `limit` positions, round((i + 1) n / k - 1), halves to even."""
    k = F.least(n, F.lit(limit))
    return _each(k, lambda i: F.bround((i + 1) * n / k - 1))


def endpoints(n: Column, limit: int) -> Column:
    """At most `limit` distinct positions from the first to the last, evenly spaced, halves to even."""
    k = F.least(n, F.lit(limit))
    return F.array_distinct(_each(k, lambda i: F.when(k == 1, F.lit(0)).otherwise(F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))))))


def floored(n: Column, k: int) -> Column:
    """k positions spaced evenly from the first to the last, truncated; may repeat."""
    return _each(F.lit(k), lambda i: F.floor(i * (n - 1) / F.lit(float(max(k - 1, 1)))))


def stepped(n: Column, limit: int) -> Column:
    """All positions, or `limit` at a step of n / limit, truncated."""
    return F.when(n <= limit, _each(n, lambda i: i)).otherwise(_each(F.lit(limit), lambda i: F.floor(i * (n / F.lit(float(limit))))))


def slots(n: Column, limit: int) -> Column:
    """Positions in whole-number arithmetic: the middle of each of `limit` equal slots."""
    return F.when(n <= limit, _each(n, lambda i: i)).otherwise(_each(F.lit(limit), lambda i: F.floor((2 * i + 1) * n / (2 * limit))))


def window_starts(n: Column, size: int, stride: int, drop_last: bool) -> Column:
    """Starts of windows of `size` positions; without drop_last also of the shorter one that reaches the end first."""
    empty = F.array().cast("array<int>")
    full = F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(stride))).otherwise(empty)
    if drop_last:
        return full
    last = F.coalesce(F.try_element_at(full, F.lit(-1)) + stride, F.lit(0))
    covered = F.coalesce(F.try_element_at(full, F.lit(-1)) + size >= n, F.lit(False))
    return F.when((n > 0) & ~covered & (last < n), F.concat(full, F.array(last))).otherwise(full)


def pyramid(last: Column, scales: list[float]) -> Column:
    """Array of (scale, start, end): half-overlapping windows of each scale up to `last`, and one that ends there."""
    return F.concat(*[_level(last, float(s)) for s in scales])


def _level(last: Column, scale: float) -> Column:
    row = lambda start: F.struct(F.lit(scale).alias("scale"), start.alias("start"), F.least(last, start + scale).alias("end"))
    n = F.ceil((last - scale) / (scale / 2)).cast("int")  # starts k scale/2 whose window ends before the last time
    inner = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: row(k * F.lit(scale / 2)))
    return F.when(last > scale, F.concat(inner, F.array(row(F.greatest(F.lit(0.0), last - scale))))).otherwise(F.array(row(F.lit(0.0))))

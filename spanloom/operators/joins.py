"""Joins with audits: indexes that fail on duplicates, sentinels, dominance, nearest and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.ranking import bounds, part_of
from spanloom.functions.intervals import touches


def latest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key by an order that must be total; as one aggregate, so that a hot key is met before the exchange."""
    return _pick(rows, keys, F.max, order)


def first(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by a total order of non-null columns."""
    return _pick(rows, keys, F.min, order)


def _pick(rows: DataFrame, keys: list[str], pick, order: tuple) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*[F.col(o).alias(f"__o{i}") if isinstance(o, str) else o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row"))
    return rows.groupBy(*keys).agg(pick(ranked).alias("__best")).select(*keys, *[F.col("__best.__row")[c].alias(c) for c in rest])


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows`; reading them fails where a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("__n", n).where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("duplicate key")).cast("boolean"))).drop("__n")


def with_sentinel(left: DataFrame, right: DataFrame, keys: list[str], value: str, sentinel: Column) -> DataFrame:
    """Left join; `value` of rows without a match becomes the sentinel."""
    return left.join(right.withColumn("__hit", F.lit(True)), keys, "left").withColumn(value, F.when(F.col("__hit"), F.col(value)).otherwise(sentinel)).drop("__hit")


def audit(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: matched, missing and extra keys, and keys that `found` has more than once."""
    e = expected.groupBy(F.col(key).alias("__k")).agg(F.lit(1).alias("e"))
    f = found.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("f"))
    both = e.join(f, "__k", "full_outer")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return both.agg(
        count(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("matched"),
        count(F.col("e").isNotNull() & F.col("f").isNull()).alias("missing"),
        count(F.col("e").isNull() & F.col("f").isNotNull()).alias("extra"),
        count(F.col("f") > 1).alias("duplicated"),
    )


def dominate(results: DataFrame, errors: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last result of each key, and the last error of keys without a result."""
    r = latest(results, keys, *order).withColumn("origin", F.lit("result"))
    e = latest(errors, keys, *order).withColumn("origin", F.lit("error"))
    return r.unionByName(e.join(r.select(*keys), keys, "left_anti"))


def positional(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Rows of equal position side by side; a position that only one side has fails."""
    l = left.select(F.col(position).alias("__p"), F.struct(*left.columns).alias("left"))  # noqa: E741
    r = right.select(F.col(position).alias("__p"), F.struct(*right.columns).alias("right"))
    both = l.join(r, "__p", "full_outer")
    sound = F.col("left").isNotNull() & F.col("right").isNotNull()
    return both.select(F.col("__p").alias(position), F.when(sound, F.col("left")).otherwise(F.raise_error(F.lit("lengths differ"))).alias("left"), "right")


def keyed_or_next(left: DataFrame, right: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Pairs rows of equal position where the keys agree; the others of `left`, in order, with the rows of the key in order.

    As in a queue by key that positional pairs don't take from: the n-th row of `left` that must fall back gets the n-th row of
    `right` of its key, paired already or not. Rows left without a partner are dropped.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    same = (left[position] == r[f"r_{position}"]) & _all_equal(left, r, keys)
    direct = left.join(r, same)
    rest = left.join(r.select(f"r_{position}", *[f"r_{k}" for k in keys]), same, "left_anti")
    n = lambda p, ks, o: F.row_number().over(Window.partitionBy(*ks).orderBy(o))
    rest = rest.withColumn("__n", n(rest, keys, position))
    queue = r.withColumn("__m", n(r, [f"r_{k}" for k in keys], f"r_{position}"))
    fallback = rest.join(queue, _all_equal(rest, queue, keys) & (rest["__n"] == queue["__m"])).drop("__n", "__m")
    return direct.withColumn("how", F.lit("position")).unionByName(fallback.withColumn("how", F.lit("key")))


def _all_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (left[k] == right[f"r_{k}"])
    return out


def overlapping(cells: DataFrame, spans: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Interval join within a key: cells (key, start, end) that touch a span (key, s_start, s_end)."""
    return cells.join(spans, (cells[key] == spans[f"s_{key}"]) & touches(F.col("start"), F.col("end"), F.col("s_start"), F.col("s_end")), how)


def bucketed_overlaps(a: DataFrame, b: DataFrame, key: str, width: float) -> DataFrame:
    """Interval join of long timelines: both sides are dealt to buckets of `width` that they touch, and a pair is made in the bucket of the later start.

    a: (key, start, end, ...); b: (key, s_start, s_end, ...). Each pair comes once; no bucket holds a whole key.
    """
    bucket = lambda x: F.floor(x / width)
    l = a.withColumn("__b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))  # noqa: E741
    r = b.withColumn("__b", F.explode(F.sequence(bucket(F.col("s_start")), bucket(F.col("s_end")))))
    hit = (l[key] == r[f"s_{key}"]) & (l["__b"] == r["__b"]) & touches(F.col("start"), F.col("end"), F.col("s_start"), F.col("s_end"))
    return l.join(r, hit & (l["__b"] == bucket(F.greatest(F.col("start"), F.col("s_start"))))).drop("__b")


def nearest(targets: DataFrame, points: DataFrame, key: str, target: str, at: str, index: str, limits: list[float] | None = None) -> DataFrame:
    """For each target time the nearest point of its key, the least index among equals; null where a key has no point.

    Time is cut at `limits` (approximate quantiles of the points, 63 at most) into parts. In each key and part one sorted pass carries the last point
    up to a target and the first from it on; what lies in other parts comes from the key's parts, an array of 64 entries at most. So a key's targets and
    points are never paired one with another, and a key with most of the rows is dealt to all parts.
    """
    limits = bounds(points, F.col(at))[0] if limits is None else limits
    kind = points.schema[index].dataType
    t = targets.select(F.col(key), F.col(target).alias("__t"), F.lit(1).alias("__is"), F.lit(None).cast(kind).alias("__i"))
    p = points.where(F.col(at).isNotNull()).groupBy(key, F.col(at).alias("__t")).agg(F.min(index).alias("__i")).select(key, "__t", F.lit(0).alias("__is"), "__i")
    part = part_of(F.col("__t"), limits)
    ends = p.groupBy(key, part.alias("part")).agg(*[f(F.struct(F.col("__t").alias("t"), F.col("__i").alias("i"))).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
    ends = ends.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("part", "first", "last"))).alias("__parts"))
    both = t.unionByName(p).withColumn("__part", part)
    point = F.when(F.col("__is") == 0, F.struct(F.col("__t").alias("t"), F.col("__i").alias("i")))
    w = Window.partitionBy(key, "__part").orderBy("__t", "__is")
    back = Window.partitionBy(key, "__part").orderBy(F.col("__t").desc(), "__is")
    out = both.withColumn("__before", F.last(point, ignorenulls=True).over(w)).withColumn("__after", F.last(point, ignorenulls=True).over(back)).where("__is = 1")
    out = out.join(ends, F.col(key).eqNullSafe(F.col("__key")), "left")
    earlier = F.try_element_at(F.filter("__parts", lambda x: x["part"] < F.col("__part")), F.lit(-1))["last"]
    later = F.get(F.filter("__parts", lambda x: x["part"] > F.col("__part")), F.lit(0))["first"]
    rank = lambda c: F.when(c.isNotNull() & F.col("__t").isNotNull(), F.struct(F.abs(c["t"] - F.col("__t")).alias("gap"), c["i"].alias("i"), c["t"].alias("t")))
    best = F.least(rank(F.coalesce("__before", earlier)), rank(F.coalesce("__after", later)))
    return out.select(key, F.col("__t").alias(target), best["i"].alias(index), best["gap"].alias("gap"), best["t"].alias(at))


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two runs side by side: their difference, and whether they are the same, nulls included."""
    l, r = a.select(key, F.col(value).alias("value_a")), b.select(key, F.col(value).alias("value_b"))  # noqa: E741
    return l.join(r, key).select(key, "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"), F.col("value_a").eqNullSafe(F.col("value_b")).alias("same"))

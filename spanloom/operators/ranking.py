"""Ranks, top-k, shards and samples by order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of the order of a table that are sorted apart.
PARTS = 64


def bounds(rows: DataFrame, *by: Column, parts: int = PARTS) -> list[list[float]]:
    """For each of several columns at most `parts` - 1 values that part the rows about evenly; any values would give right places."""
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = rows.agg(*[F.percentile_approx(c.cast("double"), at, F.lit(1000)).alias(f"b{i}") for i, c in enumerate(by)]).first()
    return [sorted(set(x or [])) for x in found]


def part_of(by: Column, limits: list[float]) -> Column:
    """The part of the order that a value falls in; nulls are in the last."""
    inner = F.size(F.filter(F.array(*map(F.lit, limits)), lambda b: b < by.cast("double"))) if limits else F.lit(0)
    return F.when(by.isNull(), len(limits) + 1).otherwise(inner)


def placed(rows: DataFrame, keys: list[str], by: Column, limits: list[float] | Column, *then: Column | str, name: str = "place", ties: bool = False) -> DataFrame:
    """Rows with their place (from 1) in the order of `by` (nulls last) and `then` within each key; with `ties` the rank of `by` alone.

    The order is cut at `limits` into parts that are sorted apart; the numbers of rows in the parts before are added, so a key with
    most of the rows isn't one task's sort. Rows of one value of `by` are sorted together. `limits` may also be the part itself, ascending
    with `by` within each key.
    """
    rows = rows.withColumn("__by", by).withColumn("__part", limits if isinstance(limits, Column) else part_of(F.col("__by"), limits))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each key and part
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), "__before")
    number = F.rank() if ties else F.row_number()
    rows = rows.withColumn("__at", number.over(Window.partitionBy(*keys, "__part").orderBy(F.col("__by").asc_nulls_last(), *([] if ties else then))))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__part") == F.col("__p"))
    return rows.join(sizes, same).withColumn(name, F.col("__at") + F.col("__before")).drop("__by", "__part", "__at", "__p", "__before", *[f"__{k}" for k in keys])


def leaderboard(rows: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """Rows with avg_rank and rank: the mean of dense ranks of each metric, largest first and missing last.

    Ties: more first places, then the lesser sum of ranks, then the larger sum of metrics over their maxima, then the
    name. The dense rank of a value is its place among the distinct values of its metric. All metrics are taken as rows (metric, value), so they are
    placed, part by part, and joined back once, however many there are. `rows` are read several times and kept by Spark meanwhile. Metrics are numbers.
    """
    rows = rows.persist()
    limits = bounds(rows, *[-F.col(m) for m in metrics])
    tops = rows.agg(*[F.max(m).alias(f"x_{m}") for m in metrics])
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__k"), F.col(m).cast("double").alias("__v")) for i, m in enumerate(metrics)])).alias("x")
    long = rows.select(*rows.columns, each).select(*rows.columns, "x.*")
    part = reduce(lambda out, i: F.when(F.col("__k") == i, part_of(F.col("__by"), limits[i])).otherwise(out), range(len(metrics)), F.lit(0))
    ranked = placed(long.select("__k", "__v").distinct(), ["__k"], -F.col("__v"), part, name="__r").select(F.col("__k").alias("__rk"), F.col("__v").alias("__rv"), "__r")
    ranks = long.join(ranked, (F.col("__k") == F.col("__rk")) & F.col("__v").eqNullSafe(F.col("__rv")))
    out = ranks.groupBy(*rows.columns).agg(F.count_if(F.col("__k") == 0).alias("__copies"), *[F.max(F.when(F.col("__k") == i, F.col("__r"))).alias(f"__r{i}") for i in range(len(metrics))])
    out = out.join(F.broadcast(tops))  # one row
    ranks = [F.col(f"__r{i}") for i in range(len(metrics))]
    total = add(ranks)
    wins = add([F.when(r == 1, 1).otherwise(0) for r in ranks])
    norm = add([F.when(F.col(f"x_{m}") > 0, F.coalesce(F.col(m) / F.col(f"x_{m}"), F.lit(0.0))).otherwise(F.lit(0.0)) for m in metrics])
    out = out.select(*rows.columns, (total / len(metrics)).alias("avg_rank"), wins.alias("__w"), total.alias("__t"), norm.alias("__m"), F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy"))
    out = placed(out, [], F.col("avg_rank"), bounds(out, F.col("avg_rank"))[0], F.col("__w").desc(), "__t", F.col("__m").desc(), name, name="rank")
    return out.drop("__w", "__t", "__m", "__copy").withColumn("rank", F.col("rank").cast("int"))


def average_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with avg_rank: the mean place of a value among its group, equals (within 1e-12) sharing it."""
    v = F.round(F.abs(F.col(value)), 12)
    out = placed(rows, keys, v, bounds(rows, v)[0], name="__rank", ties=True)
    return out.withColumn("avg_rank", F.col("__rank") + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2).drop("__rank")


def top(rows: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key by a total order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def top_chronological(rows: DataFrame, key: str, k: int, score: str, position: str) -> DataFrame:
    """Per key the positions of the k largest scores, the earlier among equals, in the order of positions."""
    best = top(rows, [key], k, F.col(score).desc(), position)
    return best.groupBy(key).agg(F.array_sort(F.collect_list(position)).alias("positions"))


def shards(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """Rows with shard: dealt in turn within each stratum in the order of a number."""
    out = placed(rows, [stratum], F.col(order), bounds(rows, F.col(order))[0], name="__place")
    return out.withColumn("shard", ((F.col("__place") - 1) % n).cast("int")).drop("__place")


def one_each_then_fill(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows: the first of each stratum by a hash of seed and key, then the next by that hash; pick says their place.

    Each stratum's best n and the best n overall are all that can be taken, so no more than those meet in one place.
    """
    hashed = rows.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256))
    first = hashed.groupBy(stratum).agg(F.min(F.struct("__h", key)).alias("__f")).select(F.col("__f")[key].alias(key), F.lit(0).alias("__g"))
    few = hashed.orderBy("__h", key).limit(2 * n).join(first, key, "left")
    picked = few.unionByName(hashed.join(first, key)).dropDuplicates([key])
    order = F.row_number().over(Window.orderBy(F.coalesce("__g", F.lit(1)), "__h", key))
    return picked.withColumn("pick", order).where(F.col("pick") <= n).drop("__h", "__g")


def round_robin(rows: DataFrame, stratum: str, n: int, *order: Column | str) -> DataFrame:
    """n rows, one of each stratum in turn."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("turn") <= n)
    return turn.orderBy("turn", stratum).limit(n)


def until_terminal(rows: DataFrame, key: str, rank: str, terminal: Column) -> DataFrame:
    """Rows of each key up to the first that is terminal, and all of keys that have none."""
    stop = F.min(F.when(terminal, F.col(rank))).over(Window.partitionBy(key))
    return rows.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col(rank) <= F.col("__stop"))).drop("__stop")

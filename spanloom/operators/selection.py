"""Small selections that cover given predicates: greedy steps over what the predicates can tell apart, not over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares that a mask's rows are dealt to before their first ones are taken.
SALTS = 64


def _firsts(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key: of each share of a key first, so that no task sorts a hot one."""
    shared = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    for by in ([*keys, "__salt"], keys):
        shared = shared.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k)
    return shared.drop("__n", "__salt")


def covering(rows: DataFrame, key: str, predicates: list[Column], order: list[str], n: int, fill: list[Column], next_best: bool = True) -> DataFrame:
    """key, pick: for each predicate in turn the first row in `order` that meets it, then rows in the order of `fill`, n in all; pick counts from 1.

    With `next_best` a predicate takes the first row not yet chosen; without, it takes none if its first row is chosen already. `order` ends with the key,
    which is unique. Rows are reduced to the first few of each set of predicates that they meet (a bit mask), and the steps are one pass over these.
    Predicates that no row meets are passed over; fewer rows than n are all chosen.
    """
    steps = len(predicates)
    mask = reduce(lambda a, b: a + b, [F.when(F.coalesce(p, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, p in enumerate(predicates)])
    few = _firsts(rows.withColumn("__mask", mask).where("__mask > 0").select("__mask", *order), ["__mask"], order, steps if next_best else 1)
    one = few.agg(F.array_sort(F.collect_list(F.struct(*order, "__mask"))).alias("rows"))  # at most `steps` rows for each of 2**steps masks
    kind = rows.schema[key].dataType.simpleString()

    def step(acc: Column, i: Column) -> Column:
        meeting = F.filter("rows", lambda r: (F.shiftright(r["__mask"], i) % 2 == 1) & (~F.array_contains(acc, r[key]) if next_best else F.lit(True)))
        first = F.get(meeting, F.lit(0))[key]
        full = F.size(acc) >= n if next_best else F.lit(False)
        return F.when(full | first.isNull() | F.coalesce(F.array_contains(acc, first), F.lit(False)), acc).otherwise(F.array_append(acc, first))

    # an expression can't take its shift from a column, so the steps are written out
    picked = F.array().cast(f"array<{kind}>")
    folded = one.select("rows", picked.alias("acc"))
    for i in range(steps):
        folded = folded.select("rows", step(F.col("acc"), i).alias("acc"))
    chosen = folded.select(F.posexplode(F.slice("acc", 1, n)).alias("pick", key)).select(key, (F.col("pick") + 1).alias("pick"))
    rest = rows.withColumns({f"__f{i}": c for i, c in enumerate(fill)})
    by = [f"__f{i}" for i in range(len(fill))]
    rest = rest.orderBy(*by).limit(2 * n).select(key, *by).join(chosen.select(key), key, "left_anti")
    rest = rest.select(key, F.lit(1 << 20).alias("pick"), *by)
    both = chosen.select(key, "pick", *[F.lit(None).cast(rest.schema[b].dataType).alias(b) for b in by]).unionByName(rest)
    return both.withColumn("pick", F.row_number().over(Window.orderBy("pick", *by))).where(F.col("pick") <= n).select(key, "pick")  # 3 n rows at most


def balanced(rows: DataFrame, key: str, task: str, dataset: str, per_task: int) -> DataFrame:
    """task, dataset, key: `per_task` rows of each task, tasks in order; datasets chosen less often by the tasks before come first, then smaller keys.

    Of each task and dataset only the first `per_task` rows can be chosen; the pass over tasks sees these alone.
    """
    few = _firsts(rows.select(task, dataset, key), [task, dataset], [key], per_task)
    tasks = few.groupBy(task).agg(F.collect_list(F.struct(dataset, key)).alias("rows"))
    one = tasks.agg(F.array_sort(F.collect_list(F.struct(task, "rows"))).alias("tasks"))
    item = f"struct<{task}: {rows.schema[task].dataType.simpleString()}, {dataset}: {rows.schema[dataset].dataType.simpleString()}, {key}: {rows.schema[key].dataType.simpleString()}>"

    def step(acc: Column, t: Column) -> Column:
        counted = F.transform(t["rows"], lambda r: F.struct(F.size(F.filter(acc, lambda c: c[dataset].eqNullSafe(r[dataset]))).alias("n"), r[key].alias(key), r[dataset].alias(dataset)))
        best = F.transform(F.slice(F.array_sort(counted), 1, per_task), lambda r: F.struct(t[task].alias(task), r[dataset].alias(dataset), r[key].alias(key)))
        return F.concat(acc, best)

    return one.select(F.explode(F.aggregate("tasks", F.array().cast(f"array<{item}>"), step)).alias("x")).select("x.*")

"""Queries of ranks, top-k, shards and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import picks
from spanloom.operators import ranking

from .registry import Tables, query


@query(
    "w01_leaderboard_dense_rank",
    """
WITH m AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS discount,
  count(*) FILTER (l_returnflag = 'R') AS returns, max(CASE WHEN l_tax > 0.02 THEN l_quantity END) AS quantity FROM lineitem GROUP BY 1),
r AS (SELECT *, dense_rank() OVER (ORDER BY revenue DESC NULLS LAST) AS r1, dense_rank() OVER (ORDER BY discount DESC NULLS LAST) AS r2,
  dense_rank() OVER (ORDER BY returns DESC NULLS LAST) AS r3, dense_rank() OVER (ORDER BY quantity DESC NULLS LAST) AS r4,
  max(revenue) OVER () AS x1, max(discount) OVER () AS x2, max(returns) OVER () AS x3, max(quantity) OVER () AS x4 FROM m),
s AS (SELECT *, (r1 + r2 + r3 + r4) / 4.0::DOUBLE AS avg_rank, (r1 = 1)::INT + (r2 = 1)::INT + (r3 = 1)::INT + (r4 = 1)::INT AS w,
  coalesce(revenue / x1, 0) + coalesce(discount / x2, 0) + coalesce(returns / x3, 0) + coalesce(quantity / x4, 0) AS n FROM r)
SELECT l_suppkey, revenue, discount, returns, quantity, avg_rank::DOUBLE AS avg_rank,
  row_number() OVER (ORDER BY avg_rank, w DESC, r1 + r2 + r3 + r4, n DESC, l_suppkey)::INT AS rank FROM s
""",
)
def leaderboard(t: Tables) -> DataFrame:
    metrics = t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 4).alias("discount"),
        F.count_if(F.col("l_returnflag") == "R").alias("returns"),
        F.max(F.when(F.col("l_tax") > 0.02, F.col("l_quantity"))).alias("quantity"),
    )
    return ranking.leaderboard(metrics, "l_suppkey", ["revenue", "discount", "returns", "quantity"])


@query(
    "w02_average_ranks",
    """SELECT o_orderkey, o_orderpriority, (rank() OVER (PARTITION BY o_orderpriority ORDER BY round(abs(o_totalprice), 12))
  + (count(*) OVER (PARTITION BY o_orderpriority, round(abs(o_totalprice), 12)) - 1) / 2.0)::DOUBLE AS avg_rank FROM orders""",
)
def average_ranks(t: Tables) -> DataFrame:
    return ranking.average_ranks(t.orders, ["o_orderpriority"], "o_totalprice").select("o_orderkey", "o_orderpriority", "avg_rank")


@query(
    "w05_top3_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INT AS rank
  FROM lineitem) WHERE rank <= 3""",
)
def top3(t: Tables) -> DataFrame:
    return ranking.top(t.lineitem, ["l_suppkey"], 3, F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("w06_round_robin_shard", "SELECT o_orderkey, o_orderpriority, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 4)::INT AS shard FROM orders")
def round_robin_shard(t: Tables) -> DataFrame:
    return ranking.shards(t.orders, "o_orderpriority", "o_orderkey", 4).select("o_orderkey", "o_orderpriority", "shard")


@query(
    "w07_merged_sequence",
    """SELECT o_orderkey, shard, (row_number() OVER (PARTITION BY shard ORDER BY o_orderkey) - 1 + coalesce(before, 0))::BIGINT AS seq
FROM (SELECT o_orderkey, (o_custkey % 4)::INT AS shard FROM orders)
LEFT JOIN (SELECT shard, sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT (o_custkey % 4)::INT AS shard, count(*) AS n FROM orders GROUP BY 1)) USING (shard)""",
)
def merged_sequence(t: Tables) -> DataFrame:
    """Sequence numbers over shards: the place within the shard plus the sizes of the shards before; no sort holds a shard."""
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("shard"))
    first = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over the four shards
    before = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0)))
    places = ranking.placed(rows, ["shard"], F.col("o_orderkey"), ranking.bounds(rows, F.col("o_orderkey"))[0])
    return places.join(before, "shard").select("o_orderkey", "shard", (F.col("place") - 1 + F.col("before")).cast("long").alias("seq"))


@query(
    "t01_topk_chronological",
    """SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS positions FROM
  (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS r FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1""",
)
def topk_chronological(t: Tables) -> DataFrame:
    scored = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("s"))
    return ranking.top_chronological(scored, "l_orderkey", 3, "s", "l_linenumber")


@query(
    "t03_t07_sampling_positions",
    """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n, list_transform(range(least(n, 8)), lambda i: round_even((i + 1) * n / least(n, 8)::DOUBLE - 1, 0)::INT) AS centred,
  list_distinct(list_transform(range(least(n, 8)), lambda i: CASE WHEN n = 1 THEN 0 ELSE round_even(i * (n - 1) / (least(n, 8) - 1)::DOUBLE, 0)::INT END)).list_sort() AS endpoints,
  list_transform(range(8), lambda i: floor(i * (n - 1) / 7.0::DOUBLE)::INT) AS floored,
  CASE WHEN n <= 8 THEN list_transform(range(n), lambda i: i::INT) ELSE list_transform(range(8), lambda i: floor(i * (n / 8.0::DOUBLE))::INT) END AS stepped,
  CASE WHEN n <= 8 THEN list_transform(range(n), lambda i: i::INT) ELSE list_transform(range(8), lambda i: ((2 * i + 1) * n // 16)::INT) END AS slots FROM u""",
)
def sampling_positions(t: Tables) -> DataFrame:
    n = F.col("n")
    users = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.select("user_id", "n", picks.centred(n, 8).alias("centred"), picks.endpoints(n, 8).alias("endpoints"), picks.floored(n, 8).alias("floored"), picks.stepped(n, 8).alias("stepped"), picks.slots(n, 8).alias("slots"))


@query(
    "t09_best_by_six_keys",
    """SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_linestatus, l_discount DESC, l_quantity, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1""",
)
def best_by_six_keys(t: Tables) -> DataFrame:
    order = ["l_returnflag", "l_linestatus", F.col("l_discount").desc(), "l_quantity", "l_orderkey", "l_linenumber", "l_partkey"]
    return ranking.top(t.lineitem, ["l_suppkey"], 1, *order).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "t13_round_robin_strata",
    """SELECT c_custkey, c_mktsegment, turn FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS turn FROM customer) ORDER BY turn, c_mktsegment LIMIT 23""",
)
def round_robin_strata(t: Tables) -> DataFrame:
    return ranking.round_robin(t.customer, "c_mktsegment", 23, F.col("c_acctbal").desc(), "c_custkey").select("c_custkey", "c_mktsegment", "turn")


@query(
    "t15_hash_ordered_stratified_sample",
    """WITH h AS (SELECT c_custkey, c_mktsegment, sha256('7:' || c_custkey::VARCHAR) AS h FROM customer),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) = 1 THEN 0 ELSE 1 END AS g FROM h)
SELECT c_custkey, c_mktsegment, pick FROM (SELECT *, row_number() OVER (ORDER BY g, h, c_custkey)::INT AS pick FROM f) WHERE pick <= 20""",
)
def hash_ordered_sample(t: Tables) -> DataFrame:
    return ranking.one_each_then_fill(t.customer, "c_mktsegment", "c_custkey", 20, 7).select("c_custkey", "c_mktsegment", "pick")


@query(
    "t17_extremes_then_fill",
    """WITH a AS (SELECT o_orderpriority, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS k1, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k2 FROM orders GROUP BY 1),
e AS (SELECT k1 AS o_orderkey FROM a UNION SELECT k2 FROM a)
SELECT o_orderkey, 'extreme' AS why FROM e UNION ALL
(SELECT o_orderkey, 'fill' AS why FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)) ORDER BY rn, o_orderpriority LIMIT 15)""",
)
def extremes_then_fill(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    ends = orders.groupBy("o_orderpriority").agg(F.min(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")).alias("a"), F.min(F.struct("o_orderdate", "o_orderkey")).alias("b"))
    extreme = ends.select(F.explode(F.array("a.o_orderkey", "b.o_orderkey")).alias("o_orderkey")).distinct()
    rest = orders.join(extreme, "o_orderkey", "left_anti")
    fill = ranking.round_robin(rest, "o_orderpriority", 15, "o_orderkey").select("o_orderkey", F.lit("fill").alias("why"))
    return extreme.withColumn("why", F.lit("extreme")).unionByName(fill)


@query(
    "t21_early_exit_traversal",
    """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS rank FROM events),
s AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') THEN rank END) OVER (PARTITION BY user_id) AS stop FROM r)
SELECT user_id, event_id, event_type, rank FROM s WHERE stop IS NULL OR rank <= stop""",
)
def early_exit(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    ranked = t.events.select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"))
    return ranking.until_terminal(ranked, "user_id", "rank", F.col("event_type").isin("purchase", "error"))


@query("t22_ordered_limit", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 2) ORDER BY o_orderkey LIMIT 50")
def ordered_limit(t: Tables) -> DataFrame:
    kinds = t.orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").limit(2)
    return t.orders.join(kinds, "o_orderpriority", "left_semi").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query(
    "t23_first_mismatch",
    """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT a.o_custkey, min(a.i)::INT AS first_mismatch FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.i = b.i AND a.o_orderkey <> b.o_orderkey GROUP BY 1""",
)
def first_mismatch(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = lambda *o: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*o))
    rows = t.orders.select("o_custkey", "o_orderkey", w("o_orderdate", "o_orderkey").alias("i"), w("o_orderkey").alias("j"))
    a, b = rows.select("o_custkey", "i", F.col("o_orderkey").alias("x")), rows.select("o_custkey", F.col("j").alias("i"), F.col("o_orderkey").alias("y"))
    return a.join(b, ["o_custkey", "i"]).where("x != y").groupBy("o_custkey").agg(F.min("i").alias("first_mismatch"))

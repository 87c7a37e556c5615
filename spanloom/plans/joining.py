"""Queries of joins, audits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import audits, joins

from .registry import Tables, query


@query(
    "j01_positional_merge",
    """WITH a AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS p FROM events),
b AS (SELECT user_id, event_id AS other, row_number() OVER (ORDER BY event_id) AS p FROM events)
SELECT a.event_id, a.event_type, b.user_id, a.event_id = b.other AS agrees FROM a JOIN b USING (p)""",
)
def positional_merge(t: Tables) -> DataFrame:
    """Two lists side by side; event_id is the dense position in its list."""
    both = joins.positional(t.events.select("event_id", "event_type"), t.events.select("event_id", "user_id"), "event_id")
    return both.select("left.event_id", "left.event_type", "right.user_id", (F.col("left.event_id") == F.col("right.event_id")).alias("agrees"))


@query(
    "j02_position_or_queue",
    """WITH l AS (SELECT event_id AS p, user_id AS k FROM events WHERE event_type <> 'error'),
r AS (SELECT event_id - 1 AS p, user_id AS k FROM events),
d AS (SELECT l.p, r.p AS r_p, 'position' AS how FROM l JOIN r ON l.p = r.p AND l.k = r.k),
f AS (SELECT p, k, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM l WHERE p NOT IN (SELECT p FROM d)),
q AS (SELECT p, k, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM r)
SELECT p, r_p, how FROM d UNION ALL SELECT f.p, q.p, 'key' FROM f JOIN q ON f.k = q.k AND f.n = q.n""",
)
def position_or_queue(t: Tables) -> DataFrame:
    left = t.events.where("event_type != 'error'").select(F.col("event_id").alias("p"), F.col("user_id").alias("k"))
    right = t.events.select((F.col("event_id") - 1).alias("p"), F.col("user_id").alias("k"))
    return joins.keyed_or_next(left, right, ["k"], "p").select("p", "r_p", "how")


@query("j03_duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return joins.duplicates(t.events, ["user_id", "event_type"])


@query("j04_left_join_sentinel", "SELECT d.doc_id, d.source, l.quality::DOUBLE AS quality, CASE WHEN l.doc_id IS NULL THEN 'NOT_RUN' ELSE l.toxic::VARCHAR END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_sentinel(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return joins.with_sentinel(t.documents.select("doc_id", "source"), labels, ["doc_id"], "toxic", F.lit("NOT_RUN"))


@query("j06_latest_wins", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(t: Tables) -> DataFrame:
    return joins.latest(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("j07_first_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(t: Tables) -> DataFrame:
    return joins.first(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query(
    "j08_join_audit",
    """WITH e AS (SELECT DISTINCT doc_id FROM documents), f AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 5 FROM labels) GROUP BY 1)
SELECT count(*) FILTER (e.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS matched, count(*) FILTER (f.doc_id IS NULL) AS missing,
  count(*) FILTER (e.doc_id IS NULL) AS extra, count(*) FILTER (n > 1) AS duplicated FROM e FULL JOIN f ON e.doc_id = f.doc_id""",
)
def join_audit(t: Tables) -> DataFrame:
    found = t.labels.select("doc_id").union(t.labels.select(F.col("doc_id") + 5))
    return joins.audit(t.documents.select("doc_id"), found, "doc_id")


@query(
    "j10_pivot_interventions",
    """SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, max(value) FILTER (event_type = 'click') AS top_click, max(value) FILTER (event_type = 'purchase') AS top_purchase FROM events GROUP BY 1""",
)
def pivot_interventions(t: Tables) -> DataFrame:
    of = lambda k, c: F.when(F.col("event_type") == k, F.col(c))
    return t.events.groupBy("user_id").agg(F.count(of("view", "value")).alias("n_view"), F.max(of("click", "value")).alias("top_click"), F.max(of("purchase", "value")).alias("top_purchase"))


@query(
    "j13_results_dominate_errors",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'signup' AND value > 60),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error')
SELECT user_id, event_id, 'result' AS origin FROM r WHERE r = 1 UNION ALL SELECT user_id, event_id, 'error' FROM e WHERE r = 1 AND user_id NOT IN (SELECT user_id FROM r)""",
)
def results_dominate(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    out = joins.dominate(rows.where("event_type = 'signup' AND value > 60"), rows.where("event_type = 'error'"), ["user_id"], "ts", "event_id")
    return out.select("user_id", "event_id", "origin")


_SPANS = """spans AS (SELECT o_orderkey AS k, l_linenumber AS n, l_partkey AS p, least(epoch(o_orderdate), epoch(l_shipdate)) / 86400.0 AS s, greatest(epoch(o_orderdate), epoch(l_shipdate)) / 86400.0 AS e, l_returnflag AS f
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


#: Tasks over the orders of a table where the rows of an order are sorted, joined and grouped in one stage, so that what a task holds stays small.
KEY_PARTS = 192


def spans(t: Tables) -> DataFrame:
    """k, n, p, s, e, f: an interval in days for each line of an order, between order and shipping."""
    day = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double") / 86400.0
    rows = t.orders.join(t.lineitem.repartition(KEY_PARTS, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.least(day("o_orderdate"), day("l_shipdate")).alias("s"), F.greatest(day("o_orderdate"), day("l_shipdate")).alias("e"), F.col("l_returnflag").alias("f"))


@query(
    "j14_interval_semi_join",
    f"WITH {_SPANS} SELECT k, n, p FROM spans a WHERE f = 'N' AND EXISTS (SELECT 1 FROM spans b WHERE b.f = 'R' AND a.k = b.k AND greatest(a.s, b.s) <= least(a.e, b.e))",
)
def interval_semi(t: Tables) -> DataFrame:
    rows = spans(t)
    cells = rows.where("f = 'N'").select("k", "n", "p", F.col("s").alias("start"), F.col("e").alias("end"))
    other = rows.where("f = 'R'").select(F.col("k").alias("s_k"), F.col("s").alias("s_start"), F.col("e").alias("s_end"))
    return joins.overlapping(cells, other, "k").select("k", "n", "p")


@query(
    "j15_bucketed_interval_join",
    """WITH a AS (SELECT l_suppkey AS k, l_orderkey AS x, l_linenumber AS n, l_partkey AS p, epoch(l_shipdate) / 86400.0 AS s, epoch(l_shipdate) / 86400.0 + l_quantity / 10 AS e FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_suppkey AS k, epoch(l_shipdate) / 86400.0 AS s, epoch(l_shipdate) / 86400.0 + 3 AS e FROM lineitem WHERE l_returnflag = 'R')
SELECT a.k, x, n, p, count(*) AS hits FROM a JOIN b ON a.k = b.k AND greatest(a.s, b.s) <= least(a.e, b.e) GROUP BY 1, 2, 3, 4""",
)
def bucketed_interval_join(t: Tables) -> DataFrame:
    day = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double") / 86400.0
    a = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), day.alias("start"), (day + F.col("l_quantity") / 10).alias("end"))
    b = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_k"), day.alias("s_start"), (day + 3).alias("s_end"))
    return joins.bucketed_overlaps(a, b, "k", 8.0).groupBy("k", "x", "n", "p").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "j17_nearest_asof",
    """WITH e AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t FROM events),
g AS (SELECT DISTINCT user_id, floor(t / 21600) * 21600 AS target FROM e)
SELECT user_id, target, arg_min(event_id, (abs(t - target), event_id)) AS event_id, min(abs(t - target)) AS gap FROM g JOIN e USING (user_id) GROUP BY 1, 2""",
)
def nearest_asof(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select("user_id", "event_id", (F.col("us") / 1e6).alias("t"))
    targets = e.select("user_id", (F.floor(F.col("t") / 21600) * 21600).cast("double").alias("target")).distinct()
    return joins.nearest(targets, e, "user_id", "target", "t", "event_id").drop("t")


@query(
    "j18_chain_composition",
    """WITH e AS (SELECT user_id, event_id, event_type, epoch(ts) AS t FROM events WHERE event_type IN ('view', 'click', 'purchase')),
c AS (SELECT a.user_id, a.event_id AS v, b.event_id AS c, p.event_id AS p, p.t - a.t AS extent FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.t < b.t AND b.t - a.t <= 43200
  JOIN e p ON b.user_id = p.user_id AND p.event_type = 'purchase' AND b.t < p.t AND p.t - a.t <= 86400)
SELECT user_id, v, c, p, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY extent, v, c, p)::INT AS rank FROM c) WHERE rank <= 3""",
)
def chain_composition(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    role = lambda kind, x: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(x), F.col("t").alias(f"t_{x}"))
    both = role("view", "v").join(role("click", "c"), "user_id").where("t_v < t_c AND t_c - t_v <= 43200")
    chains = both.join(role("purchase", "p"), "user_id").where("t_c < t_p AND t_p - t_v <= 86400")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("t_p") - F.col("t_v"), "v", "c", "p"))
    return chains.withColumn("rank", rank).where("rank <= 3").select("user_id", "v", "c", "p", "rank")


@query("j23_semi_by_list", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_by_list(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query(
    "j26_run_comparison",
    """WITH a AS (SELECT l_partkey AS k, round(avg(l_quantity), 6) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_partkey AS k, round(avg(l_quantity), 6) AS v FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
SELECT k, a.v AS value_a, b.v AS value_b, round(b.v - a.v, 6) AS delta, a.v IS NOT DISTINCT FROM b.v AS same FROM a JOIN b USING (k)""",
)
def run_comparison(t: Tables) -> DataFrame:
    run = lambda c: t.lineitem.where(c).groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return joins.compared(run("l_linenumber <= 3"), run("l_linenumber > 2"), "k", "v").withColumn("delta", F.round("delta", 6))


@query(
    "j27_attrition_funnel",
    """SELECT count(*) AS base, count(*) FILTER (o) AS ordered, count(*) FILTER (o AND r) AS returned, count(*) FILTER (o AND r AND b) AS large FROM (SELECT c_custkey,
  c_custkey IN (SELECT o_custkey FROM orders) AS o, c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') AS r,
  c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS b FROM customer)""",
)
def attrition_funnel(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    returned = orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return audits.funnel(t.customer, "c_custkey", {"ordered": orders, "returned": returned, "large": orders.where("o_totalprice > 300000")})


@query("u01_set_difference", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'both' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def set_difference(t: Tables) -> DataFrame:
    ids, have = t.documents.select("doc_id"), t.labels.select("doc_id")
    return ids.join(have, "doc_id", "left_anti").withColumn("side", F.lit("missing")).union(ids.intersect(have).withColumn("side", F.lit("both")))


@query(
    "u03_paired_groups",
    """SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'R')) AS n FROM lineitem GROUP BY 1) WHERE n = 2""",
)
def paired_groups(t: Tables) -> DataFrame:
    has = lambda v: F.bool_or(F.col("l_returnflag") == v)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(has("A").alias("a"), has("R").alias("r")).where("a AND r").select("o_orderkey")


@query("u05_first_occurrence", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def first_occurrence(t: Tables) -> DataFrame:
    """Keyed by a digest, so that texts aren't exchanged."""
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query(
    "u09_multiset_equal",
    """SELECT o_custkey, list_sort(list(o_orderstatus)) = list_sort(list(CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END)) AS equal FROM orders GROUP BY 1""",
)
def multiset_equal(t: Tables) -> DataFrame:
    mapped = F.when(F.col("o_orderstatus") == "P", F.lit("O")).otherwise(F.col("o_orderstatus"))
    return t.orders.groupBy("o_custkey").agg((F.array_sort(F.collect_list("o_orderstatus")) == F.array_sort(F.collect_list(mapped))).alias("equal"))


@query(
    "q01_check_table",
    """SELECT * FROM (VALUES ('nonnegative', (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_quantity >= 0, false))), ('small_discount', (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_discount <= 0.05, false))),
  ('known_flag', (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_returnflag IN ('A', 'N', 'R'), false)))) v("check", n_bad) CROSS JOIN LATERAL (SELECT n_bad = 0 AS passed)""",
)
def check_table(t: Tables) -> DataFrame:
    return audits.checks(t.lineitem, {"nonnegative": F.col("l_quantity") >= 0, "small_discount": F.col("l_discount") <= 0.05, "known_flag": F.col("l_returnflag").isin("A", "N", "R")})


@query("q03_key_collisions", "SELECT p_brand, count(DISTINCT p_type) AS n_ids FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def key_collisions(t: Tables) -> DataFrame:
    return audits.colliding(t.part, "p_brand", "p_type")


@query(
    "q05_order_audit",
    """SELECT count(*) FILTER (NOT ok_rank) AS bad_rank, count(*) FILTER (NOT ok_time) AS bad_time FROM (SELECT n = max_line AS ok_rank, t AS ok_time FROM
 (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS max_line, bool_and(coalesce(l_shipdate >= prev, true)) AS t FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS prev FROM lineitem) GROUP BY 1))""",
)
def order_audit(t: Tables) -> DataFrame:
    prev = F.lag("l_shipdate").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    per = t.lineitem.withColumn("ok", F.coalesce(F.col("l_shipdate") >= prev, F.lit(True))).groupBy("l_orderkey").agg((F.count(F.lit(1)) == F.max("l_linenumber")).alias("r"), F.bool_and("ok").alias("t"))
    return per.agg(F.count_if(~F.col("r")).alias("bad_rank"), F.count_if(~F.col("t")).alias("bad_time"))


@query("q21_blocking_gate", "SELECT l_suppkey, bool_or(l_returnflag = 'R' AND q IS NULL) AS blocked FROM lineitem LEFT JOIN (SELECT p_partkey, 1 AS q FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY 1")
def blocking_gate(t: Tables) -> DataFrame:
    settled = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("q"))
    return t.lineitem.join(settled, "l_partkey", "left").groupBy("l_suppkey").agg(F.bool_or((F.col("l_returnflag") == "R") & F.col("q").isNull()).alias("blocked"))


@query("f18_leak_scan", "SELECT event_id, CASE WHEN props LIKE '%\"k\": 1%' THEN 'a' WHEN event_type LIKE '%err%' THEN 'err' END AS leak FROM events WHERE props LIKE '%\"k\": 1%' OR event_type LIKE '%err%'")
def leak_scan(t: Tables) -> DataFrame:
    rows = audits.leaking_values(t.events.select("event_id", "event_type", "props"), ['\\"k\\": 1', "err"])
    return rows.select("event_id", F.when(F.col("leak") == "err", F.lit("err")).otherwise("a").alias("leak"))

"""Queries of predicates, states, nested summaries and interventions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import aggregates, interventions, ranking

from .registry import Tables, query


@query("f01_task_filter_groups", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE contains(lower(c_mktsegment), 'b') OR regexp_matches(lower(c_mktsegment), 'mach|hold') GROUP BY 1")
def task_filter(t: Tables) -> DataFrame:
    task = F.lower("c_mktsegment")
    return t.customer.where(F.contains(task, F.lit("b")) | task.rlike("mach|hold")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("f06_shard_predicate", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 3")
def shard_predicate(t: Tables) -> DataFrame:
    return t.orders.where(F.pmod("o_orderkey", F.lit(7)) == 3).select("o_orderkey", "o_totalprice")


@query(
    "f12_adjacent_overlaps",
    """SELECT l_suppkey, count(*) FILTER (nxt < s + l_quantity) AS overlaps FROM (SELECT l_suppkey, l_quantity, epoch(l_shipdate) / 86400 AS s, lead(epoch(l_shipdate) / 86400) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS nxt FROM lineitem) GROUP BY 1""",
)
def adjacent_overlaps(t: Tables) -> DataFrame:
    day = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400
    rows = t.lineitem.select("l_suppkey", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", day.alias("s"))
    after = F.lead("s").over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    return rows.withColumn("nxt", after).groupBy("l_suppkey").agg(F.count_if(F.coalesce(F.col("nxt") < F.col("s") + F.col("l_quantity"), F.lit(False))).alias("overlaps"))


@query("f16_allowed_combinations", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'), ('R', 'F')) GROUP BY 1, 2")
def allowed_combinations(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("A", "F"), ("N", "O"), ("R", "F")], "l_returnflag string, l_linestatus string")
    return t.lineitem.join(F.broadcast(allowed), ["l_returnflag", "l_linestatus"], "left_semi").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("p12_path_remap", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 's/' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'p/' || substr(url, 8) ELSE url END AS path FROM pages")
def path_remap(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.remap_prefix(F.col("url"), [("https://", "s/"), ("http://", "p/")]).alias("path"))


@query("p16_projection_with_defaults", "SELECT o_orderkey, coalesce(l.n, 0) AS n_lines, coalesce(l.top, -1) AS top, o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON o_orderkey = l_orderkey")
def projection_with_defaults(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top"))
    return t.orders.join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("top", F.lit(-1.0)).alias("top"), "o_orderstatus")


@query("p25_mapped_names", "SELECT event_id, coalesce(m.name, event_type) AS name FROM events LEFT JOIN (VALUES ('view', 'look'), ('click', 'tap')) m(k, name) ON event_type = k")
def mapped_names(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("view", "look"), ("click", "tap")], "event_type string, name string")
    return t.events.join(F.broadcast(names), "event_type", "left").select("event_id", F.coalesce("name", "event_type").alias("name"))


@query(
    "a13_aspect_means",
    """SELECT aspect, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT 'discount' AS aspect, l_discount AS v FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem) GROUP BY 1""",
)
def aspect_means(t: Tables) -> DataFrame:
    """Means of several columns as rows: one aggregate of all, then unpivoted, so that rows aren't multiplied."""
    aspects = {"discount": "l_discount", "tax": "l_tax", "quantity": "l_quantity"}
    one = t.lineitem.agg(*[F.struct(F.lit(a).alias("aspect"), F.round(F.avg(c), 6).alias("mean"), F.count(c).alias("n")).alias(a) for a, c in aspects.items()])
    return one.select(F.explode(F.array(*aspects)).alias("x")).select("x.*")


@query("a20_nested_summary", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_r, list(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag = 'R') AS r_lines, bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') AS paired FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0")
def nested_summary(t: Tables) -> DataFrame:
    is_r = F.col("l_returnflag") == "R"
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    out = rows.groupBy("l_orderkey").agg(F.count_if(is_r).alias("n_r"), F.array_sort(F.collect_list(F.when(is_r, F.col("l_linenumber")))).alias("r_lines"), (F.bool_or(is_r) & F.bool_or(F.col("l_returnflag") == "A")).alias("paired"))
    return out.where("n_r > 0")


@query(
    "a27_missingness",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount = 0) AS n_missing, round(count(*) FILTER (l_discount = 0) / count(*), 6) AS rate, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2""",
)
def missingness(t: Tables) -> DataFrame:
    n, none = F.count(F.lit(1)), F.count_if(F.col("l_discount") == 0)
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(n.alias("n"), none.alias("n_missing"), F.round(none / n, 6).alias("rate"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("a49_distinct_coverage", "SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS with_return FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def distinct_coverage(t: Tables) -> DataFrame:
    """Distinct suppliers in two ways: brand and supplier are reduced to one row first, flags and all."""
    pairs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    return pairs.groupBy("p_brand").agg(F.count(F.lit(1)).alias("suppliers"), F.count_if("r").alias("with_return"))


@query(
    "a61_reason_distribution",
    """WITH r AS (SELECT l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'LARGE' END, CASE WHEN l_discount > 0.08 THEN 'CHEAP' END, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem)
SELECT 'reason' AS dimension, reason AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'line', l_linenumber::VARCHAR, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'both', l_linenumber || '::' || reason, count(*) FROM r GROUP BY 2""",
)
def reason_distribution(t: Tables) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("l_quantity") > 40, F.lit("LARGE")), F.when(F.col("l_discount") > 0.08, F.lit("CHEAP")), F.when(F.col("l_returnflag") == "R", F.lit("RETURNED"))))
    rows = t.lineitem.select("l_linenumber", F.explode(reasons).alias("reason"))
    return aggregates.by_dimensions(rows, {"reason": ["reason"], "line": ["l_linenumber"], "both": ["l_linenumber", "reason"]}, n=F.count(F.lit(1)))


@query(
    "g25_g29_interventions",
    """WITH n AS (SELECT user_id, (count(*))::INT AS n FROM events GROUP BY 1) SELECT user_id, n, CASE WHEN 15 + 2 < n THEN range(2, 18)::INT[] END AS shifted, list_transform(range(12), lambda i: round_even(i * 15 / 11.0::DOUBLE, 0)::INT) AS resampled,
  range(greatest(0, least(4 - 4, n - 24)), least(n, greatest(0, least(4 - 4, n - 24)) + 24))::INT[] AS widened, [8, 9, 10, 11, 0, 1, 2, 3, 12, 13, 14, 15, 4, 5, 6, 7]::INT[] AS blocks, 16 AS moved FROM n""",
)
def intervention_plans(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    whole = F.sequence(F.lit(0), F.lit(15))
    blocks = interventions.block_shuffled(whole)
    return rows.select(
        "user_id", "n", interventions.shifted(F.lit(0), F.lit(15), F.col("n"), 2).alias("shifted"), interventions.resampled(F.lit(0), F.lit(15), 12).alias("resampled"),
        interventions.widened(F.lit(4), F.lit(19), F.col("n"), 24).alias("widened"), blocks.alias("blocks"), interventions.moved(whole, blocks).alias("moved"),
    )


@query("u04_superset_groups", "SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'purchase') AND bool_or(event_type = 'error')")
def superset_groups(t: Tables) -> DataFrame:
    has = lambda v: F.bool_or(F.col("event_type") == v)
    return t.events.groupBy("user_id").agg(has("purchase").alias("a"), has("error").alias("b")).where("a AND b").select("user_id")


@query("u10_union_of_shards", "SELECT o_orderkey % 3 AS shard, count(*) AS n, count(DISTINCT o_orderkey) = count(*) AS sound FROM orders GROUP BY 1")
def union_of_shards(t: Tables) -> DataFrame:
    parts = [t.orders.where(F.col("o_orderkey") % 3 == k).select("o_orderkey", F.lit(k).cast("long").alias("shard")) for k in range(3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("o_orderkey") == F.count(F.lit(1))).alias("sound"))


@query(
    "v13_leaderboard_promote",
    """WITH m AS (SELECT c_mktsegment AS name, round(avg(c_acctbal), 4) AS score FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 UNION ALL SELECT 'NEW', 4500) SELECT name, score, dense_rank() OVER (ORDER BY score DESC NULLS LAST)::DOUBLE AS avg_rank, row_number() OVER (ORDER BY score DESC, name)::INT AS rank FROM m""",
)
def leaderboard_promote(t: Tables) -> DataFrame:
    """An entry removed, one added, and all ranked again."""
    board = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.round(F.avg("c_acctbal"), 4).alias("score"))
    gone = t.spark.createDataFrame([("BUILDING",)], "name string")
    now = board.join(gone, "name", "left_anti").unionByName(t.spark.createDataFrame([("NEW", 4500.0)], "name string, score double"))
    return ranking.leaderboard(now, "name", ["score"])


@query("v14_cleanup", "SELECT s_suppkey FROM supplier WHERE NOT (contains(lower(s_name), '7') OR contains(s_nationkey::VARCHAR, '1'))")
def cleanup(t: Tables) -> DataFrame:
    return t.supplier.where(~(F.contains(F.lower("s_name"), F.lit("7")) | F.contains(F.col("s_nationkey").cast("string"), F.lit("1")))).select("s_suppkey")


@query("v42_count_audit", "SELECT count(*) FILTER (n < 10) AS lt, count(*) FILTER (n = 10) AS eq, count(*) FILTER (n > 10) AS gt, median(n) AS middle FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def count_audit(t: Tables) -> DataFrame:
    n = F.col("n")
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(n < 10).alias("lt"), F.count_if(n == 10).alias("eq"), F.count_if(n > 10).alias("gt"), F.median("n").alias("middle"))


@query(
    "v59_reviewer_agreement",
    """SELECT l_partkey, count(*) AS n, CASE WHEN count(*) < 2 THEN 'INELIGIBLE' WHEN count(DISTINCT (l_returnflag, l_linestatus)) = 1 THEN 'ELIGIBLE' ELSE 'ADJUDICATE' END AS route FROM lineitem GROUP BY 1""",
)
def reviewer_agreement(t: Tables) -> DataFrame:
    n, kinds = F.count(F.lit(1)), F.countDistinct("l_returnflag", "l_linestatus")
    return t.lineitem.groupBy("l_partkey").agg(n.alias("n"), F.when(n < 2, F.lit("INELIGIBLE")).when(kinds == 1, F.lit("ELIGIBLE")).otherwise("ADJUDICATE").alias("route"))


@query("q11_monotone_times", "SELECT user_id, bool_and(coalesce(ts >= prev, true)) AS sound, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY 1")
def monotone_times(t: Tables) -> DataFrame:
    prev = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select("user_id", "ts", F.coalesce(F.col("ts") >= prev, F.lit(True)).alias("ok"))
    return rows.groupBy("user_id").agg(F.bool_and("ok").alias("sound"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("q22_conflicting_labels", "SELECT text, count(DISTINCT quality) AS labels FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1 UNION ALL SELECT 'total', count(*) FROM labels")
def conflicting_labels(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), "text").join(t.labels, "doc_id")
    bad = rows.groupBy("h").agg(F.countDistinct("quality").alias("labels"), F.first("text").alias("text")).where("labels > 1").select("text", "labels")
    return bad.unionByName(t.labels.agg(F.count(F.lit(1)).alias("labels")).select(F.lit("total").alias("text"), "labels"))


@query(
    "x51_certificate_policies",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 30 THEN 'SUPPORTED' WHEN l_quantity < 5 THEN 'CONTRADICTED' ELSE 'UNCERTAIN' END AS o, l_discount > 0.04 AS spatial, l_tax > 0.03 AS contrast FROM lineitem),
p AS (SELECT * FROM (VALUES ('original', false, false), ('spatial', true, false), ('full', true, true)) p(policy, needs_spatial, needs_contrast))
SELECT policy, status, count(*) AS n FROM (SELECT policy, CASE WHEN o = 'CONTRADICTED' THEN 'REJECTED' WHEN o = 'UNCERTAIN' THEN 'UNCERTAIN' WHEN (needs_spatial AND NOT spatial) OR (needs_contrast AND NOT contrast) THEN 'UNCERTAIN' ELSE 'VERIFIED' END AS status FROM c CROSS JOIN p) GROUP BY 1, 2""",
)
def certificate_policies(t: Tables) -> DataFrame:
    """Verdicts under several policies: rows are first counted by what the verdict depends on, then met with the policies."""
    o = F.when(F.col("l_quantity") > 30, F.lit("SUPPORTED")).when(F.col("l_quantity") < 5, F.lit("CONTRADICTED")).otherwise("UNCERTAIN")
    cases = t.lineitem.groupBy(o.alias("o"), (F.col("l_discount") > 0.04).alias("spatial"), (F.col("l_tax") > 0.03).alias("contrast")).agg(F.count(F.lit(1)).alias("n"))
    policy = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(s).alias("s"), F.lit(c).alias("c")) for p, s, c in (("original", False, False), ("spatial", True, False), ("full", True, True))])
    rows = cases.withColumn("p", F.explode(policy))
    lacking = (F.col("p.s") & ~F.col("spatial")) | (F.col("p.c") & ~F.col("contrast"))
    status = F.when(F.col("o") == "CONTRADICTED", F.lit("REJECTED")).when((F.col("o") == "UNCERTAIN") | lacking, F.lit("UNCERTAIN")).otherwise("VERIFIED")
    return rows.groupBy("p.policy", status.alias("status")).agg(F.sum("n").alias("n"))


@query("e01_model_seam", "SELECT event_id, CASE WHEN value > 66 THEN 'YES' WHEN value > 33 THEN 'NO' ELSE 'INVALID' END AS answer FROM events")
def model_seam(t: Tables) -> DataFrame:
    """Requests answered by a stand-in for a model, batch by batch within partitions; the answers are then read as text."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"event_id": b["event_id"], "raw": [" yes. " if v > 66 else "No" if v > 33 else "?" for v in b["value"]]})

    rows = t.events.select("event_id", "value").mapInPandas(infer, "event_id long, raw string")
    return rows.select("event_id", text.yes_no(F.col("raw")).alias("answer"))

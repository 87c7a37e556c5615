"""Queries of aggregates, pivots and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import aggregates

from .registry import Tables, query


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("a01_count_by_type", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def count_by_type(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "a03_pooled_where_several",
    """WITH s AS (SELECT l_returnflag AS d, l_linenumber AS fps, avg(l_discount) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT d, fps::VARCHAR AS fps, round(m, 6) AS mean, n FROM s UNION ALL SELECT l_returnflag, 'all', round(avg(l_discount), 6), count(*) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1""",
)
def pooled_where_several(t: Tables) -> DataFrame:
    sets = t.lineitem.groupingSets([[F.col("l_returnflag"), F.col("l_linenumber")], [F.col("l_returnflag")]], "l_returnflag", "l_linenumber").agg(
        F.grouping("l_linenumber").alias("g"), F.round(F.avg("l_discount"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi")
    )
    return sets.where("g = 0 OR lo != hi").select(F.col("l_returnflag").alias("d"), F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("l_linenumber").cast("string")).alias("fps"), "mean", "n")


@query(
    "a04_threshold_shares",
    """SELECT p_brand, round(avg(m), 6) AS mean, round(avg((m >= 20)::INT), 6) AS at_20, round(avg((m >= 25)::INT), 6) AS at_25, round(avg((m >= 30)::INT), 6) AS at_30, count(*) AS n
FROM (SELECT l_partkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def threshold_shares(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("m"))
    share = lambda x: F.round(F.avg(F.when(F.col("m") >= x, 1).otherwise(0)), 6).alias(f"at_{x}")
    return m.join(t.part, "p_partkey").groupBy("p_brand").agg(F.round(F.avg("m"), 6).alias("mean"), share(20), share(25), share(30), F.count(F.lit(1)).alias("n"))


@query(
    "a07_balanced_accuracy",
    """WITH p AS (SELECT lang, quality, (n_chars > 1000)::INT AS pred FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, quality, count(*) AS n, count(*) FILTER (quality = pred) AS ok FROM p GROUP BY 1, 2)
SELECT lang, round(sum(ok) / sum(n), 6) AS accuracy, round(avg(ok / n), 6) AS balanced_accuracy, sum(n)::BIGINT AS n FROM c GROUP BY 1""",
)
def balanced_accuracy(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select("lang", "quality", (F.col("n_chars") > 1000).cast("int").alias("pred"))
    return _rounded(aggregates.balanced_accuracy(rows, ["lang"], "quality", "pred"), "accuracy", "balanced_accuracy")


@query(
    "a11_micro_macro",
    """SELECT round(sum(ok) / sum(n), 6) AS micro, round(avg(ok / n), 6) AS macro FROM (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS ok FROM documents JOIN labels USING (doc_id) GROUP BY 1)""",
)
def micro_macro(t: Tables) -> DataFrame:
    per = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("ok"))
    return per.agg(F.round(F.sum("ok") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("ok") / F.col("n")), 6).alias("macro"))


@query("a12_weighted_pooling", "SELECT l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS pooled, sum(l_quantity) AS weight FROM lineitem GROUP BY 1")
def weighted_pooling(t: Tables) -> DataFrame:
    return _rounded(aggregates.pooled(t.lineitem, ["l_linestatus"], "l_discount", "l_quantity"), "pooled")


@query(
    "a15_mean_without_zeros",
    "SELECT l_suppkey, round(avg(nullif(l_discount, 0)), 6) AS discount, round(avg(nullif(l_tax, 0)), 6) AS tax, round((coalesce(avg(nullif(l_discount, 0)), 0) + coalesce(avg(nullif(l_tax, 0)), 0)) / 2, 6) AS both FROM lineitem GROUP BY 1",
)
def mean_without_zeros(t: Tables) -> DataFrame:
    mean = lambda c: F.avg(F.when(F.col(c) != 0, F.col(c)))
    zero = lambda c: F.coalesce(mean(c), F.lit(0.0))
    return t.lineitem.groupBy("l_suppkey").agg(F.round(mean("l_discount"), 6).alias("discount"), F.round(mean("l_tax"), 6).alias("tax"), F.round((zero("l_discount") + zero("l_tax")) / 2, 6).alias("both"))


_JUDGE = """SELECT {d} AS dimension, {v} AS value, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem {g}"""


@query(
    "a17_grouping_sets_judge",
    " UNION ALL ".join(
        _JUDGE.format(d=d, v=v, g=g)
        for d, v, g in (("'overall'", "'all'", ""), ("'task'", "l_returnflag", "GROUP BY l_returnflag"), ("'dataset'", "l_linestatus", "GROUP BY l_linestatus"), ("'task_dataset'", "l_returnflag || '::' || l_linestatus", "GROUP BY l_returnflag, l_linestatus"))
    ),
)
def grouping_sets_judge(t: Tables) -> DataFrame:
    dims = {"overall": [], "task": ["l_returnflag"], "dataset": ["l_linestatus"], "task_dataset": ["l_returnflag", "l_linestatus"]}
    return aggregates.by_dimensions(t.lineitem, dims, mean=F.round(F.avg("l_discount"), 6), n=F.count(F.lit(1)))


@query(
    "a19_confusion_pivot",
    """SELECT quality, count(*) FILTER (p = 0) AS pred_0, count(*) FILTER (p = 1) AS pred_1, count(*) FILTER (p = 2) AS pred_2, count(*) AS total
FROM (SELECT quality, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1""",
)
def confusion_pivot(t: Tables) -> DataFrame:
    p = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2)
    return aggregates.confusion(t.documents.join(t.labels, "doc_id").select("quality", p.alias("p")), "quality", "p", [0, 1, 2])


@query("a21_fixed_list_with_zeros", "SELECT k AS kind, count(event_id) AS n FROM (VALUES ('view'), ('refund'), ('error')) v(k) LEFT JOIN events ON k = event_type GROUP BY 1")
def fixed_list(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([("view",), ("refund",), ("error",)], "kind string")
    counts = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "a24_micro_macro_families",
    """WITH f AS (SELECT l_suppkey, l_linenumber % 3 AS fam, count(*) FILTER (l_linestatus = 'F') AS valid, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS yes FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, round(sum(yes) / nullif(sum(valid), 0), 6) AS micro, round(avg(yes / nullif(valid, 0)), 6) AS macro, sum(valid)::BIGINT AS n_included FROM f GROUP BY 1""",
)
def micro_macro_families(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("fam", F.col("l_linenumber") % 3)
    return _rounded(aggregates.family_scores(rows, ["l_suppkey"], "fam", F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"), "micro", "macro")


@query(
    "a25_paired_deltas",
    """WITH g AS (SELECT l_suppkey, avg(l_discount) FILTER (l_returnflag = 'R') AS mp, avg(l_discount) FILTER (l_returnflag = 'A') AS mn, median(l_discount) FILTER (l_returnflag = 'R') AS dp, median(l_discount) FILTER (l_returnflag = 'A') AS dn,
 count(l_discount) FILTER (l_returnflag = 'R') AS n_pos, count(l_discount) FILTER (l_returnflag = 'A') AS n_neg FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(mp, 6) AS mean_pos, round(mn, 6) AS mean_neg, round(dp, 6) AS median_pos, round(dn, 6) AS median_neg, n_pos, n_neg, round(mp - mn, 6) AS delta FROM g WHERE n_pos > 0 AND n_neg > 0""",
)
def paired_deltas(t: Tables) -> DataFrame:
    out = aggregates.paired_deltas(t.lineitem, "l_suppkey", "l_returnflag", "R", "A", "l_discount")
    return _rounded(out, "mean_pos", "mean_neg", "median_pos", "median_neg", "delta")


@query(
    "a30_distribution_stats",
    """SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
 round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders GROUP BY 1""",
)
def distribution_stats(t: Tables) -> DataFrame:
    return _rounded(aggregates.distribution(t.orders, ["o_orderpriority"], "o_totalprice"), "mean", "std", "q1", "median", "q3", "iqr", digits=4)


@query("a34_sign_counts", "SELECT c_mktsegment, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_acctbal = 0) AS zero, count(*) FILTER (c_acctbal < 0) AS negative FROM customer GROUP BY 1")
def sign_counts(t: Tables) -> DataFrame:
    return aggregates.signs(t.customer, ["c_mktsegment"], "c_acctbal")


@query(
    "a40_causal_scores",
    """SELECT user_id, round((keep + 1 - drp) / 2, 6) AS c_s FROM (SELECT user_id, avg((value > 50)::INT) FILTER (event_type = 'view') AS keep, avg((value > 50)::INT) FILTER (event_type = 'error') AS drp FROM events GROUP BY 1)""",
)
def causal_scores(t: Tables) -> DataFrame:
    share = lambda k: F.avg(F.when(F.col("event_type") == k, (F.col("value") > 50).cast("int")))
    return t.events.groupBy("user_id").agg(F.round((share("view") + 1 - share("error")) / 2, 6).alias("c_s"))


@query("a48_repeat_count", "SELECT l_suppkey, sum(n - 1)::BIGINT AS repeats FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def repeat_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).groupBy("l_suppkey").agg(F.sum(F.col("n") - 1).alias("repeats"))


@query(
    "a56_claim_aggregation",
    """WITH c AS (SELECT user_id AS claim_id, date_trunc('day', ts)::DATE AS scope, CASE WHEN event_type = 'purchase' AND value > 80 THEN 'VERIFIED' WHEN event_type = 'error' AND value > 80 THEN 'REJECTED' ELSE 'UNCERTAIN' END AS s FROM events),
p AS (SELECT claim_id, scope, bool_or(s = 'VERIFIED') AS v, bool_or(s = 'REJECTED') AS r FROM c GROUP BY 1, 2), k AS (SELECT user_id AS claim_id, min(date_trunc('day', ts))::DATE AS own FROM events GROUP BY 1)
SELECT claim_id, CASE WHEN bool_or(v AND r) THEN 'CONFLICT' WHEN bool_or(v) THEN 'SUPPORTED' WHEN bool_or(r AND scope = own) THEN 'CONTRADICTED' ELSE 'INSUFFICIENT' END AS status FROM k JOIN p USING (claim_id) GROUP BY 1""",
)
def claim_aggregation(t: Tables) -> DataFrame:
    e = t.events.withColumn("day", F.to_date("ts"))
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 80), F.lit("VERIFIED")).when((F.col("event_type") == "error") & (F.col("value") > 80), F.lit("REJECTED")).otherwise("UNCERTAIN")
    certificates = e.select(F.col("user_id").alias("claim_id"), F.col("day").alias("c_scope"), kind.alias("final_status"))
    claims = e.groupBy(F.col("user_id").alias("claim_id")).agg(F.min("day").alias("scope"))
    return aggregates.claim_status(certificates, claims)


@query(
    "a57_coverage",
    """WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS ok FROM orders) SELECT o_custkey, count(*) AS n_required, count(*) FILTER (ok) AS n_supported, CASE WHEN bool_and(ok) THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS coverage FROM s GROUP BY 1""",
)
def coverage(t: Tables) -> DataFrame:
    required = t.orders.select("o_custkey", F.col("o_orderkey").alias("claim_id"))
    statuses = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", F.lit("SUPPORTED")).otherwise("INSUFFICIENT").alias("status"))
    return aggregates.coverage(required, statuses, "o_custkey")


@query("a58_strict_totals", "SELECT l_suppkey, CASE WHEN count(nullif(l_discount, 0)) = count(*) THEN round(sum(nullif(l_discount, 0)), 6) END AS strict, round(coalesce(sum(nullif(l_discount, 0)), 0), 6) AS loose FROM lineitem GROUP BY 1")
def strict_totals(t: Tables) -> DataFrame:
    v = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return t.lineitem.groupBy("l_suppkey").agg(F.round(aggregates.strict_sum(v), 6).alias("strict"), F.round(F.coalesce(F.sum(v), F.lit(0.0)), 6).alias("loose"))


@query(
    "a69_signed_rank",
    """WITH RECURSIVE m AS (SELECT l_partkey, avg(l_quantity) AS mean FROM lineitem GROUP BY 1), v AS (SELECT l_orderkey AS k, round(l_quantity - mean, 6) AS d FROM lineitem JOIN m USING (l_partkey)),
z AS (SELECT k, d, 2 * rank() OVER (PARTITION BY k ORDER BY abs(d)) + count(*) OVER (PARTITION BY k, abs(d)) - 1 AS r2, row_number() OVER (PARTITION BY k ORDER BY abs(d), d) AS i FROM v WHERE abs(d) > 1e-12),
g AS (SELECT k, count(*) AS n, sum(r2) AS total, sum(r2) FILTER (d > 0) AS plus FROM z GROUP BY 1),
w(k, i, ways) AS (SELECT k, 0::BIGINT, list_prepend(1::BIGINT, list_transform(range(total::BIGINT), lambda x: 0::BIGINT)) FROM g WHERE n <= 20
 UNION ALL SELECT w.k, w.i + 1, list_transform(range(len(ways)), lambda j: ways[j + 1] + CASE WHEN j >= z.r2 THEN ways[j - z.r2 + 1] ELSE 0 END) FROM w JOIN z ON z.k = w.k AND z.i = w.i + 1),
f AS (SELECT w.k, ways FROM w JOIN g ON w.k = g.k AND w.i = g.n),
c AS (SELECT k, count(*)::DOUBLE AS n, count(*) FILTER (abs(d) <= 1e-12)::DOUBLE AS n_zero FROM v GROUP BY 1)
SELECT c.k AS l_orderkey, c.n, c.n_zero, CASE WHEN g.n > 20 THEN NULL ELSE coalesce(plus, 0) / 2 END AS w_plus, CASE WHEN g.n > 20 THEN NULL ELSE (coalesce(total, 0) - coalesce(plus, 0)) / 2 END AS w_minus,
  CASE WHEN g.n > 20 THEN NULL WHEN total > 0 THEN (2 * coalesce(plus, 0) - total) / total ELSE 0 END AS rank_biserial,
  CASE WHEN g.n > 20 THEN NULL WHEN g.n IS NULL THEN 1 ELSE least(1, 2 * list_sum(ways[1:least(coalesce(plus, 0), total - coalesce(plus, 0))::BIGINT + 1]) / 2 ** g.n) END AS p_value, CASE WHEN g.n > 20 THEN 'TOO_MANY' ELSE 'OK' END AS status
FROM c LEFT JOIN g USING (k) LEFT JOIN f USING (k)""",
)
def signed_rank(t: Tables) -> DataFrame:
    """The quantities of each order's lines against the mean quantity of their part, over all lines."""
    means = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean"))
    rows = t.lineitem.join(means.withColumnRenamed("l_partkey", "m_partkey"), F.col("l_partkey").eqNullSafe(F.col("m_partkey")))
    return aggregates.signed_rank(rows.select("l_orderkey", F.round(F.col("l_quantity") - F.col("mean"), 6).alias("delta")), ["l_orderkey"], "delta")


@query(
    "v19_upper_median",
    """SELECT p_brand, v[len(v) // 2 + 1] AS upper_median, round(len(list_filter(v, lambda x: x > 40)) / greatest(1, len(v)), 6) AS tail FROM (SELECT p_brand, list(p_size ORDER BY p_size) AS v FROM part GROUP BY 1)""",
)
def upper_median(t: Tables) -> DataFrame:
    """The value at place n div 2, zero-based: by rank, so that no group is gathered."""
    from pyspark.sql import Window

    sizes = t.part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("p_brand").orderBy("p_size")
    placed = sizes.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("p_brand")))
    return placed.groupBy("p_brand").agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("p_size"))).alias("upper_median"), F.round(F.coalesce(F.sum(F.when(F.col("p_size") > 40, F.col("c"))), F.lit(0)) / F.max("n"), 6).alias("tail"))


@query(
    "v09_wide_pivot",
    "SELECT l_returnflag, " + ", ".join(f"round(avg(l_discount) FILTER (l_linenumber = {k}), 6) AS m_{k}" for k in range(1, 8)) + " FROM lineitem GROUP BY 1",
)
def wide_pivot(t: Tables) -> DataFrame:
    out = t.lineitem.groupBy("l_returnflag").pivot("l_linenumber", list(range(1, 8))).agg(F.round(F.avg("l_discount"), 6))
    return out.withColumnsRenamed({str(k): f"m_{k}" for k in range(1, 8)})

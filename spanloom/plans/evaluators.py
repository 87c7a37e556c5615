"""Queries of evaluators: from answers and truths to scores by class, group and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import aggregates, matching

from .registry import Tables, query
from .temporal import _SIDES, _sides


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def _share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("int")), 6)


_HITS = f"""WITH {_SIDES}, t AS (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold), np AS (SELECT k, count(*) AS np FROM pr GROUP BY 1), ng AS (SELECT k, count(*) AS ng FROM gt GROUP BY 1),
h AS (SELECT k, threshold, count(DISTINCT p) AS hp, count(DISTINCT g) AS hg FROM io JOIN t ON iou > threshold GROUP BY 1, 2),
s AS (SELECT k, avg(coalesce(hp, 0) / np) AS precision, avg(coalesce(hg, 0) / ng) AS recall FROM np JOIN ng USING (k) CROSS JOIN t LEFT JOIN h USING (k, threshold) GROUP BY 1)"""


def _temporal_f1(t: Tables) -> DataFrame:
    """k, precision, recall, f1 of the keys that have both sides: means over thresholds, then the harmonic mean of the means."""
    preds, truths = _sides(t)
    sizes = preds.groupBy("k").agg(F.count(F.lit(1)).alias("np")).join(truths.groupBy("k").agg(F.count(F.lit(1)).alias("ng")), "k")
    pairs = matching.pairs(preds, truths, ["k"]).where("iou > 0.3")
    best = lambda side: pairs.groupBy("k", side).agg(F.max("iou").alias("iou")).groupBy("k").agg(*[F.count_if(F.col("iou") > x).alias(f"{side}{int(10 * x)}") for x in (0.3, 0.5, 0.7)])
    rows = sizes.join(best("p"), "k", "left").join(best("g"), "k", "left").fillna(0)
    mean = lambda side, of: (F.col(f"{side}3") / F.col(of) + F.col(f"{side}5") / F.col(of) + F.col(f"{side}7") / F.col(of)) / 3
    rows = rows.select("k", mean("p", "np").alias("precision"), mean("g", "ng").alias("recall"))
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


@query("a05_temporal_f1", _HITS + " SELECT k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM s")
def temporal_f1(t: Tables) -> DataFrame:
    return _temporal_f1(t).select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "a06_dvc_by_dataset",
    _HITS + """ SELECT o_orderpriority, count(*) AS n, count(s.k) AS scored, round(avg(CASE WHEN s.k IS NOT NULL THEN CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END END), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall
FROM orders LEFT JOIN s ON k = o_orderkey GROUP BY 1""",
)
def dvc_by_dataset(t: Tables) -> DataFrame:
    """Records without a prediction or truth aren't scored, but counted."""
    rows = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority").join(_temporal_f1(t), "k", "left")
    return rows.groupBy("o_orderpriority").agg(_n(), F.count("f1").alias("scored"), *[F.round(F.avg(c), 6).alias(c) for c in ("f1", "precision", "recall")])


@query(
    "v08_matches_at_thresholds",
    f"""WITH {_SIDES}, t AS (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold), b AS (SELECT k, p, arg_min(g, (-iou, g)) AS g, max(iou) AS iou FROM io GROUP BY 1, 2)
SELECT k, p, threshold, g, round(iou, 6) AS iou FROM b JOIN t ON iou >= threshold""",
)
def matches_at_thresholds(t: Tables) -> DataFrame:
    """The best truth of each prediction, found once and dealt to the thresholds that it passes."""
    preds, truths = _sides(t)
    best = matching.best(matching.pairs(preds, truths, ["k"]), ["k"], 0.3)
    passed = F.filter(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7)]), lambda x: F.col("iou") >= x)
    return best.select("k", "p", F.explode(passed).alias("threshold"), "g", F.round("iou", 6).alias("iou"))


@query(
    "a16_offline_judge",
    f"""WITH {_SIDES}, t AS (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold), b AS (SELECT k, p, max(iou) AS iou FROM io GROUP BY 1, 2), m AS (SELECT k, p, threshold, (k + p) % 5 + 1 AS score FROM b JOIN t ON iou >= threshold)
SELECT coalesce(threshold::VARCHAR, 'overall') AS threshold, count(*) AS n, round(avg(score), 6) AS score FROM m GROUP BY ROLLUP (threshold)""",
)
def offline_judge(t: Tables) -> DataFrame:
    """Scores of the matched pairs at each threshold, and over all of them."""
    preds, truths = _sides(t)
    best = matching.pairs(preds, truths, ["k"]).where("iou >= 0.3").groupBy("k", "p").agg(F.max("iou").alias("iou"))
    passed = F.filter(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7)]), lambda x: F.col("iou") >= x)
    rows = best.select(F.explode(passed).alias("threshold"), ((F.col("k") + F.col("p")) % 5 + 1).alias("score"))
    return rows.rollup("threshold").agg(_n(), F.round(F.avg("score"), 6).alias("score")).withColumn("threshold", F.coalesce(F.col("threshold").cast("string"), F.lit("overall")))


_PARTS = {"two_structures": ("l_suppkey", "l_quantity"), "cystic_plate": ("l_partkey", "l_linenumber"), "triangle": ("l_orderkey", "l_suppkey")}


@query(
    "a08_cvs_components",
    """WITH c AS (SELECT l_suppkey % 3 AS p1, l_quantity::BIGINT % 3 AS t1, l_partkey % 3 AS p2, l_linenumber % 3 AS t2, l_orderkey % 3 AS p3, l_suppkey % 3 AS t3 FROM lineitem),
e AS (SELECT 'two_structures' AS component, p1 AS p, t1 AS t FROM c UNION ALL SELECT 'cystic_plate', p2, t2 FROM c UNION ALL SELECT 'triangle', p3, t3 FROM c)
SELECT component, count(*) AS n, round(avg((p = t)::INT), 6) AS accuracy, round(avg(abs(p - t)), 6) AS mae FROM e GROUP BY 1""",
)
def cvs_components(t: Tables) -> DataFrame:
    """Accuracy and mean error of each component: one aggregate of all components, then unpivoted."""
    of = lambda c: F.col(c).cast("long") % 3
    cells = [F.struct(F.lit(k).alias("component"), _n(), _share(of(p) == of(v)).alias("accuracy"), F.round(F.avg(F.abs(of(p) - of(v))), 6).alias("mae")).alias(k) for k, (p, v) in _PARTS.items()]
    return t.lineitem.agg(*cells).select(F.explode(F.array(*_PARTS)).alias("x")).select("x.*")


@query(
    "a08_cvs_ratings",
    """WITH c AS (SELECT l_suppkey % 3 + l_partkey % 3 + l_orderkey % 3 AS p, l_quantity::BIGINT % 3 + l_linenumber % 3 + l_suppkey % 3 AS t FROM lineitem), r AS (SELECT CASE WHEN p <= 1 THEN 'poor' WHEN p <= 3 THEN 'fair' WHEN p <= 5 THEN 'good' ELSE 'excellent' END AS p, CASE WHEN t <= 1 THEN 'poor' WHEN t <= 3 THEN 'fair' WHEN t <= 5 THEN 'good' ELSE 'excellent' END AS t FROM c)
SELECT coalesce(t, 'overall') AS rating, count(*) AS n, round(avg((p = t)::INT), 6) AS accuracy FROM r GROUP BY ROLLUP (t)""",
)
def cvs_ratings(t: Tables) -> DataFrame:
    total = lambda cs: F.when((s := sum((F.col(c).cast("long") % 3 for c in cs), F.lit(0))) <= 1, "poor").when(s <= 3, "fair").when(s <= 5, "good").otherwise("excellent")
    rows = t.lineitem.select(total([p for p, _ in _PARTS.values()]).alias("p"), total([v for _, v in _PARTS.values()]).alias("rating"))
    out = rows.rollup("rating").agg(_n(), _share(F.col("p") == F.col("rating")).alias("accuracy"), F.grouping("rating").alias("g"))
    return out.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("rating")).alias("rating"), "n", "accuracy")


@query(
    "a09_skill_levels",
    """WITH s AS (SELECT CASE l_returnflag WHEN 'A' THEN 'novice' WHEN 'N' THEN 'intermediate' END AS p, CASE WHEN l_quantity <= 20 THEN 'novice' WHEN l_quantity <= 35 THEN 'intermediate' ELSE 'expert' END AS t, abs(l_linenumber % 5 - l_suppkey % 5) AS err FROM lineitem)
SELECT coalesce(t, 'overall') AS level, count(*) AS n, round(avg((p = t)::INT), 6) AS accuracy, round(avg(err), 6) AS mae FROM s WHERE p IS NOT NULL GROUP BY ROLLUP (t)""",
)
def skill_levels(t: Tables) -> DataFrame:
    """Rows whose level can't be read are left out before anything is counted."""
    p = F.when(F.col("l_returnflag") == "A", "novice").when(F.col("l_returnflag") == "N", "intermediate")
    level = F.when(F.col("l_quantity") <= 20, "novice").when(F.col("l_quantity") <= 35, "intermediate").otherwise("expert")
    rows = t.lineitem.select(p.alias("p"), level.alias("level"), F.abs(F.col("l_linenumber") % 5 - F.col("l_suppkey") % 5).alias("err")).where("p IS NOT NULL")
    out = rows.rollup("level").agg(_n(), _share(F.col("p") == F.col("level")).alias("accuracy"), F.round(F.avg("err"), 6).alias("mae"), F.grouping("level").alias("g"))
    return out.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("level")).alias("level"), "n", "accuracy", "mae")


@query(
    "a10_next_action",
    """WITH n AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, user_id % 3 AS fps FROM events)
SELECT coalesce(fps::VARCHAR, 'overall') AS fps, count(*) AS n, round(avg((event_type = nxt)::INT), 6) AS accuracy FROM n WHERE nxt IS NOT NULL GROUP BY ROLLUP (fps)""",
)
def next_action(t: Tables) -> DataFrame:
    """The last action as a guess of the next one, by frame rate and overall."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select("event_type", nxt.alias("nxt"), (F.col("user_id") % 3).alias("fps")).where("nxt IS NOT NULL")
    out = rows.rollup("fps").agg(_n(), _share(F.col("event_type") == F.col("nxt")).alias("accuracy"))
    return out.withColumn("fps", F.coalesce(F.col("fps").cast("string"), F.lit("overall")))


@query(
    "a18_counters_and_conditionals",
    """SELECT l_linestatus, count(*) AS windows, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'N') AS no, count(*) FILTER (l_returnflag = 'R') AS invalid,
  round(count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag <> 'R'), 0), 6) AS p_yes, round(count(*) FILTER (l_returnflag = 'A' AND l_discount > 0.095) / nullif(count(*) FILTER (l_discount > 0.095), 0), 6) AS p_yes_strong FROM lineitem GROUP BY 1""",
)
def counters(t: Tables) -> DataFrame:
    of = lambda f: F.count_if(F.col("l_returnflag") == f)
    strong = F.col("l_discount") > 0.095
    return t.lineitem.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("windows"), of("A").alias("yes"), of("N").alias("no"), of("R").alias("invalid"),
        F.round(F.try_divide(of("A"), F.count_if(F.col("l_returnflag") != "R")), 6).alias("p_yes"),
        F.round(F.try_divide(F.count_if(strong & (F.col("l_returnflag") == "A")), F.count_if(strong)), 6).alias("p_yes_strong"),
    )


@query(
    "a22_by_duration_bin",
    """WITH d(bin, pos, low, high) AS (VALUES ('short', 1, 0, 10), ('medium', 2, 10, 30), ('long', 3, 30, 60), ('very_long', 4, 60, 1000))
SELECT d.bin, d.pos, count(l_orderkey) AS n, round(avg(l_discount), 6) AS mean FROM d LEFT JOIN lineitem ON l_quantity >= low AND l_quantity < high GROUP BY 1, 2""",
)
def by_duration(t: Tables) -> DataFrame:
    """Bins in a fixed order, empty ones too; rows get their bin by an expression and are counted before they meet the list."""
    bins = [("short", 1, 10), ("medium", 2, 30), ("long", 3, 60), ("very_long", 4, 1000)]
    mark = F
    for name, _, high in bins:
        mark = mark.when(F.col("l_quantity") < high, name)
    counts = t.lineitem.groupBy(mark.alias("bin")).agg(_n(), F.round(F.avg("l_discount"), 6).alias("mean"))
    order = t.spark.createDataFrame([(b, p) for b, p, _ in bins], "bin string, pos int")
    return F.broadcast(order).join(counts, "bin", "left").select("bin", "pos", F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query(
    "a26_retention_matrix",
    """SELECT l_suppkey, max(r) FILTER (l_linenumber = 1) AS t1, max(r) FILTER (l_linenumber = 2) AS t2, max(r) FILTER (l_linenumber = 3) AS t3, max(r) FILTER (l_linenumber = 4) AS t4, max(r) FILTER (l_linenumber = 5) AS t5, max(r) FILTER (l_linenumber = 6) AS t6, max(r) FILTER (l_linenumber = 7) AS t7
FROM (SELECT l_suppkey, l_linenumber, round(avg((l_returnflag = 'A')::INT), 6) AS r FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def retention_matrix(t: Tables) -> DataFrame:
    out = t.lineitem.groupBy("l_suppkey").pivot("l_linenumber", list(range(1, 8))).agg(_share(F.col("l_returnflag") == "A"))
    return out.select("l_suppkey", *[F.col(str(k)).alias(f"t{k}") for k in range(1, 8)])


@query(
    "a29_stability_and_usable",
    """SELECT c.o_orderpriority, n, stability, usable FROM (SELECT o_orderpriority, count(*) AS n, round(avg((l_returnflag = 'A')::INT), 6) AS stability FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) c
JOIN (SELECT o_orderpriority, count(*) AS usable FROM (SELECT o_orderkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')) GROUP BY 1) q USING (o_orderpriority)""",
)
def stability_and_usable(t: Tables) -> DataFrame:
    """Both counts from one pass: lines to orders, orders to groups."""
    of = lambda f: F.count_if(F.col("l_returnflag") == f).alias(f.lower())
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(_n(), of("A"), of("R")).join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    usable = F.count_if((F.col("a") > 0) & (F.col("r") > 0)).alias("usable")
    return per.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("a") / F.sum("n"), 6).alias("stability"), usable)


@query(
    "a35_a68_cohort_summary",
    """SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS candidates, count(DISTINCT l_suppkey) AS groups, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'R') AS invalid FROM lineitem WHERE l_linestatus = 'O'""",
)
def cohort_summary(t: Tables) -> DataFrame:
    of = lambda f: F.count_if(F.col("l_returnflag") == f)
    return t.lineitem.where("l_linestatus = 'O'").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("l_orderkey").alias("candidates"), F.countDistinct("l_suppkey").alias("groups"),
        F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.median("l_quantity"), 6).alias("median"), of("A").alias("yes"), of("R").alias("invalid"),
    )


@query(
    "a38_dynamic_sensitivity",
    """WITH p AS (SELECT l_orderkey, avg(l_discount) FILTER (l_returnflag = 'A') AS shuffle, avg(l_discount) FILTER (l_returnflag = 'N') AS block, avg(l_discount) FILTER (l_returnflag = 'R') AS frozen FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(shuffle, 6) AS shuffle, round(block, 6) AS block, round(frozen, 6) AS frozen, round(list_avg(list_filter([shuffle, block], lambda x: x IS NOT NULL)), 6) AS order_mean, round(list_avg(list_filter([shuffle, block, frozen], lambda x: x IS NOT NULL)), 6) AS all_mean FROM p""",
)
def dynamic_sensitivity(t: Tables) -> DataFrame:
    """Three types as columns, and means over those that are there."""
    out = t.lineitem.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_discount")).toDF("l_orderkey", "shuffle", "block", "frozen")

    def mean(*cs: str) -> Column:
        there = F.array_compact(F.array(*cs))
        return F.round(F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there)), 6)

    return out.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("shuffle", "block", "frozen")], mean("shuffle", "block").alias("order_mean"), mean("shuffle", "block", "frozen").alias("all_mean"))


@query(
    "a41_a43_control_advantage",
    """WITH p AS (SELECT o_custkey, l_orderkey, max(l_linenumber % 2) FILTER (l_returnflag = 'A') AS keep, max(l_suppkey % 2) FILTER (l_returnflag = 'N') AS dropped, avg(l_partkey % 2) FILTER (l_returnflag = 'R') AS control FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
s AS (SELECT *, (keep + 1 - dropped) / 2 AS causal, (control - dropped) AS advantage FROM p)
SELECT o_custkey, count(causal) AS n, round(avg(causal), 6) AS causal, round(avg(advantage), 6) + 0 AS advantage FROM s GROUP BY 1 HAVING count(causal) > 0""",
)
def control_advantage(t: Tables) -> DataFrame:
    """Scores of candidates, null where a part lacks, then means of their question."""
    when = lambda f, c: F.when(F.col("l_returnflag") == f, F.col(c) % 2)
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(when("A", "l_linenumber")).alias("keep"), F.max(when("N", "l_suppkey")).alias("drop"), F.avg(when("R", "l_partkey")).alias("control"))
    rows = per.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    causal = (F.col("keep") + 1 - F.col("drop")) / 2
    out = rows.groupBy("o_custkey").agg(F.count(causal).alias("n"), F.round(F.avg(causal), 6).alias("causal"), F.round(F.avg(F.col("control") - F.col("drop")), 6).alias("advantage"))
    return out.where("n > 0")


@query(
    "a52_uniform_spacing",
    """WITH d AS (SELECT user_id, epoch(ts) AS s, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, count(d) AS n, round(median(d), 3) AS median, round(stddev_pop(d), 3) AS spread, round(max(abs(d - m)), 3) AS worst, max(abs(d - m)) <= 60 AS uniform FROM (SELECT *, median(d) OVER (PARTITION BY user_id) AS m FROM d) GROUP BY 1""",
)
def uniform_spacing(t: Tables) -> DataFrame:
    """Distances of neighbours against their median; the largest error is at the least or the largest distance, so one aggregate does."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    d = s - F.lag(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    out = t.events.select("user_id", d.alias("d")).groupBy("user_id").agg(F.count("d").alias("n"), F.median("d").alias("m"), F.stddev_pop("d").alias("spread"), F.min("d").alias("low"), F.max("d").alias("high"))
    worst = F.greatest(F.col("m") - F.col("low"), F.col("high") - F.col("m"))
    return out.select("user_id", "n", F.round("m", 3).alias("median"), F.round("spread", 3).alias("spread"), F.round(worst, 3).alias("worst"), (worst <= 60).alias("uniform"))


@query(
    "a53_alignment_metrics",
    """WITH c AS (SELECT l_orderkey AS k, list(DISTINCT l_linenumber) AS w, list(DISTINCT l_linenumber) FILTER (l_returnflag = 'A') AS v FROM lineitem GROUP BY 1)
SELECT k, len(w) AS window_cells, coalesce(len(v), 0) AS visible, len(w) > 0 AS has_density, round(coalesce(len(v), 0) / len(w), 6) AS recall FROM c""",
)
def alignment_metrics(t: Tables) -> DataFrame:
    """Share of a window's cells that are visible, by sizes of sets."""
    w = F.collect_set("l_linenumber")
    v = F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")))
    out = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(w.alias("w"), v.alias("v"))
    both = F.size(F.array_intersect("w", "v"))
    return out.select("k", F.size("w").cast("long").alias("window_cells"), both.cast("long").alias("visible"), (F.size("w") > 0).alias("has_density"), F.round(both / F.size("w"), 6).alias("recall"))


@query(
    "a65_inventory",
    """SELECT lang, count(*) AS n, min(n_chars) AS low, round(median(n_chars), 6) AS mid, max(n_chars) AS high, count(DISTINCT source) AS sources, list_sort(min(doc_id, 3)) AS examples FROM documents GROUP BY 1""",
)
def inventory(t: Tables) -> DataFrame:
    """Counts and sizes by task, with the first three rows as examples: kept as a short sorted list, never as the whole group."""
    stats = t.documents.groupBy("lang").agg(_n(), F.min("n_chars").alias("low"), F.round(F.median("n_chars"), 6).alias("mid"), F.max("n_chars").alias("high"), F.countDistinct("source").alias("sources"))
    first = t.documents.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("r")).where("r <= 3")
    return stats.join(first.groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("examples")), "lang")


@query(
    "a67_prediction_distributions",
    """SELECT dimension, value, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) FILTER (l_returnflag = 'N') AS no, count(*) FILTER (l_returnflag = 'R') AS invalid FROM
(SELECT 'status' AS dimension, l_linestatus AS value, l_returnflag FROM lineitem UNION ALL SELECT 'line', l_linenumber::VARCHAR, l_returnflag FROM lineitem UNION ALL SELECT 'supplier', l_suppkey::VARCHAR, l_returnflag FROM lineitem
 UNION ALL SELECT 'status_line', l_linestatus || '::' || l_linenumber, l_returnflag FROM lineitem UNION ALL SELECT 'all', 'all', l_returnflag FROM lineitem) GROUP BY 1, 2""",
)
def prediction_distributions(t: Tables) -> DataFrame:
    of = lambda f: F.count_if(F.col("l_returnflag") == f)
    dims = {"status": ["l_linestatus"], "line": ["l_linenumber"], "supplier": ["l_suppkey"], "status_line": ["l_linestatus", "l_linenumber"], "all": []}
    return aggregates.by_dimensions(t.lineitem, dims, n=F.count(F.lit(1)), yes=of("A"), no=of("N"), invalid=of("R"))


@query(
    "v10_model_task_dataset_pivot",
    """SELECT c_mktsegment, round(avg(o_totalprice) FILTER (o_orderstatus = 'F' AND q = 1), 4) AS "F_1", round(avg(o_totalprice) FILTER (o_orderstatus = 'F' AND q = 2), 4) AS "F_2", round(avg(o_totalprice) FILTER (o_orderstatus = 'O' AND q = 1), 4) AS "O_1", round(avg(o_totalprice) FILTER (o_orderstatus = 'O' AND q = 2), 4) AS "O_2",
  round(avg(o_totalprice) FILTER (o_orderstatus = 'P' AND q = 1), 4) AS "P_1", round(avg(o_totalprice) FILTER (o_orderstatus = 'P' AND q = 2), 4) AS "P_2" FROM (SELECT *, o_orderkey % 2 + 1 AS q FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def model_task_dataset(t: Tables) -> DataFrame:
    """A column for each task and data set, all named beforehand, so nothing is scanned to find them."""
    rows = t.orders.select("o_custkey", "o_totalprice", F.concat_ws("_", "o_orderstatus", (F.col("o_orderkey") % 2 + 1).cast("string")).alias("cell"))
    rows = rows.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rows.groupBy("c_mktsegment").pivot("cell", [f"{s}_{q}" for s in "FOP" for q in (1, 2)]).agg(F.round(F.avg("o_totalprice"), 4))


@query(
    "v15_three_way_join",
    """SELECT o_orderkey, coalesce(r.flag, e.flag, 'ERROR') AS answer, r.flag IS NULL AND e.flag IS NULL AS missing FROM orders LEFT JOIN (SELECT l_orderkey AS k, arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey)) AS flag FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) r ON r.k = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k, 'INVALID' AS flag FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) e ON e.k = o_orderkey""",
)
def three_way_join(t: Tables) -> DataFrame:
    """Results and errors of a manifest's rows from one aggregate; results dominate, and rows with neither are errors."""
    last = F.max_by(F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")), F.when(F.col("l_returnflag") == "A", F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    bad = F.max(F.when(F.col("l_returnflag") == "R", "INVALID"))
    found = t.lineitem.where("l_returnflag != 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(last.alias("r"), bad.alias("e"))
    return t.orders.select("o_orderkey").join(found, "o_orderkey", "left").select("o_orderkey", F.coalesce("r", "e", F.lit("ERROR")).alias("answer"), (F.col("r").isNull() & F.col("e").isNull()).alias("missing"))


@query(
    "v16_diagnostic_cells",
    """SELECT a.s AS class, b.n AS type, count(l_orderkey) AS n, round(avg((l_returnflag = 'A')::INT), 6) AS p_yes FROM (VALUES ('O'), ('F'), ('Z')) a(s) CROSS JOIN (VALUES (1), (4), (9)) b(n) LEFT JOIN lineitem ON l_linestatus = a.s AND l_linenumber = b.n GROUP BY 1, 2""",
)
def diagnostic_cells(t: Tables) -> DataFrame:
    cells = t.spark.createDataFrame([(a, b) for a in ("O", "F", "Z") for b in (1, 4, 9)], "class string, type int")
    counts = t.lineitem.groupBy(F.col("l_linestatus").alias("class"), F.col("l_linenumber").alias("type")).agg(_n(), _share(F.col("l_returnflag") == "A").alias("p_yes"))
    return F.broadcast(cells).join(counts, ["class", "type"], "left").select("class", "type", F.coalesce("n", F.lit(0)).alias("n"), "p_yes")


@query("v01_v05_grouped_positions", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS position FROM events WHERE event_type = 'click' OR event_type LIKE 'p%'")
def grouped_positions(t: Tables) -> DataFrame:
    """Exact and partial matches of a type, with the position within its group."""
    at = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")) - 1
    return t.events.where((F.col("event_type") == "click") | F.col("event_type").startswith("p")).select("event_type", "event_id", at.alias("position"))


@query(
    "v11_fallback_scores",
    """WITH j AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS judge, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS pre, avg(o_totalprice) AS sim FROM orders GROUP BY 1)
SELECT o_custkey, round(coalesce(judge, pre, sim), 4) AS score, CASE WHEN judge IS NOT NULL THEN 'judge' WHEN pre IS NOT NULL THEN 'precomputed' ELSE 'similarity' END AS source FROM j""",
)
def fallback_scores(t: Tables) -> DataFrame:
    of = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    rows = t.orders.groupBy("o_custkey").agg(of("P").alias("judge"), of("F").alias("pre"), F.avg("o_totalprice").alias("sim"))
    return rows.select("o_custkey", F.round(F.coalesce("judge", "pre", "sim"), 4).alias("score"), F.when(F.col("judge").isNotNull(), "judge").when(F.col("pre").isNotNull(), "precomputed").otherwise("similarity").alias("source"))



"""Queries of timelines: cells, windows, overlaps, matching, suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import intervals, labels
from spanloom.operators import matching, timeline

from .joining import _SPANS, spans
from .registry import Tables, query


@query(
    "w03_cells_lag_lead",
    """WITH e AS (SELECT user_id, epoch(ts)::DOUBLE - min(epoch(ts)::DOUBLE) OVER (PARTITION BY user_id) AS t FROM events), p AS (SELECT DISTINCT user_id, round(t, 3) AS t FROM e)
SELECT user_id, t, round(coalesce((lag(t) OVER w + t) / 2, 0), 5) AS cell_start, round(coalesce((t + lead(t) OVER w) / 2, max(t) OVER (PARTITION BY user_id)), 5) AS cell_end FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)""",
)
def cells(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = t.events.select("user_id", us.alias("us"))
    points = e.select("user_id", F.round(F.col("us") - F.min("us").over(Window.partitionBy("user_id")), 3).alias("t")).distinct()
    points = points.withColumn("last", F.max("t").over(Window.partitionBy("user_id")))
    out = timeline.cells(points, "user_id", "t", "last")
    return out.select("user_id", "t", F.round("cell_start", 5).alias("cell_start"), F.round("cell_end", 5).alias("cell_end"))


@query("w04_deltas", "SELECT user_id, event_id, round(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts)::DOUBLE, 3) AS delta FROM events")
def deltas(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.round((F.lead(us).over(w) - us) / 1e6, 3).alias("delta"))


@query(
    "a51_frame_quality",
    """WITH d AS (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS d FROM events)
SELECT user_id, count(*) AS n, round(1 - count(DISTINCT value) / count(*), 6) AS dup_ratio, count(*) FILTER (d < 0) AS falls, min(d) AS least, round(median(d), 6) AS middle, max(d) AS most FROM d GROUP BY 1""",
)
def frame_quality(t: Tables) -> DataFrame:
    d = F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("value")
    rows = t.events.select("user_id", "value", d.alias("d"))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(1 - F.countDistinct("value") / F.count(F.lit(1)), 6).alias("dup_ratio"), F.count_if(F.col("d") < 0).alias("falls"),
        F.min("d").alias("least"), F.round(F.median("d"), 6).alias("middle"), F.max("d").alias("most"),
    )


@query(
    "g30_position_windows",
    """SELECT user_id, unnest(range(0, n - 15, 8))::INT AS start_pos, (unnest(range(0, n - 15, 8)) + 15)::INT AS end_pos FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) WHERE n >= 16""",
)
def position_windows(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return timeline.position_windows(n, "user_id", "n", 16, 8)


@query(
    "g33_pyramid_windows",
    """WITH u AS (SELECT o_custkey AS k, round((max(epoch(o_orderdate)) - min(epoch(o_orderdate)))::DOUBLE / 86400, 0) AS last FROM orders GROUP BY 1),
s AS (SELECT k, last, unnest([180.0::DOUBLE, 720.0::DOUBLE]) AS scale FROM u),
w AS (SELECT k, last, scale, unnest(CASE WHEN last > scale THEN list_append(list_transform(range(ceil((last - scale) / (scale / 2))::BIGINT), lambda i: i * (scale / 2)), greatest(0, last - scale)) ELSE [0.0::DOUBLE] END) AS start FROM s)
SELECT k, 'PYRAMID' AS role, scale, start, least(last, start + scale) AS "end" FROM w UNION ALL SELECT k, 'FULL_CLIP', last, 0, last FROM u""",
)
def pyramid_windows(t: Tables) -> DataFrame:
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    users = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.round((F.max(s) - F.min(s)) / 86400, 0).alias("last"))
    return timeline.pyramid_windows(users, "k", "last", [180.0, 720.0])


@query(
    "j15_window_membership",
    """WITH e AS (SELECT user_id, event_id, floor((epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id)) / 3600) AS h FROM events), u AS (SELECT user_id, max(h) AS last FROM e GROUP BY 1),
w AS (SELECT user_id, unnest(range(0, last::BIGINT + 1, 120)) AS s FROM u) SELECT w.user_id, s::BIGINT AS start, count(*) AS n, min(event_id) AS first_event FROM w JOIN e ON w.user_id = e.user_id AND h BETWEEN s AND s + 240 GROUP BY 1, 2""",
)
def window_membership(t: Tables) -> DataFrame:
    """Events to the overlapping windows they fall in: each event is dealt to its windows, so no window meets all events of a user."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t.events.select("user_id", "event_id", F.floor((us - F.min(us).over(Window.partitionBy("user_id"))) / 3.6e9).alias("h"))
    low = F.greatest(F.lit(0), F.ceil((F.col("h") - 240) / 120)).cast("long")
    rows = e.withColumn("start", F.explode(F.sequence(low, F.floor(F.col("h") / 120).cast("long"), F.lit(1)))).withColumn("start", F.col("start") * 120)
    return rows.groupBy("user_id", "start").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


_PAIR = "greatest(0, least(a.e, b.e) - greatest(a.s, b.s))"


@query(
    "g01_g03_interval_iou_pairs",
    f"""WITH {_SPANS} SELECT a.k, a.n AS p, b.n AS g, a.p AS pp, b.p AS gp, round(CASE WHEN greatest(a.e, b.e) > least(a.s, b.s) THEN {_PAIR} / (greatest(a.e, b.e) - least(a.s, b.s)) ELSE 0 END, 6) AS hull,
  round({_PAIR} / (least(greatest(a.e, b.e) - least(a.s, b.s), a.e - a.s + b.e - b.s) + 1e-8), 6) AS ordered, round(CASE WHEN a.e - a.s + b.e - b.s - {_PAIR} > 0 THEN {_PAIR} / (a.e - a.s + b.e - b.s - {_PAIR}) ELSE 0 END, 6) AS united
  FROM spans a JOIN spans b ON a.k = b.k AND a.f = 'R' AND b.f = 'N'""",
)
def iou_pairs(t: Tables) -> DataFrame:
    rows = spans(t)
    a = rows.where("f = 'R'").select("k", F.col("n").alias("p"), F.col("p").alias("pp"), F.col("s").alias("a1"), F.col("e").alias("a2"))
    b = rows.where("f = 'N'").select("k", F.col("n").alias("g"), F.col("p").alias("gp"), F.col("s").alias("b1"), F.col("e").alias("b2"))
    four = [F.col(c) for c in ("a1", "a2", "b1", "b2")]
    named = {"hull": intervals.iou_hull, "ordered": intervals.iou_ordered, "united": intervals.iou_union}
    return a.join(b, "k").select("k", "p", "g", "pp", "gp", *[F.round(f(*four), 6).alias(n) for n, f in named.items()])


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Predictions (returned lines) and truths (others) of orders; p and g are unique within an order."""
    rows = spans(t).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("n", "p", "s", "e", "f")))
    preds = rows.where("f = 'R'").select("k", F.col("i").alias("p"), F.col("s").alias("p_start"), F.col("e").alias("p_end"))
    return preds, rows.where("f != 'R'").select("k", F.col("i").alias("g"), F.col("s").alias("g_start"), F.col("e").alias("g_end"))


_SIDES = f"{_SPANS}, i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s, e, f) AS i FROM spans), pr AS (SELECT k, i AS p, s, e FROM i WHERE f = 'R'), gt AS (SELECT k, i AS g, s, e FROM i WHERE f <> 'R'), io AS (SELECT a.k, p, g, CASE WHEN greatest(a.e, b.e) > least(a.s, b.s) THEN {_PAIR} / (greatest(a.e, b.e) - least(a.s, b.s)) ELSE 0 END AS iou FROM pr a JOIN gt b ON a.k = b.k)"


@query(
    "j20_threshold_pairs",
    f"""WITH {_SIDES}, t AS (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS threshold)
SELECT threshold, count(DISTINCT (k, p)) AS preds_hit, count(DISTINCT (k, g)) AS truths_hit, count(*) AS pairs FROM io JOIN t ON iou > threshold GROUP BY 1""",
)
def threshold_pairs(t: Tables) -> DataFrame:
    """Several thresholds at once, from the best pair of each prediction and truth."""
    preds, truths = _sides(t)
    return matching.hits(matching.pairs(preds, truths, ["k"]), ["k"], (0.3, 0.5, 0.7))


@query("j21_best_match_per_pred", f"WITH {_SIDES} SELECT k, p, arg_min(g, (-iou, g)) AS g, round(max(iou), 6) AS iou FROM io WHERE iou >= 0.3 GROUP BY 1, 2")
def best_match(t: Tables) -> DataFrame:
    preds, truths = _sides(t)
    return matching.best(matching.pairs(preds, truths, ["k"]), ["k"], 0.3).withColumn("iou", F.round("iou", 6))


def _matched(t: Tables) -> DataFrame:
    preds, truths = _sides(t)
    p = preds.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", F.col("p_start").alias("start"), F.col("p_end").alias("end")))).alias("ps"))
    g = truths.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("g", F.col("g_start").alias("start"), F.col("g_end").alias("end")))).alias("gs"))
    return p.join(g, "k").withColumn("m", matching.greedy(F.col("ps"), F.col("gs"), 0.3))


_GREEDY = f"""WITH RECURSIVE {_SIDES}, o AS (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY g) AS r FROM gt WHERE k IN (SELECT k FROM pr)),
w(k, r, used, ps, gs, iou) AS (SELECT DISTINCT k, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[], []::DOUBLE[] FROM o
 UNION ALL SELECT w.k, w.r + 1, CASE WHEN b.iou >= 0.3 AND b.iou > 0 THEN list_append(used, b.p) ELSE used END, CASE WHEN b.iou >= 0.3 AND b.iou > 0 THEN list_append(ps, b.p) ELSE ps END, CASE WHEN b.iou >= 0.3 AND b.iou > 0 THEN list_append(gs, o.g) ELSE gs END, CASE WHEN b.iou >= 0.3 AND b.iou > 0 THEN list_append(w.iou, b.iou) ELSE w.iou END
 FROM w JOIN o ON o.k = w.k AND o.r = w.r + 1 LEFT JOIN LATERAL (SELECT p, iou FROM io WHERE io.k = w.k AND io.g = o.g AND NOT list_contains(w.used, io.p) ORDER BY iou DESC, p LIMIT 1) b ON true),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC) AS z FROM w) WHERE z = 1)"""


@query("j22_greedy_match", _GREEDY + " SELECT k, unnest(ps) AS p, unnest(gs) AS g, round(unnest(iou), 6) AS iou FROM f")
def greedy_match(t: Tables) -> DataFrame:
    rows = _matched(t).select("k", "ps", "gs", F.explode("m").alias("x"))
    return rows.select("k", F.get("ps", F.col("x.p"))["p"].alias("p"), F.get("gs", F.col("x.g"))["g"].alias("g"), F.round("x.iou", 6).alias("iou"))


@query(
    "a02_match_scores",
    _GREEDY
    + """, n AS (SELECT len(ps) AS m, list_sum(iou) AS total, (SELECT count(*) FROM pr WHERE pr.k = f.k) AS np, (SELECT count(*) FROM gt WHERE gt.k = f.k) AS ng FROM f)
SELECT round(avg(m / ng), 6) AS recall, round(avg(m / np), 6) AS precision, round(avg(CASE WHEN m > 0 THEN 2 * (m / np) * (m / ng) / (m / np + m / ng) ELSE 0 END), 6) AS f1, round(avg(CASE WHEN m > 0 THEN total / m ELSE 0 END), 6) AS mean_iou, count(*) AS n FROM n""",
)
def match_scores(t: Tables) -> DataFrame:
    rows = _matched(t)
    s = matching.scores(F.col("m"), F.size("ps"), F.size("gs"))
    return rows.select(*[c.alias(n) for n, c in s.items()]).agg(*[F.round(F.avg(n), 6).alias(n) for n in s], F.count(F.lit(1)).alias("n"))


@query(
    "t02_temporal_suppression",
    """WITH RECURSIVE d AS (SELECT user_id, ts::DATE::VARCHAR AS id, round(avg(value), 6) AS margin, count(*)::DOUBLE AS scale, min(floor(epoch(ts))) AS s, max(floor(epoch(ts))) + 86400 AS e FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY -margin, scale, s, id) AS r FROM d),
w(user_id, r, kept, id, status, suppressor) AS (SELECT DISTINCT user_id, 0::BIGINT, []::STRUCT(id VARCHAR, s DOUBLE, e DOUBLE)[], NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM o
 UNION ALL SELECT user_id, r, CASE WHEN b IS NULL AND len(kept) < 5 THEN list_append(kept, {'id': id, 's': s, 'e': e}) ELSE kept END, id, CASE WHEN b IS NOT NULL THEN 'SUPPRESSED' WHEN len(kept) < 5 THEN 'SELECTED' ELSE 'NOT_SELECTED_BUDGET' END, b
 FROM (SELECT o.*, w.kept, list_filter(w.kept, lambda k: greatest(0, least(k.e, o.e) - greatest(k.s, o.s)) / (greatest(k.e, o.e) - least(k.s, o.s)) >= 0.3)[1].id AS b FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1))
SELECT user_id, id, r AS rank, status, suppressor FROM w WHERE r > 0""",
)
def suppression(t: Tables) -> DataFrame:
    """Windows of a user's day: margin is the mean value, scale the number of events."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    day = t.events.withColumn("d", F.to_date("ts")).groupBy("user_id", "d").agg(F.avg("value").alias("margin"), F.count(F.lit(1)).cast("double").alias("scale"), F.min(s).alias("start"), (F.max(s) + 86400).alias("end"))
    rows = day.select("user_id", F.col("d").cast("string").alias("id"), F.round("margin", 6).alias("margin"), "scale", "start", "end")
    return matching.suppress(rows, "user_id", 0.3, 5)


@query(
    "g20_flatten_overlaps",
    f"""WITH {_SPANS}, i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s, e, f) AS i FROM spans), t AS (SELECT DISTINCT k, s AS t FROM i UNION SELECT DISTINCT k, e FROM i),
q AS (SELECT k, t AS a, lead(t) OVER (PARTITION BY k ORDER BY t) AS b FROM t) SELECT q.k, a AS start, b AS "end", arg_min(i.i, (-(e - s), i.i))::VARCHAR AS caption FROM q JOIN i ON q.k = i.k AND s < b AND e > a GROUP BY 1, 2, 3""",
)
def flatten_overlaps(t: Tables) -> DataFrame:
    rows = spans(t).withColumn("ordinal", F.row_number().over(Window.partitionBy("k").orderBy("n", "p", "s", "e", "f")))
    return timeline.flattened(rows.select("k", "ordinal", F.col("s").alias("start"), F.col("e").alias("end"), F.col("ordinal").cast("string").alias("caption")), "k")


@query(
    "g21_span_clip_status",
    """WITH x AS (SELECT o_orderkey AS k, (epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0 AS a, (epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0 + l_quantity - 2 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT k, a, b, CASE WHEN b < a THEN 'GT_END_BEFORE_START' WHEN (b < 0 OR a > 400) AND (CASE WHEN b < 0 THEN abs(b) ELSE a - 400 END) <= 10 THEN 'OUTSIDE_CLIP_NEAR_BOUNDARY'
  WHEN b < 0 OR a > 400 OR greatest(0, -a, b - 400) > 10 THEN 'GT_OUT_OF_RANGE' WHEN a < 0 OR b > 400 THEN 'PARTIAL_BOUNDARY_CLIPPED' END AS reason FROM x)
SELECT k, CASE WHEN bool_or(coalesce(reason = 'GT_END_BEFORE_START', false)) THEN 'GT_INVALID' WHEN bool_or(coalesce(reason = 'GT_OUT_OF_RANGE', false)) THEN 'GT_OUT_OF_RANGE'
  WHEN bool_or(reason IS NULL OR reason = 'PARTIAL_BOUNDARY_CLIPPED') THEN 'OK' ELSE 'GT_NEAR_BOUNDARY_NOT_VISIBLE' END AS status, count(*) FILTER (reason = 'PARTIAL_BOUNDARY_CLIPPED')::INT AS n_clipped FROM r GROUP BY 1""",
)
def span_clip_status(t: Tables) -> DataFrame:
    s = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("k"), ((s("l_shipdate") - s("o_orderdate")) / 86400.0).alias("a"), "l_quantity")
    clipped = intervals.clip_span(F.col("a"), F.col("a") + F.col("l_quantity") - 2, F.lit(400.0), intervals.tolerance(F.lit(0.1)))
    per = rows.groupBy("k").agg(F.collect_list(clipped).alias("c"))
    n = F.size(F.filter("c", lambda x: x["reason"] == "PARTIAL_BOUNDARY_CLIPPED"))
    return per.select("k", intervals.clip_status(F.col("c")).alias("status"), n.alias("n_clipped"))


@query(
    "x41_alignment_labels",
    """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS total FROM events GROUP BY 1), e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
w AS (SELECT user_id, pos // 16 AS w, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS vis, CASE WHEN avg(value) > 50 THEN 'YES' ELSE 'NO' END AS pred FROM e GROUP BY 1, 2),
c AS (SELECT user_id, w::BIGINT AS w, pred, CASE WHEN n < 8 THEN 'INVALID_TEMPORAL' WHEN total = 0 THEN 'NO_VISIBLE_GT' WHEN vis = 0 THEN 'NO_GT_OVERLAP' WHEN vis / n >= 0.25 OR vis / total >= 0.5 THEN 'STRONG_GT_ALIGNED' ELSE 'WEAK_GT_ALIGNED' END AS alignment FROM w JOIN u USING (user_id))
SELECT *, CASE WHEN pred <> 'YES' THEN 'NOT_SUPPORT_CANDIDATE' WHEN alignment = 'NO_VISIBLE_GT' THEN 'NO_VISIBLE_GT_FRAME' WHEN alignment = 'NO_GT_OVERLAP' THEN 'SPURIOUS_SUPPORT' WHEN alignment = 'STRONG_GT_ALIGNED' THEN 'STRONG_GT_SUPPORT' WHEN alignment = 'WEAK_GT_ALIGNED' THEN 'WEAK_GT_SUPPORT' ELSE alignment END AS label FROM c""",
)
def alignment_labels(t: Tables) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    hit = F.count_if(F.col("event_type") == "purchase")
    w = t.events.withColumn("w", F.floor(pos / 16)).groupBy("user_id", "w").agg(F.count(F.lit(1)).alias("n"), hit.alias("vis"), F.when(F.avg("value") > 50, F.lit("YES")).otherwise("NO").alias("pred"))
    total = F.sum("vis").over(Window.partitionBy("user_id"))
    c = w.withColumn("total", total).withColumn("alignment", labels.alignment_class(F.col("n") >= 8, F.col("total"), F.col("vis"), F.col("vis") / F.col("n"), F.try_divide("vis", "total")))
    return c.select("user_id", "w", "pred", "alignment", labels.support_label(F.col("pred"), F.col("alignment")).alias("label"))


@query("r07_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    from spanloom.streaming import streams

    return streams.tumbling(t.events, "1 day").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("v", 4).alias("v"))


@query(
    "r07_session_windows",
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def session_windows(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")

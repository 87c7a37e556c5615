"""Queries of nested documents, schedules, drawn permutations, covering selections, placements and unions of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import placements
from spanloom.operators import audits, geometry, interventions, nested, ranking, selection, timeline

from .registry import Tables, query

CHECK = "CASE WHEN value > {0} THEN 'HIGH' WHEN value > {1} THEN 'MIDDLE' ELSE 'LOW' END"


@query(
    "a59_status_histogram",
    f"""SELECT path, status, count(*) AS n FROM (
SELECT 'status' AS path, event_type AS status FROM events UNION ALL
SELECT 'run.execution_status', {CHECK.format(50, 10)} FROM events UNION ALL
SELECT 'run.steps.check_status', {CHECK.format(80, 20)} FROM events UNION ALL
SELECT 'run.steps.check_status', {CHECK.format(40, 5)} FROM events WHERE user_id % 3 = 0 UNION ALL
SELECT 'run.steps.detail.applicability', CASE WHEN user_id % 2 = 0 THEN 'APPLIES' ELSE 'DOES_NOT' END FROM events UNION ALL
SELECT 'run.steps.detail.parts.inner.region_specificity', event_type FROM events WHERE event_id % 5 > 0 UNION ALL
SELECT 'run.steps.detail.parts.inner.region_specificity', 'WHOLE' FROM events) GROUP BY 1, 2""",
)
def status_histogram(t: Tables) -> DataFrame:
    """Statuses at any depth of JSON documents made of events: objects, lists of objects and lists of lists, and values that are no statuses."""
    check = lambda a, b: F.expr(CHECK.format(a, b))
    inner = lambda s: F.struct(F.struct(s.alias("region_specificity"), F.col("event_id").alias("other_status")).alias("inner"))
    parts = F.array(F.array(inner(F.when(F.col("event_id") % 5 > 0, F.col("event_type")))), F.array(inner(F.lit("WHOLE"))))
    detail = F.struct(F.when(F.col("user_id") % 2 == 0, "APPLIES").otherwise("DOES_NOT").alias("applicability"), parts.alias("parts"), F.col("event_type").alias("kind"))
    steps = F.array(F.struct(check(80, 20).alias("check_status"), detail.alias("detail")), F.struct(F.when(F.col("user_id") % 3 == 0, check(40, 5)).alias("check_status"), F.when(F.col("user_id") < 0, detail).alias("detail")))
    run = F.struct(check(50, 10).alias("execution_status"), steps.alias("steps"), F.array(F.lit("status"), F.lit("ok")).alias("list_status"))
    events = t.events.select("event_id", "user_id", "event_type", "value", "props").repartition(ranking.PARTS, "event_id")  # much is done for each row, and a file may be one task
    docs = events.select(F.to_json(F.struct(F.col("event_type").alias("status"), run.alias("run"), F.col("props").alias("props"))).alias("doc"))
    return nested.statuses(docs, "doc")


@query(
    "r03_attempt_chains",
    """WITH a AS (SELECT event_id // 4 AS chain, CASE WHEN event_id % 13 = 0 THEN (event_id + 1) % 4 WHEN event_id % 4 = 3 AND event_id % 3 > 0 THEN 2 ELSE event_id % 4 END AS i, CASE WHEN event_type = 'purchase' THEN 'OK' ELSE 'INFERENCE_ERROR' END AS status, event_type IN ('click', 'view') AS retryable FROM events),
d AS (SELECT DISTINCT * FROM a), i AS (SELECT chain, i, count(*) AS records, bool_or(status = 'OK' OR NOT retryable) AS ended FROM d GROUP BY 1, 2),
k AS (SELECT chain, count(*) AS n, max(i) AS top, max(records) AS most, min(i) FILTER (ended) AS first_end FROM i GROUP BY 1)
SELECT chain, n, CASE WHEN most > 1 THEN 'CONFLICTING_IMMUTABLE_ATTEMPTS' WHEN n <> top + 1 THEN 'INCOMPLETE_RAW_ATTEMPT_CHAIN' WHEN first_end < top THEN 'ATTEMPT_AFTER_TERMINAL_RAW_RESULT' WHEN n > 3 THEN 'RAW_ATTEMPTS_EXCEED_FROZEN_RETRY_LIMIT' WHEN first_end = top OR n = 3 THEN 'COMPLETE' ELSE 'OPEN' END AS state FROM k""",
)
def attempt_chains(t: Tables) -> DataFrame:
    i = F.expr("CASE WHEN event_id % 13 = 0 THEN (event_id + 1) % 4 WHEN event_id % 4 = 3 AND event_id % 3 > 0 THEN 2 ELSE event_id % 4 END")
    rows = t.events.select(F.expr("event_id div 4").alias("chain"), i.alias("i"), F.when(F.col("event_type") == "purchase", "OK").otherwise("INFERENCE_ERROR").alias("status"), F.col("event_type").isin("click", "view").alias("retryable"))
    return audits.attempt_chains(rows, "chain", "i", "status", "retryable", 3)


FRAMES = "SELECT user_id, event_id, (epoch(ts) - (SELECT epoch(min(ts)) FROM events))::DOUBLE AS t FROM events"


def _frames(t: Tables) -> DataFrame:
    begin = t.events.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("b"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.join(F.broadcast(begin)).select("user_id", "event_id", (micros / 1e6 - F.col("b") / 1e6).alias("t"))  # one row


@query(
    "v41_target_alignment",
    f"""WITH f AS ({FRAMES}), r AS (SELECT user_id, floor(min(t)) + 1 AS a, floor(max(t)) AS b FROM f GROUP BY 1),
s AS (SELECT user_id, a AS start, CASE WHEN user_id % 4 = 0 THEN b + 9000 ELSE b END AS "end", CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE 20000.0 + user_id % 7 END AS step FROM r),
v AS (SELECT s.*, CASE WHEN step <= 0 OR "end" < start THEN 'BAD_SCHEDULE' WHEN "end" > (SELECT max(t) FROM f WHERE f.user_id = s.user_id) + 1e-6 THEN 'OUTSIDE_RANGE' ELSE 'OK' END AS status FROM s),
w AS (SELECT user_id, start + unnest(range(0, floor(("end" - start) / step + 1e-9)::BIGINT + 1)) * step AS target FROM v WHERE status = 'OK'),
n AS (SELECT w.user_id, target, arg_min({{'i': event_id, 't': t}}, {{'g': abs(t - target), 'i': event_id}}) AS x FROM w JOIN f ON f.user_id = w.user_id GROUP BY 1, 2)
SELECT user_id, target, x.i AS event_id, round(x.t, 6) AS t, round(abs(x.t - target), 6) AS error, 'OK' AS status FROM n UNION ALL SELECT user_id, NULL, NULL, NULL, NULL, status FROM v WHERE status <> 'OK'""",
)
def target_alignment(t: Tables) -> DataFrame:
    """A user's events as frames, a schedule for each user; some schedules leave the frames' time, some have no step."""
    frames = _frames(t)
    spans = frames.groupBy("user_id").agg((F.floor(F.min("t")) + 1).cast("double").alias("start"), F.floor(F.max("t")).cast("double").alias("b"))
    schedules = spans.select("user_id", "start", F.when(F.col("user_id") % 4 == 0, F.col("b") + 9000).otherwise(F.col("b")).alias("end"), F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(20000.0 + F.col("user_id") % 7).alias("step"))
    out = timeline.aligned(frames, schedules, "user_id", "t", "event_id")
    return out.withColumns({c: F.round(c, 6) for c in ("t", "error")})


@query(
    "t08_sampled_frames",
    f"""WITH f AS ({FRAMES}), c AS (SELECT user_id, max(t) AS duration, count(*) AS total, greatest(1, least(trunc(max(t) * 0.0001)::BIGINT, 100 + user_id % 2 * 0, count(*))) AS n FROM f GROUP BY 1),
w AS (SELECT user_id, unnest(range(0, n)) * (duration / n) AS target FROM c WHERE n < total),
x AS (SELECT w.user_id, target, arg_min({{'i': event_id, 't': t}}, {{'g': abs(t - target), 'i': event_id}}) AS x FROM w JOIN f ON f.user_id = w.user_id GROUP BY 1, 2)
SELECT user_id, round(target, 6) AS target, x.i AS event_id, round(x.t, 6) AS t FROM x UNION ALL SELECT f.user_id, round(f.t, 6), f.event_id, round(f.t, 6) FROM f JOIN c ON f.user_id = c.user_id WHERE n >= total""",
)
def sampled_frames(t: Tables) -> DataFrame:
    frames = _frames(t)
    clips = frames.groupBy("user_id").agg(F.max("t").alias("duration"))
    out = timeline.sampled(frames, clips, "user_id", "t", "event_id", 0.0001, 100)
    return out.withColumns({c: F.round(c, 6) for c in ("t", "target")})


@query(
    "g28_v31_v32_dynamic_interventions",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 12 ELSE 16 END AS n FROM orders),
k AS (SELECT o_orderkey, n, list_transform(range(0, n), lambda i: 'f' || (i + o_orderkey % 3)) AS fr FROM c),
drawn AS (SELECT o_orderkey, a, list(i ORDER BY md5(concat_ws(':', o_orderkey, a, i)), i) AS p FROM k, (SELECT unnest(range(0, 6)) AS a), (SELECT unnest(range(0, 16)) AS i) WHERE n = 16 GROUP BY 1, 2),
judged AS (SELECT *, len(list_filter(range(0, 16), lambda i: p[i + 1] <> i)) AS moved, len(list_filter(range(1, 16), lambda i: p[i + 1] = p[i] + 1)) AS kept FROM drawn),
best AS (SELECT o_orderkey, arg_min(p, a) AS p, min(a) AS attempt FROM judged WHERE moved >= 12 AND 15 - kept >= 8 GROUP BY 1),
rows_ AS (SELECT k.o_orderkey, 'FULL_SHUFFLE' AS kind, 'ORDER' AS family, coalesce(attempt, -1) AS attempt, fr, n, p FROM k LEFT JOIN best USING (o_orderkey)
UNION ALL SELECT o_orderkey, 'BLOCK_SHUFFLE', 'ORDER', -1, fr, n, CASE WHEN n = 16 THEN [8, 9, 10, 11, 0, 1, 2, 3, 12, 13, 14, 15, 4, 5, 6, 7] END FROM k
UNION ALL SELECT o_orderkey, 'FREEZE_MID', 'FREEZE', -1, fr, n, CASE WHEN n = 16 THEN list_transform(range(0, 16), lambda i: 7) END FROM k)
SELECT o_orderkey, kind, family, CASE WHEN n = 16 THEN 'OK' ELSE kind || '_EXPECTED_16_FRAMES_GOT_' || n END AS reason, attempt::INT AS attempt, list_transform(p, lambda i: fr[i + 1]) AS frames,
CASE WHEN n = 16 THEN true END AS same_length, CASE WHEN n = 16 AND kind <> 'FREEZE_MID' THEN list_sort(list_transform(p, lambda i: fr[i + 1])) = list_sort(fr) END AS same_frames,
CASE WHEN n = 16 AND kind = 'FULL_SHUFFLE' THEN true END AS moved_enough, CASE WHEN n = 16 AND kind = 'BLOCK_SHUFFLE' THEN true END AS blocks_kept, CASE WHEN n = 16 AND kind = 'FREEZE_MID' THEN true END AS frozen FROM rows_""",
)
def dynamic_interventions(t: Tables) -> DataFrame:
    """Three interventions for each order as a candidate of 16 frames, some of 12; what must hold comes out as columns."""
    n = F.when(F.col("o_orderkey") % 10 == 0, 12).otherwise(16)
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("f"), (i + F.col("o_orderkey") % 3).cast("string")))
    orders = t.orders.select("o_orderkey").repartition(ranking.PARTS, "o_orderkey")  # much is done for each row, and a file may be one task
    return interventions.dynamic(orders.select("o_orderkey", frames.alias("frames")), "o_orderkey", "frames")


COVER = ["o_totalprice > 450000", "o_totalprice < 2000", "o_orderstatus = 'F'", "o_orderstatus = 'P'", "month(o_orderdate) = 2", "o_orderpriority = '1-URGENT'", "o_custkey % 11 = 3", "o_orderstatus = 'NONE'", "o_orderpriority = '5-LOW'"]


def _cover_sql(predicates: list[str], order: str, n: int, next_best: bool) -> str:
    """A table for each step, each with the rows chosen so far."""
    steps = ["s0 AS (SELECT NULL::BIGINT AS o_orderkey, 0 AS pick WHERE false)"]
    for i, p in enumerate(predicates):
        seen = f"AND o_orderkey NOT IN (SELECT o_orderkey FROM s{i})" if next_best else ""
        room = f"AND (SELECT count(*) FROM s{i}) < {n}" if next_best else ""
        first = f"(SELECT o_orderkey FROM orders WHERE {p} {seen} {room} ORDER BY {order} LIMIT 1)"
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT * FROM s{i} UNION ALL SELECT o_orderkey, (SELECT count(*) FROM s{i}) + 1 FROM {first} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s{i}))")
    last = f"s{len(predicates)}"
    fill = f"SELECT o_orderkey, (SELECT count(*) FROM {last}) + row_number() OVER (ORDER BY md5('fill:' || o_orderkey)) AS pick FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {last})"
    return f"WITH {', '.join(steps)} SELECT o_orderkey, pick::INT AS pick FROM (SELECT * FROM {last} UNION ALL {fill}) WHERE pick <= {n}"


@query("t14_covering_smoke_selection", _cover_sql(COVER, "o_orderpriority, o_custkey, o_orderkey", 12, True))
def covering_smoke_selection(t: Tables) -> DataFrame:
    """Twelve orders that cover nine predicates: for each the first one not yet chosen, then by a hash."""
    fill = F.md5(F.concat(F.lit("fill:"), F.col("o_orderkey").cast("string")))
    return selection.covering(t.orders, "o_orderkey", [F.expr(p) for p in COVER], ["o_orderpriority", "o_custkey", "o_orderkey"], 12, [fill])


@query("t18_inspection_sample", _cover_sql(COVER[::-1], "o_orderkey", 7, False))
def inspection_sample(t: Tables) -> DataFrame:
    """As above, but a predicate whose first order is chosen already takes no other, and what is over seven at the end is cut."""
    fill = F.md5(F.concat(F.lit("fill:"), F.col("o_orderkey").cast("string")))
    return selection.covering(t.orders, "o_orderkey", [F.expr(p) for p in COVER[::-1]], ["o_orderkey"], 7, [fill], next_best=False)


def _balanced_sql(tasks: list[str], per_task: int) -> str:
    out = ["b0 AS (SELECT NULL::VARCHAR AS task, NULL::VARCHAR AS dataset, NULL::BIGINT AS o_orderkey WHERE false)"]
    for i, task in enumerate(tasks):
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT * FROM b{i} UNION ALL (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders WHERE o_orderpriority = '{task}' ORDER BY (SELECT count(*) FROM b{i} WHERE dataset = o_orderstatus), o_orderkey LIMIT {per_task}))")
    return f"WITH {', '.join(out)} SELECT * FROM b{len(tasks)}"


@query("t16_balanced_smoke_sample", _balanced_sql(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 4))
def balanced_smoke_sample(t: Tables) -> DataFrame:
    """Four orders of each priority; statuses that the priorities before have taken less often come first."""
    rows = t.orders.select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("dataset"), "o_orderkey")
    return selection.balanced(rows, "o_orderkey", "task", "dataset", 4)


BOX = "[l_partkey % 13 / 20.0::DOUBLE, l_suppkey % 11 / 16.0::DOUBLE, l_partkey % 13 / 20.0::DOUBLE + (1 + l_linenumber) / 20.0::DOUBLE, l_suppkey % 11 / 16.0::DOUBLE + (1 + l_orderkey % 6) / 16.0::DOUBLE]"


def _box() -> F.Column:
    x, y = F.col("l_partkey") % 13 / 20.0, F.col("l_suppkey") % 11 / 16.0
    return F.array(x, y, x + (1 + F.col("l_linenumber")) / 20.0, y + (1 + F.col("l_orderkey") % 6) / 16.0)


@query(
    "t19_v68_control_placements",
    f"""WITH RECURSIVE c AS (SELECT l_orderkey, l_linenumber, {BOX} AS b, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2, 3),
s AS (SELECT *, b[3] - b[1] AS w, b[4] - b[2] AS h FROM c),
p AS (SELECT *, list_transform([[0.0, 0.0], [1.0 - w, 0.0], [0.0, 1.0 - h], [1.0 - w, 1.0 - h], [(1.0 - w) / 2, 0.0], [(1.0 - w) / 2, 1.0 - h], [0.0, (1.0 - h) / 2], [1.0 - w, (1.0 - h) / 2], [b[1] - w, b[2]], [b[3], b[2]], [b[1], b[2] - h], [b[1], b[4]]], lambda q: [q[1], q[2], q[1] + w, q[2] + h]) AS places FROM s),
f AS (SELECT l_orderkey, l_linenumber, b, places, 0 AS i, []::DOUBLE[][] AS regions, []::VARCHAR[] AS states FROM p
UNION ALL SELECT l_orderkey, l_linenumber, b, places, i + 1, CASE WHEN state = 'SELECTED' THEN list_append(regions, q) ELSE regions END, list_append(states, state) FROM (SELECT *, CASE WHEN len(regions) >= 2 THEN 'NOT_EVALUATED_AFTER_REQUEST_SATISFIED' WHEN NOT (q[1] >= 0 AND q[1] < q[3] AND q[3] <= 1 AND q[2] >= 0 AND q[2] < q[4] AND q[4] <= 1) THEN 'OUT_OF_BOUNDS'
WHEN greatest(0, least(b[3], q[3]) - greatest(b[1], q[1])) * greatest(0, least(b[4], q[4]) - greatest(b[2], q[2])) > 0 THEN 'OVERLAPS_TARGET'
WHEN len(list_filter(regions, lambda r: greatest(0, least(r[3], q[3]) - greatest(r[1], q[1])) * greatest(0, least(r[4], q[4]) - greatest(r[2], q[2])) > 0)) > 0 THEN 'OVERLAPS_PREVIOUS_CONTROL' ELSE 'SELECTED' END AS state FROM (SELECT *, places[i + 1] AS q FROM f WHERE i < 12)))
SELECT l_orderkey, l_linenumber, regions, states, CASE WHEN len(regions) = 2 THEN 'READY_FOR_REGISTERED_OPERATOR' ELSE 'CONTROL_UNAVAILABLE' END AS runner_input_status FROM f WHERE i = 12""",
)
def control_placements(t: Tables) -> DataFrame:
    """Two control boxes for the box of each returned line: the first disjoint ones of twelve placements, and what became of each placement."""
    rows = t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F'").select("l_orderkey", "l_linenumber", _box().alias("b")).distinct()
    made = rows.select("l_orderkey", "l_linenumber", placements.chosen(F.col("b"), placements.placements(F.col("b")), 2).alias("x"))
    ready = F.when(placements.availability(F.col("x.regions"), 2) == "CONTROL_AVAILABLE", "READY_FOR_REGISTERED_OPERATOR").otherwise("CONTROL_UNAVAILABLE")
    return made.select("l_orderkey", "l_linenumber", "x.regions", "x.states", ready.alias("runner_input_status"))


@query(
    "v57_residual_geometry",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, min({BOX}) AS b FROM lineitem GROUP BY 1, 2), p AS (SELECT x.l_orderkey, x.b AS r, y.b AS q FROM b x JOIN b y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = 2 WHERE x.l_linenumber = 1),
m AS (SELECT *, greatest(0, least(r[3], q[3]) - greatest(r[1], q[1])) * greatest(0, least(r[4], q[4]) - greatest(r[2], q[2])) AS i, (r[3] - r[1]) * (r[4] - r[2]) AS ra, (q[3] - q[1]) * (q[4] - q[2]) AS qa,
greatest(0, least(ceil(r[3] * 640), ceil(q[3] * 640)) - greatest(floor(r[1] * 640), floor(q[1] * 640))) * greatest(0, least(ceil(r[4] * 480), ceil(q[4] * 480)) - greatest(floor(r[2] * 480), floor(q[2] * 480))) AS px FROM p)
SELECT l_orderkey, round(i, 9) AS intersection, round(i / (ra + qa - i), 9) AS iou, round(qa, 9) AS residual_area, px::BIGINT AS pixel_overlap, px = 0 AS valid, CASE WHEN px <> 0 THEN 'RESIDUAL_PROPOSAL_INVALID_MASK_OVERLAP' END AS invalid_code FROM m""",
)
def residual_geometry(t: Tables) -> DataFrame:
    """The second line's box as the residual of the first one's: overlaps exactly and in pixels of 640 x 480."""
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(_box()).alias("b"))
    pair = rows.groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == k, F.col("b"))).alias(n) for k, n in ((1, "r"), (2, "q"))]).where("r IS NOT NULL AND q IS NOT NULL")
    out = pair.select("l_orderkey", geometry.residual_audit(F.col("r"), F.col("q"), F.lit(640), F.lit(480)).alias("x")).select("l_orderkey", "x.*")
    return out.withColumns({c: F.round(c, 9) for c in ("intersection", "iou", "residual_area")})


@query(
    "v57_union_area",
    """WITH b AS (SELECT DISTINCT l_orderkey, (l_partkey % 17)::INT AS x1, (l_suppkey % 13)::INT AS y1, (l_partkey % 17 + l_linenumber % 6)::INT AS x2, (l_suppkey % 13 + l_quantity::INT % 9)::INT AS y2 FROM lineitem),
c AS (SELECT DISTINCT l_orderkey, x, unnest(range(y1, y2)) AS y FROM (SELECT l_orderkey, y1, y2, unnest(range(x1, x2)) AS x FROM b)), n AS (SELECT l_orderkey, count(*) AS n FROM c GROUP BY 1)
SELECT l_orderkey, coalesce(n, 0)::DOUBLE AS area FROM (SELECT DISTINCT l_orderkey FROM b) LEFT JOIN n USING (l_orderkey)""",
)
def union_area(t: Tables) -> DataFrame:
    """The area that the boxes of an order cover together; the SQL counts cells of a raster."""
    x, y = F.col("l_partkey") % 17, F.col("l_suppkey") % 13
    box = F.array(*[c.cast("double") for c in (x, y, x + F.col("l_linenumber") % 6, y + F.col("l_quantity").cast("int") % 9)])
    return geometry.union_area(t.lineitem.select("l_orderkey", box.alias("b")), ["l_orderkey"], "b")

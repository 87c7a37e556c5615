"""Queries of parsers and projections: texts and nested fields to typed columns, and filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import boxes, intervals, parsing
from spanloom.functions import text as texts

from .registry import Tables, query


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


_WORDS = ["Novice", " beginner ", "INTERMEDIATE", "n", "3", "quite good", "zzz", "very high", "poor", "x"]
_LEVEL_SQL = "CASE said " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in parsing.LEVELS.items()) + " ELSE CASE " + " ".join(f"WHEN contains(said, '{k}') THEN '{v}'" for k, v in parsing.LEVELS.items()) + " ELSE said END END"


@query("x11_level_synonyms", f"WITH s AS (SELECT lower(trim({_WORDS}[l_suppkey % 10 + 1])) AS said FROM lineitem) SELECT said, {_LEVEL_SQL} AS level, count(*) AS n FROM s GROUP BY 1, 2")
def level_synonyms(t: Tables) -> DataFrame:
    said = F.get(F.array(*map(F.lit, _WORDS)), (F.col("l_suppkey") % 10).cast("int"))
    return t.lineitem.groupBy(F.lower(F.trim(said)).alias("said"), parsing.level_of(said).alias("level")).agg(_n())


@query(
    "x06_x14_boxes",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN [event_id % 90, user_id % 900, event_id % 90 + 5, user_id % 900 + 7]::DOUBLE[] WHEN 1 THEN [event_id % 90, user_id % 900, event_id % 90 + 5, user_id % 900 + 7]::DOUBLE[] END AS wrapped,
  CASE event_id % 4 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS found FROM events""",
)
def box_texts(t: Tables) -> DataFrame:
    """Boxes in fences and lists, in prose, and several of them."""
    k, u = F.col("event_id") % 90, F.col("user_id") % 900
    box = F.concat(F.lit("["), F.concat_ws(", ", k, u, k + 5, u + 7), F.lit("]"))
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("```json\n["), box, F.lit("]\n```"))).when(kind == 1, box).when(kind == 2, F.lit("no box here")).otherwise(F.concat(F.lit("see "), box, F.lit(" and "), box))
    return t.events.select("event_id", parsing.wrapped_box(text).alias("wrapped"), F.size(parsing.box_list(text)).cast("long").alias("found"))


@query(
    "x18_schedules",
    """SELECT event_id, s AS start, e AS "end", CASE WHEN e >= s THEN list_transform(range(0, floor((e - s) / 2.5 + 1e-8)::BIGINT + 1), lambda i: round(s + i * 2.5, 8)) END AS targets
FROM (SELECT event_id, user_id::DOUBLE / 2 AS s, (event_id % 100)::DOUBLE AS e FROM events)""",
)
def schedules(t: Tables) -> DataFrame:
    """Times asked for in a question, read from its text."""
    asked = F.format_string("from %s to %s seconds every 2.5 seconds", (F.col("user_id") / 2).cast("string"), (F.col("event_id") % 100).cast("double").cast("string"))
    number = lambda i: F.regexp_extract(asked, r"from (\d+\.?\d*) to (\d+\.?\d*) seconds every (\d+\.?\d*)", i).cast("double")
    rows = t.events.select("event_id", number(1).alias("start"), number(2).alias("end"), number(3).alias("step"))
    return rows.select("event_id", "start", "end", parsing.schedule(F.col("start"), F.col("end"), F.col("step")).alias("targets"))


@query(
    "x19_x20_json_flags",
    """SELECT CASE event_id % 5 WHEN 0 THEN 'global' WHEN 1 THEN 'local' WHEN 2 THEN 'global' END AS kind, CASE WHEN event_id % 5 < 3 THEN (event_id % 7) / 2.0 END AS reward, count(*) AS n FROM events GROUP BY 1, 2""",
)
def json_flags(t: Tables) -> DataFrame:
    kind, value = F.col("event_id") % 5, ((F.col("event_id") % 7) / 2).cast("string")
    flag = F.when(kind == 0, "true").when(kind == 1, "false").when(kind == 2, '"True"').otherwise("3")
    text = F.when(kind == 4, F.lit("not json")).when(kind == 3, F.lit('{"isGlobal": 3, "reward": "x"}')).otherwise(F.concat(F.lit('{"isGlobal": '), flag, F.lit(', "reward": '), value, F.lit("}")))
    return t.events.groupBy(parsing.query_type(text).alias("kind"), parsing.reward(text).alias("reward")).agg(_n())


@query("x21_judge_scores", "SELECT event_id, CASE WHEN event_id % 6 < 5 THEN (event_id % 5 + 1)::DOUBLE END AS accuracy, CASE WHEN event_id % 6 < 5 THEN (user_id % 5 + 1)::DOUBLE END AS detail FROM events")
def judge_scores(t: Tables) -> DataFrame:
    """Scores of two aspects, written in one of five ways or not at all."""
    a, d, way = F.col("event_id") % 5 + 1, F.col("user_id") % 5 + 1, F.col("event_id") % 6
    say = lambda pattern: F.format_string(pattern, a, d)
    text = F.when(way == 0, say('{"accuracy": %d, "detail": %d}')).when(way == 1, say("Accuracy: %d\nDetail: %d")).when(way == 2, say("accuracy = %d; detail = %d")).when(way == 3, say("Accuracy - %d, Detail - %d")).when(way == 4, say("accuracy (%d) detail (%d)")).otherwise("none")
    return t.events.select("event_id", parsing.aspect_score(text, "accuracy").alias("accuracy"), parsing.aspect_score(text, "detail").alias("detail"))


@query("p04_targets", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_orderstatus END AS target, CASE o_orderkey % 3 WHEN 1 THEN 'action' WHEN 2 THEN 'phase' END AS kind FROM orders")
def targets(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    empty = F.struct(F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("phase"))
    item = F.struct(F.when(k == 1, F.col("o_orderpriority")).alias("action"), F.when(k != 0, F.col("o_orderstatus")).alias("phase"))
    return t.orders.select("o_orderkey", parsing.first_present(F.array(empty, item), "action", "phase").alias("x")).select("o_orderkey", "x.target", "x.kind")


@query("p08_window_positions", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber AS first, l_linenumber + l_quantity::INT AS last FROM lineitem")
def window_positions(t: Tables) -> DataFrame:
    ident = F.format_string("%d::w::pos%d-%d", "l_orderkey", "l_linenumber", (F.col("l_linenumber") + F.col("l_quantity")).cast("int"))
    at = lambda i: F.regexp_extract(ident, r"::pos(\d+)-(\d+)$", i).cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", at(1).alias("first"), at(2).alias("last"))


@query("p11_dataset_resolution", "SELECT doc_id, CASE WHEN source <> '' AND doc_id % 3 > 0 THEN source WHEN contains(lower(text), 'the') THEN 'english' ELSE 'from_' || lang END AS dataset FROM documents")
def dataset_resolution(t: Tables) -> DataFrame:
    """The source where it is given, else a rule on the question, else one on the id."""
    given = F.nullif(F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise(""), F.lit(""))
    asked = F.when(F.contains(F.lower("text"), F.lit("the")), "english")
    return t.documents.select("doc_id", F.coalesce(given, asked, F.concat(F.lit("from_"), "lang")).alias("dataset"))


@query("p14_safe_paths", "SELECT page_id % 6 AS kind, count(*) AS n, count(*) FILTER (page_id % 6 = 0 OR page_id % 6 = 5) AS safe FROM pages GROUP BY 1")
def safe_paths(t: Tables) -> DataFrame:
    kind = F.col("page_id") % 6
    path = F.when(kind == 0, "a/b.jpg").when(kind == 1, "/a/b.jpg").when(kind == 2, "a/../b.jpg").when(kind == 3, "./a").when(kind == 4, "a//b").otherwise("a..b/c.jpg")
    return t.pages.groupBy(kind.alias("kind")).agg(_n(), F.count_if(parsing.safe_relative(path)).alias("safe"))


@query("p15_p17_visible_projection", "SELECT o_orderkey AS id, o_orderpriority AS task, epoch(o_orderdate)::BIGINT AS asked_at FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000")
def visible_projection(t: Tables) -> DataFrame:
    """Only listed fields, of valid rows: what isn't listed can't leak."""
    return t.orders.where("o_orderstatus != 'P' AND o_totalprice > 1000").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("asked_at"))


@query("p22_canonical_tasks", "SELECT CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' END AS task, count(*) AS n FROM events GROUP BY 1")
def canonical_tasks(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("view", "look", "click", "act", "purchase", "act")])
    return t.events.groupBy(F.element_at(names, F.col("event_type")).alias("task")).agg(_n())


@query("p26_v04_class_maps", "SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS class, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def class_maps(t: Tables) -> DataFrame:
    """Numbers of the distinct names in order; only the names meet in one place."""
    names = t.orders.groupBy("o_orderpriority").agg(_n())
    ranked = names.agg(F.array_sort(F.collect_list(F.struct("o_orderpriority", "n"))).alias("x")).select(F.posexplode("x").alias("class", "x"))
    return ranked.select("x.o_orderpriority", F.col("class").cast("long").alias("class"), "x.n")


@query("f02_f04_task_filters", "SELECT CASE WHEN contains(event_type, 'up') THEN 'summary' ELSE 'caption' END AS task, user_id % 4 AS ds, count(*) AS n FROM events WHERE (contains(event_type, 'up') OR regexp_matches(event_type, 'chase|ick')) AND value > 10 GROUP BY 1, 2")
def task_filters(t: Tables) -> DataFrame:
    task = F.col("event_type")
    rows = t.events.where((F.contains(task, F.lit("up")) | task.rlike("chase|ick")) & (F.col("value") > 10))
    return rows.groupBy(F.when(F.contains(task, F.lit("up")), "summary").otherwise("caption").alias("task"), (F.col("user_id") % 4).alias("ds")).agg(_n())


@query("f03_f05_selected_types", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') ORDER BY event_id LIMIT 25")
def selected_types(t: Tables) -> DataFrame:
    """The first rows of some types by position; the limit is the feature."""
    return t.events.where(F.col("event_type").isin("click", "view")).orderBy("event_id").limit(25).select("event_id", "event_type")


def _box(c: str) -> Column:
    return F.array(*[F.col(f"{c}{k}") for k in range(4)])


_BOXES = "b AS (SELECT event_id, event_id % 50 AS a0, user_id % 40 AS a1, event_id % 50 + 20 AS a2, user_id % 40 + 30 AS a3, event_id % 60 AS b0, user_id % 30 AS b1, event_id % 60 + 25 AS b2, user_id % 30 + 15 AS b3 FROM events)"


def _boxes(t: Tables) -> DataFrame:
    e, u = F.col("event_id").cast("double"), F.col("user_id").cast("double")
    sides = {"a0": e % 50, "a1": u % 40, "a2": e % 50 + 20, "a3": u % 40 + 30, "b0": e % 60, "b1": u % 30, "b2": e % 60 + 25, "b3": u % 30 + 15}
    return t.events.select("event_id", *[v.alias(k) for k, v in sides.items()])


_INTER = "greatest(0, least(a2, b2) - greatest(a0, b0)) * greatest(0, least(a3, b3) - greatest(a1, b1))"


@query(
    "g10_g17_geometry_change",
    f"""WITH {_BOXES}, i AS (SELECT *, {_INTER} AS i FROM b) SELECT event_id, (375 - 600)::DOUBLE AS delta_area, (b0 + b2 - a0 - a2) / 2.0 AS shift_x, (b1 + b3 - a1 - a3) / 2.0 AS shift_y, i::DOUBLE AS intersection, round(i / (975.0 - i), 6) AS iou FROM i""",
)
def geometry_change(t: Tables) -> DataFrame:
    a, b = _box("a"), _box("b")
    inter = boxes.intersection_area(a, b)
    shift = lambda k: ((F.col(f"b{k}") + F.col(f"b{k + 2}")) - (F.col(f"a{k}") + F.col(f"a{k + 2}"))) / 2
    iou = F.coalesce(F.try_divide(inter, boxes.area(a) + boxes.area(b) - inter), F.lit(0.0))
    return _boxes(t).select("event_id", (boxes.area(b) - boxes.area(a)).alias("delta_area"), shift(0).alias("shift_x"), shift(1).alias("shift_y"), inter.alias("intersection"), F.round(iou, 6).alias("iou"))


@query(
    "g13_unit_to_pixels",
    f"""WITH {_BOXES} SELECT event_id, floor(a0 / 100.0 * 640)::BIGINT AS x1, floor(a1 / 100.0 * 480)::BIGINT AS y1, ceil(a2 / 100.0 * 640)::BIGINT AS x2, ceil(a3 / 100.0 * 480)::BIGINT AS y2 FROM (SELECT event_id, a0::DOUBLE AS a0, a1::DOUBLE AS a1, a2::DOUBLE AS a2, a3::DOUBLE AS a3 FROM b)""",
)
def unit_to_pixels(t: Tables) -> DataFrame:
    at = lambda c, size, f: f(F.col(c) / 100 * size).cast("long")
    return _boxes(t).select("event_id", at("a0", 640, F.floor).alias("x1"), at("a1", 480, F.floor).alias("y1"), at("a2", 640, F.ceil).alias("x2"), at("a3", 480, F.ceil).alias("y2"))


@query(
    "g04_g05_interval_iou",
    """SELECT event_id, CASE WHEN e1 < s1 OR e2 < s2 THEN NULL WHEN greatest(e1, e2) = least(s1, s2) THEN 0 ELSE round(greatest(0, least(e1, e2) - greatest(s1, s2)) / (greatest(e1, e2) - least(s1, s2)), 6) END AS iou
FROM (SELECT event_id, (event_id % 20)::DOUBLE AS s1, (user_id % 30)::DOUBLE AS e1, (event_id % 15)::DOUBLE AS s2, (event_id % 15 + user_id % 7)::DOUBLE AS e2 FROM events)""",
)
def interval_iou(t: Tables) -> DataFrame:
    """Overlap of two spans over their hull; null where an end is before its start."""
    s1, e1, s2 = (F.col("event_id") % 20).cast("double"), (F.col("user_id") % 30).cast("double"), (F.col("event_id") % 15).cast("double")
    e2 = s2 + F.col("user_id") % 7
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    iou = F.when(hull == 0, 0.0).otherwise(F.round(intervals.overlap_length(s1, e1, s2, e2) / hull, 6))
    return t.events.select("event_id", F.when((e1 >= s1) & (e2 >= s2), iou).alias("iou"))


@query(
    "g07_box_iou_pairs",
    f"""WITH {_BOXES}, u AS (SELECT b.*, user_id FROM b JOIN events USING (event_id)), p AS (SELECT l.user_id, l.event_id AS p, r.event_id AS g, l.a0, l.a1, l.a2, l.a3, r.b0, r.b1, r.b2, r.b3 FROM u l JOIN u r ON l.user_id = r.user_id AND l.event_id % 9 = 0 AND r.event_id % 9 = 4)
SELECT p, g, round({_INTER} / (975.0 - {_INTER}), 6) AS iou FROM p WHERE {_INTER} > 0""",
)
def box_pairs(t: Tables) -> DataFrame:
    """Overlaps of all boxes of one kind with all of another within a user; the key bounds a group, and only overlapping pairs are kept."""
    rows = _boxes(t).join(t.events.select("event_id", "user_id"), "event_id")
    left = rows.where("event_id % 9 = 0").select("user_id", F.col("event_id").alias("p"), _box("a").alias("a"))
    right = rows.where("event_id % 9 = 4").select("user_id", F.col("event_id").alias("g"), _box("b").alias("b"))
    inter = boxes.intersection_area(F.col("a"), F.col("b"))
    return left.join(right, "user_id").where(inter > 0).select("p", "g", F.round(inter / (boxes.area(F.col("a")) + boxes.area(F.col("b")) - inter), 6).alias("iou"))


@query("g19_tight_boxes", "SELECT user_id, min(event_id % 37) AS x1, min(event_id % 23) AS y1, max(event_id % 37) AS x2, max(event_id % 23) AS y2 FROM events WHERE value > 40 GROUP BY 1")
def tight_boxes(t: Tables) -> DataFrame:
    """The least box around the points of a mask that are set."""
    x, y = F.col("event_id") % 37, F.col("event_id") % 23
    return t.events.where("value > 40").groupBy("user_id").agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"))


@query(
    "g22_v37_time_bases",
    """SELECT event_id, event_type, round((event_id % 500) / hz, 6) AS seconds, hz IS NULL AS unsupported FROM events LEFT JOIN (VALUES ('view', 15.0::DOUBLE), ('click', 1.0), ('signup', 0.5)) r(event_type, hz) USING (event_type)""",
)
def time_bases(t: Tables) -> DataFrame:
    """Positions to seconds by the rate of a data set, a small fixed table; without a rate the row is told."""
    rates = t.spark.createDataFrame([("view", 15.0), ("click", 1.0), ("signup", 0.5)], "event_type string, hz double")
    rows = t.events.join(F.broadcast(rates), "event_type", "left")
    return rows.select("event_id", "event_type", F.round((F.col("event_id") % 500) / F.col("hz"), 6).alias("seconds"), F.col("hz").isNull().alias("unsupported"))


@query(
    "g34_role_domains",
    """WITH d AS (SELECT event_id, event_type AS role, (event_id % 40)::DOUBLE AS s, (event_id % 40 + 10)::DOUBLE AS e FROM events)
SELECT event_id, role, CASE role WHEN 'view' THEN greatest(0, s - 5) WHEN 'click' THEN s ELSE greatest(s, e - 3) END AS low, CASE role WHEN 'view' THEN least(e, s + 3) WHEN 'click' THEN e ELSE least(45, e + 5) END AS high FROM d""",
)
def role_domains(t: Tables) -> DataFrame:
    """Where a role is searched: before, at, or after the core of an action."""
    s = (F.col("event_id") % 40).cast("double")
    e, role = s + 10, F.col("event_type")
    low = F.when(role == "view", F.greatest(F.lit(0.0), s - 5)).when(role == "click", s).otherwise(F.greatest(s, e - 3))
    high = F.when(role == "view", F.least(e, s + 3)).when(role == "click", e).otherwise(F.least(F.lit(45.0), e + 5))
    return t.events.select("event_id", role.alias("role"), low.alias("low"), high.alias("high"))


@query(
    "g31_g35_tail_windows",
    """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id, n, unnest(CASE WHEN n <= 16 THEN [0] ELSE list_distinct(list_append(range(0, n - 16 + 1, 8), n - 16)) END) AS start FROM u)
SELECT user_id, start, least(n, start + 16) AS stop FROM w""",
)
def tail_windows(t: Tables) -> DataFrame:
    """Windows of 16 every 8 positions, and one that ends with the last."""
    n = F.col("n")
    starts = F.when(n <= 16, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.greatest(n - 16, F.lit(0)), F.lit(8).cast("long")), F.array(n - 16))))
    rows = t.events.groupBy("user_id").agg(_n()).select("user_id", "n", F.explode(starts).alias("start"))
    return rows.select("user_id", "start", F.least("n", F.col("start") + 16).alias("stop"))


@query("x38_clean_means", "SELECT l_suppkey, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM (SELECT l_suppkey, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS v FROM lineitem) GROUP BY 1")
def clean_means(t: Tables) -> DataFrame:
    """Means and medians that skip NaN as they skip null."""
    v = F.nanvl(F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).otherwise(F.lit(float("nan"))), F.lit(None).cast("double"))
    return t.lineitem.select("l_suppkey", v.alias("v")).groupBy("l_suppkey").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"))


@query(
    "t11_anchor_schedule",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(event_id) FILTER (p = floor((n - 1) / 2.0)) AS middle, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY 1""",
)
def anchor_schedule(t: Tables) -> DataFrame:
    """The middle, first and last row of each key, by ranks and a conditional aggregate."""
    key = Window.partitionBy("user_id")
    rows = t.events.select("user_id", "event_id", F.row_number().over(key.orderBy("event_id")).alias("p"), F.count(F.lit(1)).over(key).alias("n"))
    middle = F.max(F.when(F.col("p") - 1 == F.floor((F.col("n") - 1) / 2), F.col("event_id")))
    return rows.groupBy("user_id").agg(middle.alias("middle"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("u07_spans_once", "SELECT l_orderkey, list(s ORDER BY p, s) AS spans FROM (SELECT l_orderkey, {'a': l_linenumber, 'b': l_quantity::INT % 5} AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def spans_once(t: Tables) -> DataFrame:
    """Spans of a list once each, in the order of their first occurrence."""
    once = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("int") % 5).alias("b")).agg(F.min("l_partkey").alias("p"))
    return once.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("p", "a", "b"))).alias("x")).select("l_orderkey", F.transform("x", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias("spans"))


@query(
    "x05_box_series",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT k, i, i // 2 + 0.5 AS t, CASE WHEN i % 3 > 0 AND p % 5 > 0 THEN [p, s, p + 1.5, 0]::DOUBLE[] END AS told FROM l),
c AS (SELECT k, i, t, last_value(told IGNORE NULLS) OVER (PARTITION BY k ORDER BY i) AS box FROM b), o AS (SELECT k, t, min(i) AS i, arg_max(box, i) AS box FROM c WHERE box IS NOT NULL GROUP BY 1, 2), g AS (SELECT k, list({'t': t::DOUBLE, 'box': box} ORDER BY i) AS series FROM o GROUP BY 1)
SELECT l_orderkey, coalesce(series, []) AS series FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN g ON k = l_orderkey""",
)
def box_series(t: Tables) -> DataFrame:
    """The lines of an order as boxes at times, some told twice, some without four numbers."""
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    p, i = F.col("p"), F.col("l_linenumber")
    box = F.when(i % 3 == 0, F.concat(p, F.lit(", "), p)).when(p % 5 > 0, F.concat_ws(", ", p, "s", F.concat(p + 1, F.lit(".5")), F.lit("0"))).otherwise("1, 2, x, 4")
    line = F.concat(F.floor(i / 2), F.lit(".5 seconds: ["), box, F.lit("]"))
    answers = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(i, line.alias("line")))), lambda r: r["line"]), "\n").alias("answer"))
    return answers.select("l_orderkey", texts.box_series(F.col("answer")).alias("series"))

"""Queries of frames and boxes that are held against each other: key sets, expansions, packets, time bases, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import boxes

from .parsing import _BOXES, _INTER, _box, _boxes
from .registry import Tables, query


@query(
    "v06_key_sets_and_boxes",
    """WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_linenumber) FILTER (l_returnflag <> 'R'), []) AS p, coalesce(list(DISTINCT l_linenumber) FILTER (l_discount < 0.08), []) AS g, count(*) FILTER (l_returnflag <> 'R' AND l_tax * 100 >= l_quantity) AS bad FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_sort(list_filter(g, lambda k: NOT list_contains(p, k))) AS missing, list_sort(list_filter(p, lambda k: NOT list_contains(g, k))) AS extra, bad, bad = 0 AND list_sort(p) = list_sort(g) AS valid FROM s""",
)
def key_sets(t: Tables) -> DataFrame:
    """Keys that only one side has, both ways, and predicted boxes whose end isn't after their start."""
    keys = lambda c: F.collect_set(F.when(c, F.col("l_linenumber")))
    predicted = F.col("l_returnflag") != "R"
    bad = F.count_if(predicted & (F.col("l_tax") * 100 >= F.col("l_quantity")))
    rows = t.lineitem.groupBy("l_orderkey").agg(keys(predicted).alias("p"), keys(F.col("l_discount") < 0.08).alias("g"), bad.alias("bad"))
    rows = rows.select("l_orderkey", F.array_sort(F.array_except("g", "p")).alias("missing"), F.array_sort(F.array_except("p", "g")).alias("extra"), "bad")
    return rows.withColumn("valid", (F.col("bad") == 0) & (F.size("missing") == 0) & (F.size("extra") == 0))


_NAMES = ["data", "model", "the", "and", "de"]


@query(
    "v02_v03_first_contained_name",
    "SELECT coalesce(nullif(lang, 'en'), nullif(source, ''), 'unknown') AS dataset, CASE " + " ".join(f"WHEN contains(lower(text), '{n}') THEN '{n}'" for n in _NAMES) + " ELSE 'unknown' END AS name, count(*) AS n FROM documents GROUP BY 1, 2",
)
def first_contained(t: Tables) -> DataFrame:
    """The first name of an ordered list that a text contains, by data set, the first field that says one."""
    text = F.lower("text")
    name = F.coalesce(*[F.when(F.contains(text, F.lit(n)), n) for n in _NAMES], F.lit("unknown"))
    dataset = F.coalesce(F.nullif("lang", F.lit("en")), F.nullif("source", F.lit("")), F.lit("unknown"))
    return t.documents.groupBy(dataset.alias("dataset"), name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g32_expanded_windows",
    """WITH n AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, list_slice(range(1, n + 1), greatest(1, l_linenumber - 2), least(n, l_linenumber + 2))::INT[] AS positions FROM lineitem JOIN n USING (l_orderkey)""",
)
def expanded(t: Tables) -> DataFrame:
    """A position with two more on either side, within those that there are."""
    sizes = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    at = F.col("l_linenumber")
    around = F.sequence(F.greatest(F.lit(1), at - 2), F.least(F.col("n"), at + 2))
    return t.lineitem.join(sizes, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.transform(around, lambda k: k.cast("int")).alias("positions"))


@query(
    "v17_pointer_against_truths",
    f"""WITH {_BOXES}, u AS (SELECT b.*, user_id FROM b JOIN events USING (event_id)), f AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1), p AS (SELECT u.user_id, a0, a1, a2, a3 FROM u JOIN f USING (user_id, event_id)),
g AS (SELECT user_id, b0, b1, b2, b3 FROM u WHERE event_id % 7 = 3), s AS (SELECT user_id, avg({_INTER} / (975.0 - {_INTER})) AS iou, count(*) AS boxes FROM p JOIN g USING (user_id) GROUP BY 1)
SELECT user_id, coalesce(boxes, 0) AS boxes, round(iou, 6) AS iou, CASE WHEN boxes IS NULL THEN 'NO_TRUTH_IN_WINDOW' WHEN iou = 0 THEN 'ZERO_OVERLAP' ELSE 'EVALUATED' END AS reason FROM p LEFT JOIN s USING (user_id)""",
)
def pointer_against_truths(t: Tables) -> DataFrame:
    """Mean overlap of a key's one predicted box with all its truths; a reason where there are none. The box is an aggregate, so a hot key is one row on that side."""
    rows = _boxes(t).join(t.events.select("event_id", "user_id"), "event_id")
    pointer = rows.groupBy("user_id").agg(F.min_by(_box("a"), F.col("event_id")).alias("a"))
    truths = rows.where("event_id % 7 = 3").select("user_id", _box("b").alias("b"))
    inter = boxes.intersection_area(F.col("a"), F.col("b"))
    iou = inter / (boxes.area(F.col("a")) + boxes.area(F.col("b")) - inter)
    out = pointer.join(truths, "user_id", "left").groupBy("user_id").agg(F.count("b").alias("boxes"), F.avg(iou).alias("iou"))
    reason = F.when(F.col("boxes") == 0, "NO_TRUTH_IN_WINDOW").when(F.col("iou") == 0, "ZERO_OVERLAP").otherwise("EVALUATED")
    return out.select("user_id", "boxes", F.round("iou", 6).alias("iou"), reason.alias("reason"))


_CAUSES = ["NOT_APPLIED", "UNIFORM_REGION", "SMALL_REGION", "UNRESOLVED"]


def _cause() -> Column:
    return F.when(F.col("l_tax") == 0, 1).when(F.col("l_discount") == 0, 2).when(F.col("l_quantity") < 5, 3).otherwise(4)


@query(
    "v65_cause_by_precedence",
    f"""SELECT l_orderkey, {_CAUSES}[min(CASE WHEN l_tax = 0 THEN 1 WHEN l_discount = 0 THEN 2 WHEN l_quantity < 5 THEN 3 ELSE 4 END)] AS cause, count(*) AS audits FROM lineitem GROUP BY 1""",
)
def cause_by_precedence(t: Tables) -> DataFrame:
    """Of all audits of a key the cause that comes first in a fixed list: the least rank, met before the exchange."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.min(_cause()).alias("k"), F.count(F.lit(1)).alias("audits"))
    return rows.select("l_orderkey", F.element_at(F.array(*map(F.lit, _CAUSES)), F.col("k")).alias("cause"), "audits")


@query(
    "g24_decimal_time_base",
    """WITH s AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) AS us FROM events GROUP BY 1)
SELECT user_id, n, us / 1e6 AS seconds, (us - (n - 1) * 38400000000) / 1e6 AS tail, us BETWEEN (n - 1) * 38400000000 AND n * 38400000000 AS regular FROM s""",
)
def decimal_time_base(t: Tables) -> DataFrame:
    """Length of a key's record against its frames at a fixed rate, in decimals: the tail may be one frame long at most."""
    rows = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    us = F.unix_micros(F.col("high").cast("timestamp")) - F.unix_micros(F.col("low").cast("timestamp"))
    seconds = (us.cast("decimal(18,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(24,6)")
    tail = seconds - (F.col("n") - 1).cast("decimal(12,0)") * F.lit(38400).cast("decimal(5,0)")
    return rows.select("user_id", "n", seconds.cast("double").alias("seconds"), tail.cast("double").alias("tail"), ((tail >= 0) & (tail <= 38400)).alias("regular"))


@query(
    "v52_visual_packets",
    """WITH d AS (SELECT user_id, event_id % 41 AS frame, min(event_id) AS first_id FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM d),
k AS (SELECT DISTINCT user_id, p FROM (SELECT user_id, max(n) AS n FROM r GROUP BY 1), (SELECT unnest(range(8)) AS i), LATERAL (SELECT CASE WHEN n <= 8 THEN i ELSE (i * (n - 1)) // 7 END AS p))
SELECT r.user_id, r.frame, r.first_id, r.p AS position, r.n AS frames FROM r JOIN k USING (user_id, p)""",
)
def visual_packets(t: Tables) -> DataFrame:
    """Frames of a key once each, and at most eight of them at even positions, ends included.

    A position is taken if it is the floor of i * (n - 1) / 7 for the least i that reaches it, so rows decide for themselves.
    """
    once = t.events.groupBy("user_id", (F.col("event_id") % 41).alias("frame")).agg(F.min("event_id").alias("first_id"))
    key = Window.partitionBy("user_id")
    rows = once.select("*", (F.row_number().over(key.orderBy("frame")) - 1).cast("long").alias("position"), F.count(F.lit(1)).over(key).alias("frames"))
    last = F.col("frames") - 1
    i = F.expr("(7 * position + frames - 2) div greatest(frames - 1, 1)")
    return rows.where((F.col("frames") <= 8) | (F.floor(i * last / 7) == F.col("position"))).select("user_id", "frame", "first_id", "position", "frames")

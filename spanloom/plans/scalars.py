"""Queries of text, JSON, boxes, labels and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import boxes, labels, text

from .registry import Tables, query


@query(
    "p01_p03_conversation_qa",
    """SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_user, arg_max(text, turn) FILTER (role = 'user') AS last_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_answer, count(*) AS turns FROM conversations GROUP BY 1""",
)
def conversation_qa(t: Tables) -> DataFrame:
    of = lambda pick, role: pick(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    return t.conversations.groupBy("conv_id").agg(of(F.min, "user").alias("first_user"), of(F.max, "user").alias("last_user"), of(F.max, "assistant").alias("last_answer"), F.count(F.lit(1)).alias("turns"))


@query(
    "p07_id_parts",
    """WITH i AS (SELECT o_orderkey, o_custkey || '&&' || o_orderkey || '&&' || (o_orderkey + 7) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '&&1.5' END AS id FROM orders)
SELECT o_orderkey, CASE WHEN len(string_split(id, '&&')) = 4 THEN string_split(id, '&&')[1] END AS video, CASE WHEN len(string_split(id, '&&')) = 4 THEN string_split(id, '&&')[2]::DOUBLE END AS start, CASE WHEN len(string_split(id, '&&')) = 4 THEN string_split(id, '&&')[4]::DOUBLE END AS fps FROM i""",
)
def id_parts(t: Tables) -> DataFrame:
    ident = F.concat_ws("&&", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 7).cast("string"), F.when(F.col("o_orderkey") % 5 != 0, F.lit("1.5")))
    return t.orders.select("o_orderkey", text.id_parts(ident).alias("x")).select("o_orderkey", "x.video", F.col("x.start").cast("double").alias("start"), "x.fps")


@query("p09_ordered_rules", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') THEN 'A' WHEN contains(lower(p_name), '1') THEN 'one' WHEN contains(lower(p_name), 'p') THEN 'P' ELSE p_brand END AS family FROM part")
def ordered_rules(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.first_match(F.col("p_name"), [("a", "A"), ("1", "one"), ("p", "P")], F.col("p_brand")).alias("family"))


@query("p24_yes_no", r"SELECT user_id, event_id, CASE WHEN regexp_matches(a, '(?i)^yes[.!]?$') THEN 'YES' WHEN regexp_matches(a, '(?i)^no[.!]?$') THEN 'NO' ELSE 'INVALID' END AS answer FROM (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'YES' WHEN 1 THEN ' no. ' WHEN 2 THEN 'Yes!' WHEN 3 THEN 'maybe' END AS r, trim(regexp_replace(coalesce(r, ''), '\s+', ' ', 'g')) AS a FROM events)")
def yes_no(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.lit("YES")).when(k == 1, F.lit(" no. ")).when(k == 2, F.lit("Yes!")).when(k == 3, F.lit("maybe"))
    return t.events.select("user_id", "event_id", text.yes_no(raw).alias("answer"))


@query(
    "x01_regex_segments",
    r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)', 1) AS a, regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)', 2) AS b FROM documents)
SELECT doc_id, len(a) AS n, a[1]::DOUBLE AS first_start, b[1]::DOUBLE AS first_end FROM m WHERE len(a) > 0""",
)
def regex_segments(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", text.dash_segments(F.col("text")).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0))["start"].alias("first_start"), F.get("s", F.lit(0))["end"].alias("first_end"))


@query("x13_json_props", "SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k')::INT >= 50 AS high FROM events")
def json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_id", k.alias("k"), (k >= 50).alias("high"))


@query(
    "x09_x12_skill_levels",
    """WITH m AS (SELECT p_partkey, ((p_size % 6) + (p_partkey % 5)) / 2.0 AS m FROM part) SELECT p_partkey, round(m, 6) AS mean, CASE WHEN m <= 2 THEN 'novice' WHEN m <= 3.5 THEN 'intermediate' ELSE 'expert' END AS level FROM m""",
)
def skill_levels(t: Tables) -> DataFrame:
    said = F.format_string("Respect for tissue: %d/5, Suture/needle handling: %d/5", F.col("p_size") % 6, F.col("p_partkey") % 5)
    mean = text.mean_out_of_five(said)
    return t.part.select("p_partkey", F.round(mean, 6).alias("mean"), text.skill_level(mean).alias("level"))


@query(
    "x07_x08_component_totals",
    """WITH m AS (SELECT p_partkey, (p_size % 3) + (p_partkey % 3) + (p_size % 2) AS total FROM part) SELECT p_partkey, total::INT AS total, CASE WHEN total <= 1 THEN 'poor' WHEN total <= 3 THEN 'fair' WHEN total <= 5 THEN 'good' ELSE 'excellent' END AS rating FROM m""",
)
def component_totals(t: Tables) -> DataFrame:
    said = F.format_string("Two structures: %d, Cystic plate: %d, Hepatocystic triangle: %d", F.col("p_size") % 3, F.col("p_partkey") % 3, F.col("p_size") % 2)
    total = F.aggregate(text.component_scores(said), F.lit(0), lambda a, s: a + s["score"])
    return t.part.select("p_partkey", total.alias("total"), text.rating_of_total(total).alias("rating"))


@query(
    "x27_support_margin",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, -l_quantity / 10 AS a, -l_extendedprice / 10000 AS b, -l_discount * 50 AS c, -l_tax * 50 AS d FROM lineitem), g AS (SELECT *, greatest(b, c, d) AS m FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, round(a - (m + ln(exp(b - m) + exp(c - m) + exp(d - m))), 6) AS margin, CASE WHEN a >= b AND a >= c AND a >= d THEN 'A' WHEN b >= c AND b >= d THEN 'B' WHEN c >= d THEN 'C' ELSE 'D' END AS best FROM g""",
)
def support_margin(t: Tables) -> DataFrame:
    s = {"A": -F.col("l_quantity") / 10, "B": -F.col("l_extendedprice") / 10000, "C": -F.col("l_discount") * 50, "D": -F.col("l_tax") * 50}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(labels.support_margin(s["A"], [s["B"], s["C"], s["D"]]), 6).alias("margin"), labels.best_label(s).alias("best"))


@query(
    "x29_cosine_argmax",
    """WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, e.label, c.label AS best, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 6) AS cos FROM embeddings e CROSS JOIN c)
SELECT vec_id, label, arg_min(best, (-cos, best)) AS best, max(cos) AS cos FROM s GROUP BY 1, 2""",
)
def cosine_argmax(t: Tables) -> DataFrame:
    """Each vector against the centroids of the labels, a vocabulary: all of them are one broadcast row, so a vector stays one row and nothing is sorted.

    The row holds a centroid for each of at most 1,000 labels; more raise an error, as they would not be a vocabulary.
    """
    e = t.embeddings
    parts = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    c = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    every = F.collect_list(F.struct((-F.col("label")).alias("o"), "c", F.sqrt(dot(F.col("c"), F.col("c"))).alias("n")))
    one = c.agg(F.when(F.count(F.lit(1)) <= 1000, every).otherwise(F.raise_error(F.lit("too many labels"))).alias("cs"))
    cos = lambda x: F.round(dot(F.col("embedding"), x["c"]) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * x["n"]), 6)
    best = F.array_max(F.transform("cs", lambda x: F.struct(cos(x).alias("cos"), x["o"].alias("o"))))
    return e.join(F.broadcast(one)).select("vec_id", "label", best.alias("x")).select("vec_id", "label", (-F.col("x.o")).alias("best"), F.col("x.cos").alias("cos"))


@query("x31_stable_ids", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS digest, 'order_' || substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 24) AS ident FROM orders""")
def stable_ids(t: Tables) -> DataFrame:
    keys = ("o_orderkey", "o_custkey", "o_orderstatus")
    return t.orders.select("o_orderkey", labels.stable_hash(*keys).alias("digest"), labels.stable_id("order", *keys).alias("ident"))


@query(
    "x35_bins",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 2 THEN '<2 sec' WHEN l_quantity < 4 THEN '2-4 sec' WHEN l_quantity < 10 THEN '4-10 sec' WHEN l_quantity < 30 THEN '10-30 sec' ELSE '>=30 sec' END AS duration_bin,
 CASE WHEN l_discount = 0 THEN '0' WHEN l_discount * 10 < 0.5 THEN '(0,0.5)' ELSE '>=0.5' END AS iou_bin FROM lineitem""",
)
def bins(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", labels.duration_bin(F.col("l_quantity")).alias("duration_bin"), labels.iou_bin(F.col("l_discount") * 10).alias("iou_bin"))


_BOX = "SELECT p_partkey AS k, [p_size::DOUBLE, p_size * 2.0::DOUBLE, p_size + 40.0::DOUBLE, p_size * 2.0::DOUBLE + 30] AS a, [p_partkey % 50::DOUBLE, p_partkey % 90::DOUBLE, p_partkey % 50 + 35.0::DOUBLE, p_partkey % 90 + 50.0::DOUBLE] AS b FROM part"


@query(
    "g06_box_iou",
    f"""WITH x AS ({_BOX}), i AS (SELECT *, greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) AS i, (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) AS s FROM x)
SELECT k, round(i / greatest(s - i, 1e-6), 6) AS iou, round((a[3] - a[1]) * (a[4] - a[2]) / 1000000, 6) AS fraction, [greatest(0, least(640, floor(a[1] / 1000 * 640)))::BIGINT, greatest(0, least(480, floor(a[2] / 1000 * 480)))::BIGINT, greatest(0, least(640, ceil(a[3] / 1000 * 640)))::BIGINT, greatest(0, least(480, ceil(a[4] / 1000 * 480)))::BIGINT] AS pixels FROM i""",
)
def box_iou(t: Tables) -> DataFrame:
    s, k = F.col("p_size").cast("double"), F.col("p_partkey")
    m, n = (k % 50).cast("double"), (k % 90).cast("double")
    rows = t.part.select(k.alias("k"), F.array(s, s * 2, s + 40, s * 2 + 30).alias("a"), F.array(m, n, m + 35, n + 50).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("k", F.round(boxes.iou_floor(a, b), 6).alias("iou"), F.round(boxes.area_fraction_1000(a), 6).alias("fraction"), boxes.to_pixels(a, F.lit(640), F.lit(480)).alias("pixels"))


@query(
    "f09_retention",
    """SELECT user_id, avg(CASE WHEN value > 20 AND event_type = 'purchase' THEN 1 WHEN value > 20 AND event_type = 'error' THEN 0 END) AS retained, count(CASE WHEN value > 20 AND event_type IN ('purchase', 'error') THEN 1 END) AS n FROM events GROUP BY 1""",
)
def retention(t: Tables) -> DataFrame:
    prediction = F.when(F.col("event_type") == "purchase", F.lit("YES")).when(F.col("event_type") == "error", F.lit("NO"))
    r = labels.retention(F.col("value") > 20, prediction)
    return t.events.groupBy("user_id").agg(F.avg(r).alias("retained"), F.count(r).alias("n"))


@query("s17_content_addresses", "SELECT sha256(text) AS address, count(*) AS copies, min(doc_id) AS first_id, count(DISTINCT text) AS payloads FROM documents GROUP BY 1")
def content_addresses(t: Tables) -> DataFrame:
    """One address for each payload; a second payload under an address is told by its length and second hash, not by moving texts."""
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("address"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    return rows.groupBy("address").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.countDistinct("h", "n").alias("payloads"))


@query(
    "x34_human_bytes",
    "SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN printf('%.2f MiB', n_chars / 1048576.0) WHEN n_chars >= 1024 THEN printf('%.2f KiB', n_chars / 1024.0) ELSE n_chars || ' B' END AS size FROM documents",
)
def human_bytes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", labels.human_bytes(F.col("n_chars")).alias("size"))

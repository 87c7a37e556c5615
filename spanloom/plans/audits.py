"""Queries of audits: joins with assertions, agreement of runs, coverage, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joining import KEY_PARTS
from .registry import Tables, query


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def _rows(one: DataFrame, **columns: Column) -> DataFrame:
    """A table of one row as rows of name and value."""
    return one.agg(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("value")).alias(k) for k, v in columns.items()]).select(F.explode(F.array(*columns)).alias("x")).select("x.*")


@query(
    "j11_candidates_rebuilt",
    """WITH a AS (SELECT o_custkey, list(o_orderkey) AS ids FROM orders GROUP BY 1), e AS (SELECT o_custkey AS parent, unnest(ids) AS id FROM a)
SELECT parent, count(*) AS listed, count(o_orderkey) AS found, count(*) FILTER (o_custkey = parent) AS of_parent, count(*) FILTER (o_orderstatus = 'F') AS finished FROM e LEFT JOIN orders ON o_orderkey = id GROUP BY 1""",
)
def candidates_rebuilt(t: Tables) -> DataFrame:
    """Ids of an array are looked up again, and their parent is held against the one that lists them."""
    listed = t.orders.groupBy(F.col("o_custkey").alias("parent")).agg(F.collect_list("o_orderkey").alias("ids")).select("parent", F.explode("ids").alias("o_orderkey"))
    rows = listed.join(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", "left")
    return rows.groupBy("parent").agg(F.count(F.lit(1)).alias("listed"), F.count("o_custkey").alias("found"), F.count_if(F.col("o_custkey") == F.col("parent")).alias("of_parent"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query(
    "j12_final_records",
    """WITH r AS (SELECT l_orderkey AS k, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), e AS (SELECT l_orderkey AS k, arg_max(l_linenumber::VARCHAR, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CASE WHEN r.v IS NOT NULL THEN 'RESULT' WHEN e.v IS NOT NULL THEN 'ERROR' ELSE 'NOT_RUN' END AS status, coalesce(r.v, e.v) AS value FROM orders LEFT JOIN r ON r.k = o_orderkey LEFT JOIN e ON e.k = o_orderkey WHERE o_orderpriority = '1-URGENT'""",
)
def final_records(t: Tables) -> DataFrame:
    """The last result of each expected id, else its last error, else none; both from one aggregate."""
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    last = lambda f, v: F.max_by(F.when(F.col("l_returnflag") == f, v), F.when(F.col("l_returnflag") == f, order))
    rows = t.lineitem.where("l_returnflag != 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(last("A", F.col("l_linestatus")).alias("r"), last("R", F.col("l_linenumber").cast("string")).alias("e"))
    out = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey").join(rows, "o_orderkey", "left")
    status = F.when(F.col("r").isNotNull(), "RESULT").when(F.col("e").isNotNull(), "ERROR").otherwise("NOT_RUN")
    return out.select("o_orderkey", status.alias("status"), F.coalesce("r", "e").alias("value"))


@query(
    "j16_u08_distinct_views",
    """SELECT user_id, w AS "window", count(*) AS events, count(DISTINCT (event_type, floor(value)::BIGINT % 10)) AS views FROM (SELECT *, unnest([event_id // 500, event_id // 500 - 1]) AS w FROM events) WHERE w >= 0 GROUP BY 1, 2""",
)
def distinct_views(t: Tables) -> DataFrame:
    """Events in overlapping windows, of which those that look the same count once; each event is dealt to its windows."""
    k = F.floor(F.col("event_id") / 500)
    rows = t.events.withColumn("window", F.explode(F.array(k, k - 1))).where("window >= 0")
    return rows.groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_type", F.floor("value") % 10).alias("views"))


@query(
    "j19_shared_results",
    """WITH p AS (SELECT l_partkey, l_suppkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT o_orderkey, count(*) AS bindings, round(sum(q), 4) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN p USING (l_partkey, l_suppkey) GROUP BY 1""",
)
def shared_results(t: Tables) -> DataFrame:
    """Results of shared tasks to all that are bound to them: many rows to one, joined by the task's key."""
    results = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.avg("l_quantity").alias("q"))
    return t.lineitem.join(results, ["l_partkey", "l_suppkey"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("bindings"), F.round(F.sum("q"), 4).alias("total"))


@query(
    "j24_v40_generated_ids",
    """WITH g AS (SELECT 'S_' || lpad(doc_id::VARCHAR, 6, '0') AS sid, quality FROM labels), p AS (SELECT 'S_' || lpad(doc_id::VARCHAR, 6, '0') AS sid, n_chars FROM documents)
SELECT quality, count(*) AS n, round(avg(n_chars), 4) AS mean FROM p JOIN g USING (sid) GROUP BY 1""",
)
def generated_ids(t: Tables) -> DataFrame:
    """A join by ids that both sides generate."""
    sid = F.concat(F.lit("S_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("sid")
    return t.documents.select(sid, "n_chars").join(t.labels.select(sid, "quality"), "sid").groupBy("quality").agg(_n(), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("j28_conditional_score", "SELECT lang, count(*) AS n, round(avg((toxic = CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END)::INT), 6) AS score FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND (n_chars % 2 = 0) = (doc_id % 2 = 0) GROUP BY 1")
def conditional_score(t: Tables) -> DataFrame:
    """Scores of rows whose task agrees with their truth's."""
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.where("quality = 1").select("doc_id", "toxic"), "doc_id").where("(n_chars % 2 = 0) = (doc_id % 2 = 0)")
    guess = F.when(F.col("n_chars") % 5 == 0, 1).otherwise(0)
    return rows.groupBy("lang").agg(_n(), F.round(F.avg((F.col("toxic") == guess).cast("int")), 6).alias("score"))


@query(
    "j29_v39_sorted_intersections",
    """WITH p AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), g AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_custkey % 4 > 0)
SELECT coalesce(p.k, g.k) AS k, CASE WHEN g.k IS NULL THEN 'EXTRA' WHEN p.k IS NULL THEN 'MISSING' ELSE 'MATCHED' END AS status, CASE WHEN p.k IS NOT NULL AND g.k IS NOT NULL THEN round(v - c_acctbal, 4) END AS delta FROM p FULL JOIN g ON p.k = g.k""",
)
def sorted_intersections(t: Tables) -> DataFrame:
    """The last prediction of a key against its truth, with keys that only one side has."""
    p = t.orders.where("o_orderstatus != 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_totalprice", "o_orderkey").alias("v"))
    g = t.customer.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("k"), "c_acctbal")
    status = F.when(F.col("c_acctbal").isNull(), "EXTRA").when(F.col("v").isNull(), "MISSING").otherwise("MATCHED")
    return p.join(g, "k", "full").select("k", status.alias("status"), F.round(F.col("v") - F.col("c_acctbal"), 4).alias("delta"))


@query(
    "q06_traversal_audit",
    """WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS is_last, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, count(*) FILTER (value < before) AS out_of_order, count(*) - count(DISTINCT floor(value)) AS revisits, count(*) FILTER (event_type = 'purchase' AND NOT is_last) AS early_exits FROM r GROUP BY 1""",
)
def traversal_audit(t: Tables) -> DataFrame:
    """Order, revisits, and exits that aren't the last step of a traversal."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t.events.select("user_id", "event_type", "value", F.lead("event_id").over(w).isNull().alias("last"), F.lag("value").over(w).alias("before"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("value") < F.col("before")).alias("out_of_order"), (F.count(F.lit(1)) - F.countDistinct(F.floor("value"))).alias("revisits"), F.count_if((F.col("event_type") == "purchase") & ~F.col("last")).alias("early_exits"))


@query(
    "q07_result_audit",
    """WITH a AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_totalprice > 250000 AS answered FROM orders), c AS (SELECT l_orderkey AS k, count(*) AS cited, count(*) FILTER (l_returnflag = 'A') AS verified, count(DISTINCT l_linenumber) AS bound FROM lineitem GROUP BY 1)
SELECT CASE WHEN answered AND c.k IS NULL THEN 'CITED_CERTIFICATE_MISSING' WHEN answered AND verified = 0 THEN 'CITED_NOT_VERIFIED' WHEN answered AND bound < cited THEN 'BOUND_TWICE' WHEN answered AND o_orderstatus = 'P' THEN 'COVERAGE_INCOMPLETE' WHEN NOT answered AND o_orderstatus = 'P' THEN 'NON_ANSWER_CARRIES_ANSWER' ELSE 'OK' END AS verdict, count(*) AS n FROM a LEFT JOIN c USING (k) GROUP BY 1""",
)
def result_audit(t: Tables) -> DataFrame:
    """Answers against the certificates that they cite: the first rule that is broken."""
    cited = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("cited"), F.count_if(F.col("l_returnflag") == "A").alias("verified"), F.countDistinct("l_linenumber").alias("bound"))
    rows = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus", (F.col("o_totalprice") > 250000).alias("answered")).join(cited, "k", "left")
    a, open_ = F.col("answered"), F.col("o_orderstatus") == "P"
    verdict = F.when(a & F.col("cited").isNull(), "CITED_CERTIFICATE_MISSING").when(a & (F.col("verified") == 0), "CITED_NOT_VERIFIED").when(a & (F.col("bound") < F.col("cited")), "BOUND_TWICE").when(a & open_, "COVERAGE_INCOMPLETE").when(~a & open_, "NON_ANSWER_CARRIES_ANSWER").otherwise("OK")
    return rows.groupBy(verdict.alias("verdict")).agg(_n())


@query(
    "q09_q10_generation_totals",
    """WITH o AS (SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) SELECT 'total' AS name, count(DISTINCT l_orderkey) AS value, count(DISTINCT l_orderkey) = (SELECT n FROM o) AS expected FROM lineitem UNION ALL SELECT 'valid', count(*) FILTER (l_returnflag <> 'R'), true FROM lineitem UNION ALL SELECT 'without_source', count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)), count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) = 0 FROM lineitem""",
)
def generation_totals(t: Tables) -> DataFrame:
    """Totals against what is expected of them: as many orders of lines as orders that have lines, no line without an order; the valid ones have no expectation."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("valid"))
    known = t.orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("there"))
    rows = per_order.join(known, "l_orderkey", "left")
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.sum("there").alias("sourced"), F.sum("valid").alias("valid"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("without_source"))
    one = lambda name, expected: F.struct(F.lit(name).alias("name"), F.col(name).alias("value"), expected.alias("expected"))
    return out.select(F.explode(F.array(one("total", F.col("total") == F.col("sourced")), one("valid", F.lit(True)), one("without_source", F.col("without_source") == 0))).alias("r")).select("r.*")


@query("q12_v29_v48_paths", "SELECT (page_id % 10) AS shard, count(*) AS n, count(*) FILTER (NOT starts_with(url, 'http')) AS outside, count(*) - count(DISTINCT url) AS repeated, count(*) FILTER (html IS NULL OR html = '') AS missing FROM pages GROUP BY 1")
def paths(t: Tables) -> DataFrame:
    return t.pages.groupBy((F.col("page_id") % 10).alias("shard")).agg(_n(), F.count_if(~F.col("url").startswith("http")).alias("outside"), (F.count(F.lit(1)) - F.countDistinct("url")).alias("repeated"), F.count_if(F.coalesce(F.col("html"), F.lit("")) == "").alias("missing"))


@query(
    "q13_q14_file_validation",
    """SELECT count(*) AS n, count(*) >= 100 AS enough, count(*) FILTER (doc_id IS NULL OR text IS NULL) AS lacking, count(*) - count(DISTINCT doc_id) AS repeated, CASE WHEN count(*) < 100 THEN 'TOO_FEW' WHEN count(*) FILTER (doc_id IS NULL OR text IS NULL) > 0 THEN 'LACKING' WHEN count(*) > count(DISTINCT doc_id) THEN 'REPEATED' ELSE 'OK' END AS verdict FROM documents""",
)
def file_validation(t: Tables) -> DataFrame:
    lacking = F.count_if(F.col("doc_id").isNull() | F.col("text").isNull())
    out = t.documents.agg(_n(), lacking.alias("lacking"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated"))
    verdict = F.when(F.col("n") < 100, "TOO_FEW").when(F.col("lacking") > 0, "LACKING").when(F.col("repeated") > 0, "REPEATED").otherwise("OK")
    return out.select("n", (F.col("n") >= 100).alias("enough"), "lacking", "repeated", verdict.alias("verdict"))


@query("q18_selection_rows", "SELECT CASE WHEN l_quantity < 1 OR l_quantity > 48 THEN 'OUT_OF_RANGE' WHEN l_discount > l_tax * 3 AND l_tax > 0.001 THEN 'ORDER' WHEN l_linenumber > 6 THEN 'TOO_MANY' ELSE 'OK' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def selection_rows(t: Tables) -> DataFrame:
    reason = F.when((F.col("l_quantity") < 1) | (F.col("l_quantity") > 48), "OUT_OF_RANGE").when((F.col("l_discount") > F.col("l_tax") * 3) & (F.col("l_tax") > 0.001), "ORDER").when(F.col("l_linenumber") > 6, "TOO_MANY").otherwise("OK")
    return t.lineitem.groupBy(reason.alias("reason")).agg(_n())


@query("v23_v24_coverage_assertions", "SELECT count(DISTINCT event_type) = 5 AS all_kinds, count(DISTINCT user_id) >= 2 AS several, bool_or(value > 400) AS has_large, bool_or(value < 20) AS has_small, count(*) FILTER (props IS NULL) = 0 AS complete FROM events")
def coverage_assertions(t: Tables) -> DataFrame:
    return t.events.agg((F.countDistinct("event_type") == 5).alias("all_kinds"), (F.countDistinct("user_id") >= 2).alias("several"), F.bool_or(F.col("value") > 400).alias("has_large"), F.bool_or(F.col("value") < 20).alias("has_small"), (F.count_if(F.col("props").isNull()) == 0).alias("complete"))


@query("v25_v76_artifact_order", "WITH a(position, k) AS (VALUES (0, 33), (1, 7), (2, 1), (3, 99999999)) SELECT position, k, o_orderstatus, o_orderkey IS NULL AS missing FROM a LEFT JOIN orders ON o_orderkey = k")
def artifact_order(t: Tables) -> DataFrame:
    """Rows in the order of a fixed list, with those that the table lacks."""
    listed = t.spark.createDataFrame([(0, 33), (1, 7), (2, 1), (3, 99999999)], "position int, k int")
    found = t.orders.select(F.col("o_orderkey").cast("int").alias("k"), "o_orderstatus").join(F.broadcast(listed.select("k")), "k", "left_semi")
    return F.broadcast(listed).join(found, "k", "left").select("position", "k", "o_orderstatus", F.col("o_orderstatus").isNull().alias("missing"))


@query("v26_v80_cache_keys", "SELECT count(*) AS n, count(DISTINCT k) AS keys, count(DISTINCT p) AS payloads FROM (SELECT sha256(l_partkey || ':' || l_suppkey || ':' || l_returnflag) AS k, (l_partkey, l_suppkey, l_returnflag) AS p FROM lineitem)")
def cache_keys(t: Tables) -> DataFrame:
    """Keys are made of what they stand for: as many keys as different payloads."""
    parts = ["l_partkey", "l_suppkey", "l_returnflag"]
    key = F.unhex(F.sha2(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag"), 256))
    # Dealt by the key to many tasks, where payloads and then keys are counted without another exchange of either.
    payload = t.lineitem.select(*parts, key.alias("k")).repartition(KEY_PARTS, "k").groupBy("k", *parts).agg(_n())
    keys = payload.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("payloads"))
    return keys.agg(F.sum("n").alias("n"), F.count("k").alias("keys"), F.sum("payloads").alias("payloads"))


@query(
    "v27_shared_clip_keys",
    """WITH c AS (SELECT l_suppkey AS clip, list_sort(list(DISTINCT l_orderkey))[1:2] AS two FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2)
SELECT clip, two[1] AS a, two[2] AS b, sha256(clip || ':' || two[1]) = sha256(clip || ':' || two[2]) AS same FROM c""",
)
def shared_clip_keys(t: Tables) -> DataFrame:
    """The two smallest ids of each shared clip: the least, and the least of the others."""
    rows = t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("clip"), "l_orderkey").agg(_n())
    low = rows.groupBy("clip").agg(F.min("l_orderkey").alias("a"))
    second = rows.join(low, "clip").where("l_orderkey > a").groupBy("clip", "a").agg(F.min("l_orderkey").alias("b"))
    key = lambda c: F.sha2(F.concat_ws(":", F.col("clip").cast("string"), F.col(c).cast("string")), 256)
    return second.select("clip", "a", "b", (key("a") == key("b")).alias("same"))


@query("v45_adapter_comparison", "SELECT l_linestatus AS dataset, count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_returnflag = 'N') AS failed, count(*) FILTER (l_returnflag = 'R') AS invalid, bool_and(l_quantity > 0) AS all_positive, bool_or(l_discount > 0.09) AS any_high FROM lineitem GROUP BY 1")
def adapter_comparison(t: Tables) -> DataFrame:
    of = lambda f: F.count_if(F.col("l_returnflag") == f)
    return t.lineitem.groupBy(F.col("l_linestatus").alias("dataset")).agg(of("A").alias("ok"), of("N").alias("failed"), of("R").alias("invalid"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.bool_or(F.col("l_discount") > 0.09).alias("any_high"))


@query("v46_evaluator_rows", "SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('signup', 'error')")
def evaluator_rows(t: Tables) -> DataFrame:
    return t.events.where(~F.col("event_type").isin("signup", "error")).select("event_id", "event_type", "value")


@query("v47_task_list", "SELECT event_type, CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'act' ELSE event_type END AS task FROM events GROUP BY 1")
def task_list(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("view", "look"), ("click", "act")], "event_type string, task string")
    return t.events.select("event_type").distinct().join(F.broadcast(names), "event_type", "left").select("event_type", F.coalesce("task", "event_type").alias("task"))


@query(
    "v49_question_templates",
    """WITH q AS (SELECT lang, regexp_replace(lower(split_part(text, ' ', 1)), '[^a-z]+', '#', 'g') AS p FROM documents WHERE text IS NOT NULL), c AS (SELECT lang, p, count(*) AS n FROM q GROUP BY 1, 2)
SELECT lang, p, n, r FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, p) AS r FROM c) WHERE r <= 3""",
)
def question_templates(t: Tables) -> DataFrame:
    """The three most usual patterns of each task; patterns are counted before they are ranked."""
    pattern = F.regexp_replace(F.lower(F.substring_index("text", " ", 1)), "[^a-z]+", "#")
    counts = t.documents.where("text IS NOT NULL").groupBy("lang", pattern.alias("p")).agg(_n())
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "p"))).where("r <= 3")


@query("v50_duplicate_references", "SELECT l_suppkey, count(*) AS refs, count(*) - count(DISTINCT l_partkey) AS repeated FROM lineitem GROUP BY 1")
def duplicate_references(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("refs"), (F.count(F.lit(1)) - F.countDistinct("l_partkey")).alias("repeated"))


@query("v51_frozen_selection", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) >= 40 AS enough FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def frozen_selection(t: Tables) -> DataFrame:
    """The first forty in the selector's order; whether there were enough is told."""
    rows = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_totalprice")
    return rows.withColumn("enough", F.count(F.lit(1)).over(Window.partitionBy()) >= 40)  # over the forty alone


@query(
    "v54_hypotheses_with_null",
    "SELECT l_suppkey, l_linenumber::VARCHAR AS hypothesis, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2 UNION ALL SELECT s_suppkey, 'NULL', 0 FROM supplier",
)
def hypotheses(t: Tables) -> DataFrame:
    """Hypotheses of the selected rows, and always one that nothing happened."""
    some = t.lineitem.where("l_returnflag = 'A'").groupBy("l_suppkey", F.col("l_linenumber").cast("string").alias("hypothesis")).agg(_n())
    return some.unionByName(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.lit("NULL").alias("hypothesis"), F.lit(0).cast("long").alias("n")))


@query(
    "v55_v56_claim_graph",
    """WITH e AS (SELECT event_id AS id, user_id AS g, CASE WHEN event_id % 4 > 0 THEN event_id - event_id % 7 END AS parent FROM events)
SELECT count(*) FILTER (e.parent = e.id) AS self_parents, count(*) FILTER (e.parent IS NOT NULL AND p.id IS NULL) AS missing, count(*) FILTER (p.id > e.id) AS late, count(*) FILTER (e.parent IS NULL) AS roots, count(DISTINCT e.g) AS graphs FROM e LEFT JOIN e p ON p.id = e.parent AND p.g = e.g""",
)
def claim_graph(t: Tables) -> DataFrame:
    """Parents of claims: themselves, missing, or later than their children."""
    e = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("g"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") - F.col("event_id") % 7).alias("parent"))
    p = e.select(F.col("id").alias("parent"), "g", F.lit(True).alias("there"))
    rows = e.join(p, ["parent", "g"], "left")
    given, same = F.col("parent").isNotNull(), F.col("parent") == F.col("id")
    return rows.agg(F.count_if(same).alias("self_parents"), F.count_if(given & F.col("there").isNull()).alias("missing"), F.count_if(F.col("there") & (F.col("parent") > F.col("id"))).alias("late"), F.count_if(~given).alias("roots"), F.countDistinct("g").alias("graphs"))


@query(
    "v60_v61_override_merge",
    """SELECT coalesce(c_custkey, k) AS k, CASE WHEN c_custkey IS NULL THEN 'EXTRA' WHEN o.k IS NULL THEN 'MISSING' WHEN n > 1 THEN 'REPEATED' ELSE 'MERGED' END AS status FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) c FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = k""",
)
def override_merge(t: Tables) -> DataFrame:
    """Every template exactly once: what is missing, extra or repeated among the overrides."""
    o = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(_n())
    c = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit(True).alias("wanted"))
    status = F.when(F.col("wanted").isNull(), "EXTRA").when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "REPEATED").otherwise("MERGED")
    return c.join(o, "k", "full").select("k", status.alias("status"))


@query("v67_eligible_candidates", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def eligible_candidates(t: Tables) -> DataFrame:
    """One candidate of each order, the preferred role first: a minimum, taken before rows are exchanged."""
    role = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct(role.alias("role"), "l_linenumber", "l_partkey", "l_suppkey")).alias("x")).select("l_orderkey", "x.l_linenumber", "x.l_partkey")


@query(
    "v69_fresh_windows",
    """WITH e AS (SELECT DISTINCT l_suppkey, l_linenumber AS w FROM lineitem WHERE l_returnflag = 'A'), s AS (SELECT l_suppkey, l_linenumber AS w, count(*) AS n, count(*) FILTER (l_discount > 0.1) AS odd FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2)
SELECT e.l_suppkey, count(*) FILTER (s.n IS NULL) AS missing, count(*) FILTER (s.n > 1) AS repeated, coalesce(sum(odd), 0)::BIGINT AS odd FROM e LEFT JOIN s USING (l_suppkey, w) GROUP BY 1""",
)
def fresh_windows(t: Tables) -> DataFrame:
    e = t.lineitem.where("l_returnflag = 'A'").select("l_suppkey", F.col("l_linenumber").alias("w")).distinct()
    s = t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F'").groupBy("l_suppkey", F.col("l_linenumber").alias("w")).agg(_n(), F.count_if(F.col("l_discount") > 0.1).alias("odd"))
    return e.join(s, ["l_suppkey", "w"], "left").groupBy("l_suppkey").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"))


@query("v73_scope_hashes", "SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS digest, count(*) AS n FROM orders GROUP BY 1")
def scope_hashes(t: Tables) -> DataFrame:
    """A digest of a key's rows in order."""
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    text = F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",")
    return t.orders.groupBy("o_custkey").agg(F.sha2(text, 256).alias("digest"), _n())


@query(
    "v74_v75_contrast_and_forced_answers",
    """WITH g AS (SELECT l_orderkey AS k, min(l_linenumber) AS target, list_sort(list(DISTINCT l_linenumber)) AS claims, min(l_linenumber) FILTER (l_returnflag = 'A') AS strict FROM lineitem GROUP BY 1)
SELECT k, target, len(claims) - 1 AS alternatives, CASE WHEN len(claims) >= 2 THEN 'DECLARED' ELSE 'UNRESOLVED' END AS exclusivity, coalesce(strict, claims[1]) AS forced, strict IS NULL AS fallback FROM g""",
)
def contrast_groups(t: Tables) -> DataFrame:
    """A target with its alternatives, and the answer that is given if the strict one lacks: the first claim."""
    strict = F.min(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")))
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("target"), (F.countDistinct("l_linenumber") - 1).alias("alternatives"), strict.alias("strict"))
    return g.select("k", "target", "alternatives", F.when(F.col("alternatives") >= 1, "DECLARED").otherwise("UNRESOLVED").alias("exclusivity"), F.coalesce("strict", "target").alias("forced"), F.col("strict").isNull().alias("fallback"))


@query(
    "v79_phase_invariants",
    """SELECT l_suppkey, count(*) FILTER (l_quantity < 0 OR l_quantity > 50) AS outside, count(*) FILTER ((l_discount > 0.05) = (l_returnflag = 'N')) AS inconsistent, bool_or(l_discount > 0.09) AND bool_or(l_discount < 0.01) AS has_both FROM lineitem GROUP BY 1""",
)
def phase_invariants(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if((F.col("l_quantity") < 0) | (F.col("l_quantity") > 50)).alias("outside"), F.count_if((d > 0.05) == (F.col("l_returnflag") == "N")).alias("inconsistent"), (F.bool_or(d > 0.09) & F.bool_or(d < 0.01)).alias("has_both"))


@query(
    "w08_frames_and_tiles",
    """SELECT event_id, ntile(4) OVER w AS tile, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::BIGINT AS near, max(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def frames_and_tiles(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = F.floor("value")
    return t.events.select("event_id", F.ntile(4).over(w).cast("long").alias("tile"), F.sum(v).over(w.rowsBetween(-2, 1)).alias("near"), F.max(v).over(w.rangeBetween(-1000, 0)).alias("top"))


@query(
    "u06_checked_unique_sorted",
    "SELECT c_custkey AS id, c_name, count(*) OVER (PARTITION BY c_name) > 1 AS repeated FROM customer WHERE c_acctbal > 0",
)
def checked_unique(t: Tables) -> DataFrame:
    """Rows by id, with those told whose second key repeats: counts of keys, joined back."""
    rows = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_name")
    return rows.join(rows.groupBy("c_name").agg(_n()), "c_name").select("id", "c_name", (F.col("n") > 1).alias("repeated"))


@query(
    "a54_a55_schema_summary",
    """SELECT lang, count(*) AS n, min(n_chars) AS low, round(avg(n_chars), 4) AS mean, max(n_chars) AS high, count(*) FILTER (n_chars < 500) AS h0, count(*) FILTER (n_chars >= 500 AND n_chars < 2000) AS h1, count(*) FILTER (n_chars >= 2000) AS h2 FROM documents GROUP BY 1""",
)
def schema_summary(t: Tables) -> DataFrame:
    c = F.col("n_chars")
    return t.documents.groupBy("lang").agg(_n(), F.min(c).alias("low"), F.round(F.avg(c), 4).alias("mean"), F.max(c).alias("high"), F.count_if(c < 500).alias("h0"), F.count_if((c >= 500) & (c < 2000)).alias("h1"), F.count_if(c >= 2000).alias("h2"))


@query(
    "a60_guarded_alignment",
    """SELECT l_linestatus, count(*) FILTER (l_returnflag <> 'R') AS comparable, count(*) FILTER (l_returnflag = 'R') AS refused, round(avg(CASE WHEN l_returnflag <> 'R' THEN l_discount END), 6) AS box_mean, round(avg(CASE WHEN l_returnflag = 'A' THEN l_tax END), 6) AS span_mean FROM lineitem GROUP BY 1""",
)
def guarded_alignment(t: Tables) -> DataFrame:
    """Means over rows of the same coordinate system and time base; others are refused, not averaged."""
    of = lambda c, v: F.round(F.avg(F.when(c, F.col(v))), 6)
    f = F.col("l_returnflag")
    return t.lineitem.groupBy("l_linestatus").agg(F.count_if(f != "R").alias("comparable"), F.count_if(f == "R").alias("refused"), of(f != "R", "l_discount").alias("box_mean"), of(f == "A", "l_tax").alias("span_mean"))

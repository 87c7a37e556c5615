"""The trie of conversations' prefixes: rolling fingerprints group candidates, turns verify them, sums over paths roll up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from . import common

#: The base of the polynomial, odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Conversations share the first turns of one of so many, at most so many turns.
BLOCK, HEAD = 100, 5
#: Depths, and conversations by number, that one task orders together.
DEPTHS, IDS = 1024, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _powers(exponents: np.ndarray, base: int = BASE) -> np.ndarray:
    """base**e modulo 2**64, by the bits of the exponents."""
    out, square = np.ones(len(exponents), np.uint64), base
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        with np.errstate(over="ignore"):
            out = np.where((exponents >> bit) & 1 == 1, out * np.uint64(square), out)
        square = square * square % (1 << 64)
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, mark, chars, tie: a turn's role and text by their SHA-256, so that no text is exchanged."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("chars"))
    return rows.select("*", F.xxhash64("digest").alias("mark"), F.monotonically_increasing_id().alias("tie"))


SCAN = "conv_id long, part int, k long, before long, after long, digest binary, chars long, first_conv long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix sums of mark * BASE**place for each conversation of a sorted part; last, a row without digest that tells what the part's last conversation has come to."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in SCAN.split(", ")]
    last, first, count, total = None, None, 0, np.uint64(0)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        mark = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        first = int(conv[0]) if first is None else first
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        of = np.repeat(starts, np.diff(np.append(starts, n)))
        k = np.arange(n) - of
        goes_on = last is not None and int(conv[0]) == last
        if goes_on:
            k[of == 0] += count
        with np.errstate(over="ignore"):
            terms = mark * _powers(k)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
            after = sums[1:] - sums[of]
            if goes_on:
                after[of == 0] += total
            before = after - terms
        last, count, total = int(conv[-1]), int(k[-1]) + 1, after[-1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(k.astype(np.int64)), pa.array(before.view(np.int64)), pa.array(after.view(np.int64)), batch.column(1), batch.column(3), pa.nulls(n, pa.int64())], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([0], pa.int64()), pa.array(np.array([total], np.uint64).view(np.int64)), pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([first], pa.int64())], names=names)


def _carried(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """conv_id, part, turns and sum in the parts before: for conversations over more than one part. A row for each part reaches the driver."""
    parts = rows.where("digest is null").select("part", "first_conv", "conv_id", "k", "after").collect()
    out, open_, n, total = [], None, 0, 0
    for p in sorted(parts):
        if p.first_conv == open_:
            out.append((open_, p.part, n, total))
        if p.conv_id == open_ and p.first_conv == open_:
            n, total = n + p.k, (total + pow(BASE, n, 1 << 64) * p.after) % (1 << 64)
        else:
            open_, n, total = p.conv_id, p.k, p.after % (1 << 64)
    return [(c, p, n, s - (1 << 64) if s >> 63 else s) for c, p, n, s in out]


@pandas_udf(LongType())
def _moved(start: pd.Series, value: pd.Series, less: pd.Series, places: pd.Series) -> pd.Series:
    """start + (value - less) * BASE**places modulo 2**64; places may be negative."""
    by = places.to_numpy(np.int64)
    with np.errstate(over="ignore"):
        factor = _powers(np.maximum(by, 0)) * _powers(np.maximum(-by, 0), INVERSE)
        out = start.to_numpy(np.int64).view(np.uint64) + (value.to_numpy(np.int64).view(np.uint64) - less.to_numpy(np.int64).view(np.uint64)) * factor
    return pd.Series(out.view(np.int64))


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, before, after, digest, chars: the turns of each conversation by place, with the sums before and after.

    Turns are sorted by ranges of conversation and turn, so that a long conversation lies in many parts; each part is scanned
    once, and what its last conversation has come to is added in the parts behind.
    """
    spark = conversations.sparkSession
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "tie"]
    rows = turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "mark", "chars")
    rows = common.stored(rows.mapInArrow(_scan, SCAN), "turns")
    carry = F.broadcast(spark.createDataFrame(_carried(rows), "conv_id long, part int, more long, plus long"))
    rows = rows.where("digest is not null").join(carry, ["conv_id", "part"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("more", "plus")})
    zero = F.lit(0).cast("long")
    return rows.select("conv_id", (F.col("k") + F.col("more")).alias("pos"), _moved("plus", "before", zero, "more").alias("before"), _moved("plus", "after", zero, "more").alias("after"), "digest", "chars")


def _at(array: str, index: Column) -> Column:
    return F.get(F.col(array), index.cast("int"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """A row for each conversation: how its rebuilt form comes from its own turns and those of its block's first conversation.

    conv_id, length (own turns), top (the block's first), skip (own turns left out), taken (turns taken from the first one), start
    (sum over these), less (sum over the own ones left out), depth (turns rebuilt); for first ones, by depth from 1, how many others
    take so many turns (`joined`), and by depth from 0 which ones end there (`ended`), less than 100 each.
    """
    sums = [F.max(F.when(F.col("pos") == i, F.col("after"))) for i in range(HEAD)]
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), F.array(F.lit(0).cast("long"), *sums).alias("sums"))
    convs = convs.withColumn("top", F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK)))
    tops = convs.where("conv_id = top").select("top", F.col("length").alias("top_length"), F.col("sums").alias("top_sums"))
    first = F.col("conv_id") == F.col("top")
    skip = F.when(first, F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1))
    out = convs.join(tops, "top", "left").withColumn("skip", skip.cast("long"))
    out = out.withColumn("taken", F.least("skip", F.coalesce("top_length", F.lit(0))))
    out = out.select("conv_id", "length", "top", "skip", "taken", F.coalesce(_at("top_sums", F.col("taken")), F.lit(0)).alias("start"), F.coalesce(_at("sums", F.least("skip", "length")), F.lit(0)).alias("less"), (F.col("taken") + F.greatest(F.lit(0), F.col("length") - F.col("skip"))).alias("depth"))
    out = common.stored(out, "conversations")
    over = F.col("length") <= F.col("skip")
    others = out.where("conv_id <> top and taken > 0").groupBy("top").agg(
        F.array(*[F.count_if(F.col("taken") >= i) for i in range(1, HEAD + 1)]).alias("joined"),
        F.array(F.array().cast("array<long>"), *[F.collect_list(F.when(over & (F.col("taken") == i), F.col("conv_id"))) for i in range(1, HEAD + 1)]).alias("ended"),
    )
    return out.join(others.withColumnRenamed("top", "conv_id"), "conv_id", "left")


def sources(rows: DataFrame, convs: DataFrame, bits: int = 64) -> DataFrame:
    """The turns that stand in rebuilt conversations, each once: its depth there, the fingerprints of the prefix it ends (`label`) and of the one before (`parent`).

    Turns that others take are rows of the conversation that they come from, with their number (n) and the conversations that end
    there (ended). up_conv, up_pos: where the turn before stands; `bits` of the fingerprints are kept.
    """
    shift = F.col("taken") - F.col("skip")
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    depth = F.col("pos") + shift + 1
    own = F.when(F.col("pos") == F.col("length") - 1, F.array("conv_id")).otherwise(F.array().cast("array<long>"))
    inner = F.col("pos") > F.col("skip")
    out = rows.join(convs, "conv_id").where("pos >= skip")
    return out.select(
        "conv_id", "pos", depth.alias("depth"), "digest", "chars",
        _moved("start", "after", "less", shift).bitwiseAND(mask).alias("label"), _moved("start", "before", "less", shift).bitwiseAND(mask).alias("parent"),
        (1 + F.coalesce(_at("joined", depth - 1), F.lit(0))).alias("n"), F.concat(own, F.coalesce(_at("ended", depth), F.array().cast("array<long>"))).alias("ended"),
        F.when(inner, F.col("conv_id")).when(F.col("taken") > 0, F.col("top")).alias("up_conv"), F.when(inner, F.col("pos") - 1).otherwise(F.col("taken") - 1).alias("up_pos"),
    )


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with labels that stand for one prefix each, and the nodes: depth, label, parent, n, least, chars.

    The turns of a label are held against the one of its representative, the smallest conversation: the turn itself by SHA-256, and the
    label of the prefix before. If no label differs at any depth, the turns are equal one by one from the first to the last.
    Labels that differ are split by turn and parent, and what follows on them gets the new parent, until none differs.
    """
    what = F.struct("parent", "digest")
    turn = 0
    while True:
        groups = rows.groupBy("depth", "label").agg(F.sum("n").alias("n"), F.min("conv_id").alias("least"), F.min_by("chars", "conv_id").alias("chars"), F.min_by(what, "conv_id").alias("first"), F.min(what).alias("low"), F.max(what).alias("high"))
        groups = groups.select("depth", "label", "n", "least", "chars", F.col("first.parent").alias("parent"), ((F.col("low") != F.col("first")) | (F.col("high") != F.col("first"))).alias("mixed"))
        groups = common.stored(groups, "nodes")
        mixed = groups.where("mixed").select("depth", "label", "mixed")
        if mixed.isEmpty():
            return rows, groups.drop("mixed")
        turn += 1
        split = rows.join(mixed, ["depth", "label"], "left").withColumn("label", F.when(F.col("mixed"), F.xxhash64("label", "parent", "digest", F.lit(turn))).otherwise(F.col("label")))
        split = common.stored(split, "split")
        moved = split.where("mixed").select(F.col("conv_id").alias("up_conv"), F.col("pos").alias("up_pos"), F.col("label").alias("moved"))
        rows = split.drop("mixed").join(moved, ["up_conv", "up_pos"], "left").withColumn("parent", F.coalesce("moved", "parent")).drop("moved")
        rows = common.stored(rows.select(*[c for c in split.columns if c != "mixed"]), "split")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal (depth, label) in sorted rows; only the state of one digest is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for depth, label, ids in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2).to_pylist()):
            if (depth, label) != now:
                if state is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (depth, label), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done)], names=["depth", "label", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])], names=["depth", "label", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, label, ends_sha256 of ends (depth, label, conv_id): identifiers are joined in blocks of numbers, and the blocks in order go through one digest."""
    blocks = ends.groupBy("depth", "label", F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    order = blocks.repartition("depth", "label").sortWithinPartitions("depth", "label", "block")
    return order.select("depth", "label", "ids").mapInArrow(_hashed, "depth long, label long, ends_sha256 string")


def trie(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, as the contract of op12 says.

    Sums over subtrees are sums over paths: a node's weight belongs to its smallest conversation, and each node adds the weights of the
    conversations that pass it, those of its own smallest one from its depth on. So no level waits for the level below.

    Rows with a null conv_id are of no conversation and left out; a null turn comes first, equal turns are ordered by the SHA-256 of their content, null roles and texts are
    empty, repeated rows are turns each. Blocks are of 100 from a multiple of 100 on, for negative numbers too. Other columns are not read. An
    empty table has no node, not even the root. `bits` of fingerprints are kept: few make many collisions, and the same result.
    """
    spark = conversations.sparkSession
    rows = placed(conversations)
    convs = rebuilt(rows)
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not top.n:
        return spark.createDataFrame([], schema)
    turns_, nodes = verified(common.stored(sources(rows, convs, bits), "sources"))

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("label")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children.where("depth > 0"), ["depth", "label"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = common.stored(nodes.withColumn("w", (F.col("n") - 1) * F.col("chars")), "nodes")
    # the weight of each conversation: of the nodes whose smallest it is, and whether it ends one without children
    own = common.stored(nodes.groupBy(F.col("least").alias("conv_id")).agg(F.sum("w").alias("weight"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "weights")
    steps = range(1, HEAD + 1)
    taken = convs.where("conv_id <> top and taken > 0").select("conv_id", "top", "taken").join(own, "conv_id")
    taken = taken.groupBy(F.col("top").alias("conv_id")).agg(*[F.array(*[F.sum(F.when(F.col("taken") >= i, F.col(c)).otherwise(0)) for i in steps]).alias(f"{c}s") for c in ("weight", "leaf")])
    passing = turns_.join(nodes.where("n > 1").select("depth", "label"), ["depth", "label"]).select("depth", "label", "conv_id").join(own, "conv_id", "left").join(taken, "conv_id", "left")
    shared = passing.groupBy("depth", "label").agg(*[F.sum(F.coalesce(c, F.lit(0)) + F.coalesce(_at(f"{c}s", F.col("depth") - 1), F.lit(0))).alias(f"all_{c}") for c in ("weight", "leaf")])

    # of a node's smallest conversation, the weights from its depth on: within blocks of depths, and of the blocks below
    deep = nodes.where("n > 1").select("depth", "label", "least", "w", F.floor(F.col("depth") / DEPTHS).alias("block"))
    blocks = deep.groupBy("least", "block").agg(F.sum("w").alias("w"))
    below = F.coalesce(F.sum("w").over(Window.partitionBy("least").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("w").over(Window.partitionBy("least", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    deep = deep.select("depth", "label", "least", "block", inside.alias("inside")).join(blocks.select("least", "block", below.alias("below")), ["least", "block"])
    deep = deep.select("depth", "label", (F.col("inside") + F.col("below")).alias("own_weight"))

    root = own.agg(F.sum("weight").alias("w"), F.sum("leaf").alias("leaves")).first()
    ends = turns_.select("depth", "label", F.explode("ended").alias("conv_id")).unionByName(convs.where("depth = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("label"), "conv_id"))
    digests = end_digests(ends)
    firsts = nodes.where("depth = 1").count()
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("label").alias("parent"), F.col("least").alias("parent_conv_id"))
    linked = nodes.where("depth > 1").join(above, ["depth", "parent"]).unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(top.least)))
    out = linked.join(shared, ["depth", "label"], "left").join(deep, ["depth", "label"], "left").join(own.select(F.col("conv_id").alias("least"), "weight"), "least", "left")
    out = out.select(
        "depth", "label", F.col("least").alias("conv_id"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.when(F.col("n") > 1, F.col("all_leaf")).otherwise(1).alias("n_leaves"), F.when(F.col("n") > 1, F.col("own_weight") + F.col("all_weight") - F.col("weight")).otherwise(0).alias("saved_tokens"),
    )
    start = spark.createDataFrame([(0, 0, top.least, None, top.n, firsts, root.leaves or 1, root.w or 0)], "depth long, label long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    out = out.unionByName(start).join(digests, ["depth", "label"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


SQL = """WITH own AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) AS turns FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1),
bits AS (SELECT conv_id, turns, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS b FROM own),
heads AS (SELECT conv_id, turns, xor(list_reduce([4294967295::BIGINT] || b, lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295) % 6 AS h FROM bits),
made AS (SELECT c.conv_id, coalesce(o.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns FROM heads c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100),
paths AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS p FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM made)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n) AS ends FROM paths GROUP BY 1, 2),
linked AS (SELECT v.*, u.conv_id AS parent_conv_id, CASE WHEN v.d > 0 THEN (v.n_convs - 1) * length(v.p[v.d].t) ELSE 0 END AS w FROM nodes v LEFT JOIN nodes u ON u.d = v.d - 1 AND u.p = v.p[1:v.d - 1]),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k USING (d, p)),
rolled AS (SELECT a.d, a.p, sum(a.w) AS saved, count(*) FILTER (a.n_children = 0) AS leaves FROM (SELECT unnest(range(0, f.d + 1)) AS d, f.p[1:unnest(range(0, f.d + 1))] AS p, f.w, f.n_children FROM full_ f) a GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, r.leaves AS n_leaves, r.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256 FROM full_ f JOIN rolled r USING (d, p)"""

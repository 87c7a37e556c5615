"""Near duplicates: b-bit MinHash signatures, bands, confirmed links and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textnum import bytes_of, hashes, mix, runs

#: Words of a shingle, and the least Jaccard similarity of a link in hundredths.
SHINGLE, PERCENT = 5, 80
#: Minima; bits kept of each; bands and the minima of each. At similarity 0.8 a pair shares no band once in 10**9.
MINIMA, BITS, BANDS, ROWS = 256, 4, 40, 4
#: Standard deviations by which an estimate may fall short of the threshold before a candidate is given up.
SIGMAS = 5.0
#: Documents of each side that meet at once, about.
BLOCK = 256
#: Tasks that a key with many rows is dealt over; a band is heavy if it has more than one entry in HEAVY, so there are at most HEAVY of them.
SALT, HEAVY = 16, 1024

_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = _RNG.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)
_LONGS = MINIMA * BITS // 64


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of fewer words, of the whole sequence; of none, empty."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    at = np.arange(max(1, n - size + 1))
    return np.unique(runs(words, at, at + min(size, n), 1))


def minima(items: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 2**32 - 1, np.uint32)
    keys = (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(keys), 2048):
        np.minimum(low, ((keys[k : k + 2048, None] ^ _XOR) * _MUL).min(0), out=low)
    return low


def signature(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the low bits of all minima packed into 64-bit numbers."""
    part = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix((key << np.uint64(1)) ^ key ^ (part[:, k] + np.uint64(0x9E3779B97F4A7C15)))
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(_LONGS, 64 // BITS)
    packed = np.bitwise_or.reduce(bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)
    return key.view(np.int64), packed.view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (size of the set), f1, f2 (its hash), bands, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            n, f1, f2, bands, sigs = [], [], [], [], []
            for text in batch.column(1):
                items = shingles(hashes(text.as_py() or "", lower=True), size)
                n.append(len(items))
                f1.append(np.add.reduce(mix(items), dtype=np.uint64).view(np.int64) if len(items) else 0)
                f2.append(np.bitwise_xor.reduce(mix(items + np.uint64(1))).view(np.int64) if len(items) else 0)
                band, sig = signature(minima(items)) if len(items) else none
                bands.append(band)
                sigs.append(sig)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(bands), _lists(sigs)], names=["doc_id", "n", "f1", "f2", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>, sig array<long>")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two sets by their packed signatures, corrected for low bits that agree by chance."""
    differ = F.lit(0)
    ones = F.lit(int("1" * (64 // BITS), 1 << BITS))
    for i in range(_LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(folded.bitwiseAND(ones))
    chance = 2.0**-BITS
    return (1 - differ / F.lit(MINIMA) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    p = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    return percent / 100 - SIGMAS * (p * (1 - p) / MINIMA) ** 0.5 / (1 - 2.0**-BITS)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, z: compressed texts of the documents in `ids` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, z binary")
    return rows.join(ids, "id", "left_semi")


def _salt(ident: str) -> Column:
    return F.pmod(F.xxhash64(F.col(ident)), F.lit(SALT)).cast("int")


def _looked_up(rows: DataFrame, key: str, ident: str, table: DataFrame) -> DataFrame:
    """`rows` with the columns of `table` at `key`, unique there; null where it has none.

    Rows that share a key are dealt over SALT tasks by `ident`, and the table's row is sent to those that have any.
    """
    rows = rows.withColumn("salt", _salt(ident))
    found = rows.select(key, "salt").distinct().join(table, key)
    return rows.join(found, [key, "salt"], "left").drop("salt")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of `pairs` (a, na, b, nb) those whose full sets, of na and nb shingles, have the similarity."""
    rows = _looked_up(pairs, "b", "a", texts.select(F.col("id").alias("b"), F.col("z").alias("zb")))
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").where("zb IS NOT NULL").select("a", "na", "b", "nb", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, za, zb in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5))):
                x, y = _set_of(za, size), _set_of(zb, size)
                # rows that repeat an identifier with another text are told by the size of the set
                keep.append(len(x) == na and len(y) == nb and _similar(x, y, percent))
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _set_of(squeezed: bytes, size: int) -> np.ndarray:
    return shingles(hashes(zstandard.decompress(squeezed).decode(), lower=True), size)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def components(links: DataFrame) -> DataFrame:
    """id, comp: the smallest identifier that each end of `links` (a, b) reaches.

    Rounds of taking the least label among neighbours and then the label of the label; each step is a table in the
    shared folder, so plans stay short. Ends once a round changes nothing.
    """
    both = common.stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = common.stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("comp")), "labels")
    while True:
        near = _looked_up(both, "b", "a", labels.select(F.col("id").alias("b"), "comp")).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = common.stored(labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("low")), "labels")
        new = common.stored(_jumped(step, labels), "labels")
        labels = new.select("id", "comp")
        if new.where("comp != old").isEmpty():
            return labels


def _jumped(step: DataFrame, labels: DataFrame) -> DataFrame:
    root = labels.select(F.col("id").alias("low"), F.col("comp").alias("root"))
    return _looked_up(step, "low", "id", root).select("id", "old", F.least("low", "root").alias("comp"))


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs` (doc_id, text).

    A document's set: the distinct runs of `size` words of its text with A-Z in lower case; with fewer words, the whole
    sequence as one; without words, empty. Documents of equal sets form a class. Classes that share a band are
    candidates; those whose b-bit estimate reaches the threshold, less a margin of standard deviations, are confirmed on
    the full sets. component_id is the smallest doc_id reachable by links, kept whether it is the document's own.

    No bucket's pairs are listed. A class is estimated against the first and last of its buckets and confirmed with the best,
    which gives first components. Then, in one pass, every pair of a bucket that lies in different components meets, in
    blocks of numpy arrays: documents outside their bucket's largest component with all of that component, and with each
    other. Blocks give links, at most one for a document and component, so what is written never grows with the square of a
    group; a group that no link holds together is compared pair by pair all the same, as nothing less would be exact.

    Null and empty texts: n_shingles 0, linked with nothing. Null doc_id: linked with nothing, null component, kept.
    Rows that repeat a doc_id: each judged by its own text; links of any of them are the document's. Other columns are
    not read. An empty table gives an empty result.
    """
    cut = least_estimate(percent)
    rows = common.stored(_signed(docs, size), "signed")
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    nodes = common.stored(real.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).drop("f1", "f2"), "nodes")
    members = _members(nodes)
    texts = common.stored(_texts(docs, members.select("id").distinct()), "texts")
    signs = nodes.select("id", "n", "sig")
    best = common.stored(_best(members, signs, percent, cut), "best")
    labels = components(common.stored(_confirmed(best, texts, size, percent), "confirmed"))
    meetings = _meetings(_placed(members, labels), labels)
    near = common.stored(_dealt(meetings.join(signs, "id")).mapInArrow(_near(percent, cut), "g long, side int, comp long, id long, n long"), "near")
    links = common.stored(_dealt(near.join(texts, "id")).mapInArrow(_linked(size, percent), "a long, ca long, b long, cb long"), "linked")
    return _labelled(rows, real, _merged(labels, links))


def _members(nodes: DataFrame) -> DataFrame:
    """band, salt, salts, low, high, id: the entries of buckets with several classes. A heavy band's are dealt over SALT salts."""
    entries = nodes.select("id", F.explode("bands").alias("band"))
    sizes = entries.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    sizes = common.stored(sizes, "buckets")
    most = max(BLOCK, nodes.count() * BANDS // HEAVY)
    heavy = F.broadcast(sizes.where(F.col("size") > most).select("band", F.lit(SALT).alias("salts")))  # at most HEAVY rows
    salts = F.when(F.col("size") > most, SALT).otherwise(1)
    buckets = sizes.select("band", "low", "high", salts.alias("salts")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = entries.join(heavy, "band", "left").select("band", "id", F.when(F.col("salts").isNull(), 0).otherwise(_salt("id")).alias("salt"))
    return common.stored(dealt.join(buckets, ["band", "salt"]), "members")


def _best(members: DataFrame, signs: DataFrame, percent: int, cut: float) -> DataFrame:
    """a, na, b, nb: for each class that of the first and last ones of its buckets which is nearest by estimate, if near enough."""
    pairs = common.stored(members.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a != b").distinct(), "pairs")
    of = lambda end: signs.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("sig").alias(f"s{end}"))
    both = _looked_up(pairs, "b", "a", of("b")).join(of("a"), "a").where(_sizes_fit("na", "nb", percent))
    both = both.select("a", "na", "b", "nb", estimate(F.col("sa"), F.col("sb")).alias("est")).where(F.col("est") >= cut)
    return both.groupBy("a", "na").agg(F.max_by(F.struct("b", "nb"), F.struct("est", F.col("b"))).alias("best")).select("a", "na", "best.b", "best.nb")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes differ too much can't be similar enough: an exact bound."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, id, comp, main, main_size, few: members of the buckets that hold several components, with the largest of these and the number of members outside it."""
    placed = common.stored(members.select("band", "salt", "salts", "id").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "labelled")
    sizes = placed.groupBy("band", "salts", "comp").agg(F.count(F.lit(1)).alias("size"))
    top = F.max(F.struct("size", "comp")).alias("top")
    open_ = sizes.groupBy("band", "salts").agg(F.count(F.lit(1)).alias("comps"), F.sum("size").alias("of"), top).where("comps > 1")
    open_ = open_.select("band", F.col("top.comp").alias("main"), F.col("top.size").alias("main_size"), "of", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    few = F.when(F.col("main_size") > 1, F.col("of") - F.col("main_size")).otherwise(F.col("of"))
    return common.stored(placed.join(open_, ["band", "salt"]).select("band", "id", "comp", "main", "main_size", few.alias("few")), "placed")


def _block_pairs(rows: DataFrame, group: Column) -> DataFrame:
    """g, side, comp, id: each row of a group (blocks, comp, id) in each pair of blocks that has its own; in a pair with itself it meets all others (side 2)."""
    own, other = F.col("own"), F.col("other")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    return rows.select(F.xxhash64(group, F.least(own, other), F.greatest(own, other)).alias("g"), side.alias("side"), "comp", "id")


def _meetings(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """g, side, comp, id: who meets whom. In a group, side 0 meets side 1, and members of side 2 meet each other.

    Documents outside their bucket's main component meet each other, bucket by bucket, and all blocks of that component.
    """
    few = placed.where("(comp != main OR main_size = 1) AND few > 1")
    among = _block_pairs(few.select("band", "comp", "id", F.ceil(F.col("few") / BLOCK).cast("int").alias("blocks")), F.col("band"))
    asks = common.stored(placed.where("comp != main AND main_size > 1").select(F.col("main").alias("of"), "comp", "id").distinct(), "asks")
    sizes = labels.groupBy(F.col("comp").alias("of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m"))
    wanted = asks.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q")).join(sizes, "of")
    wanted = common.stored(wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), "wanted")
    key = lambda: F.xxhash64("of", "mb", "qb", F.lit("asks")).alias("g")
    own = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    q = asks.withColumn("salt", _salt("id")).join(wanted, ["of", "salt"]).withColumn("qb", own("q")).withColumn("mb", every("m")).select(key(), F.lit(0).alias("side"), "comp", "id")
    m = labels.withColumn("of", F.col("comp")).withColumn("salt", _salt("id")).join(wanted, ["of", "salt"]).withColumn("mb", own("m")).withColumn("qb", every("q"))
    return among.unionByName(q).unionByName(m.select(key(), F.lit(1).alias("side"), "comp", "id"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in order of `g`, several whole groups at a time, with the bounds of the groups."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        g = held.column("g").to_numpy()
        edges = np.flatnonzero(g[1:] != g[:-1]) + 1
        if len(edges):
            yield held.slice(0, int(edges[-1])), np.concatenate([[0], edges])
            held = held.slice(int(edges[-1]))
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of each signature in `a` and each in `b`."""
    folded = a[:, None, :] ^ b[None, :, :]
    whole = folded.copy()
    for k in range(1, BITS):
        folded |= whole >> np.uint64(k)
    differ = np.bitwise_count(folded & np.uint64(int("1" * (64 // BITS), 1 << BITS))).sum(2, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def _meeting(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a group that ask and rows that answer."""
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _near(percent: int, cut: float):
    """The rows that some row they meet, of another component, is near to by size and estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _groups(batches):
            side, comp, n = (batch.column(c).to_numpy() for c in ("side", "comp", "n"))
            sig = batch.column("sig").flatten().to_numpy().view(np.uint64).reshape(-1, _LONGS)
            keep = np.zeros(len(side), bool)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                q, m = _meeting(side[lo:hi])
                if hi - lo < 2 or not len(q) or not len(m):
                    continue
                q, m = q + lo, m + lo
                fit = 100 * np.minimum(n[q][:, None], n[m]) >= percent * np.maximum(n[q][:, None], n[m])
                fit &= comp[q][:, None] != comp[m]
                if fit.any():
                    fit &= _estimates(sig[q], sig[m]) >= cut
                    keep[q[fit.any(1)]] = True
                    keep[m[fit.any(0)]] = True
            yield batch.filter(pa.array(keep)).select(["g", "side", "comp", "id", "n"])

    return run


def _linked(size: int, percent: int):
    """a, ca, b, cb: for each row that asks, and each other component that it meets, the first linked row by the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _groups(batches):
            side, comp, ids, n = (batch.column(c).to_numpy() for c in ("side", "comp", "id", "n"))
            out: list[tuple[int, int, int, int]] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                q, m = _meeting(side[lo:hi])
                if not len(q) or not len(m):
                    continue
                sets = [_set_of(z.as_py(), size) for z in batch.column("z").slice(lo, hi - lo)]
                lengths = np.array([len(s) for s in sets])
                right = lengths == n[lo:hi]  # another text under the same identifier has another size
                items = np.concatenate([sets[k] for k in m])
                order = np.argsort(items, kind="stable")
                items, owner = items[order], np.repeat(np.arange(len(m)), lengths[m])[order]
                for k in q.tolist():
                    if not right[k]:
                        continue
                    first, count = np.searchsorted(items, sets[k], "left"), np.searchsorted(items, sets[k], "right")
                    count -= first
                    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    both = np.bincount(owner[at], minlength=len(m))
                    link = right[m] & (comp[lo:hi][m] != comp[lo + k]) & (100 * both >= percent * (lengths[k] + lengths[m] - both))
                    if side[lo + k] == 2:
                        link &= comp[lo:hi][m] > comp[lo + k]  # the other one asks too
                    at = m[link] + lo
                    for c, b in dict(zip(comp[at][::-1].tolist(), ids[at][::-1].tolist())).items():
                        out.append((int(ids[lo + k]), int(comp[lo + k]), b, c))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["a", "ca", "b", "cb"])

    return run


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links (a, ca, b, cb) between components; only the graph of components is walked."""
    roots = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    alone = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").withColumn("comp", F.col("id"))
    known = common.stored(labels.unionByName(alone), "labels")
    return common.stored(_looked_up(known, "comp", "id", roots).select("id", F.coalesce("root", "comp").alias("comp")), "labels")


def _labelled(rows: DataFrame, real: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of all rows, copies included; a class with a third of all rows is joined run by run."""
    classes = common.elect(real.select("f1", "f2", "n", "doc_id"), ["f1", "f2", "n"], "doc_id", smallest=True)
    classes = classes.join(labels.select(F.col("id").alias("keep"), "comp"), "keep", "left").select("f1", "f2", "n", "run", F.coalesce("comp", "keep").alias("class_comp"))
    out = rows.select("doc_id", "n", "f1", "f2", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), common.run_of("doc_id")).alias("run")).join(classes, ["f1", "f2", "n", "run"], "left")
    out = out.join(labels.select(F.col("id").alias("doc_id"), F.col("comp").alias("own_comp")), "doc_id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("class_comp", "own_comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose document is the first of its group, with their columns unchanged.

    Where rows share a doc_id and differ in text, each text counts as a document of its own. Rows without doc_id stay.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("least"), F.max(text).alias("most"))
    shared = common.stored(shared.where("least != most").select(F.col("doc_id").alias("__shared")), "shared_ids")
    if not shared.isEmpty():
        return _drop_near_texts(docs, shared, size, percent)
    lost = near_groups(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, docs["doc_id"] == F.col("__lost"), "left_anti")


def _drop_near_texts(docs: DataFrame, shared: DataFrame, size: int, percent: int) -> DataFrame:
    """`drop_near` where the doc_ids in `shared` (__shared) stand for several texts: there a hash of doc_id and text is the identifier.

    The first of a group is that of the least doc_id. Rows are joined by identifier, so a large group isn't gathered.
    """
    own = F.when(F.col("__shared").isNull(), F.col("doc_id").cast("long")).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    rows = docs.join(shared, docs["doc_id"] == F.col("__shared"), "left").withColumn("__own", own)
    rows = common.stored(rows.select(*docs.columns, "__own"), "own_ids")
    groups = near_groups(rows.select(F.col("__own").alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias("__g"), F.col("component_id").alias("__c"))
    placed = groups.where("__g IS NOT NULL").join(rows.where("__own IS NOT NULL").select("doc_id", "__own").distinct(), F.col("__g") == F.col("__own"))
    first = placed.groupBy("__c").agg(F.min(F.struct("doc_id", "__own")).alias("first")).select(F.col("first.__own").alias("__first"))
    return rows.join(first, rows["__own"] == F.col("__first"), "left").where("__own IS NULL OR __first IS NOT NULL").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents"), size=2)

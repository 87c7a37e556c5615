"""Rule figures of whole texts, and lines that too many documents of a host share. DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A line is above the limits when at least MIN_DOCS documents of its host have it, and more than SHARE of them: a share behaves alike at every size.
MIN_DOCS, SHARE = 5, 0.02
#: A document is depleted when less than this share of its words is left.
LEFT = 0.5


def _lines(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it occurs there and wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words of the array `w` in 3-word windows found twice or more.

    Windows are sorted by hash, so that equal ones are neighbours; the positions of those that have an equal neighbour are
    sorted, and each adds its three words less those that the one before has added.
    """
    n = F.size(w)
    mark = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
    marks = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), mark))

    def hits(m: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(m, i)["h"] == F.get(m, j)["h"], F.lit(False))
        found = F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.when(same(i, i - 1) | same(i, i + 1), F.get(m, i)["p"]))
        return F.array_sort(F.array_compact(found))

    begin = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
    add = lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum"), p.alias("last"))
    return F.when(n < 4, F.lit(0)).otherwise(F.aggregate(_let(marks, hits), begin, add, lambda s: s["sum"]))


def figures(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, source) to doc_id, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Everything is an expression on its own row; no rows are exchanged. Windows are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = _let(common.words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), text.alias("text"), counts.alias("c")).select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.col("c.n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", common.SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(_lines(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("c.repeat").cast("long").alias("n_repeat_words"),
    )


def _line_rows(docs: DataFrame) -> DataFrame:
    """source, doc_id, text_hash, pos, line (hash of the normalised line), n (its words): a row for each line with a word."""
    normal = F.lower(F.trim(F.regexp_replace("line", common.SPACES, " ")))
    return (
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("source", "doc_id", "text_hash", "pos", normal.alias("line"))
        .select("source", "doc_id", "text_hash", "pos", F.xxhash64("line").alias("line"), F.size(F.split("line", " ")).alias("n"))
    )


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """source, line: hashes of normalised lines that at least `min_docs` documents of a host have, and more than `share` of its documents.

    Documents are distinct doc_ids on both sides; rows that repeat one count once, and rows without one together as one.
    Counts are taken before the exchange, so a line or host with a third of all rows arrives as a few partial counts.
    """
    doc = F.struct("doc_id")  # counts null as a value
    lines = _line_rows(docs).groupBy("source", "line").agg(F.countDistinct(doc).alias("docs")).where(F.col("docs") >= min_docs)
    hosts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.countDistinct(doc).alias("of"))
    return lines.join(hosts, "source").where(F.col("docs") > share * F.col("of")).select("source", "line")


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_common_words for each row of `docs`.

    Lines are normalised (lower case, single spaces) and hashed; lines above the limits are removed from each document,
    and a document of which less than `left` of the words are left is rejected, as are those that fail the base rules.

    Null text: no words, fails the base. Null source: the host "". Null doc_id: judged as any other. Repeated rows give
    repeated results. Other columns are not read. An empty table gives an empty result.
    """
    frequent = common.stored(common_lines(docs, min_docs, share), "lines")  # its size decides how it is joined
    hits = _line_rows(docs).join(frequent, ["source", "line"])
    once = hits.groupBy("doc_id", "text_hash", "source", "pos").agg(F.max("n").alias("n"))  # repeated rows count once
    removed = once.groupBy("doc_id", "text_hash", "source").agg(F.sum("n").alias("removed")).select(*[F.col(c).alias(f"r_{c}") for c in ("doc_id", "text_hash", "source")], "removed")
    rows = figures(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("removed", F.lit(0))
    return (
        rows.join(removed, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("text_hash") == F.col("r_text_hash")) & (F.col("source") == F.col("r_source")), "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("n_words") - gone >= left * F.col("n_words"))).alias("kept"), gone.cast("long").alias("n_common_words"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, line FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
nl AS (SELECT doc_id, source, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM l),
hosts AS (SELECT source, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS of FROM d GROUP BY source),
freq AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS docs FROM nl GROUP BY source, line) JOIN hosts USING (source) WHERE docs >= 5 AND docs > 0.02 * of),
gone AS (SELECT doc_id, sum(len(string_split(line, ' ')))::BIGINT AS gone FROM nl JOIN freq USING (source, line) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_common_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_common_words >= 0.5 * n_words AS kept, n_common_words
FROM f
"""

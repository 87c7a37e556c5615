"""Column expressions that read answers, identifiers and scores out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def pairs(text: Column, pattern: str, first: int = 1, second: int = 2) -> Column:
    """Array of (start, end) for each match of a pattern with two numbers."""
    a, b = F.regexp_extract_all(text, F.lit(pattern), F.lit(first)), F.regexp_extract_all(text, F.lit(pattern), F.lit(second))
    return F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("start"), y.cast("double").alias("end")))


def dash_segments(text: Column) -> Column:
    return pairs(text, NUMBER + r"\s*-\s*" + NUMBER)


def to_segments(text: Column) -> Column:
    """`from a to b`, rounded to two digits, then clock times `h:m:s to h:m:s`."""
    plain = F.transform(pairs(text, rf"(?i){NUMBER}(?:s| seconds?)?\s*to\s*{NUMBER}(?:s| seconds?)?"), lambda s: F.struct(F.bround(s["start"], 2).alias("start"), F.bround(s["end"], 2).alias("end")))
    clock = r"(?i)([0-9]+):([0-9]+):([0-9]+)\s+to\s+([0-9]+):([0-9]+):([0-9]+)"
    part = [F.transform(F.regexp_extract_all(text, F.lit(clock), F.lit(k)), lambda x: x.cast("double")) for k in range(1, 7)]
    at = lambda i, k: F.get(part[k], i) * 3600 + F.get(part[k + 1], i) * 60 + F.get(part[k + 2], i)
    n = F.size(part[0])
    empty = F.array().cast("array<struct<start:double,end:double>>")
    clocks = F.when(n == 0, empty).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(at(i, 0).alias("start"), at(i, 3).alias("end"))))
    return F.concat(plain, clocks)


def segments(text: Column) -> Column:
    """Segments written `a-b`; where there are none, those of `to_segments`."""
    dashed = dash_segments(text)
    return F.when(F.size(dashed) > 0, dashed).otherwise(to_segments(text))


def caption_lines(text: Column) -> Column:
    """Array of (start, end, caption) from lines `a-b seconds: caption`; a caption runs to the next such line."""
    pattern = rf"(?s){NUMBER}\s*-\s*{NUMBER}\s*seconds?:\s*(.*?)(?=\s*[0-9]+(?:\.[0-9]+)?\s*-\s*[0-9]+(?:\.[0-9]+)?\s*seconds?:|\z)"
    spans = pairs(text, pattern)
    captions = F.regexp_extract_all(text, F.lit(pattern), F.lit(3))
    return F.zip_with(spans, captions, lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.trim(c).alias("caption")))


def box_series(text: Column) -> Column:
    """Array of (t, box) from `t seconds: [x1, y1, x2, y2]`, each time once where it is first told, with the box told last.

    What isn't four decimal numbers takes the last box before it, and is left out where there is none. Null texts give null.
    """
    pattern = r"(\d+(?:\.\d+)?)\s+seconds:\s*\[([^\]]+)\]"
    number = r"^\s*\[*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
    told = lambda b: F.transform(F.split(b, ","), lambda x: F.nullif(F.regexp_extract(x, number, 1), F.lit("")).try_cast("double"))
    whole = lambda b: F.get(F.filter(F.array(told(b)), lambda n: (F.size(n) == 4) & F.forall(n, lambda x: x.isNotNull())), F.lit(0))
    rows = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda t, b: F.struct(t.cast("double").alias("t"), whole(b).alias("box")))
    kind = "array<struct<t:double,box:array<double>>>"
    step = lambda acc, r: F.concat(acc, F.array(F.struct(r["t"].alias("t"), F.coalesce(r["box"], F.get(F.slice(acc, -1, 1), F.lit(0))["box"]).alias("box"))))
    once = lambda acc: F.transform(F.array_distinct(F.transform(acc, lambda r: r["t"])), lambda t: F.element_at(F.filter(acc, lambda r: r["t"] == t), -1))
    return F.aggregate(rows, F.array().cast(kind), step, lambda acc: once(F.filter(acc, lambda r: r["box"].isNotNull())))


def yes_no(text: Column) -> Column:
    """YES, NO or INVALID."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(flat.rlike(r"^(?i)yes[.!]?$"), F.lit("YES")).when(flat.rlike(r"^(?i)no[.!]?$"), F.lit("NO")).otherwise("INVALID")


def named_scores(text: Column, pattern: str) -> Column:
    """Array of (name, score) from parts between commas that match a pattern with a name and a number."""
    parts = F.filter(F.split(text, ","), lambda p: p.rlike(pattern))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, pattern, 1)).alias("name"), F.regexp_extract(p, pattern, 2).cast("int").alias("score")))


def component_scores(text: Column) -> Column:
    return named_scores(text, r"([A-Za-z ]+):\s*([0-9]+)")


def aspect_scores(text: Column) -> Column:
    return named_scores(text, r"([A-Za-z /]+):\s*([0-9]+)\s*/\s*5")


def mean_out_of_five(text: Column) -> Column:
    scores = F.regexp_extract_all(text, F.lit(r"([0-9]+)\s*/\s*5"), F.lit(1))
    return F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(scores))


def skill_level(mean: Column) -> Column:
    return F.when(mean <= 2.0, F.lit("novice")).when(mean <= 3.5, F.lit("intermediate")).when(mean.isNotNull(), F.lit("expert"))


def rating_of_total(total: Column) -> Column:
    return F.when(total <= 1, F.lit("poor")).when(total <= 3, F.lit("fair")).when(total <= 5, F.lit("good")).when(total.isNotNull(), F.lit("excellent"))


def first_match(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """Value of the first rule whose key the lower-case text contains: order matters."""
    out = None
    for key, value in rules:
        hit = F.contains(F.lower(text), F.lit(key))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(default)


def answer_letter(text: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(text, r"(?i)\b([A-D])\b", 1), F.lit("")))


def id_parts(ident: Column, mark: str = "&&") -> Column:
    """Struct (video, start, end, fps) of an identifier of exactly four parts; null otherwise."""
    p = F.split(ident, mark)
    at = lambda k: F.get(p, F.lit(k))
    return F.when(F.size(p) == 4, F.struct(at(0).alias("video"), at(1).try_cast("int").alias("start"), at(2).try_cast("int").alias("end"), at(3).try_cast("double").alias("fps")))


def turn(conversation: Column, speakers: list[str], last: bool = False) -> Column:
    """First or last turn of any of the speakers, without the video mark."""
    turns = F.filter(conversation, lambda t: t["from"].isin(speakers))
    value = (F.try_element_at(turns, F.lit(-1)) if last else F.get(turns, F.lit(0)))["value"]
    return F.trim(F.replace(value, F.lit("<video>"), F.lit("")))


def remap_prefix(path: Column, prefixes: list[tuple[str, str]]) -> Column:
    """Path with the first prefix that fits replaced."""
    out = None
    for old, new in prefixes:
        hit, to = F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return out.otherwise(path)

"""Answers of models as Columns: levels, boxes, schedules, scores, JSON flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for a skill level, in the order in which parts of a text are looked for.
LEVELS = {
    "novice": "novice", "beginner": "novice", "intermediate": "intermediate", "expert": "expert", "advanced": "expert",
    "n": "novice", "i": "intermediate", "e": "expert", "1": "novice", "2": "intermediate", "3": "expert",
    "low": "novice", "medium": "intermediate", "high": "expert", "poor": "novice", "good": "intermediate", "excellent": "expert",
}


def level_of(text: Column) -> Column:
    """A level by its whole text, else by the first word of LEVELS that it contains, else the text itself."""
    said = F.lower(F.trim(text))
    whole = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), said)
    part = F
    for word, level in LEVELS.items():
        part = part.when(F.contains(said, F.lit(word)), level)
    return F.coalesce(whole, part, said)


def _unfenced(text: Column) -> Column:
    """A text without a fence of one to three backticks before `json` and without one at its end; blanks at both ends don't count."""
    said = F.trim(text)
    opened, bare = F.length(said) - F.length(F.ltrim(said, F.lit("`"))), F.ltrim(said, F.lit("`"))
    said = F.when(opened.between(1, 3) & (F.lower(F.left(bare, F.lit(4))) == "json"), F.substr(bare, F.lit(5))).otherwise(said)
    return F.trim(F.when(F.length(said) - F.length(F.rtrim(said, F.lit("`"))) <= 3, F.rtrim(said, F.lit("`"))).otherwise(said), F.lit(" \t\r\n"))


def wrapped_box(text: Column) -> Column:
    """Box of a JSON answer in thousandths: {"bbox": [x1, y1, x2, y2]} alone, or the list by itself, in a fence, in lists of one or in JSON texts, three layers at most.

    Null for anything else: other keys, more than one list, not four numbers, fractions, corners outside 0 to 1000 or not in order.
    """
    is_a = lambda v, *kinds: F.schema_of_variant(v).rlike("^(" + "|".join(kinds) + ")")
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    keys = lambda v: F.size(F.try_variant_get(v, "$", "map<string,variant>"))
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def inward(v: Column, _: Column) -> Column:
        return F.when(is_a(v, "STRING"), F.try_parse_json(F.try_variant_get(v, "$", "string"))).when(is_a(v, "ARRAY") & (F.size(items(v)) == 1), F.get(items(v), F.lit(0))).otherwise(v)

    def corners(four: Column) -> Column:
        x1, y1, x2, y2 = (F.get(four, F.lit(i)) for i in range(4))
        return F.when((F.size(four) == 4) & F.forall(four, lambda c: (c == F.floor(c)) & c.between(0, 1000)) & (x1 < x2) & (y1 < y2), four)

    listed = lambda v: F.when(is_a(v, "OBJECT"), F.when(keys(v) == 1, F.try_variant_get(v, "$.bbox", "array<variant>"))).otherwise(items(F.aggregate(F.sequence(F.lit(1), F.lit(3)), v, inward)))
    number = lambda v: F.when(is_a(v, "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$", "double"))
    return bound(F.transform(bound(F.try_parse_json(_unfenced(text)), listed), number), corners)


def box_list(text: Column) -> Column:
    """All [a, b, c, d] of whole or decimal numbers in a text."""
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    found = F.regexp_extract_all(text, F.lit(rf"\[{number},{number},{number},{number}\]"), F.lit(0))
    return F.transform(found, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(-?\d+(?:\.\d+)?)")), lambda n: n.cast("double")))


def schedule(start: Column, end: Column, step: Column) -> Column:
    """start, start + step, ... up to end, to eight decimals; null where the step or the order is wrong."""
    count = F.floor((end - start) / step + 1e-8).cast("int")
    return F.when((step > 0) & (end >= start), F.transform(F.sequence(F.lit(0), count), lambda i: F.round(start + i * step, 8)))


def query_type(text: Column) -> Column:
    """global or local by the isGlobal of a JSON object, a boolean or its name; null for anything else."""
    said = F.lower(F.get_json_object(text, "$.isGlobal"))
    return F.when(said == "true", "global").when(said == "false", "local")


def reward(text: Column) -> Column:
    return F.get_json_object(text, "$.reward").try_cast("double")


def aspect_score(text: Column, aspect: str) -> Column:
    """The score of an aspect, from the first of several ways of writing it that is found: "aspect": n, aspect: n, aspect = n, aspect - n, aspect (n)."""
    ways = [rf'(?i)"{aspect}"\s*:\s*(\d+(?:\.\d+)?)', rf"(?i){aspect}\s*:\s*(\d+(?:\.\d+)?)", rf"(?i){aspect}\s*=\s*(\d+(?:\.\d+)?)", rf"(?i){aspect}\s*-\s*(\d+(?:\.\d+)?)", rf"(?i){aspect}\s*\((\d+(?:\.\d+)?)\)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(text, w, 1), F.lit("")) for w in ways]).cast("double")


def first_present(items: Column, *fields: str) -> Column:
    """Of an array of structs the first item that has one of the fields: its value and the name of the field, the earlier field of an item first."""
    named = lambda x: F.coalesce(*[F.when(x[f].isNotNull(), F.struct(x[f].alias("target"), F.lit(f).alias("kind"))) for f in fields])
    return F.get(F.array_compact(F.transform(items, named)), F.lit(0))


def safe_relative(path: Column) -> Column:
    """Whether a path stays below its root: relative, without empty, . or .. parts."""
    return F.coalesce(path.rlike(r"^[^/\\]") & ~path.rlike(r"(^|/)(\.{1,2}|)(/|$)"), F.lit(False))

"""Documents of any shape: values at any depth, walked level by level within the row as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.claims import bound

#: Keys that hold a status although they don't end with `status`: fixed values.
STATUS_KEYS = ("applicability", "region_specificity")


def _value(path: Column, key: Column, v: Column) -> Column:
    """path and what a value is: the members of an object, the elements of a list, a status; or none of them."""
    named = key.endswith("status") | key.isin(*STATUS_KEYS)
    status = F.when(named & (F.schema_of_variant(v) == "STRING"), F.try_variant_get(v, "$", "string"))
    return F.struct(path.alias("path"), F.try_variant_get(v, "$", "map<string,variant>").alias("members"), F.try_variant_get(v, "$", "array<variant>").alias("elements"), status.alias("status"))


def _held(x: Column) -> Column:
    """The values that an object or a list holds; elements of lists have their list's path and no key."""
    members = F.transform(F.map_entries(x["members"]), lambda e: _value(F.when(x["path"] == "", e["key"]).otherwise(F.concat(x["path"], F.lit("."), e["key"])), e["key"], e["value"]))
    return F.coalesce(members, F.transform(x["elements"], lambda v: _value(x["path"], F.lit(None).cast("string"), v)))


def statuses(docs: DataFrame, doc: str, depth: int = 12) -> DataFrame:
    """path, status, n: how often each status stands at each path of JSON documents; elements of lists have their list's path.

    Each step replaces the objects and lists of a document by those that they hold and keeps the statuses among them, so a value is looked at once; a
    document's statuses become rows for the count alone. Documents nested deeper than `depth` are an error, never cut. Null documents, and such as aren't
    JSON, have no status.
    """
    deep = lambda values: F.filter(values, lambda x: x["members"].isNotNull() | x["elements"].isNotNull())
    told = lambda values: F.transform(F.filter(values, lambda x: x["status"].isNotNull()), lambda x: F.struct(x["path"].alias("path"), x["status"].alias("status")))
    state = lambda open_, found: F.struct(open_.alias("open"), found.alias("found"))
    root = deep(F.array(_value(F.lit(""), F.lit(None).cast("string"), F.try_parse_json(F.col(doc)))))
    step = lambda acc, _: bound(F.flatten(F.transform(acc["open"], _held)), lambda values: state(deep(values), F.concat(acc["found"], told(values))))
    walked = lambda open_: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), state(open_, told(open_)), step)
    whole = lambda acc: F.when(F.size(acc["open"]) > 0, F.raise_error(F.lit(f"a document is nested deeper than {depth}"))).otherwise(acc["found"])
    return docs.select(F.explode(bound(bound(root, walked), whole)).alias("x")).groupBy("x.path", "x.status").agg(F.count(F.lit(1)).alias("n"))

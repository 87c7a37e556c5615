"""Checks as rows: name, passed, number of bad rows; and scans for names and values that must not leak."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, MapType, StructType

# Parts of names that give ground truth away.
FORBIDDEN = ("gt", "gnd", "ground_truth", "label", "answer", "struc_info", "alignment")


def checks(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """check, n_bad, passed: how many rows break each condition, in one pass; a null condition is broken."""
    bad = [F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()]
    one = rows.agg(*bad)
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in conditions])
    return one.select(F.explode(pairs).alias("c")).select("c.check", "c.n_bad", (F.col("c.n_bad") == 0).alias("passed"))


def colliding(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """Keys that stand for more than one identifier."""
    return rows.groupBy(key).agg(F.countDistinct(ident).alias("n_ids")).where("n_ids > 1")


def forbidden_fields(kind: DataType, path: str = "$") -> list[str]:
    """Paths of a schema whose names have a forbidden part."""
    out = []
    if isinstance(kind, StructType):
        for f in kind.fields:
            here = f"{path}.{f.name}"
            tokens = set(f.name.lower().split("_")) | {f.name.lower()}
            out += [here] * bool(tokens & set(FORBIDDEN)) + forbidden_fields(f.dataType, here)
    elif isinstance(kind, ArrayType):
        out += forbidden_fields(kind.elementType, f"{path}[*]")
    elif isinstance(kind, MapType):
        out += forbidden_fields(kind.valueType, f"{path}.*")
    return out


def leaking_values(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """Rows whose serialised form has one of the tokens, and which comes first in the list."""
    text = F.to_json(F.struct(*rows.columns))
    first = reduce(lambda c, t: c.when(F.contains(text, F.lit(t)), F.lit(t)), tokens[1:], F.when(F.contains(text, F.lit(tokens[0])), F.lit(tokens[0])))
    return rows.withColumn("leak", first).where("leak IS NOT NULL")


def funnel(base: DataFrame, key: str, stages: dict[str, DataFrame]) -> DataFrame:
    """One row: how many keys of `base` are left after each stage, in order; a stage is a DataFrame with the key."""
    out = base.select(key).distinct()
    alive = F.lit(True)
    counts = [F.count(F.lit(1)).alias("base")]
    for name, df in stages.items():
        out = out.join(df.select(key).distinct().withColumn(f"__{name}", F.lit(True)), key, "left")
        alive = alive & F.coalesce(F.col(f"__{name}"), F.lit(False))
        counts.append(F.count_if(alive).alias(name))
    return out.agg(*counts)


#: States of an attempt chain: fixed values.
CONFLICT, GAP, AFTER_END, OVER_LIMIT, COMPLETE, OPEN = "CONFLICTING_IMMUTABLE_ATTEMPTS", "INCOMPLETE_RAW_ATTEMPT_CHAIN", "ATTEMPT_AFTER_TERMINAL_RAW_RESULT", "RAW_ATTEMPTS_EXCEED_FROZEN_RETRY_LIMIT", "COMPLETE", "OPEN"


def attempt_chains(rows: DataFrame, key: str, index: str, status: str, retryable: str, limit: int) -> DataFrame:
    """key, n, state: the attempts of each key as a chain from 0 on that ends with the first success or error that isn't retried, or at `limit`.

    Faults in this order: two records of one index that differ, a missing index, attempts after the end, more than `limit`. Repeated equal records
    count once. Two aggregates, the first met before its exchange.
    """
    ended = (F.col(status) == "OK") | ~F.coalesce(F.col(retryable), F.lit(False))
    record = F.struct(status, retryable)
    each = rows.groupBy(key, index).agg((~F.min(record).eqNullSafe(F.max(record))).alias("differs"), F.coalesce(F.bool_or(ended), F.lit(False)).alias("ended"))
    out = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(index).alias("top"), F.min(index).alias("low"), F.bool_or("differs").alias("differs"), F.min(F.when(F.col("ended"), F.col(index))).alias("end"))
    end = F.coalesce(F.col("end"), F.col("top") + 1)
    state = F.when(F.col("differs"), CONFLICT).when((F.col("n") != F.col("top") + 1) | (F.col("low") < 0), GAP).when(end < F.col("top"), AFTER_END).when(F.col("n") > limit, OVER_LIMIT).when((end == F.col("top")) | (F.col("n") == limit), COMPLETE).otherwise(OPEN)
    return out.select(key, "n", state.alias("state"))


def reconciled(sources: dict[str, DataFrame], key: list[str], values: list[str]) -> DataFrame:
    """key, n_<source>, errors: each key of any source once, with what is wrong with it, in this order.

    MISSING_<source>, DUPLICATE_<source>, and <value>_MISMATCH where sources that have the key differ in a value (nulls count as a value).
    Sources are one union with a column for each one's number of rows, aggregated once: no chain of outer joins. Keys may be null.
    """
    sides = [df.select(*key, *values, *[F.lit(int(n == name)).alias(f"__{n}") for n in sources]) for name, df in sources.items()]
    counts = [F.sum(f"__{n}").alias(f"n_{n}") for n in sources]
    differs = [(~F.min(F.struct(v)).eqNullSafe(F.max(F.struct(v)))).alias(f"__d_{v}") for v in values]
    out = reduce(DataFrame.unionByName, sides).groupBy(*key).agg(*counts, *differs)
    codes = [F.when(F.col(f"n_{n}") == 0, f"MISSING_{n.upper()}") for n in sources] + [F.when(F.col(f"n_{n}") > 1, f"DUPLICATE_{n.upper()}") for n in sources] + [F.when(F.col(f"__d_{v}"), f"{v.upper()}_MISMATCH") for v in values]
    return out.select(*key, *[f"n_{n}" for n in sources], F.array_compact(F.array(*codes)).alias("errors"))


def prediction_audit(manifest: DataFrame, predictions: DataFrame, errors: DataFrame, key: str, valid: str, answer: str) -> DataFrame:
    """One row of counts: what of a manifest (key, valid) has a final prediction (key, answer), and what became of errors (key).

    As a manifest with a repeated key has no index, its keys then count neither as valid nor as invalid.
    """
    sides = [
        manifest.select(key, F.lit(0).alias("side"), F.coalesce(valid, F.lit(False)).alias("valid"), F.lit(None).cast("string").alias("answer")),
        predictions.select(key, F.lit(1).alias("side"), F.lit(False).alias("valid"), F.col(answer).cast("string").alias("answer")),
        errors.select(key, F.lit(2).alias("side"), F.lit(False).alias("valid"), F.lit(None).cast("string").alias("answer")),
    ]
    bad = (F.col("side") == 1) & ~F.coalesce(F.col("answer").isin("YES", "NO"), F.lit(False))
    each = reduce(DataFrame.unionByName, sides).groupBy(key).agg(*[F.count_if(F.col("side") == i).alias(n) for i, n in enumerate("mpe")], F.bool_or("valid").alias("valid"), F.count_if(bad).alias("bad"))
    m, p, e, ok = (F.col(c) for c in ("m", "p", "e", "valid"))
    c = lambda x: F.count_if(x)
    out = each.agg(
        F.sum("m").alias("n_total"), c(m > 1).alias("duplicate_manifest"), c((m > 0) & ok).alias("v"), c((m > 0) & ~ok).alias("i"), F.sum("p").alias("n_final_predictions"), c((m > 0) & ok & (p == 0)).alias("miss"), c((p > 0) & ~((m > 0) & ok)).alias("x"), c(p > 0).alias("ids"),
        c((p > 0) & (m > 0) & ~ok).alias("inv"), c(p > 1).alias("duplicate_predictions"), F.sum("bad").alias("invalid_predictions"), F.sum("e").alias("n_errors"), c((e > 0) & (p > 0)).alias("errors_resolved"), c((e > 0) & (m > 0) & ok & (p == 0)).alias("unres"),
    )
    whole = lambda name, none=F.lit(0): F.when(F.col("duplicate_manifest") == 0, F.col(name)).otherwise(none)
    return out.select("n_total", whole("v").alias("n_valid"), whole("i").alias("n_invalid"), "n_final_predictions", whole("miss").alias("missing"), whole("x", F.col("ids")).alias("extra"), whole("inv").alias("for_invalid"), "duplicate_predictions", "duplicate_manifest", "invalid_predictions", "n_errors", "errors_resolved", whole("unres").alias("unresolved"))


def bound_timestamps(manifest: DataFrame, frames: DataFrame, clip: str) -> DataFrame:
    """clip, errors: whether the rows of a manifest (clip, frame_order, reference, seconds) are the frames (clip, frame_order, reference), one by one, in rising time.

    FRAME_COUNT_MISMATCH, BINDING_MISMATCH, TIMESTAMP_NONFINITE, TIMESTAMP_NEGATIVE, TIMESTAMP_NONMONOTONIC, DURATION_NOT_POSITIVE. References of other types than
    whole numbers are compared as strings.
    """
    whole = all(isinstance(df.schema["reference"].dataType, IntegralType) for df in (manifest, frames))
    reference = F.col("reference") if whole else F.col("reference").cast("string").alias("reference")
    listed = manifest.select(clip, "frame_order", F.lit(True).alias("listed"), reference, F.col("seconds").cast("double").alias("seconds"))
    return bound_rows(listed.union(frames.select(clip, "frame_order", F.lit(False), reference, F.lit(None).cast("double"))), clip)


def bound_rows(rows: DataFrame, clip: str) -> DataFrame:
    """clip, errors as of `bound_timestamps`, from one table of both sides: clip, frame_order, listed (a row of the manifest, else a frame), reference, seconds.

    Each manifest row is also sent to the next place, so neighbours meet in one aggregate and no window runs over a clip. Rows that are dealt by clip already aren't
    exchanged, and references that are numbers aren't sorted.
    """
    rows = rows.withColumn("ahead", F.explode(F.when(F.col("listed"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    here, listed = F.col("ahead") == 0, F.col("listed")
    m, f = here & listed, here & ~listed
    place = rows.groupBy(clip, (F.col("frame_order") + F.col("ahead")).alias("frame_order")).agg(
        F.count_if(m).alias("m"), F.count_if(f).alias("f"), F.max(F.when(m, F.col("reference"))).alias("mr"), F.max(F.when(f, F.col("reference"))).alias("fr"), F.min(F.when(m, F.col("seconds"))).alias("t"), F.max(F.when(~here, F.col("seconds"))).alias("before")
    )
    here = (F.col("m") > 0) | (F.col("f") > 0)
    infinite = F.col("t").isNull() | F.isnan("t") | (F.abs("t") == float("inf"))
    out = place.groupBy(clip).agg(
        F.sum("m").alias("m"), F.sum("f").alias("f"), F.bool_or(here & ~((F.col("m") == 1) & (F.col("f") == 1) & F.col("mr").eqNullSafe(F.col("fr")))).alias("unbound"), F.bool_or((F.col("m") > 0) & infinite).alias("infinite"),
        F.bool_or(F.coalesce((F.col("m") > 0) & (F.col("t") < 0), F.lit(False))).alias("negative"), F.bool_or(F.coalesce((F.col("m") > 0) & (F.col("t") < F.col("before")), F.lit(False))).alias("falls"), F.min("t").alias("low"), F.max("t").alias("high"),
    )
    codes = [(F.col("m") != F.col("f"), "FRAME_COUNT_MISMATCH"), (F.col("unbound"), "BINDING_MISMATCH"), (F.col("infinite"), "TIMESTAMP_NONFINITE"), (F.col("negative"), "TIMESTAMP_NEGATIVE"), (F.col("falls"), "TIMESTAMP_NONMONOTONIC"), (~F.coalesce((F.col("m") >= 2) & (F.col("high") > F.col("low")), F.lit(False)), "DURATION_NOT_POSITIVE")]
    return out.select(clip, F.array_compact(F.array(*[F.when(c, n) for c, n in codes])).alias("errors"))

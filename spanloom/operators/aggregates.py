"""Aggregates: conditional, in several dimensions at once, exact quantiles, paired tests."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_dimensions(rows: DataFrame, dimensions: dict[str, list[str]], **aggs: Column) -> DataFrame:
    """dimension, value (its columns joined by ::), and the aggregates, for several groupings in one pass."""
    columns = sorted({c for cs in dimensions.values() for c in cs})
    sets = [[F.col(c) for c in cs] for cs in dimensions.values()]
    grouped = rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id(*columns).alias("__id"), *[v.alias(k) for k, v in aggs.items()])
    name, value = None, None
    for d, cs in dimensions.items():
        ident = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs)
        hit = F.col("__id") == ident
        text = F.concat_ws("::", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cs]) if cs else F.lit("all")
        name = F.when(hit, F.lit(d)) if name is None else name.when(hit, F.lit(d))
        value = F.when(hit, text) if value is None else value.when(hit, text)
    return grouped.select(name.alias("dimension"), value.alias("value"), *aggs)


def balanced_accuracy(rows: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """accuracy (share of rows), balanced_accuracy (mean over classes of the share within each), n."""
    ratio = rows.groupBy(*keys, truth).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(predicted)).alias("ok"))
    return ratio.groupBy(*keys).agg((F.sum("ok") / F.sum("n")).alias("accuracy"), F.avg(F.col("ok") / F.col("n")).alias("balanced_accuracy"), F.sum("n").alias("n"))


def confusion(rows: DataFrame, truth: str, predicted: str, values: list) -> DataFrame:
    """A row for each truth: counts of the predicted values, and their total."""
    counts = [F.count_if(F.coalesce(F.col(predicted) == v, F.lit(False))).alias(f"pred_{v}") for v in values]
    return rows.groupBy(truth).agg(*counts, F.count(F.lit(1)).alias("total"))


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, std (n - 1), min, q1, median, q3, max, iqr; quantiles exact, by linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q"))
    at = lambda k: F.get("q", F.lit(k))
    return out.select(*keys, "n", "mean", "std", "min", "max", at(0).alias("q1"), at(1).alias("median"), at(2).alias("q3"), (at(2) - at(0)).alias("iqr"))


def family_scores(rows: DataFrame, candidate: list[str], family: str, included: Column, kept: Column) -> DataFrame:
    """candidate, micro (kept over included), macro (mean of the families' shares, those without rows left out), n_included."""
    per = rows.groupBy(*candidate, family).agg(F.count_if(included).alias("valid"), F.count_if(included & kept).alias("yes"))
    share = F.try_divide("yes", "valid")
    return per.groupBy(*candidate).agg(F.try_divide(F.sum("yes"), F.sum("valid")).alias("micro"), F.avg(share).alias("macro"), F.sum("valid").alias("n_included"))


def paired_deltas(rows: DataFrame, group: str, label: str, positive: str, negative: str, value: str) -> DataFrame:
    """Means and medians of two labels within each group that has both, and the difference of the means."""
    of = lambda f, v: f(F.when(F.col(label) == v, F.col(value)))
    out = rows.where(F.col(label).isin(positive, negative)).groupBy(group).agg(
        of(F.avg, positive).alias("mean_pos"), of(F.avg, negative).alias("mean_neg"), of(F.median, positive).alias("median_pos"), of(F.median, negative).alias("median_neg"),
        of(F.count, positive).alias("n_pos"), of(F.count, negative).alias("n_neg"),
    )
    return out.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).withColumn("delta", F.col("mean_pos") - F.col("mean_neg"))


def signs(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count_if(v > 0).alias("positive"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"))


def pooled(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("pooled"), F.sum(weight).alias("weight"))


def strict_sum(value: Column) -> Column:
    """The sum, null where any row has none."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def claim_status(certificates: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, status: of `claims` (claim_id, scope) from `certificates` (claim_id, c_scope, final_status).

    CONFLICT where one scope has both a verified and a rejected certificate; else SUPPORTED where any is verified; else
    CONTRADICTED where the claim's own scope is rejected; else INSUFFICIENT.
    """
    has = lambda s: F.bool_or(F.col("final_status") == s)
    per = certificates.groupBy("claim_id", "c_scope").agg(has("VERIFIED").alias("v"), has("REJECTED").alias("r"))
    out = claims.join(per, "claim_id", "left").groupBy("claim_id").agg(
        F.bool_or(F.col("c_scope").isNotNull() & F.col("v") & F.col("r")).alias("conflict"), F.bool_or("v").alias("verified"), F.bool_or(F.col("r") & (F.col("c_scope") == F.col("scope"))).alias("own"),
    )
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select("claim_id", F.when(t("conflict"), F.lit("CONFLICT")).when(t("verified"), F.lit("SUPPORTED")).when(t("own"), F.lit("CONTRADICTED")).otherwise("INSUFFICIENT").alias("status"))


def coverage(required: DataFrame, statuses: DataFrame, sample: str) -> DataFrame:
    """sample, n_required, n_supported, coverage: COMPLETE where all required claims (sample, claim_id) are supported."""
    out = required.join(statuses, "claim_id", "left").groupBy(sample).agg(F.count(F.lit(1)).alias("n_required"), F.count_if(F.coalesce(F.col("status") == "SUPPORTED", F.lit(False))).alias("n_supported"))
    return out.withColumn("coverage", F.when(F.col("n_required") == F.col("n_supported"), F.lit("COMPLETE")).otherwise("INCOMPLETE"))


@functools.lru_cache(1 << 16)
def _at_most(ranks: tuple[int, ...], low: int) -> int:
    """How many choices among the ranks sum to `low` or less. The numbers of choices by sum are the digits of one whole number, wide enough that none overflows."""
    wide = len(ranks) + 1
    ways = 1
    for r in ranks:
        ways += ways << (wide * r)
    return (ways & ((1 << wide * (low + 1)) - 1)) % ((1 << wide) - 1)  # the sum of the digits


def wilcoxon(values: list[float], most: int = 20) -> tuple:
    """n, zeros, W+, W-, rank-biserial r and the exact two-sided p of a signed-rank test; ranks of equals are averaged.

    The distribution of W+ over all signs is counted over doubled ranks, which are whole numbers, so nothing is enumerated.
    """
    clean = [float(v) for v in values if v is not None and not math.isnan(v)]
    rest = sorted((abs(v), v > 0) for v in clean if abs(v) > 1e-12)
    if len(rest) > most:
        raise ValueError("TOO_MANY_NONZERO_PAIRS")
    ranks, k = [], 0
    while k < len(rest):
        end = k
        while end < len(rest) and rest[end][0] - rest[k][0] <= 1e-12:
            end += 1
        ranks += [k + end + 1] * (end - k)  # twice the average rank
        k = end
    plus = sum(r for r, (_, up) in zip(ranks, rest) if up)
    total = sum(ranks)
    low = min(plus, total - plus)
    p = min(1.0, 2 * _at_most(tuple(ranks), low) / 2 ** len(ranks)) if ranks else 1.0
    return len(clean), len(clean) - len(rest), plus / 2, (total - plus) / 2, (2 * plus - total) / total if total else 0.0, p


def signed_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The exact signed-rank test of each group; status TOO_MANY and no figures but the counts for groups of more than 20 nonzero values.

    Rows are exchanged once. Only the nonzero values of groups that are tested, 20 at most, meet in an array; a batch of such groups is one call of Python.
    """
    known = F.col(value).isNotNull() & ~F.isnan(value)
    nonzero = known & (F.abs(value) > 1e-12)
    marked = rows.withColumn("__nonzero", F.count(F.when(nonzero, 1)).over(Window.partitionBy(*keys)))
    few = F.when(nonzero & (F.col("__nonzero") <= 20), F.col(value).cast("double"))
    groups = marked.groupBy(*keys).agg(F.count(F.when(known, 1)).alias("__n"), F.first("__nonzero").alias("__nonzero"), F.collect_list(few).alias("__v"))
    tests = groups.withColumn("__t", F.when(F.col("__nonzero") <= 20, F.pandas_udf(_hinted(_tests), "w_plus double, w_minus double, rank_biserial double, p_value double")("__v")))
    counts = [F.col("__n").cast("double").alias("n"), (F.col("__n") - F.col("__nonzero")).cast("double").alias("n_zero")]
    return tests.select(*keys, *counts, "__t.*", F.when(F.col("__nonzero") > 20, "TOO_MANY").otherwise("OK").alias("status"))


def _tests(v: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([wilcoxon(x.tolist())[2:] for x in v], columns=["w_plus", "w_minus", "rank_biserial", "p_value"])


def _hinted(f):
    f.__annotations__ = {"v": pd.Series, "return": pd.DataFrame}
    return f

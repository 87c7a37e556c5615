"""Claims of models, metrics of evaluation outputs and clip times as Columns; JSON is read as VARIANT, whole and strictly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest text of a claim, frames of a packet, frames a second of a bank of frames.
LONGEST, PACKET, RATE = 2000, 8, 2

#: Metric, names of its task in an output (the first that is there counts), names of its field (likewise).
METRICS = (
    ("cvs_acc", ("cvs_assessment", "CVS"), ("component_balanced_accuracy", "accuracy")),
    ("nap_acc", ("next_action", "NEXT_ACTION"), ("accuracy",)),
    ("sa_acc", ("skill_assessment", "SKILL"), ("aspect_balanced_accuracy", "accuracy")),
    ("stg_miou", ("stg", "STG"), ("mean_iou",)),
    ("tag_miou_03", ("tal", "TAL"), ("meanIoU@0.3",)),
    ("tag_miou_05", ("tal", "TAL"), ("meanIoU@0.5",)),
    ("dvc_llm", ("dvc", "DVC", "dense_captioning"), ("caption_score",)),
    ("dvc_f1", ("dvc", "DVC", "dense_captioning"), ("temporal_f1",)),
    ("vs_llm", ("vs", "VS", "video_summary"), ("score", "average_score", "caption_score")),
    ("rc_llm", ("rc", "RC", "region_caption"), ("score", "average_score", "caption_score")),
)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _is_a(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def claim_id(sample: Column, text: Column) -> Column:
    """A stable name of a claim of a sample: digest of both as a JSON list."""
    return F.concat(F.lit("claim_"), F.left(F.sha2(F.to_json(F.array(sample, text)), 256), F.lit(24)))


def parse_claims(raw: Column, sample: Column, maximum: int) -> Column:
    """Struct (claims: array of claim_id and text, reason) of an answer that is exactly {"claims": [{"text": ...}, ...]}.

    Texts lose blanks at their ends; empty, longer than LONGEST characters or repeated ones refuse the whole answer, as do more than `maximum` claims.
    Either claims or reason is null. Null and blank answers are NOT_JSON. No claims are an empty array.
    """

    def judged(v: Column) -> Column:
        return bound(F.try_variant_get(v, "$.claims", "array<variant>"), lambda items: read(v, items))

    def read(v: Column, items: Column) -> Column:
        texts = F.transform(items, lambda c: F.when(_is_a(F.try_variant_get(c, "$.text", "variant"), "STRING"), F.try_variant_get(c, "$.text", "string")))
        return bound(texts, lambda texts: bound(F.transform(texts, stripped), lambda plain: bound(reason(v, items, texts, plain), lambda r: made(plain, r))))

    def reason(v: Column, items: Column, texts: Column, plain: Column) -> Column:
        exact = _is_a(v, "OBJECT") & (_keys(v) == F.array(F.lit("claims"))) & items.isNotNull()
        formed = F.forall(items, lambda c: _is_a(c, "OBJECT") & (_keys(c) == F.array(F.lit("text"))))
        sound = F.forall(texts, lambda t: t.isNotNull() & (F.length(t) <= LONGEST)) & F.forall(plain, lambda t: t != "")
        return (
            F.when(v.isNull(), "NOT_JSON").when(~F.coalesce(exact, F.lit(False)), "EXPECTED_CLAIMS_ARRAY").when(F.size(items) > maximum, "TOO_MANY_CLAIMS")
            .when(~F.coalesce(formed, F.lit(False)), "CLAIM_FORM").when(~F.coalesce(sound, F.lit(False)), "CLAIM_TEXT").when(F.size(F.array_distinct(plain)) < F.size(plain), "DUPLICATE_CLAIM")
        )

    def made(plain: Column, why: Column) -> Column:
        claims = F.transform(plain, lambda t: F.struct(claim_id(sample, t).alias("claim_id"), t.alias("text")))
        return F.struct(F.when(why.isNull(), claims).alias("claims"), why.alias("reason"))

    return bound(F.try_parse_json(raw), judged)


def reported_metrics(text: Column) -> Column:
    """Struct (success, missing, and one double for each of METRICS) of an evaluation output {"aggregated_results": {task: {"overall": {field: value}}}}.

    A task with an overall has all its metrics, 0 where no field is there; a task without one has none. success: all metrics are there.
    Null texts, such as aren't JSON and outputs without aggregated_results have no metric.
    """

    def read(v: Column) -> Column:
        def value(tasks: tuple[str, ...], fields: tuple[str, ...]) -> Column:
            task = F.coalesce(*[F.try_variant_get(v, f"$.aggregated_results.{t}", "variant") for t in tasks])
            overall = F.try_variant_get(task, "$.overall", "variant")
            found = F.coalesce(*[F.try_variant_get(overall, f"$['{f}']", "double") for f in fields], F.lit(0.0))
            return F.when(overall.isNotNull(), found)

        return F.struct(*[value(tasks, fields).alias(name) for name, tasks, fields in METRICS])

    def told(m: Column) -> Column:
        missing = F.array_compact(F.array(*[F.when(m[name].isNull(), F.lit(name)) for name, _, _ in METRICS]))
        return F.struct((F.size(missing) == 0).alias("success"), missing.alias("missing"), *[m[name].alias(name) for name, _, _ in METRICS])

    return bound(bound(F.try_parse_json(text), read), told)


def submission_id(given: Column, video: Column, starts: list[Column], ends: list[Column], fps: Column) -> Column:
    """The given id, or else video&&start&&end&&fps with the first start and end that aren't empty; what is missing is empty there."""
    full = lambda c: F.nullif(c.cast("string"), F.lit(""))
    parts = [full(video), F.coalesce(*map(full, starts)), F.coalesce(*map(full, ends)), full(fps)]
    return F.coalesce(full(given), F.concat_ws("&&", *[F.coalesce(p, F.lit("")) for p in parts]))


def native_times(refs: Column, start: Column, end: Column, fps: Column) -> Column:
    """Struct of a clip's own clock: times since its first reference, at RATE references a second, as exact decimals; null times and a reason where its span
    leaves the declared duration or the gap after it is longer than one period of the clip and one of the bank, or where the clip's rate isn't positive.
    Null or empty refs: NO_FRAMES. Periods are rounded to six decimals."""
    exact = "decimal(18,6)"

    def told(t: Column) -> Column:
        span, allowed = F.element_at(t, -1), (F.try_divide(F.lit(1), fps).cast(exact) + F.lit(1 / RATE).cast(exact)).cast(exact)
        duration = (end.cast(exact) - start.cast(exact)).cast(exact)
        tail = (duration - span).cast(exact)
        reason = F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, "NO_FRAMES").when(~F.coalesce(fps > 0, F.lit(False)), "NO_RATE").when((span < 0) | (span > duration), "SPAN_EXCEEDS_DURATION").when(tail > allowed, "TAIL_GAP_EXCEEDS_BOUND")
        return F.struct(F.when(reason.isNull(), t).alias("times"), span.alias("span"), tail.alias("tail"), allowed.alias("allowed"), (F.size(t) - F.size(F.array_distinct(t))).alias("repeated"), reason.alias("reason"))

    return bound(F.transform(refs, lambda r: ((r - F.get(refs, F.lit(0))).cast("decimal(12,0)") / F.lit(RATE)).cast(exact)), lambda t: told(F.when(F.size(t) > 0, t)))


def spread(items: Column, most: int = PACKET) -> Column:
    """All items, or where there are more than `most` the first, the last and evenly placed ones between, halves upwards."""
    n = F.size(items)
    slots = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(items, F.floor((i * (n - 1) + (most - 1) // 2) / (most - 1)).cast("int")))
    return F.when(n <= most, items).otherwise(slots)

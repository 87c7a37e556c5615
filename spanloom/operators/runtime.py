"""Fresh claims bound to windows of public records, packets of frames, decisions among candidates, rows of a submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import claims as fc
from spanloom.functions import scopes

#: Tasks that are left out of a submission unless asked for.
REGION_TASKS = ("region_caption_gpt", "region_caption_gemini")
#: What the note of a confirmation must not mention; its longest length; frames of a window.
FORBIDDEN = ("bbox", "mask", "pixel", "roi", "ground truth", "gt")
NOTE, FRAMES = 1000, 3

KINDS = ("INDEX", "DIGEST", "CLAIM_ID", "TEXT")


def bind_claims(claims: DataFrame, windows: DataFrame, records: DataFrame, excluded: list[int] = ()) -> DataFrame:
    """One row for each claim and each window without one: claim_id, source_record_index, claim_scope, frame_ids and `reasons`, empty where all is in order.

    claims: source_record_index, digest, claim_id, text. windows: claim_id, orders (array of int), confirmed, note. records: source_record_index, digest,
    sample_id, n_frames, one row each. frame_ids are null where there is a reason. Repeated indices, digests, identifiers or texts are told at each of their
    claims; they are counted before rows are exchanged, so that one value may hold any share of them. Nulls fail their rule. A window repeated under
    one identifier, or under none of the claims, is told. Empty claims give only such windows.
    """
    text = fc.stripped(F.col("text"))
    rows = claims.select("source_record_index", "digest", fc.stripped(F.col("claim_id")).alias("claim_id"), text.alias("text"))
    rows = rows.withColumn("row", F.sha2(F.to_json(F.struct("*")), 256))
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in zip(KINDS, rows.columns)])
    keys = rows.select("row", F.explode(values).alias("k")).select("row", "k.*").where("value IS NOT NULL")
    counted = keys.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeats = keys.join(counted, ["kind", "value"]).groupBy("row").agg(F.collect_set("kind").alias("repeated"))

    shown = windows.groupBy(fc.stripped(F.col("claim_id")).alias("claim_id")).agg(F.count(F.lit(1)).alias("n_windows"), F.min(F.struct("orders", F.col("confirmed").alias("confirmed"), "note")).alias("w"))
    known = records.select("source_record_index", F.col("digest").alias("known_digest"), "sample_id", "n_frames")
    out = rows.join(shown, "claim_id", "full").join(repeats, "row", "left").join(known, "source_record_index", "left")

    orders, note = F.col("w.orders"), F.col("w.note")
    consecutive = F.size(orders).between(1, FRAMES) & (F.get(orders, F.lit(0)) >= 0) & (orders == F.transform(orders, lambda _, i: F.get(orders, F.lit(0)) + i))
    within = F.element_at(F.nullif(orders, F.array().cast("array<int>")), -1) < F.col("n_frames")
    said = (F.trim(note) != "") & (F.length(note) <= NOTE)
    clean = ~F.lower(note).rlike("|".join(FORBIDDEN))
    out = out.withColumn("scope", scopes.claim_scope(F.col("text"))["claim_scope"])
    scope = F.col("scope")
    ok = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("EXCLUDED_INDEX", ~F.col("source_record_index").isin(*excluded) if excluded else F.col("source_record_index").isNotNull()),
        ("DIGEST_FORM", F.col("digest").rlike("^[0-9a-f]{64}$")),
        ("CLAIM_FORM", (F.col("claim_id") != "") & (F.col("text") != "")),
        *[(f"REPEATED_{k}", ~F.array_contains(F.coalesce(F.col("repeated"), F.array().cast("array<string>")), k)) for k in KINDS],
        ("RECORD_MISMATCH", F.col("digest") == F.col("known_digest")),
        ("SCOPE_NOT_LOCAL", scope == "LOCAL_ATOMIC"),
        ("WINDOW_COUNT", F.col("n_windows") == 1),
        ("WINDOW_ORDERS", consecutive),
        ("WINDOW_BEYOND_RECORD", within),
        ("NOT_CONFIRMED", F.col("w.confirmed")),
        ("NOTE_FORM", said),
        ("NOTE_FORBIDDEN", clean),
    ]
    told = F.array_compact(F.array(*[F.when(~ok(good), F.lit(name)) for name, good in rules]))
    reasons = F.when(F.col("row").isNull(), F.array(F.lit("WINDOW_WITHOUT_CLAIM"))).otherwise(told)
    frames = F.transform(orders, lambda o: F.format_string("%s:frame:%06d", F.col("sample_id"), o))
    out = out.select("claim_id", "source_record_index", scope.alias("claim_scope"), reasons.alias("reasons"), frames.alias("frame_ids"))
    return out.withColumn("frame_ids", F.when(F.size("reasons") == 0, F.col("frame_ids")))


def packet_frames(frames: DataFrame, packet: str, order: str, visual: list[str], shown: str) -> DataFrame:
    """packet, slot, order, aliases: of each packet the first shown frame of each distinct picture, eight at most, evenly spread by order.

    aliases are all orders of the packet with that picture, shown or not. Packets without a shown frame have no rows. A picture is the values of `visual`,
    nulls alike; rows repeated in full count once.
    """
    key = F.sha2(F.to_json(F.struct(*visual), {"ignoreNullFields": "false"}), 256)
    seen = frames.groupBy(packet, key.alias("key")).agg(F.array_sort(F.collect_set(order)).alias("aliases"), F.min(F.when(F.col(shown), F.col(order))).alias("order")).where(F.col("order").isNotNull())
    kept = seen.groupBy(packet).agg(fc.spread(F.array_sort(F.collect_list(F.struct("order", "key", "aliases")))).alias("frames"))
    return kept.select(packet, F.posexplode("frames").alias("slot", "f")).select(packet, "slot", "f.order", "f.aliases")


def decide(candidates: DataFrame, key: str, eligible: str = "ELIGIBLE_SPATIAL_ANCHOR") -> DataFrame:
    """Of each key the candidate to follow, with the number of them: an eligible route first, then most accepted required parts, most accepted contextual
    ones, fewest contextual warnings, the earliest, the smallest identifier.

    candidates: key, candidate_id, position, route, required and contextual (arrays of labels; null: none). One aggregate met before the exchange, no window.
    """
    none = F.array().cast("array<string>")
    accepted = lambda c: F.size(F.filter(F.coalesce(F.col(c), none), lambda x: x == "ACCEPTED"))
    warnings = F.size(F.coalesce(F.col("contextual"), none)) - accepted("contextual")
    order = F.struct(F.when(F.col("route") == eligible, 0).otherwise(1).alias("a"), (-accepted("required")).alias("b"), (-accepted("contextual")).alias("c"), warnings.alias("d"), "position", "candidate_id")
    best = candidates.groupBy(key).agg(F.min_by(F.struct("candidate_id", "route", accepted("required").alias("accepted"), warnings.alias("warnings")), order).alias("best"), F.count(F.lit(1)).alias("candidates"))
    return best.select(key, "best.*", "candidates")


def submission_rows(predictions: DataFrame, include_regions: bool = False) -> DataFrame:
    """id, qa_type, prediction and the identifiers of predictions for an evaluator: null tasks and predictions are empty, region captions left out unless asked for."""
    task = F.coalesce(F.col("qa_type"), F.lit(""))
    rows = predictions.select("sample_id", F.col("original_index").alias("original_idx"), "id", task.alias("qa_type"), F.coalesce("prediction", F.lit("")).alias("prediction"), "data_source")
    return rows if include_regions else rows.where(~F.col("qa_type").isin(*REGION_TASKS))


def region_audit(rows: DataFrame) -> DataFrame:
    """One row: status, rc_samples, missing_or_unmatched of the samples whose task begins with region_caption: those without an anchor frame, without its
    box, or with an anchor that isn't a frame of theirs. rows: qa_type, anchor, box (array), frames (array)."""
    regions = F.coalesce(F.col("qa_type").startswith("region_caption"), F.lit(False))
    sound = (F.col("anchor") != "") & (F.size("box") > 0) & F.array_contains("frames", F.col("anchor"))
    n = F.count_if(regions)
    return rows.agg(F.when(n > 0, "RC_SELECTOR_ADAPTATION_REQUIRED").otherwise("NO_RC_SAMPLES").alias("status"), n.alias("rc_samples"), F.count_if(regions & ~F.coalesce(sound, F.lit(False))).alias("missing_or_unmatched"))

"""How far a claim reaches, by its text alone: one witness of several, a whole scene, or one local fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.claims import bound

# The scopes with their reasons, first match first, and the patterns that tell them.
SCOPES = (
    (
        "MULTI_SUPPORT_POSSIBLE",
        "EXISTENTIAL_INTERCHANGEABLE_WITNESS",
        (
            r"\bat least one\s+(?:[a-z-]+\s+){0,4}(?:instrument|tool|device|object)s?\b",
            r"\b(?:one or more|any|some)\s+(?:[a-z-]+\s+){0,4}(?:instrument|tool|device|object)s?\b",
            r"\bthere (?:is|are)\s+(?:an?|at least one|some)\s+",
            r"\b(?:an?|the)\s+(?:[a-z-]+\s+){0,3}(?:instrument|tool|device)\s+(?:is|are)\s+(?:visibly\s+)?(?:present|visible)\b",
        ),
    ),
    (
        "GLOBAL_DISTRIBUTED",
        "GLOBAL_SCENE_OR_VIEWPOINT",
        (
            r"\b(?:egocentric|first-person)\s+view(?:point)?\b",
            r"\b(?:overall|global|entire)\s+(?:scene|view|state|procedure)\b",
            r"\b(?:scene|environment)\s+(?:is|shows|depicts|contains)\b",
            r"\b(?:supplied|provided)\s+frames?\s+(?:visibly\s+)?depict\b.*\b(?:procedure|scene|viewpoint)\b",
            r"\b(?:an?|the)\s+(?:open\s+)?surgical procedure\s+from\s+an?\s+(?:egocentric|first-person)\b",
        ),
    ),
    (
        "LOCAL_ATOMIC",
        "LOCAL_OBJECT_STATE_OR_RELATION",
        (
            r"\b(?:contact(?:s|ing)?|touch(?:es|ing)?|press(?:es|ing)?|grasp(?:s|ing)?|hold(?:s|ing)?|cut(?:s|ting)?|enter(?:s|ing)?)\b",
            r"\b(?:inside|within|centered|attached|secured|open|against)\b",
            r"\b(?:forceps|jaw|baseplate|stoma|specimen-retrieval bag|retrieval bag|catheter|tubular structure)\b.*\b(?:visible|identifiable|contact(?:s|ing)?|inside|enter(?:s|ing)|open)\b",
        ),
    ),
)
#: Fixed value: scope and reason where no pattern is found.
UNRESOLVED = ("UNRESOLVED_SCOPE", "SCOPE_NOT_DETERMINABLE_FROM_PUBLIC_CLAIM_TEXT")


def claim_scope(text: Column) -> Column:
    """claim_scope, reason_code, single_roi_certificate_applicable, claim_text_sha256 of a claim; null for null and blank ones.

    Case and runs of blanks don't count for the scope; the digest is of the text without blanks at its ends.
    """
    told = lambda scope, reason: F.struct(F.lit(scope).alias("claim_scope"), F.lit(reason).alias("reason_code"))

    def found(plain: Column) -> Column:
        out = told(*UNRESOLVED)
        for scope, reason, patterns in reversed(SCOPES):
            out = F.when(reduce(lambda a, b: a | b, [plain.rlike(p) for p in patterns]), told(scope, reason)).otherwise(out)
        return out

    def judged(stripped: Column) -> Column:
        full = lambda x: F.struct(x["claim_scope"].alias("claim_scope"), x["reason_code"].alias("reason_code"), (x["claim_scope"] == "LOCAL_ATOMIC").alias("single_roi_certificate_applicable"), F.sha2(stripped, 256).alias("claim_text_sha256"))
        return F.when(stripped != "", bound(bound(F.regexp_replace(F.lower(stripped), r"\s+", " "), found), full))

    return bound(F.regexp_replace(text, r"^\s+|\s+$", ""), judged)


# The questions that ask for a time, with the event as the first group.
TERMINAL = (
    ("when_does_happen", r"when does ([^?.!]+?) happen[?!]+"),
    ("when_is_performed", r"when is ([^?.!]+?) performed[?!]+"),
    ("during_what_interval_does_occur", r"during what interval does ([^?.!]+?) occur[?!]+"),
    ("find_segments_where_happens", r"find the segment\(s\) where ([^?.!]+?) happens[.!?]+"),
    ("what_is_time_span_of", r"what is the time span of ([^?.!]+?)[?!]+"),
    ("when_can_i_see_in_video", r"when can i see ([^?.!]+?) in the video[?!]+"),
)


def terminal_query(question: Column) -> Column:
    """template, event of a question that ends with one of the known clauses, lower-cased and with single blanks; null where no clause ends it, or any clause stands in it besides."""
    ends = lambda plain, p: plain.rlike(rf"{p}\s*\z")
    event = lambda plain, p: F.trim(F.regexp_extract(plain, rf"{p}\s*\z", 1))
    once = lambda counts: reduce(lambda a, b: a + b, counts) == 1

    def judged(plain: Column) -> Column:
        made = F.coalesce(*[F.when(ends(plain, p), F.struct(F.lit(name).alias("template"), event(plain, p).alias("event"))) for name, p in TERMINAL])
        sound = once([ends(plain, p).cast("int") for _, p in TERMINAL]) & once([F.regexp_count(plain, F.lit(p)) for _, p in TERMINAL])
        return F.when(sound, bound(made, lambda m: F.when(m["event"] != "", m)))

    return bound(F.trim(F.regexp_replace(F.lower(question), r"\s+", " ")), judged)

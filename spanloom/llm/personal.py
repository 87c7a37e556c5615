"""Personal data: base patterns, and spans that labelers' votes, weighed by expectation-maximisation, and a span classifier add."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Votes of a labeler.
NO, YES, ABSTAIN = 0, 1, 2
LABELERS = ("shape", "gazetteer", "cue", "counter_cue", "edges", "sums")
#: Candidates of each kind that the span classifier is trained on, at most; those with the smallest hashes. All others are only scored.
EXAMPLES = 2000
#: Slots of a candidate's features; candidates of this probability or more become spans.
SLOTS, THRESHOLD = 1 << 12, 0.5
#: Characters around a candidate that the labelers look at.
NEAR = 48

_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    twice = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end of the base patterns, by kind and start; each text is gone through once for each kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # the longest run before each @; a match begins nowhere else
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((EMAIL, start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in _DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        if len(parts) < 4:
            continue
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1 + start
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                out.append((IP, int(ends[i]) - len(parts[i]), int(ends[i + 3])))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, m.start(), m.end()))
    for m in _PLUS.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((PHONE, m.start(), m.end()))
    return out


# What the labelers know: fixed values.
#: Top-level domains.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co me app dev ai eu uk us ca de fr es it nl be ch at se no dk fi pl pt ie ru ua cz gr tr cn jp kr in au nz br mx ar za sg hk tv xyz online site shop example test".split())
#: Calling codes.
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "852", "886", "971", "972")
#: Words before a span that speak for its kind.
CUES = {
    EMAIL: frozenset("email e-mail mail mailto courriel correo contact contacto kontakt write reach schreib écrivez escriba".split()),
    IP: frozenset("ip ipv4 ipv6 address addr host server login logged adresse dirección client peer".split()),
    CARD: frozenset("card visa mastercard amex credit debit karte kreditkarte carte tarjeta payment paid crédit crédito pan".split()),
    PHONE: frozenset("phone tel telephone téléphone teléfono telefon call mobile cell fax whatsapp sms handy appel appelez llame móvil".split()),
}
#: Words before a span that speak against any kind.
COUNTER = frozenset("order version ver release build isbn issn invoice token sha sha256 md5 hash commit password id key page chapter section serial sku part figure table".split())

_WORD = re.compile(r"[\w-]+")
_HIDDEN = re.compile(r"[\[({<] ?(?:[Aa][Tt]|@) ?[\])}>]| [Aa][Tt] (?=[A-Za-z0-9-]+ [Dd][Oo][Tt] )")
_HIDDEN_MAIL = re.compile(r"[A-Za-z0-9_%+-]+(?:(?:\.| ?[\[({<] ?(?:[Dd][Oo][Tt]|\.) ?[\])}>] ?)[A-Za-z0-9_%+-]+)* ?(?:[\[({<] ?(?:[Aa][Tt]|@) ?[\])}>]|(?<= )[Aa][Tt](?= )) ?[A-Za-z0-9-]+(?:(?: ?[\[({<] ?(?:[Dd][Oo][Tt]|\.) ?[\])}>] ?| [Dd][Oo][Tt] |\.)[A-Za-z0-9-]+)+")
_BROKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(](?:\.|[Dd][Oo][Tt])[\])] ?[0-9]{1,3}){3}(?![0-9.])")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"\(?[0-9]++(?:[ ()./_-]{1,3}+[0-9]++)*+")
_GROUP = re.compile("[0-9]+")
_NATIONAL = re.compile(r"\(?0?[0-9]{2,5}\)?[ ./-]{0,2}[0-9]{3,4}[ ./-]{1,2}[0-9]{3,4}$")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-./])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([-./])[0-9]{1,2}\2(?:19|20)[0-9]{2}(?![0-9])")
_DOT = re.compile(r" ?[\[({<] ?(?:[Dd][Oo][Tt]|\.) ?[\])}>] ?| [Dd][Oo][Tt] ")


def issuer(digits: str) -> bool:
    """Whether a card number begins as those of the large issuers do, at their lengths."""
    two, four = int(digits[:2]), int(digits[:4])
    if len(digits) == 15:
        return two in (34, 37)
    if len(digits) == 14:
        return two in (36, 38) or 300 <= int(digits[:3]) <= 305
    return digits[0] == "4" or len(digits) >= 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two in (62, 65))


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """kind, start, end of what may be personal data in forms that the base patterns miss; nothing that meets a span of `taken`."""
    out: list[tuple[int, int, int]] = []
    for m in _HIDDEN.finditer(text):
        lo = max(0, m.start() - 80)
        out.extend((EMAIL, lo + h.start(), lo + h.end()) for h in _HIDDEN_MAIL.finditer(text[lo : m.end() + 160]) if lo + h.start() <= m.start() < lo + h.end())
    if "[.]" in text or "(.)" in text or "[dot]" in text:
        out.extend((IP, *m.span()) for m in _BROKEN_IP.finditer(text))
    seen = -1
    for m in _COLONS.finditer(text):
        if m.start() >= seen:
            lo = max(0, m.start() - 5)
            if h := _IP6.search(text[lo : lo + 48]):
                out.append((IP, lo + h.start(), lo + h.end()))
                seen = lo + h.end()
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 8:
            continue
        run = m[0]
        groups = [g.span() for g in _GROUP.finditer(run)]
        if sum(j - i for i, j in groups) < 8:
            continue
        at = m.start()
        for a in range(len(groups)):
            # groups in a row that are a card or a phone number by their digits alone; runs are short, as no number has over 19
            n, digits = 0, ""
            for b in range(a, len(groups)):
                n += groups[b][1] - groups[b][0]
                if n > 19:
                    break
                digits += run[groups[b][0] : groups[b][1]]
                lo, hi = at + groups[a][0], at + groups[b][1]
                if 13 <= n <= 19 and (b > a or len(groups) == 1) and issuer(digits) and luhn(digits):
                    out.append((CARD, lo, hi))
                if a == 0 and b == len(groups) - 1 and 8 <= n <= 15 and (len(groups) > 1 or digits[:2] == "00"):
                    out.append((PHONE, at, hi))
    busy = sorted((s, e) for _, s, e in taken)
    starts = [s for s, _ in busy]
    reach = [0, *accumulate((e for _, e in busy), max)]  # how far the spans that begin before reach
    return [x for x in dict.fromkeys(out) if reach[bisect_left(starts, x[2])] <= x[1]]


def votes(text: str, kind: int, start: int, end: int) -> tuple[list[int], list[str]]:
    """What the labelers say of a span, and the words around it."""
    span = text[start:end]
    before = _WORD.findall(text[max(0, start - NEAR) : start].lower())[-4:]
    after = _WORD.findall(text[end : end + NEAR].lower())[:2]
    digits = _NOT_DIGIT.sub("", span)
    shape = gazetteer = sums = ABSTAIN
    if kind == EMAIL:
        shape = YES if _MAIL.fullmatch(span) or _HIDDEN_MAIL.fullmatch(span) and not re.search(" [Aa][Tt] ", span) else ABSTAIN
        labels = re.split(r"[.]", _DOT.sub(".", re.split(r"[\])}>]| [Aa][Tt] |@", span, maxsplit=1)[-1]).strip())
        gazetteer = YES if labels[-1].lower() in TOP_LEVEL else ABSTAIN
        sums = YES if len(labels) > 1 and labels[-1].isalpha() and len(labels[-1]) > 1 and all(x and x[0] != "-" != x[-1] for x in labels) else NO
    elif kind == IP:
        if ":" in span:
            shape, sums = YES, YES if "::" in span or span.count(":") == 7 else NO
        else:
            parts = [int(x) for x in _GROUP.findall(span)]
            shape = YES if span.count(".") == 3 else ABSTAIN
            sums = YES if len(parts) == 4 and max(parts) <= 255 else NO
            gazetteer = NO if parts[0] in (0, 127) or parts[0] >= 224 else YES
    elif kind == CARD:
        shape = YES if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", span) else ABSTAIN
        gazetteer = YES if issuer(digits) else NO
        sums = YES if luhn(digits) else NO
    else:
        shape = YES if span[0] == "+" or _NATIONAL.match(span) else NO
        code = digits[2:] if digits[:2] == "00" else digits
        gazetteer = YES if (span[0] == "+" or digits[:2] == "00") and code.startswith(CALLING) else ABSTAIN
        sums = YES if 9 <= len(digits) <= 13 else NO
    if _DATE.match(span):
        shape = gazetteer = sums = NO
    cue = YES if CUES[kind].intersection(before) else ABSTAIN
    counter = NO if COUNTER.intersection(before) else ABSTAIN
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = NO if left.isalnum() or right.isalnum() or left in "=#$€£_\"'" and left or right in "%_\"'" and right else YES
    return [shape, gazetteer, cue, counter, edges, sums], before[-3:] + after


def slots(kind: int, given: list[int], near: list[str], span: str) -> list[int]:
    """Hashed features: votes, words around, the form of the span."""
    form = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "9", span[:64])))
    names = [f"{kind}", *(f"{kind}v{i}{v}" for i, v in enumerate(given)), *(f"{kind}w{w}" for w in near), f"{kind}f{form}", f"{kind}n{min(len(span), 40) // 4}"]
    return sorted({crc32(x.encode()) % SLOTS for x in names})


SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("slots", pa.list_(pa.int16()))])
SPAN_DDL = "array<struct<kind: byte, start: int, end: int, base: boolean, votes: int, slots: array<short>>>"


def _code(given: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(given))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found: for each row, base spans and what may be one, with votes and features."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            hashes, found = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in base))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                own = []
                for is_base, spans in ((True, base), (False, loose_spans(text, base))):
                    for kind, s, e in spans:
                        given, near = votes(text, kind, s, e)
                        own.append({"kind": kind, "start": s, "end": e, "base": is_base, "votes": _code(given), "slots": slots(kind, given, near, text[s:e])})
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(found, pa.list_(SPAN))], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "found"])

    schema = StructType.fromDDL(", ".join(f"n_{k} long" for k in KINDS) + f", base_sha256 string, found {SPAN_DDL}")
    return docs.select("doc_id", "text").mapInArrow(scan, StructType([docs.schema["doc_id"], *schema]))


def reliabilities(patterns: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """The share of true candidates, P(vote | class) by labeler, and each pattern's probability to be true.

    `patterns` are distinct rows of votes, `weights` how often each occurs. Classes and labelers' tables are estimated in turn; what a labeler
    is believed to do before any data (right four times of five where it speaks) counts as ten candidates, so that kinds with few
    candidates stay near it and the classes can't change places.
    """
    n, m = patterns.shape
    prior = np.zeros((2, m, 3))
    prior[1] = np.array([0.1, 0.4, 0.5]) * 10
    prior[0] = np.array([0.4, 0.1, 0.5]) * 10
    hot = np.eye(3)[patterns]
    said = (patterns == YES).sum(1), (patterns == NO).sum(1)
    true = (said[0] + 1) / (said[0] + said[1] + 2)
    for _ in range(rounds):
        each = np.stack([weights * (1 - true), weights * true])
        table = np.einsum("cn,nmv->cmv", each, hot) + prior
        table /= table.sum(2, keepdims=True)
        share = (each[1].sum() + 5) / (weights.sum() + 10)
        score = np.einsum("nmv,cmv->nc", hot, np.log(table)) + np.log([1 - share, share])
        true = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
    return share, table, true


def _patterns() -> np.ndarray:
    codes = np.arange(3 ** len(LABELERS))
    return np.stack([codes // 3**i % 3 for i in range(len(LABELERS))], 1)


def fit(found: DataFrame, examples: int = EXAMPLES) -> np.ndarray:
    """Weights of the span classifier, the last one constant: logistic, on at most `examples` candidates of each kind and origin with the probabilities of their votes."""
    rows = found.select(F.explode("found").alias("x"), F.xxhash64("doc_id", "base_sha256").alias("h")).select("x.*", "h")
    counted = rows.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 4 kinds x 3**6 votes at most
    believed = np.full((4, 3 ** len(LABELERS)), 0.5)
    patterns = _patterns()
    for kind in range(4):
        own = sorted((r.votes, r.n) for r in counted if r.kind == kind)
        at, n = np.array([v for v, _ in own], np.int64), np.array([w for _, w in own], float)
        believed[kind, at] = reliabilities(patterns[at], n)[2]
    order = [F.xxhash64("h", "start", "kind"), "start", "end", "slots"]
    picked = [r for kind in range(4) for base in (True, False) for r in rows.where((F.col("kind") == kind) & (F.col("base") == base)).orderBy(*order).limit(examples).select("kind", "votes", "slots").collect()]
    w = np.zeros(SLOTS + 1)
    if not picked:
        return w
    x = np.zeros((len(picked), SLOTS + 1), np.float32)
    y = np.array([believed[r.kind, r.votes] for r in picked])
    for i, r in enumerate(picked):
        x[i, r.slots] = 1
    x[:, SLOTS] = 1
    used = np.flatnonzero(x.any(0))
    x, y, v = x[:, used], y.astype(np.float32), np.zeros(len(used), np.float32)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        v -= np.float32(0.5) * ((p - y) @ x / np.float32(len(y)) + np.float32(1e-4) * v)
    w[used] = v
    return w


def find(docs: DataFrame, examples: int = EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each row of `docs` (doc_id, text), as the contract of op13 says; counts are of base spans.

    Base patterns always count. Forms that they miss (addresses spelt with at and dot, broken or version 6 addresses of machines, numbers
    with other marks, parts of longer runs) are candidates: labelers by shape, gazetteers, words before, edges and sums vote on them
    and on base spans; expectation-maximisation over the counts of all patterns of votes tells how far each labeler is right; a logistic classifier
    of votes, form and words around learns these probabilities and adds candidates of `threshold` or more that overlap nothing.

    Null and empty texts: no spans. Null doc_id and repeated rows: judged by their own text. Ties between overlapping candidates: the likelier, then the first.
    Without any candidate the classifier adds nothing. Other columns are not read; an empty table gives an empty result.
    """
    found = common.stored(candidates(docs), "personal")
    w = fit(found, examples)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("found").to_pylist():
                base = [(x["kind"], x["start"], x["end"]) for x in own if x["base"]]
                rated = []
                for x in own:
                    if not x["base"]:
                        p = 1 / (1 + np.exp(-float(w[x["slots"]].sum() + w[-1])))
                        if p >= threshold and w.any():
                            rated.append((-p, x["start"], x["kind"], x["end"]))
                added: list[tuple[int, int, int]] = []
                for _, s, kind, e in sorted(rated):
                    if all(e <= t or u <= s for _, t, u in added):
                        added.append((kind, s, e))
                out.append(joined(base + added))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.string())], names=[*names, "spans"])

    names = [c for c in found.columns if c != "found"]
    return found.mapInArrow(decide, StructType([*[found.schema[c] for c in names], *StructType.fromDDL("spans string")]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))

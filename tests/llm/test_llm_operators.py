"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import exact_dedup, licenses, minhash, packing, pieces, quality_rules, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def corpus():
    """(doc_id, text, source): near and exact copies, shared passages, junk, blanks and nulls."""
    rng = random.Random(3)
    voc = ["a", "b", "c", "dd", "E", "é", "日本"] * 3 + [f"x{i}" for i in range(60)]
    base = [[rng.choice(voc) for _ in range(120)] for _ in range(4)]
    rows = []
    for d in range(70):
        w = []
        for _ in range(rng.randint(0, 3)):
            b, s = rng.choice(base), rng.randint(0, 60)
            w += b[s : s + rng.randint(30, 110)]
            if rng.random() < 0.5:
                w += [f"z{rng.randint(0, 5)}"] * rng.randint(1, 90)
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = f"edit{d}"
        rows.append((d, "".join(x + rng.choice([" ", " ", " ", "\n", ".\n", "\t"]) for x in w)))
    for d in range(70, 110):  # near copies of one text
        w = list(base[0])
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
        rows.append((d, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "one"), (206, "w " * 300), (207, "w " * 150), (None, rows[5][1]), (None, None), (7, rows[7][1]), (208, "Üx one two"), (209, "üx one two")]
    return [(d, t, None if d == 3 else f"s{(d or 0) % 2}") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string").repartition(3)
    # columns that clash with names the operators may use
    return df.selectExpr("*", "1 AS keep", "2 AS run", "3 AS n", "'x' AS kept", "4 AS size", "5 AS id", "6 AS z", "7 AS seed", "8 AS path", "9 AS lines")


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_exact(docs):
    rows = [(d, (t or "").translate(ASCII)) for d, t, _ in corpus()]
    best, size = {}, collections.Counter(t for _, t in rows)
    for d, t in rows:
        best[t] = max(best.get(t, -1), -1 if d is None else d)
    want = [(d, None if best[t] < 0 else best[t], size[t], (d if d is not None else -1) == best[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    assert multiset(exact_dedup.exact_groups(docs).collect()) == multiset(want)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


def brute_cut(rows, n=50):
    low = {}
    for d, t in rows:
        w = words(t)
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            if d is not None and low.get(k, d) >= d:
                low[k] = d
    for d, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - n + 1):
            if d is not None and low.get(tuple(w[p : p + n]), d) < d:
                gone.update(range(p, p + n))
        yield d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_substring(docs):
    want = multiset(brute_cut([(d, t) for d, t, _ in corpus()]))
    got = substring_dedup.cut(docs)
    assert multiset(got.drop("kept_text").collect()) == want
    for r in got.collect():
        assert hashlib.sha256(" ".join(words(r.kept_text)).encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.cut(docs.where("false")).count() == 0


def brute_near(rows, size, percent):
    def shingles(t):
        w = words((t or "").translate(ASCII))
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [(d, shingles(t)) for d, t in rows]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            if d is not None and e is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    for d, s in sets:
        c = find(d) if d is not None else None
        yield d, len(s), c, c == d


@pytest.mark.parametrize("size", [2, 5])
def test_near(docs, size):
    want = multiset(brute_near([(d, t) for d, t, _ in corpus()], size, 80))
    assert multiset(minhash.near_groups(docs, size).collect()) == want
    assert minhash.drop_near(docs, size).columns == docs.columns


def test_near_of_nothing(docs):
    assert minhash.near_groups(docs.where("false")).count() == 0
    assert {r.component_id for r in minhash.near_groups(docs.where("doc_id IN (201, 202)")).collect()} == {201, 202}


def test_estimates_follow_similarity(spark):
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        both = int(400 * 2 * share / (1 + share))
        b = np.concatenate([a[:both], rng.integers(0, 2**63, 400 - both, dtype=np.uint64)])
        sig = [minhash.signature(minhash.minima(x))[1].tolist() for x in (a, b)]
        est = spark.createDataFrame([tuple(sig)], "a array<long>, b array<long>").select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(est - share) < 0.12


def test_pieces(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t, _ in corpus():
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert multiset(pieces.encode_decode(docs).collect()) == multiset(want)


def test_pieces_of_random_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceBpe(path, limit=50)
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "\t", "é", "▁", "日", "𠮷", ".", "ing", "the", "\x00", "rrr", "$$", "1", "'s", "\r\n", "<s>", "﻿"]
    for _ in range(600):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        ids = model.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids and own.decode(ids) == model.decode(ids)
    for _ in range(600):
        ids = [rng.choice([rng.randint(0, 258), rng.randint(259, 31999)]) for _ in range(8)]
        assert own.decode(ids) == model.decode(ids)


def test_packing(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True  # ids of texts without added tokens; those have a test of their own
    want = collections.defaultdict(list)
    for d, x, _ in corpus():
        want[d].append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    rows = packing.pack(docs, length=256).collect()
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        assert any(len(i) == r.doc_tokens and zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for i in want[r.doc_id])
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    total = sum(len(i) for v in want.values() for i in v)
    assert sum(r.length for r in rows) == total and padding < 0.08 * total
    for d, texts in want.items():
        assert sum(r.length for r in rows if r.doc_id == d) == sum(map(len, texts))


def test_cuts_are_the_best():
    rng = random.Random(1)
    for _ in range(200):
        at = [0]
        while at[-1] < 60:
            at.append(at[-1] + rng.randint(1, 6))
        cost = [0.0] + [rng.choice([0.0, 1.0, 4.0]) for _ in at[1:]]
        best = [0.0] + [float("inf")] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost[j] + 16 - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 16)
        cuts = packing.plan_cuts(np.array(at), np.array(cost), 16)
        price = sum(16 - (b - a) + cost[at.index(b)] for a, b in zip([0, *cuts], cuts))
        assert cuts[-1] == at[-1] and abs(price - best[-1]) < 1e-9


def test_unit_ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True  # ids of texts without added tokens; those have a test of their own
    units = packing.byte_units(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    parts = ["a", " ", " ", "  ", "\n", "\n\n", "\t", "é", "日", ".", "ing", "'s", "\x85", " ", "\xa0", "\x1f", "12", "<|endoftext|>", "﻿", "B"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(units.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_rules(docs):
    want = []
    for d, t, _ in corpus():
        t = t or ""
        w = words(t)
        tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    got = quality_rules.quality_rules(docs)
    assert multiset(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == multiset(want)
    assert got.where("base_failed AND kept").count() == 0


def test_common_lines(spark):
    """A line in four of five texts of a host; a copy counts once, another host doesn't."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Shared  line here\n{long} {i}", "h") for i in range(4)] + [(4, long + " x", "h"), (5, f"shared line here\n{long} 0", "g"), (6, f"Shared  line here\n{long} 0", "h")]
    rows += [(7, "shared line here\n" * 30 + "tail " + long, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_common_words, r.kept) for r in quality_rules.quality_rules(df, min_docs=3, share=0.5).collect()}
    assert got[0] == (3, True) and got[4] == (0, True) and got[5] == (0, True) and got[6] == (3, True)
    assert got[7][0] == 90 and got[7][1] is False


def test_warc(spark):
    rows = [(1, "http://a", "<p>x"), (2, None, "<p>x"), (3, "http://b\r\nX: y", None), (4, "http://c", ""), (5, "http://d", "é\r\n\r\nWARC/1.1\r\n"), (None, "http://e", "<p>x"), (2, None, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("keep", F.lit(1))
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if p in (1, 3) else "response", {1: 2, 3: 4}.get(p)) for p, _, h in rows]
    assert multiset(warc.round_trip(pages).collect()) == multiset(want)
    every = [(p, len((h or "").encode()), sha(h), "revisit" if p == 1 else "response", {1: 2}.get(p)) for p, _, h in rows]
    assert multiset(warc.round_trip(pages, min_revisit_bytes=3).collect()) == multiset(every)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_predicates(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "body" if i % 2 else f"b{i}") for i in range(10)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).where("warc_type = 'response' AND target_uri IN ('http://h/2', 'http://h/9', 'http://h/3')")
    assert sorted((r.target_uri, bytes(r.payload)) for r in got.collect()) == [("http://h/2", b"b2"), ("http://h/9", b"body")]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.wanted == {"warc-type": frozenset({"revisit"})}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4


def test_licences(spark):
    s = licenses.SENTENCES
    mit = "\n".join([s["mit-title"], "Copyright 2020 X", *[s[k] for k in ("mit-grant", "mit-condition", "mit-warranty")]])
    wrong = "\n".join(s[k] for k in ("apache-copy", "apache-compliance", "apache-header"))
    rows = [(1, "intro.\n" + mit), (2, s["gpl3-notice"] + " And more. " + s["reserved"]), (3, None), (4, ""), (5, wrong), (None, s["cc0-notice"].upper()), (2, s["gpl3-notice"] + " And more. " + s["reserved"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1))
    got = sorted(((r.doc_id, r.licences, [m.rule for m in r.matches]) for r in licenses.scan(df).collect()), key=str)
    two = (2, ["GPL-3.0", "Proprietary"], ["gpl3-notice", "reserved"])
    assert got == sorted([(1, ["MIT"], ["mit-titled", "mit-text"]), two, two, (3, [], []), (4, [], []), (5, [], []), (None, ["CC0-1.0"], ["cc0-notice"])], key=str)
    assert licenses.scan(df.where("false")).count() == 0


def test_packing_of_added_tokens(spark):
    """The string of an added token at the start, in the middle, at the end, twice and in part, as `tokenizers` takes it."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    texts = [f"{e} b c", f"a {e} b", f"a b {e}", f"a{e}{e}b", e, f"a\n{e}\n b <|endof", f"a  {e}  b", "plain text"]
    units = packing.byte_units(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(units.document(x), "<u4").tolist() == ids
        want[d] = (zlib.crc32(np.array([*ids, 1], "<u4").tobytes()), len(ids) + 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, length=2048).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {d: n for d, (_, n) in want.items()}
    whole = [r for r in rows if r.length == r.doc_tokens]
    assert len(whole) > 1 and all(r.ids_crc32 == want[r.doc_id][0] for r in whole)


def test_licences_wrapped(spark):
    """Texts as they are in files: wrapped, in comments, with bullets and titles; marks end sentences wherever lines do."""
    s = licenses.SENTENCES
    fill = lambda *names, lead="", width=72: textwrap.fill(" ".join(s[n] for n in names), width, initial_indent=lead, subsequent_indent=lead, break_long_words=False, break_on_hyphens=False)
    mit = "\n\n".join(["MIT License", "Copyright (c) 2020 X", fill("mit-grant"), fill("mit-condition"), fill("mit-warranty")])
    close = "\n".join(["MIT License", "Copyright (c) 2020 X", fill("mit-grant", width=40)])
    bsd = "Copyright (c) 2020, X\nAll rights reserved.\n\n" + fill("bsd-grant") + "\n\n1. " + fill("bsd-source") + "\n\n2. " + fill("bsd-binary") + "\n\n3. " + fill("bsd-endorse")
    apache = ["# Copyright 2020 X", "#", *fill("apache-header", "apache-compliance", lead="# ", width=60).split("\n"), "# You may obtain a copy of the License at", "#", "#     http://www.apache.org/licenses/LICENSE-2.0", "#", "# Unless required"]
    texts = {
        1: (mit, ["mit-titled", "mit-text"], ["MIT"]),
        2: (close, ["mit-titled"], ["MIT"]),
        3: (bsd, ["reserved", "bsd3-text"], ["BSD-3-Clause", "Proprietary"]),
        4: (fill("isc-grant", lead=" * ", width=78), ["isc-text"], ["ISC"]),
        5: ("\n".join(apache), ["apache-header"], ["Apache-2.0"]),
        6: (fill("gpl-free", lead=";; ") + "\n;;\n" + fill("gpl-hope", lead=";; ") + " without even\n;; more.\n" + fill("gpl-received", lead=";; "), ["gpl3-header"], ["GPL-3.0-or-later"]),
        7: (fill("isc-grant", width=78).replace(" for any", "; for any"), [], []),
        8: ("It says: no " + s["mit-notice"], [], []),
    }
    df = spark.createDataFrame([(d, t.replace("\n", "\r\n") if d == 4 else t) for d, (t, _, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: ([m.rule for m in r.matches], r.licences) for r in licenses.scan(df).collect()}
    assert got == {d: (rules, names) for d, (_, rules, names) in texts.items()}


def plain_match(hits, gap):
    """What `licenses.match` finds, by trying all positions and all pairs."""
    found = set()
    for rule, (licence, _) in licenses.RULES.items():
        for start, ident in hits:
            at, names = start, licenses.steps(rule)
            if ident != names[0]:
                continue
            for name in names[1:]:
                at = min((p for p, i in hits if i == name and at < p <= at + gap), default=None)
                if at is None:
                    break
            if at is not None:
                found.add((licence, rule, start, at))
    size = lambda x: len(licenses.steps(x[1]))
    return sorted((x for x in found if not any(size(y) > size(x) and y[2] <= x[2] and x[3] <= y[3] for y in found)), key=lambda x: (x[2], x[3], x[1]))


def test_licence_rules_are_matched_as_by_brute_force_and_fast():
    r = random.Random(1)
    names = [name for _, name in licenses.known()]
    for _ in range(300):
        run = r.choices(names, k=r.randint(0, 25)) if r.random() < 0.5 else [s for rule in r.choices(list(licenses.RULES), k=4) for s in licenses.steps(rule)]
        pos, hits = 0, []
        for name in run:
            pos += r.choice([1, 1, 2, 5])
            hits.append((pos, name))
        assert licenses.match(hits, 4) == plain_match(hits, 4)
    hits = [(k, licenses.steps("bsd3-text")[k % 4]) for k in range(10_000)]
    began = time.time()
    assert len(licenses.match(hits)) == 2500
    assert time.time() - began < 1

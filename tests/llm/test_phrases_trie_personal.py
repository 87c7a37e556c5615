"""Collocations, the trie of conversations and personal data: brute force, SQL, hard cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import collocations, personal, prefix_trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def grams(docs):
    f, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f[lang][tuple(w[i : i + n])] += 1
    return f, total


def brute_collocations(docs, least, top):
    f, total = grams(docs)
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "size"), [(27, 1 << 21), (8, 40), (16, 700)])
def test_collocations_are_those_of_brute_force(spark, bits, size):
    r = random.Random(bits)
    words = ["a", "b", "A", "été", "c|", "the", "x y", "日本"]
    docs = [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", " ,", "\x0b"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None])) for _ in range(60)]
    docs += [(None, "en"), ("", None), ("the a " * 400, "en"), ("the a the a", "fr"), ("only. once.", "es")]
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(docs)], DOCS).withColumn("phrase", F.lit("clash")).repartition(3)
    got = collocations.collocations(df, least=5, top=30, bits=bits, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == brute_collocations(docs, 5, 30)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None, None, None, None), (1, "...\n", "en", None, None)], DOCS)).count() == 0


def test_shards_give_each_phrase_once():
    data = collocations.plain(["a b c d e f g h i j k l m n o p. q r s t u v w x y z " * 3, "one", ""])
    whole = Counter(data[b - 1 : e + 1] for _, begins, ends, _ in collocations.phrases(data, 0, "en")[1] for b, e in zip(begins, ends))
    parts, n = Counter(), 0
    for shard, skip in collocations.shards(data, 25):
        count, found = collocations.phrases(shard, skip, "en")
        n += count
        parts.update(shard[b - 1 : e + 1] for _, begins, ends, _ in found for b, e in zip(begins, ends))
    assert parts == whole and n == collocations.phrases(data, 0, "en")[0]


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, v in own.items():
        h = crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == p).encode()).hexdigest())
        for p, m in members.items()
    }


def conversations(r, n, texts):
    rows = []
    for c in r.sample(range(700), n):
        rows += [(c, r.choice([None, 0, 1, 2, 3, 4, 5, 6]), r.choice(["user", "assistant", None]), r.choice(texts)) for _ in range(r.randint(1, 9))]
    return rows


@pytest.mark.parametrize("bits", [64, 5])
def test_trie_is_that_of_brute_force(spark, bits):
    r = random.Random(bits)
    rows = conversations(r, 150, ["", None, "a", "é日", "hello there"])
    rows += [(c, t, "user", "same") for c in (1000, 1001, 1007, 2003, 2099, 3050) for t in range(7)]  # blocks with and without a first one
    rows += [(None, 0, "user", "no conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(3)
    got = [tuple(x) for x in prefix_trie.trie(df, bits).select(TRIE).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_a_long_conversation_lies_in_many_parts(spark):
    rows = [(c, t, "user", f"t{t % 7}") for c in (200, 201, 300) for t in range(120)] + [(5, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = prefix_trie.placed(df)
    assert placed.where("conv_id = 200").selectExpr("min(pos)", "max(pos)", "count(distinct pos)").first() == (0, 119, 120)
    assert {tuple(x) for x in prefix_trie.trie(df).select(TRIE).collect()} == brute_trie([(c, t, r, x) for c, t, r, x in rows])


def test_trie_of_nothing_and_of_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(c, 0, "user", "x") for c in (101, 102, 103, 104, 105)]
    assert {tuple(x) for x in prefix_trie.trie(spark.createDataFrame(rows, schema)).select(TRIE).collect()} == brute_trie(rows)


def test_trie_sql(spark):
    rows = conversations(random.Random(3), 60, ["a", "bb", "ccc"])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    duck = duckdb.connect()
    conversations_ = df.toPandas()
    duck.register("frame", conversations_)
    duck.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM frame")
    cur = duck.execute(prefix_trie.SQL)
    names = [d[0] for d in cur.description]
    assert set(cur.fetchall()) == {tuple(x) for x in prefix_trie.trie(df).select(names).collect()}


MAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(0, *m.span()) for m in MAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(7)
    bits = ["1", "4", "255", "0", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "4111 1111 1111 1111", "é", "%", "1.2.3.4", "12", "\n"]
    for _ in range(20000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert personal.base_spans(t) == brute_base(t), t


FORMS = {
    "write to bob.smith [at] example [dot] com please": "bob.smith [at] example [dot] com",
    "mail anna (at) host.org": "anna (at) host.org",
    "call (555) 123-4567 now": "(555) 123-4567",
    "tel 0049 30 1234567": "0049 30 1234567",
    "card 4111.1111.1111.1111 ok": "4111.1111.1111.1111",
    "visa 3782 822463 10005": "3782 822463 10005",
    "server 10[.]2[.]3[.]4": "10[.]2[.]3[.]4",
    "host 2001:db8:0:0:0:ff00:42:8329 up": "2001:db8:0:0:0:ff00:42:8329",
    "card 4111 1111 1111 1111 12/25": "4111 1111 1111 1111",
    "version 1.2.3 order 20230405-12345678": None,
    "token=12345678901234567890": None,
    "2023-01-02 12:30:45": None,
    "ratio 3:4:5 in 1999": None,
    "plain words. nothing else": None,
}


def test_spans_are_added_and_base_ones_stay(spark):
    r = random.Random(5)
    texts = [f"we met at {r.randint(1, 99)} and x{i}.y@mail{i % 9}.example.com or +1 (2{r.randint(10, 99)}) 555-{r.randint(1000, 9999)} at {r.randint(1, 255)}.2.3.4 4111 1111 1111 1111 end" for i in range(80)]
    rows = [(i, t) for i, t in enumerate([*texts, *FORMS])] + [(None, None), (None, ""), (3, "again a@b.co"), (3, "again a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = personal.find(df).collect()
    assert len(got) == len(rows)
    by_id = {x.doc_id: x for x in got if x.doc_id is not None and x.doc_id >= len(texts)}
    for i, (text, want) in enumerate(FORMS.items(), len(texts)):
        spans = [text[int(s) : int(e)] for _, s, e in (x.split(":") for x in by_id[i].spans.split(",") if x)]
        assert want is None and not spans or want in spans, (text, spans)
    for x in got:
        text = dict(enumerate([*texts, *FORMS])).get(x.doc_id, "") if x.doc_id != 3 else None
        if text is not None:
            base = brute_base(text)
            assert x.base_sha256 == hashlib.sha256(personal.joined(base).encode()).hexdigest()
            assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
            assert set(personal.joined(base).split(",")) - {""} <= set(x.spans.split(","))
    assert [x.spans for x in got if x.doc_id is None] == ["", ""]
    assert personal.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_runs_take_time_in_proportion():
    for text in ("1" * 300_000, "1 " * 150_000, "1.2." * 80_000, "a@" * 100_000, "+1" * 100_000, ":0" * 100_000, "a" * 300_000 + "@", "(at) " * 20_000):
        personal.loose_spans(text, personal.base_spans(text))


def test_reliabilities_find_the_labelers_that_are_right():
    r = np.random.default_rng(1)
    true = r.random(4000) < 0.3
    right = [0.95, 0.9, 0.6, 0.9, 0.55, 0.85]
    votes = np.stack([np.where(r.random(4000) < p, true, ~true) for p in right], 1).astype(int)
    votes[r.random(votes.shape) < 0.2] = personal.ABSTAIN
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table, p = personal.reliabilities(patterns, n.astype(float))
    assert abs(share - 0.3) < 0.05 and ((p[at.ravel()] >= 0.5) == true).mean() > 0.95
    said = table[1, :, personal.YES] / (table[1, :, personal.YES] + table[1, :, personal.NO])
    assert np.abs(said - right).max() < 0.1

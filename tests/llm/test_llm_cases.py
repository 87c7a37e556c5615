"""SQL of the native operators, blocks of near duplicates, empty tables, very long texts."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm_operators import brute_near, multiset

import corpus_pipeline
from spanloom.llm import exact_dedup, licenses, minhash, packing, pieces, quality_model, quality_rules, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def boilerplate():
    """A line that a fifth of a host's documents have, one that all of another's have, copies, blanks and nulls."""
    rng = random.Random(4)
    rows = []
    for d in range(120):
        host = "ab"[d % 2] if d else None
        lines = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 6))]
        if host == "a" and d % 10 == 2:
            lines.insert(rng.randint(0, len(lines)), "Subscribe   to our LETTER now")
        if host == "b":
            lines += [f"share page {k}" for k in rng.sample(range(50), rng.randint(1, 50))]
        rows.append((d, "\n".join(lines), "en", host, 1))
    rows += [(500 + k, rows[7][1], "en", "b", 1) for k in range(9)] + [(600, None, "en", "a", 0), (601, "", "en", None, 0), (602, " \n\t\n", "en", "a", 1)]
    return rows


@pytest.mark.parametrize("module,run", [(exact_dedup, exact_dedup.exact_groups), (quality_rules, quality_rules.quality_rules)])
def test_sql(spark, module, run):
    docs = spark.createDataFrame(boilerplate(), SCHEMA)
    db = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    db.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents")
    want = db.sql(module.SQL)
    got = run(docs)
    assert multiset(got.select(want.columns).collect()) == multiset(want.fetchall())
    if module is quality_rules:
        assert got.where("n_common_words > 0").count() > 60 and got.where("NOT kept AND NOT base_failed").count() > 3


@pytest.mark.parametrize("block", [4, 64])
def test_near_in_blocks(spark, monkeypatch, block):
    """A large family around one text, chains, and documents of a bucket that no link holds together."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(160):
        w = list(base)
        for _ in range(rng.randint(2, 7)):
            w[rng.randrange(100)] = f"e{d}-{rng.randint(0, 9)}"
        rows.append((1000 - d, " ".join(w)))
    chain = [f"c{i}" for i in range(90)]
    for d in range(60):
        chain[rng.randrange(90)] = f"x{d}"
        rows.append((2000 + d, " ".join(chain)))
    rows += [(3000 + d, " ".join([f"s{i}" for i in range(60)] + [f"t{d}-{i}" for i in range(20)])) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(minhash.near_groups(df, 2).collect()) == multiset(brute_near(rows, 2, 80))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA + ", kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for run in (exact_dedup.exact_groups, substring_dedup.cut, pieces.encode_decode, quality_rules.quality_rules, minhash.near_groups, packing.pack, licenses.scan):
        assert run(none).count() == 0
    assert quality_model.score(none, labels).count() == 0 and toxicity.score(none, labels).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60_000))
    texts = {1: long, 2: "x" * 200_000, 3: long + " end", 4: "short one", 5: "\n" * 100_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("source", F.lit("s"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in pieces.encode_decode(df).collect()}
    assert got == {d: len(model.encode(t, add_bos=True, add_eos=True)) for d, t in texts.items()}
    assert {r.doc_id: r.component_id for r in minhash.near_groups(df, 2).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert {r.doc_id: r.n_removed for r in substring_dedup.cut(df).collect()} == {1: 0, 2: 0, 3: 60_000, 4: 0, 5: 0}
    packed = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert len(packed) == 5 and all(r.n == r.of for r in packed)
    assert quality_rules.quality_rules(df).where("doc_id = 1").first().n_words == 60_000


def test_tables_of_units_are_bounded():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceBpe(path, chars=60)
    for k in range(200):
        t = f"unit{k} é{k}日 " + "long" * (k % 120)
        assert own.encode(t) == model.encode(t, add_bos=True, add_eos=True)
        ids, text = own.parts(t)
        assert text == own.join(np.frombuffer(ids, "<u4").tolist())
        assert own.units.held <= 60 + pieces.LONG and max(map(len, own.units), default=0) <= pieces.LONG

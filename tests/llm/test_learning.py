"""Classifiers by held-out accuracy, the pipeline stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import learn, quality_model, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    voc = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for d in range(900):
        w = [rng.choice(voc) for _ in range(rng.randint(20, 80))]
        good, toxic = int(rng.random() < 0.8), int(rng.random() < 0.2)
        if not good:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "nastyword", "badword"])
        rows.append((d, " ".join(w), "en", "s", 1))
        labels.append((d, good, toxic))
    rows += [(9000, None, "en", "s", 0), (9001, "", None, None, 0), (None, "a b", "en", "s", 0)]
    labels += [(None, 1, 1), (9000, None, None), (5, labels[5][1], labels[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs.withColumn("y", F.lit("clash")).withColumn("score", F.lit(3)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("model,label,threshold", [(quality_model, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out(labelled, model, label, threshold):
    docs, labels = labelled
    got = model.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels.dropDuplicates(["doc_id"]), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.predicted == r[label] for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got.collect())
    assert model.score(docs.where("false"), labels).count() == 0
    assert model.score(docs, labels.where("false")).select("score").distinct().count() == 1


def test_features_of_parts_add_up(monkeypatch):
    text = " ".join(f"word{i} é{i}" for i in range(500))
    whole = learn.counted(text, False)
    monkeypatch.setattr(learn, "CHUNK", 200)
    parts = learn.counted(text, False)
    assert sorted(zip(*whole)) == sorted(zip(*parts))


def test_pipeline(spark, labelled, tmp_path):
    docs, labels = labelled
    base = docs.drop("y", "score")
    passage = " ".join(f"p{i}" for i in range(70))
    extra = [(5000, "Copy of ONE text " + "q " * 5, "en", "s", 1), (5001, "copy of one text " + "q " * 5, "en", "s", 1), (5002, "start here " + passage, "en", "s", 1), (5003, "another opening of words that differ " + passage + " " + " ".join(f"r{i}" for i in range(90)), "en", "s", 1)]
    base = base.unionByName(spark.createDataFrame(extra, base.schema))
    base.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = base
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "packing":
            assert now.columns == base.columns
            assert now.select("doc_id").subtract(before.select("doc_id")).count() == 0
    ids = lambda n: {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/{n}").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect() if r.doc_id is not None}
    assert len(good - ids("quality")) < 0.05 * len(good)
    assert 5001 in ids("exact_dedup") and 5000 not in ids("exact_dedup")
    cut = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/out/substring_dedup").where("doc_id > 5001").collect()}
    assert "p40" in cut[5002].text and "p40" not in cut[5003].text and "r80" in cut[5003].text and cut[5003].n_chars == len(cut[5003].text)
    last = spark.read.parquet(f"{tmp_path}/out/packing")
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == ids("substring_dedup")


def test_stages_decide_by_row(spark, labelled, tmp_path):
    """Rows without doc_id and rows that share one stay or go each by their own text."""
    _, labels = labelled
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    run = lambda f, rows: sorted(((r.doc_id, r.text) for r in f(spark, spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema), str(tmp_path)).collect()), key=repr)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")

    want = [(None, b), (None, c), (4, d), (9, a)]
    assert run(corpus_pipeline.exact, [(None, a), (None, b), (None, c), (4, a.upper()), (4, d), (9, a)]) == sorted(want, key=repr)

    near = " ".join(a.split()[:-1])
    assert run(corpus_pipeline.near, [(1, a), (4, near), (4, d), (None, b), (None, c), (5, d + " d80")]) == sorted([(1, a), (4, d), (None, b), (None, c)], key=repr)

    rows = [(1, "x " + a), (4, "first own words " + a), (4, b), (4, c), (None, d), (None, "y " + d)]
    assert run(corpus_pipeline.substring, rows) == sorted([(1, "x " + a), (4, "first own words"), (4, b), (4, c), (None, d), (None, "y " + d)], key=repr)

    docs, _ = labelled
    scored = quality_model.score(docs, labels).where("NOT held_out").orderBy("score").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad, good = texts[scored[0].doc_id], texts[scored[-1].doc_id]
    docs.select("doc_id", "text").where("doc_id IS NOT NULL").write.parquet(f"{tmp_path}/d")
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/d").collect()]
    got = run(corpus_pipeline.quality, [*base, (None, bad), (None, good), (7000, bad), (7000, good)])
    assert [x for x in got if x[0] in (None, 7000)] == sorted([(None, good), (7000, good)], key=repr)

from __future__ import annotations

import numpy as np
from cases import awkward, nothing

from sylvaflow.llm import language, quality
from sylvaflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_languages_on_rows_not_learned_from(spark):
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [k for k, r in got.items() if r.held_out]
    assert set(got) == set(lang) and 100 < len(held) < 300
    assert np.mean([got[k].lang_pred == lang[k] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_awkward_rows(spark):
    train = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    model = language.learn(train)
    docs = awkward(spark)
    got = language.predict(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 9)) and by[8].lang_pred != "und"
    assert language.predict(nothing(spark), model).count() == 0
    assert language.learn(nothing(spark)) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_families_and_pairs():
    rng = np.random.default_rng(0)
    shares = rng.random((60, language.DIMENSIONS)).astype(np.float32) * 1e-3
    labels = np.array(["en", "de", "fr", "xx"] * 15)
    for k, name in enumerate(["en", "de", "fr", "xx"]):
        shares[labels == name, 10 * k : 10 * k + 5] += 0.1
    model = language.Model.train(shares, labels)
    assert model.families == ["germanic", "romance", "xx"] and model.pairs == [("germanic", "de", "en")]
    number, score = model.decide(shares.astype(np.float64) @ model.weights + model.bias)
    assert [model.languages[i] for i in number] == labels.tolist() and ((score > 0) & (score <= 1)).all()


def test_quality_on_rows_not_learned_from(spark):
    got = {r.doc_id: r for r in QUERIES["op6_quality_classifier"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [k for k in labels if got[k].held_out]
    assert np.mean([got[k].predicted == labels[k] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, 1, 1), (9, None, 0), (None, 1, 0), (777, 0, 0)], "doc_id long, quality int, toxic int")
    scorer = quality.learn(docs, labels)
    got = quality.score(docs, scorer).collect()
    assert len(got) == docs.count() and len({r.score for r in got if r.doc_id == 6}) == 1
    assert all(0 <= r.score <= 1 for r in got)
    kept = quality.accepted(docs, scorer)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    one = quality.learn(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    empty = quality.learn(nothing(spark), labels)
    assert quality.score(nothing(spark), empty).count() == 0


def test_repetition_is_seen():
    from pyarrow import array, large_string

    from sylvaflow.llm.common import blocks

    (_, texts), = blocks(array(["same same same same", "four words that differ"], large_string()))
    mark = quality.streams(texts)[2]
    assert set(mark[0][mark[1] == 0]) != set(mark[0][mark[1] == 1])

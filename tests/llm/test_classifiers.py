"""Language identification and quality: held-out accuracy, and defined results for odd rows."""

import numpy as np
import pytest

from cohortspark.llm import queries
from cohortspark.llm.language import UND, LanguageModel, features, predict_language, train_language_model
from cohortspark.llm.ngrams import SpanHasher, blocks, word_hashes
from cohortspark.llm.quality import keep_quality, score_quality, train_quality_model

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "123 ... !!"), (None, "The heon of the thing"), (5, "x" * 300_000), (5, "x" * 300_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in ODD], "doc_id long, text string, score string, _text string")


def test_language_held_out(spark):
    got = queries.op1_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and got.count() == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_language_model(docs)
    rows = predict_language(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(ODD)
    by_text = dict(zip(range(len(ODD)), rows))
    assert [by_text[i].lang_pred for i in range(4)] == [UND] * 4 and by_text[0].score == 0
    assert by_text[4].lang_pred == "en" and by_text[5] == by_text[6]
    assert predict_language(odd.limit(0), model, ["doc_id"]).count() == 0


def test_language_without_training_rows(spark, odd):
    model = train_language_model(odd.withColumnRenamed("_text", "lang").where("lang is null"))
    assert isinstance(model, LanguageModel) and {r.lang_pred for r in predict_language(odd, model, ["doc_id"]).collect()} == {UND}


def test_features_cover_whole_texts():
    long = "abc " * 300_000 + "z"
    both = features([long, "abc"])
    assert np.allclose((both * both).sum(1), 1, atol=1e-3)
    assert not np.allclose(features([long])[0], features(["abc " * 300_000])[0])


def test_blocks_give_every_place_once():
    texts = [b"ab", b"", b"x" * 1_500_000, b"yz"]
    seen = np.zeros(len(texts), int)
    for buffer, owner in blocks(texts, b" ", 3):
        assert len(buffer) == len(owner) + 3
        seen += np.bincount(owner, minlength=len(texts))
    assert seen.tolist() == [len(t) + 2 for t in texts]


def test_word_hashes_depend_on_the_word_only():
    hasher = SpanHasher(12345)
    one, _ = word_hashes(np.frombuffer(b"aa bb  aa\tcc", np.uint8), hasher)
    assert one[0] == one[2] and len(set(one.tolist())) == 3


def test_quality_held_out(spark):
    got = queries.op5_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_quality_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = score_quality(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and rows[0].score == rows[1].score == rows[2].score
    kept = keep_quality(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    assert keep_quality(odd.limit(0), model).count() == 0


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = train_quality_model(odd, none)
    assert {r.score for r in score_quality(odd, model, ["doc_id"]).collect()} == {0.5}

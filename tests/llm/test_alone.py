"""A text's language and quality rest on that text alone: in any batch, order and partition."""

import random

import numpy as np
import pytest

from cohortspark.llm import ngrams
from cohortspark.llm.language import BITS, GRAMS, features, predict_language, train_language_model
from cohortspark.llm.quality import score_quality, train_quality_model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    rows = [r.text for r in docs.select("text").collect()]
    return [*rows[:190], None, "", " ", "a", "ab", "abc", "é", "\0\0", "x" * 600_000, ("word " * 130_000) + "end"]


def _in_batches(texts, fn, sizes, seed):
    order = list(range(len(texts)))
    random.Random(seed).shuffle(order)
    out, at = {}, 0
    while at < len(order):
        part = order[at : at + next(sizes)]
        at += len(part)
        out.update(zip(part, fn([texts[i] for i in part])))
    return out


def _sizes(*steps):
    while True:
        yield from steps


def test_any_batch(docs, texts, spark):
    language = train_language_model(docs)
    quality = train_quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for fn in (lambda t: list(zip(*language.predict(t))), lambda t: quality.probabilities(t)[:, 1].tolist()):
        alone = _in_batches(texts, fn, _sizes(1), 1)
        for steps in ((2,), (256,), (3, 17, 40)):
            assert _in_batches(texts, fn, _sizes(*steps), steps[0]) == alone


def test_any_partition(docs, spark):
    language = train_language_model(docs)
    quality = train_quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for scored in (lambda d: predict_language(d, language, ["doc_id"]), lambda d: score_quality(d, quality, ["doc_id"])):
        one, three, many = ({tuple(r) for r in scored(docs.repartition(n)).collect()} for n in (1, 3, 17))
        assert one == three == many and len(one) == docs.count()


def test_features_by_plain_python(monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 64)
    texts = ["The cat, the mat", "", "é", "a" * 20 + " bcd" * 40, "Zz 12"]
    got = features(texts)
    for text, row in zip(texts, got):
        plain = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        raw = b" " + plain.encode() + b" "
        want = np.zeros((len(GRAMS), 1 << BITS))
        for g, n in enumerate(GRAMS):
            for at in range(len(raw) - n + 1):
                window = np.frombuffer(raw[at : at + n], np.uint8)
                want[g, ngrams.gram_hashes(window, 1, n, BITS)[0]] += 1
        norms = np.linalg.norm(want, axis=1, keepdims=True)
        want = (want / np.maximum(norms, 1e-9)).ravel() / 2
        if len(raw) > 64:  # blocks of a long text also have windows over its last blanks
            assert np.abs(row - want).max() < 0.05
        else:
            assert np.allclose(row, want, atol=1e-6)

"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from cohortspark.llm.common import TEXT_ROWS, labelled_sample, map_texts
from cohortspark.llm.ngrams import SPACE, SpanHasher, blocks, gram_hashes, mixed, word_hashes

BITS = 15
GRAMS = (3, 4)
#: Words, word pairs and each n-gram length have buckets of their own.
BUCKETS = (2 + len(GRAMS)) << BITS
DIM = 8
EPOCHS = 6
RATE = 0.6
#: Training rows per label; the model is fitted on a sample of this size and applied to all rows.
PER_LABEL = 800

_hasher = SpanHasher(0x9E3779B97F4A7C15)


def subwords(texts: list):
    """Blocks of ``(text index, bucket)``: words, word pairs, and n-grams inside one word and its border blanks.

    A word that follows itself falls in one bucket whatever the word is, so that repetition can be learned.
    """
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    for buffer, owner in blocks(raw, b" ", max(GRAMS) - 1):
        count = len(owner)
        hashes, starts = word_hashes(buffer[:count], _hasher)
        yield owner[starts], (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        first, second = hashes[:-1], hashes[1:]
        pair = np.where(first == second, np.uint64(0), mixed(first * np.uint64(3) + second) >> np.uint64(64 - BITS))
        same = owner[starts[:-1]] == owner[starts[1:]] if len(starts) else np.zeros(0, bool)
        yield owner[starts[:-1]][same], pair.astype(np.int64)[same] + (1 << BITS)
        space = SPACE[buffer]
        before = np.concatenate([[0], np.cumsum(space)])
        for g, n in enumerate(GRAMS, 2):
            inner = before[n - 1 : n - 1 + count] - before[1 : 1 + count]
            at = np.flatnonzero((inner == 0) & ~(space[:count] & space[n - 1 : n - 1 + count]))
            yield owner[at], gram_hashes(buffer, count, n, BITS)[at].astype(np.int64) + (g << BITS)


@dataclass
class QualityModel:
    """``logits[b]`` is the class scores of bucket ``b``: its vector times the output layer."""

    labels: list
    logits: np.ndarray

    def probabilities(self, texts: list) -> np.ndarray:
        """Softmax of the mean over all subwords; a text without words has the scores of the bias alone."""
        k = len(self.labels)
        total = np.zeros((len(texts), k))
        seen = np.zeros(len(texts))
        for owner, bucket in subwords(texts):
            seen += np.bincount(owner, minlength=len(texts))
            for j in range(k):
                total[:, j] += np.bincount(owner, self.logits[j][bucket], len(texts))
        z = total / np.maximum(seen, 1)[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def counts(texts: list) -> list[tuple[bytes, bytes]]:
    """Distinct buckets of each text and how often they occur."""
    owners, buckets = zip(*subwords(texts)) if texts else ((), ())
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    key, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    return [
        ((key[a:b] % BUCKETS).astype(np.int32).tobytes(), n[a:b].astype(np.float32).tobytes())
        for a, b in zip(cut, cut[1:])
    ]


def fit_quality_model(examples: list[tuple[np.ndarray, np.ndarray]], labels: list, shares: dict, seed: int = 11) -> QualityModel:
    """Stochastic gradient descent over documents; ``shares`` is the true share of each label, to weigh the sample."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names)), np.float32)
    target = np.array([names.index(v) for v in labels])
    drawn = np.bincount(target, minlength=len(names)) / len(target)
    weight = np.array([shares[n] for n in names]) / drawn
    steps, done = EPOCHS * len(target), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(target)):
            rate = RATE * (1 - done / steps)
            done += 1
            bucket, n = examples[i]
            if not len(bucket):
                continue
            part = n / n.sum()
            mean = part @ vectors[bucket]
            z = np.exp((z := mean @ out) - z.max())
            slope = z / z.sum()
            slope[target[i]] -= 1
            slope *= rate * weight[target[i]]
            back = out @ slope
            out -= np.outer(mean, slope)
            # Each vector gets its share of the document's gradient; scaled up as in per-token updates.
            vectors[bucket] -= np.outer(np.minimum(part * len(bucket), 1.0), back)
    return QualityModel(names, np.ascontiguousarray((vectors @ out).T.astype(np.float64)))


def train_quality_model(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL
) -> QualityModel:
    """Fit on at most ``per_label`` rows of each label, drawn by hash of the key and weighed back to the true shares.

    Label rows without key or label, and documents without text, are not learned from.  Without any row, every text
    scores one half; with one label only, every text gets it.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("_label"))
    shares = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}  # one row per class
    total = sum(shares.values())
    picked = labelled_sample(known, key, "_label", per_label)
    sample = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(picked), key)
    rows = map_texts(sample, [key, "_label"], text, lambda t: list(zip(*counts(t))) or [[], []], "b binary, n binary")
    rows = rows.orderBy(F.xxhash64(key), key, "_label", "b").limit(per_label * len(shares)).collect() if shares else []
    if not rows:
        return QualityModel([0, 1], np.zeros((2, BUCKETS)))
    examples = [(np.frombuffer(r["b"], np.int32), np.frombuffer(r["n"], np.float32)) for r in rows]
    return fit_quality_model(examples, [r["_label"] for r in rows], {k: v / total for k, v in shares.items()})


def _scorer(spark, model: QualityModel, good):
    shared = spark.sparkContext.broadcast(model)  # classes x buckets numbers: a fixed size

    def score(texts: list) -> np.ndarray:
        model = shared.value
        if good not in model.labels:
            return np.zeros(len(texts))
        return model.probabilities(texts)[:, model.labels.index(good)]

    return score


def score_quality(df: DataFrame, model: QualityModel, carry: list[str], text: str = "text", good=1) -> DataFrame:
    """``carry`` columns with ``score`` (probability of label ``good``) and ``predicted`` for every row.

    Whole texts are read; null and empty texts score as the model's empty document.  Repeated rows and null keys are
    kept; an empty table gives no rows.  No shuffle.
    """
    score = _scorer(df.sparkSession, model, good)

    def both(texts):
        p = score(texts)
        return [p, (p >= 0.5).astype(np.int32)]

    return map_texts(df, carry, text, both, "score double, predicted int")


def keep_quality(df: DataFrame, model: QualityModel, text: str = "text", good=1, least: float = 0.5) -> DataFrame:
    """Rows of ``df``, with all its columns, whose text scores at least ``least``.

    Null and empty texts score as the model's empty document and stay or go with it; repeated rows stay or go together;
    an empty table gives no rows.
    """
    score = _scorer(df.sparkSession, model, good)

    @pandas_udf("double")
    def scored(texts):
        values = [None if t is None else t for t in texts.tolist()]
        import pandas as pd

        return pd.Series(np.concatenate([score(values[i : i + TEXT_ROWS]) for i in range(0, len(values), TEXT_ROWS)] or [[]]))

    return df.where(scored(F.col(text)) >= least)

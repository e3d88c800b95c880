"""Language identification: the family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import labelled_sample, map_texts
from cohortspark.llm.ngrams import crossing, gram_hashes, text_blocks

UND = "und"
BITS = 11
GRAMS = (1, 2, 3, 4)
#: Training rows per language; the model is fitted on a sample of this size and applied to all rows.
PER_LANGUAGE = 400
MAX_LANGUAGES = 200

# Language codes by family.  A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "indic": ("hi", "bn", "mr", "ne", "ur", "pa", "gu"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

#: ASCII that is no letter becomes a blank; other bytes stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(texts: list) -> np.ndarray:
    """Rows of unit length: hashed counts of 1 to 4 bytes of the lower-cased text, all of it.

    A row rests on its own text alone: windows that would run over a text's end are left out.
    """
    size = 1 << BITS
    width = size * len(GRAMS)
    counts = np.zeros((len(texts), width), np.float32)
    raw = [b" ".join((t or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) for t in texts]
    for buffer, owner, ends in text_blocks(raw, b" ", max(GRAMS) - 1):
        rows = np.arange(owner[0], owner[-1] + 1)
        row = owner - owner[0]
        for g, n in enumerate(GRAMS):
            at = gram_hashes(buffer, len(owner), n, BITS) + row * size
            found = np.bincount(at, minlength=len(rows) * size)
            np.subtract.at(found, at[crossing(ends, n)], 1)
            found = found.reshape(len(rows), size)
            counts[rows, g * size : (g + 1) * size] += found
    counts = counts.reshape(len(texts), len(GRAMS), size)
    counts /= np.maximum(np.linalg.norm(counts, axis=2, keepdims=True), 1e-9)
    return counts.reshape(len(texts), width) / np.float32(np.sqrt(len(GRAMS)))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights and bias of a linear SVM with hinge loss, by dual coordinate descent; ``y`` is +1 or -1."""
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1] + 1)
    alpha = np.zeros(len(y))
    norms = (x * x).sum(1) + 1.0
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (x[i] @ w[:-1] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c * share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[:-1] += step * x[i]
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    """Separators between families (one against the rest) and between the languages of a family (pairs)."""

    families: list[tuple[str, list[str]]] = field(default_factory=list)
    weights: np.ndarray | None = None
    family_at: list[int] = field(default_factory=list)
    pair_at: dict[tuple[str, str], int] = field(default_factory=dict)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        rows = [i for i, ok in enumerate(letters) if ok]
        if not rows or not self.families:
            return names, scores
        x = features([texts[i] for i in rows])
        # Row by row in double precision and rounded, so that a text's score does not hang on the others in its batch.
        weights, bias = self.weights[:, :-1].astype(np.float64), self.weights[:, -1].astype(np.float64)
        margins = np.array([weights @ row + bias for row in x.astype(np.float64)]).round(9)
        sure = 1.0 / (1.0 + np.exp(-4.0 * margins))
        for i, m, p in zip(rows, margins, sure):
            best, score = 0, 1.0
            if len(self.families) > 1:
                best = int(np.argmax(m[self.family_at]))
                score = float(p[self.family_at[best]])
            members = self.families[best][1]
            votes = {a: [0, 0.0] for a in members}
            for a, b in combinations(members, 2):
                at = self.pair_at[a, b]
                votes[a if m[at] >= 0 else b][0] += 1
                votes[a][1] += p[at]
                votes[b][1] += 1 - p[at]
            winner = max(members, key=lambda a: (votes[a][0], votes[a][1]))
            if len(members) > 1:
                score *= votes[winner][1] / (len(members) - 1)
            names[i], scores[i] = winner, round(min(1.0, max(0.0, float(score))), 9)
        return names, scores


def fit_language_model(x: np.ndarray, labels: list[str]) -> LanguageModel:
    names = sorted(set(labels))
    at = np.array([names.index(v) for v in labels])
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(_FAMILY_OF.get(name, name), []).append(name)
    model = LanguageModel(families=sorted(groups.items()))
    rows = []
    if len(model.families) > 1:
        for _, members in model.families:
            inside = np.isin(at, [names.index(m) for m in members])
            model.family_at.append(len(rows))
            rows.append(fit_svm(x, np.where(inside, 1.0, -1.0)))
    for _, members in model.families:
        for a, b in combinations(members, 2):
            mine = np.isin(at, [names.index(a), names.index(b)])
            model.pair_at[a, b] = len(rows)
            rows.append(fit_svm(x[mine], np.where(at[mine] == names.index(a), 1.0, -1.0)))
    model.weights = np.array(rows, np.float32) if rows else np.zeros((0, x.shape[1] + 1), np.float32)
    return model


def train_language_model(
    df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE
) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each label, and at most ``MAX_LANGUAGES`` labels.

    Rows without key, text or label, and texts without a letter, are not learned from.  With no rows the model answers
    ``und`` only.  Texts become feature rows where they are read; the driver gets feature rows of the sample.
    """
    usable = df.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    picked = labelled_sample(usable, key, label, per_language)
    sample = df.join(F.broadcast(picked.select(key).distinct()), key, "left_semi").where(F.col(label).isNotNull())
    width = (1 << BITS) * len(GRAMS)
    rows = map_texts(
        sample, [key, label], text, lambda texts: [[v.tobytes() for v in features(texts).astype(np.float16)]], "x binary"
    )
    rows = rows.orderBy(F.xxhash64(key), key, "x").limit(per_language * MAX_LANGUAGES).collect()
    if not rows:
        return LanguageModel()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32).reshape(len(rows), width)
    return fit_language_model(x, [r[label] for r in rows])


def predict_language(df: DataFrame, model: LanguageModel, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` columns with ``lang_pred`` and ``score`` (0 to 1) for every row, from the whole text.

    A null text and one without a letter give ``und`` with score 0.  Repeated rows, null keys and further columns are
    kept or left out as ``carry`` says; an empty table gives no rows.  No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few weight rows per family: bounded by MAX_LANGUAGES
    return map_texts(df, carry, text, lambda texts: shared.value.predict(texts), "lang_pred string, score double")

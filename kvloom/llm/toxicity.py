"""Toxicity: a linear-chain CRF tags toxic words; marginals give document scores and offending offsets.

Documents carry labels, words do not. In the training sample a word of a toxic
document is labelled toxic if it is found in toxic documents and next to never in
others; the field learns those labelled tokens by the word, its affixes and
n-grams, so that it also tags inflected forms that it has not seen. A document's
score is a logistic function of its largest marginal, the sum of its marginals
and its number of words, fitted on the same sample.

The sample holds at most PER_LABEL documents of each label, none of them held
out. Every document is scored whole.

Defined results: null and empty texts score as a document without any toxic word;
without labelled documents every score is 0; repeated rows give repeated results;
a document labelled twice counts as toxic if any label is; other columns are not
read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import crf
from .common import held_out, map_columns

PER_LABEL = 2_500
LEAST_SHARE = 0.005
LEAST_DOCS = 3
MOST_CLEAN = 0.03


def word_features(word: str) -> list[int]:
    e = crf.coded(word)
    return [crf.BIAS, crf.whole(e), *crf.affixes(e, 5), *crf.ngrams(e, 4)]


def toxic_words(sample: list[tuple[str, int]]) -> set[str]:
    """Words in enough toxic documents and, by share, hardly in any other."""
    seen = {0: Counter(), 1: Counter()}
    docs = Counter(y for _, y in sample)
    for text, y in sample:
        seen[y].update({w.lower() for w in crf.TOKEN.findall(text)})
    least = max(LEAST_DOCS, LEAST_SHARE * docs[1])
    clean = max(docs[0], 1) / max(docs[1], 1)
    return {w for w, n in seen[1].items() if n >= least and w not in crf.ENDS and seen[0][w] <= MOST_CLEAN * n * max(1.0, clean)}


class Model:
    def __init__(self, field: crf.Field, weights: np.ndarray):
        self.field, self.weights = field, weights

    def scores(self, own: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
        x = summaries(own, p, n)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def summaries(own: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """(1, logit of the largest marginal, log of the sum of marginals that matter, log of the number of words) of each document."""
    top = np.full(n, 1e-6)
    toxic = p[:, 1] if p.size else np.zeros(0)
    np.maximum.at(top, own, toxic)
    top = np.minimum(top, 1 - 1e-6)
    total = np.bincount(own, np.where(toxic > 0.1, toxic, 0), n)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(total), np.log1p(np.bincount(own, minlength=n))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """The model, from the texts and labels.toxic of at most per_label documents of each label."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select("doc_id", "text")
    ids = texts.where(F.col("text").isNotNull()).select("doc_id").join(marks, "doc_id")
    sample = [(t, int(y)) for t, y in crf.training_sample(ids, texts, "toxic", per_label)]
    if not any(y for _, y in sample):
        return None
    words = toxic_words(sample)
    field = crf.Field([0, 1], word_features, 1 << 17)
    # Toxic documents, and as many others: the words of the rest would only repeat "not toxic".
    toxic = [s for s in sample if s[1]]
    rest = [s for s in sample if not s[1]][: 2 * len(toxic)]
    field.fit([t for t, _ in toxic + rest], lambda d, w: int(d < len(toxic) and w in words), epochs=4)
    tagger = crf.Tagger(field)
    x, y = [], np.array([y for _, y in sample], float)
    for at in range(0, len(sample), 500):
        part = [t for t, _ in sample[at : at + 500]]
        own, _, p = tagger(part)
        x.append(summaries(own, p, len(part)))
    return Model(field, logistic(np.vstack(x), y))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(w.size)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, offsets of every row; offsets: start:end (code points) of words with a marginal of 1/2 or more."""

    def start():
        tagger = crf.Tagger(model.field) if model else None

        def make(texts: list) -> list[list]:
            if tagger is None:
                return [[0.0] * len(texts), [""] * len(texts)]
            own, place, p = tagger(texts)
            scores = model.scores(own, p, len(texts))
            spans: dict[int, list[int]] = {}
            for i in np.flatnonzero(p[:, 1] >= 0.5) if p.size else ():
                spans.setdefault(int(own[i]), []).append(int(place[i]))
            offsets = [""] * len(texts)
            for d, places in spans.items():
                found = list(crf.TOKEN.finditer(texts[d]))
                offsets[d] = ",".join(f"{found[i].start()}:{found[i].end()}" for i in places)
            return [[float(s) for s in scores], offsets]

        return make

    out = map_columns(docs, ["doc_id"], ["text"], start, {"score": "double", "offsets": "string"})
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offsets")

"""Language identification of code-switched text: a linear-chain CRF labels words with languages.

Features of a word: its affixes, its character n-grams, the word itself and, from
a lexicon of the training sample, the languages it belongs to. Transitions are
learned, so a word that fits several languages follows its neighbours. A
document's prediction is the language with the largest sum of marginals; its
score is that language's share.

The field is fitted on at most PER_LANGUAGE documents of each language (held-out
documents never among them); every document is then labelled whole.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any training document all are ``und``; ties go to the first language by
name; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import crf
from .common import fresh, held_out, map_columns

PER_LANGUAGE = 300
UNKNOWN = "und"
LEXICON_LEAST = 5

#: A trigram belongs to a language that has it in LEAST_DOCS and LEAST_PART of its sampled documents.
LEAST_DOCS, LEAST_PART = 2, 0.01
#: A text of LEAST_LETTERS or more has a language only if LEAST_KNOWN of its letters are in words of known trigrams.
LEAST_LETTERS, LEAST_KNOWN, LOWEST = 20, 0.5, 0.02
#: Words whose scores a process keeps (see crf.Tagger); the pipeline's workers hold other stages' tables beside them.
CACHED_WORDS = 75_000


class WordFeatures:
    def __init__(self, lexicon: dict[str, str]):
        self.lexicon = {w: crf.whole(f"<{langs}>".encode()) for w, langs in lexicon.items()}

    def __call__(self, word: str) -> list[int]:
        e = crf.coded(word)
        own = [crf.BIAS, crf.whole(e), *crf.affixes(e, 3), *crf.ngrams(e, 3)]
        if word in self.lexicon:
            own.append(self.lexicon[word])
        return own


def lexicon_of(sample: list[tuple[str, str]], least: int = LEXICON_LEAST) -> dict[str, str]:
    """word -> the languages that hold at least a third of its uses, for words used often enough."""
    counts: dict[str, Counter] = {}
    for text, lang in sample:
        for w in crf.TOKEN.findall(text.lower()):
            counts.setdefault(w, Counter())[lang] += 1
    out = {}
    for w, c in counts.items():
        total = c.total()
        if total >= least and w not in crf.ENDS:
            out[w] = "+".join(sorted(x for x, n in c.items() if 3 * n >= total))
    return out


def trigrams(word: str) -> list[str]:
    edged = f"^{word}$"
    return [edged[i : i + 3] for i in range(len(edged) - 2)]


def own_trigrams(docs: list[set[str]]) -> set[str]:
    """The trigrams of a language, from the words of its documents."""
    counts = Counter(chain.from_iterable({g for w in words for g in trigrams(w)} for words in docs))
    least = max(LEAST_DOCS, LEAST_PART * len(docs))
    return {g for g, n in counts.items() if n >= least}


def known_share(words: set[str], known: set[str]) -> float:
    return sum(len(w) for w in words if known.issuperset(trigrams(w))) / sum(map(len, words))


class Evidence:
    """Which words could be of a learned language, from outside the labels' shares.

    known: the trigrams of all languages. least: for each language, the share of
    letters in known words that a text of it needs: LEAST_KNOWN, or less if each
    half of the language's sample does not know so much of the other half (small
    samples; a single document gives 0, and then nothing is turned away).
    """

    def __init__(self, sample: list[tuple[str, str]]):
        of: dict[str, list[set[str]]] = {}
        for text, lang in sample:
            if words := set(crf.TOKEN.findall(text.lower())) - set(crf.ENDS):
                of.setdefault(lang, []).append(words)
        self.known: set[str] = set().union(*map(own_trigrams, of.values()))
        self.least: dict[str, float] = {}
        for lang, docs in of.items():
            a, b = docs[::2], docs[1::2]
            shares = sorted([known_share(w, g) for rest, g in ((b, own_trigrams(a)), (a, own_trigrams(b))) for w in rest])
            self.least[lang] = min(LEAST_KNOWN, shares[int(LOWEST * len(shares))]) if b else 0.0

    def __call__(self, word: str) -> float:
        """Letters of the word, negative if it is not known."""
        return len(word) if self.known.issuperset(trigrams(word)) else -len(word)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> crf.Field | None:
    """The field, from text and lang of at most per_language documents of each language."""
    plain = docs.select("doc_id", "text", "lang")
    sample = crf.training_sample(plain.where(F.col("text").isNotNull()).select("doc_id", "lang"), plain, "lang", per_language)
    if not sample:
        return None
    labels = sorted({lang for _, lang in sample})
    number = {lang: i for i, lang in enumerate(labels)}
    y = [number[lang] for _, lang in sample]
    field = crf.Field(labels, WordFeatures(lexicon_of(sample)))
    field.evidence = Evidence(sample)
    return field.fit([t for t, _ in sample], lambda d, w: y[d], epochs=2)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, field: crf.Field | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def start():
        tagger = crf.Tagger(field, cached=CACHED_WORDS) if field else None

        def make(texts: list) -> list[list]:
            if tagger is None:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
            own, _, p = tagger(texts)
            sums = np.stack([np.bincount(own, p[:, k], len(texts)) for k in range(p.shape[1])], axis=1)
            best, total = sums.argmax(axis=1), sums.sum(axis=1)
            known = [t > 0 and has_letter(x) for t, x in zip(total, texts)]
            return [
                [field.labels[b] if k else UNKNOWN for b, k in zip(best, known)],
                [float(min(1.0, sums[i, b] / total[i])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))],
            ]

        return make

    out = map_columns(docs, ["doc_id"], ["text"], start, {"lang_pred": "string", "score": "double"})
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, field: crf.Field | None, least_score: float = 0.3) -> DataFrame:
    """The rows of docs whose text has a language.

    That is a letter, one language with at least least_score of the words, and
    evidence that its words are of a learned language at all, for the labels'
    shares always sum to 1: of the letters, at least the language's share (see
    Evidence) in words made of trigrams of the training sample. A text that changes
    between learned languages keeps its evidence. Texts of fewer than LEAST_LETTERS
    letters are too short for it and stay; without a training document, all with a
    letter do.
    """

    def start():
        tagger = crf.Tagger(field, field.evidence, CACHED_WORDS) if field else None
        least = np.array([field.evidence.least.get(x, 0.0) for x in field.labels]) if field else None

        def make(texts: list) -> list[list]:
            if tagger is None:
                return [[has_letter(t) for t in texts]]
            own, _, p = tagger(texts)
            sums = np.stack([np.bincount(own, p[:, k], len(texts)) for k in range(p.shape[1])], axis=1)
            letters = np.bincount(own, np.abs(tagger.marked), len(texts))
            known = np.bincount(own, np.maximum(tagger.marked, 0), len(texts))
            seen = (letters < LEAST_LETTERS) | (known >= least[sums.argmax(axis=1)] * letters)
            return [[bool(has_letter(t) and s.sum() > 0 and s.max() >= least_score * s.sum() and e) for t, s, e in zip(texts, sums, seen)]]

        return make

    keep = fresh(docs, "keep_language")
    out = map_columns(docs, docs.columns, ["text"], start, {keep: "boolean"})
    return out.where(F.col(keep)).select(*docs.columns)

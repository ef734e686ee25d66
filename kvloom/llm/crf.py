"""Linear-chain conditional random fields over words, in numpy: features, forward-backward, training.

A chain is a sentence (up to '.', '!', '?' or a line's end), whatever its length.
Words get their scores from hashed features of the word alone, so the scores of a
word are computed once for each process; the chain's transitions then weigh them
against the neighbours' by forward-backward, over all chains of a batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import held_out

#: A word of letters, or the end of a chain.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = ".!?\n"
#: A process keeps the scores of at most twice so many words: those of the last CACHED_WORDS new ones, and of these before that are met again.
CACHED_WORDS = 150_000
#: Longer chains are walked in pieces of so many words.
PIECE = 128
BIAS = 1


def coded(word: str) -> bytes:
    """Two bytes a character, so that slices are cut between characters."""
    return word.encode("utf-16-le", "surrogatepass")


def whole(e: bytes) -> int:
    return crc32(e, 5)


def affixes(e: bytes, longest: int) -> list[int]:
    """Hashes of the beginnings and ends of up to ``longest`` characters."""
    ends = range(2, min(2 * longest, len(e)) + 1, 2)
    return [crc32(e[:k], 2) for k in ends] + [crc32(e[-k:], 3) for k in ends]


def ngrams(e: bytes, n: int) -> list[int]:
    """Hashes of the character n-grams of the word with marked ends."""
    edged = b"^\0" + e + b"$\0"
    return [crc32(edged[i : i + 2 * n], 4) for i in range(0, len(edged) - 2 * n + 2, 2)]


def _ahead(local: np.ndarray, first: np.ndarray, alive: np.ndarray, entry: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Forward vectors of pieces, longest first. entry: what stands before the local scores of a piece's first word."""
    ahead, now = np.empty_like(local), entry
    for t, n in enumerate(alive):
        at = first[:n] + t
        now = (now[:n] @ step if t else now[:n]) * local[at]
        now /= now.sum(axis=1, keepdims=True)
        ahead[at] = now
    return ahead


def _products(local: np.ndarray, first: np.ndarray, alive: np.ndarray, base: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each piece, the k x k matrix that takes what stands before it to the forward vector of its last word (scaled)."""
    now = base
    for t, n in enumerate(alive):
        part = (now[:n] @ step if t else now[:n]) * local[first[:n] + t][:, None, :]
        now[:n] = part / part.sum(axis=(1, 2), keepdims=True)
    return now


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marginals (tokens, labels) of chains laid end to end.

    Chains are cut into pieces of at most PIECE words, and pieces are walked
    together, longest first, so that a step is one matrix product. What enters and
    leaves the pieces of a longer chain comes from a scan over their k x k products:
    a chain of n words costs about 3 * PIECE + 2 * n / PIECE steps, not 2 * n.
    """
    k = scores.shape[1]
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    step, begin = np.exp(moves), np.exp(starts - starts.max())
    per_chain = -(-lengths // PIECE)
    n_pieces = int(per_chain.sum())
    chain_of = np.repeat(np.arange(lengths.size), per_chain)
    place = np.arange(n_pieces) - (np.cumsum(per_chain) - per_chain)[chain_of]
    size = np.minimum(PIECE, lengths[chain_of] - place * PIECE)
    first = (np.cumsum(lengths) - lengths)[chain_of] + place * PIECE
    entry, leave = np.broadcast_to(begin, (n_pieces, k)).copy(), np.ones((n_pieces, k))
    order = np.argsort(-size, kind="stable")
    alive_of = lambda sizes: sizes.size - np.cumsum(np.bincount(sizes, minlength=int(sizes.max(initial=0)) + 1))[:-1]
    if n_pieces > lengths.size:
        some = order[per_chain[chain_of[order]] > 1]
        base = np.where((place[some] == 0)[:, None, None], np.eye(k)[None], step[None])
        product = np.empty((n_pieces, k, k))
        product[some] = _products(local, first[some], alive_of(size[some]), base, step)
        head = (np.cumsum(per_chain) - per_chain)[per_chain > 1]
        count = per_chain[per_chain > 1]
        now = begin[None, :] @ product[head]
        now = now[:, 0, :]
        for j in range(1, int(count.max())):
            on = count > j
            at = head[on] + j
            now[on] /= now[on].sum(axis=1, keepdims=True)
            entry[at] = now[on] @ step
            now[on] = np.einsum("nk,nkl->nl", now[on], product[at])
        for j in range(int(count.max()) - 1, 0, -1):
            on = count > j
            at = head[on] + j
            back = np.einsum("nkl,nl->nk", product[at], leave[at])
            leave[at - 1] = back / back.sum(axis=1, keepdims=True)
    first, alive = first[order], alive_of(size)
    ahead = _ahead(local, first, alive, entry[order], step)
    out, back = np.empty_like(local), leave[order]
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        if t + 1 < len(alive) and (m := alive[t + 1]):
            nxt = (local[first[:m] + t + 1] * back[:m]) @ step.T
            back[:m] = nxt / nxt.sum(axis=1, keepdims=True)
        both = ahead[at] * back[:n]
        out[at] = both / both.sum(axis=1, keepdims=True)
    return out


class Words(dict):
    """Word -> row; words that differ in case share a row. New ones (in lower case) queue up until their features are asked for. Rows 0 ... are the chain ends."""

    def __init__(self):
        super().__init__()
        self.lower: dict[str, int] = {}
        self.new: list[str] = []
        for c in ENDS:
            self[c]

    def __missing__(self, word: str) -> int:
        low = word.lower()
        row = self.lower.get(low)
        if row is None:
            row = self.lower[low] = len(self.lower)
            self.new.append(low)
        self[word] = row
        return row


def chains(rows: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of words, length of each chain, document of each word): chains end at end marks and at a document's end."""
    end = rows < len(ENDS)
    group = np.cumsum(end) + doc_of * 1
    word = np.flatnonzero(~end)
    if not word.size:
        return word, np.zeros(0, np.int64), doc_of[word]
    g, d = group[word], doc_of[word]
    cut = np.flatnonzero((np.diff(g) != 0) | (np.diff(d) != 0)) + 1
    return word, np.diff(np.concatenate([[0], cut, [word.size]])), d


class Field:
    """Weights of the field; features(word) -> hashes."""

    def __init__(self, labels: list, features: Callable[[str], list[int]], dims: int = 1 << 16):
        self.labels, self.features, self.dims = labels, features, dims
        k = len(labels)
        self.weights = np.zeros((dims, k), np.float32)
        self.moves, self.starts = np.zeros((k, k)), np.zeros(k)

    def scores(self, words: list[str]) -> np.ndarray:
        index, at = self._index(words)
        if not index.size:
            return np.zeros((len(words), len(self.labels)))
        sums = np.add.reduceat(np.vstack([self.weights[index], np.zeros((1, len(self.labels)), np.float32)]), at[:-1], axis=0)
        sums[at[1:] == at[:-1]] = 0
        return sums

    def _index(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features of the words end to end, where each word's begin)."""
        parts, sizes = [np.zeros(0, np.int32)], [0]
        for at in range(0, len(words), 10_000):
            each = list(map(self.features, words[at : at + 10_000]))
            own = list(map(len, each))
            sizes += own
            parts.append((np.fromiter(chain.from_iterable(each), np.int64, sum(own)) % self.dims).astype(np.int32))
        return np.concatenate(parts), np.cumsum(sizes)

    def fit(self, texts: list[str], gold: Callable[[int, str], int], epochs: int = 4, batch_docs: int = 64, rate: float = 0.2, l2: float = 1e-6, seed: int = 7) -> "Field":
        """Adagrad on the chains' conditional likelihood. gold(document, word) -> label's number. Tokens and features are made once for all epochs."""
        random, k = np.random.default_rng(seed), len(self.labels)
        sums, move_sums, start_sums = (np.full(x.shape, 1e-10) for x in (self.weights, self.moves, self.starts))
        words, tokens, golds = Words(), [], []
        for d, text in enumerate(texts):
            own = TOKEN.findall(text)
            tokens.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
            golds.append(np.fromiter((-1 if w in ENDS else gold(d, w.lower()) for w in own), np.int16, len(own)))
        index_of, bounds_of = self._index(words.new)
        for _ in range(epochs):
            for part in np.array_split(random.permutation(len(texts)), max(1, len(texts) // batch_docs)):
                rows = np.concatenate([tokens[d] for d in part])
                at, lengths, _ = chains(rows, np.repeat(np.arange(part.size), [tokens[d].size for d in part]))
                if not at.size:
                    continue
                y = np.concatenate([golds[d] for d in part])[at]
                met, rows = np.unique(rows[at], return_inverse=True)
                many = bounds_of[met + 1] - bounds_of[met]
                index = index_of[np.repeat(bounds_of[met] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                table = np.stack([np.bincount(np.repeat(np.arange(met.size), many), self.weights[index, j], met.size) for j in range(k)], axis=1)
                p = forward_backward(table[rows], lengths, self.moves, self.starts)
                off = -p
                off[np.arange(y.size), y] += 1
                by_word = np.stack([np.bincount(rows, off[:, j], met.size) for j in range(k)], axis=1)
                used, back = np.unique(index, return_inverse=True)
                spread = np.repeat(by_word, many, axis=0)
                # Features that are not met here keep their weights: only the met ones decay.
                grad = np.stack([np.bincount(back, spread[:, j], used.size) for j in range(k)], axis=1) / at.size - l2 * self.weights[used]
                sums[used] += grad**2
                self.weights[used] += (rate * grad / np.sqrt(sums[used])).astype(np.float32)
                # Transitions: seen pairs less expected pairs, the latter from the neighbours' marginals.
                last = np.zeros(at.size, bool)
                last[np.cumsum(lengths) - 1] = True
                a = np.flatnonzero(~last)
                pair = p[a][:, :, None] * np.exp(self.moves)[None] * p[a + 1][:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                seen = np.bincount(y[a] * k + y[a + 1], minlength=k * k).reshape(k, k)
                g = (seen - pair.sum(axis=0)) / at.size - 1e-4 * self.moves
                move_sums += g**2
                self.moves += 0.1 * g / np.sqrt(move_sums)
                head = np.cumsum(lengths) - lengths
                g = (np.bincount(y[head], minlength=k) - p[head].sum(axis=0)) / at.size - 1e-4 * self.starts
                start_sums += g**2
                self.starts += 0.1 * g / np.sqrt(start_sums)
        return self


class Tagger:
    """Marginals of texts, with the scores of words seen before kept by a process.

    mark(word), if given, is a number kept beside a word's scores; ``marked`` has those of the words of the last call.
    """

    def __init__(self, field: Field, mark: Callable[[str], float] | None = None, cached: int | None = None):
        self.field, self.mark, self.cached = field, mark, cached or CACHED_WORDS
        self.words, self.table = Words(), np.zeros((0, len(field.labels)), np.float32)
        self.old, self.old_table = {}, self.table
        self.marks = self.old_marks = self.marked = np.zeros(0, np.float32)

    def _learn(self) -> None:
        """Rows of the new words: from the generation before, or scored."""
        new, self.words.new = self.words.new, []
        before = np.fromiter((self.old.get(w, -1) for w in new), np.int64, len(new))
        table = np.empty((len(new), len(self.field.labels)), np.float32)
        fresh = np.flatnonzero(before < 0)
        table[before >= 0] = self.old_table[before[before >= 0]]
        table[fresh] = self.field.scores([new[i] for i in fresh])
        self.table = np.vstack([self.table, table])
        if self.mark:
            marks = np.empty(len(new), np.float32)
            marks[before >= 0] = self.old_marks[before[before >= 0]]
            marks[fresh] = [self.mark(new[i]) for i in fresh]
            self.marks = np.concatenate([self.marks, marks])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of each word, the word's place among its document's tokens, marginals), words in order."""
        if len(self.words) > self.cached:
            self.old, self.old_table, self.old_marks = self.words.lower, self.table, self.marks
            self.words, self.table, self.marks = Words(), self.table[:0], self.marks[:0]
        tokens = [TOKEN.findall(t) if t else [] for t in texts]
        counts = np.array([len(t) for t in tokens], np.int64)
        rows = np.fromiter(map(self.words.__getitem__, chain.from_iterable(tokens)), np.int64, int(counts.sum()))
        if self.words.new:
            self._learn()
        docs = np.repeat(np.arange(len(texts)), counts)
        at, lengths, own = chains(rows, docs)
        if self.mark:
            self.marked = self.marks[rows[at]]
        p = forward_backward(self.table[rows[at]].astype(np.float64), lengths, self.field.moves, self.field.starts) if at.size else np.zeros((0, len(self.field.labels)))
        return own, at - (np.cumsum(counts) - counts)[own], p


#: How many more than asked for are drawn by the hash threshold, so that chance rarely leaves too few.
DRAWN = 1.25


def training_sample(ids: DataFrame, texts: DataFrame, label: str, per_label: int) -> list[tuple[str, object]]:
    """(text, label) of at most per_label documents of each label, none of them held out.

    ids(doc_id, label) are those that may be drawn; texts has doc_id and text, and
    the label too where a document's rows may differ in it. A label's documents are
    those whose id hashes below a threshold, set by their number: nothing is sorted
    or ranked, and a repeated id is one document with one text (the first by hash).
    Only numbers by label and the sample come to the driver; labels are taken to be few.
    """
    able = ids.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", label)
    counts = {r[0]: r[1] for r in able.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    part = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, DRAWN * per_label / n))])
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    chosen = able.where(unit < part[F.col(label)]).distinct()
    keys = ["doc_id", label] if label in texts.columns else ["doc_id"]
    rows = texts.where(F.col("text").isNotNull()).join(F.broadcast(chosen), keys).groupBy("doc_id", label)
    got = rows.agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first(unit).alias("unit")).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(got, key=lambda r: (str(r[label]), r["unit"], r["doc_id"])):
        if taken[r[label]] < per_label:
            taken[r[label]] += 1
            out.append((r["text"], r[label]))
    return out

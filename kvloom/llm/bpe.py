"""BPE encoding and decoding by a tokenization automaton compiled from the merges.

The automaton reads tokens: a state is the last token read, and an arc is there
exactly if the two tokens may stand side by side in a merge result. It starts as
one state that lets every base symbol follow every other. Each merge (u, v) -> w
is then applied as a gadget, in order of rank:

* arc v leaves state u, since u before v is no longer kept apart;
* w gets a state that is a copy of v's as it is at that moment (what may follow
  the new token is what could follow its right half);
* w becomes a label wherever u is one at that moment (what may stand before the
  new token is what could stand before its left half).

A copy shares the arcs of its original and remembers the rank at which it was
taken, so compiling is one pass over the merges, and an arc is looked up through
the copies.

Words come as characters, so the automaton is made deterministic over characters:
a row stands for the tokens that may be under way (characters read of each, and
the token before it), and its entry for a character names the next row and the
token that ends there. Every prefix of a word has one accepted path, so there is
never more than one such token, and a word is one walk over the table followed by
one walk back over its tokens. Rows and entries are made when text first needs
them and then kept: all 49,000 x 49,000 arcs would fit no worker. The table is
emptied at ROWS rows, which changes no result. Decoding emits the arcs' labels.

Defined results: a null text is as empty (no ids, decoded text empty); repeated
rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import map_columns

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
ROWS = 100_000
WORD_ENTRIES = 150_000
#: Fixed pattern of the vocabulary's file; white space as its library reads it.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x85\p{Z}\p{L}\p{N}]+")
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
LETTER_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
BASE = -1


def byte_characters() -> str:
    """The visible character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    own = set(visible)
    return "".join(chr(b) if b in own else chr(next(hidden)) for b in range(256))


class Automaton:
    """States, labels and arcs over the tokens of a vocabulary with word ends."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocab
        self.text = {i: t for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.birth = [BASE] * size
        self.follow_of = [BASE] * size
        self.stand_of = [BASE] * size
        self.removed: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            self._gadget(rank, vocab[left], vocab[right], vocab[left + right])
        bodies = {t.removesuffix(END) for t in vocab}
        self.begun = {body[:n] for body in bodies for n in range(1, len(body))}
        self.length = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        self.rows: dict[tuple, Row] = {}
        self.start = Row(self, (("", BASE),))

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.removed[u, v] = rank
        self.birth[w], self.follow_of[w], self.stand_of[w] = rank, v, u

    def arc(self, s: int, x: int) -> bool:
        """May label x follow state s? Through the copies: the younger of the two is a copy, so look at its original as of the copy's rank."""
        until = len(self.removed) + 1
        while True:
            if self.removed.get((s, x), until) < until:
                return False
            if self.birth[s] == self.birth[x] == BASE:
                return True
            if self.birth[s] >= self.birth[x]:
                # Copied before its own arc was taken out.
                until = min(until, self.birth[s])
                s = self.follow_of[s]
            else:
                until = min(until, self.birth[x] + 1)
                x = self.stand_of[x]

    def row(self, branches: tuple) -> "Row":
        found = self.rows.get(branches)
        if found is None:
            found = self.rows[branches] = Row(self, branches)
        return found

    def make_room(self) -> None:
        """Empty a full table. Between words only: a walk holds a row."""
        if len(self.rows) >= ROWS:
            for row in self.rows.values():
                row.clear()
            self.rows.clear()
            self.start.clear()

    def path(self, word: str) -> list[int]:
        """Labels of the accepted path over a word (visible characters), the last one with the word end."""
        self.make_room()
        row, ended = self.start, []
        for character in word[:-1]:
            row, label = row[character]
            ended.append(label)
        ended.append(row[word[-1] + END][1])
        labels, at = [], len(word)
        while at:
            labels.append(ended[at - 1])
            at -= self.length[labels[-1]]
        return labels[::-1]


class Row(dict):
    """Character (with the word end, if it is the last) -> (next row, label of the arc that ends with it or None).

    branches: (characters read of a token under way, the token before it), the longest first.
    """

    __slots__ = ("automaton", "branches")

    def __init__(self, automaton: Automaton, branches: tuple):
        super().__init__()
        self.automaton, self.branches = automaton, branches

    def __missing__(self, character: str) -> tuple["Row", int | None]:
        a = self.automaton
        ended, under_way = None, []
        for read, before in self.branches:
            grown = read + character
            label = a.ids.get(grown)
            if label is not None and (before == BASE or a.arc(before, label)):
                ended = label
            if grown in a.begun:
                under_way.append((grown, before))
        if ended is not None:
            under_way.append(("", ended))
        entry = self[character] = a.row(tuple(under_way)), ended
        return entry


def pieces(text: str) -> list[str]:
    """Words of a lower-case text. The built-in patterns say the same as the fixed one where a text has no odd white space or numerals, and are faster."""
    if ODD_SPACE.search(text):
        return PIECES.findall(text)
    if text.isascii():
        return PLAIN_PIECES.findall(text)
    if any(c.isnumeric() and not c.isdecimal() for c in set(text)):
        return PIECES.findall(text)
    return LETTER_PIECES.findall(text)


class _Words(dict):
    """Word -> (number of ids, ids, labels)."""

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, str, str]:
        e = self.encoder
        ids = e.automaton.path(word.encode().decode("latin-1").translate(e.visible))
        got = len(ids), " ".join(map(str, ids)), " ".join([e.label[i] for i in ids])
        if len(word) <= 64:
            self[word] = got
        return got


class Encoder:
    """Text to ids and back with a tokenizer's file, as its library does without special tokens added, truncation or padding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.automaton = Automaton(spec["model"]["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = self.automaton.text | {i: t for t, i in self.special.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.visible = byte_characters()
        self.words = _Words(self)

    def _parts(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids, labels) of each word and special token."""
        if len(self.words) > WORD_ENTRIES:
            self.words.clear()
        out = []
        for part in self.marks.split(text) if self.marks and "<|" in text else [text]:
            if part in self.special:
                out.append((1, str(self.special[part]), part))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += map(self.words.__getitem__, pieces(part.lower()))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self._parts(text or "") for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Labels of the ids' arcs, joined as the library joins them when the file names no decoder."""
        return " ".join([self.label[i] for i in ids if i in self.label])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them)."""
        parts = self._parts(text or "")
        ids, labels = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        return sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(labels.encode()).hexdigest()


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The automaton of a file, compiled once a process."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (joined by one space), decoded. path: the tokenizer's file, as the executors see it."""

    def start():
        enc = encoder(path)

        def make(texts: list) -> list[list]:
            ids = [enc.encode(t) for t in texts]
            return [[" ".join(map(str, i)) for i in ids], [enc.decode(i) for i in ids]]

        return make

    return map_columns(docs, ["doc_id"], ["text"], start, {"ids": "string", "decoded": "string"})


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() without moving the ids out of the task."""

    def start():
        enc = encoder(path)
        return lambda texts: list(zip(*[enc.digests(t) for t in texts])) or [[], [], []]

    return map_columns(docs, ["doc_id"], ["text"], start, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})

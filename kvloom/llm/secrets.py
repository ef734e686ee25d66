"""Secret scans: base patterns, and a token-efficiency test that exposes random strings.

A tokenizer's vocabulary holds what people write, so ordinary words, paths and
names cost few tokens a character, while random strings fall apart into short
pieces. A string of token characters of MIN_RUN or more is exposed if it has fewer
than MAX_RATIO characters a token, mixes kinds of characters, touches no base
span, and is not a known digest (hex of a digest's length), a UUID, a date or
number, or an identifier made of words.

Strings are the whole run of token characters and, as words beside a random string
would hide it in the average, if the run is not exposed as a whole: the stretches
of neighbouring segments between separators (- _ / + =), cut at base spans, UUIDs
and times. Only stretches are tried that could not be halved into two of MIN_RUN:
of a longer exposed one, some part is as dense in tokens. Half of a stretch must not be
words, or its segments have fewer than SHORT_RATIO characters a token. Exposed stretches lose
ordinary words at their ends where what is left is exposed, and those that overlap
are one span.

Offsets are code points, end exclusive. Defined results: a null text is as
empty, and both have no spans; rows are judged one by one, so repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from functools import cache

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import fresh, map_columns

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the contract. A run below its least length is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MIN_RUN = 20
MAX_RATIO = 2.4
SHORT_RATIO = 2.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
#: Known identifiers inside a run: UUIDs and times.
KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9]{2}-?[0-9]{2}-?[0-9]{2}Z?)(?![A-Za-z0-9])")
SEGMENT = re.compile(r"[A-Za-z0-9]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
WORDY = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*$")
VOCABULARY = "byte_bpe_50k.tiktoken"

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file, read once a process."""
    if path not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def is_identifier(run: str) -> bool:
    """Known digests and names that people give: not secrets."""
    if UUID.match(run) or WORDY.match(run):
        return True
    return len(run) in DIGEST_LENGTHS and all(c in "0123456789abcdefABCDEF" for c in run)


def kinds_mixed(run: str) -> int:
    return any("a" <= c <= "z" for c in run) + any("A" <= c <= "Z" for c in run) + any("0" <= c <= "9" for c in run)


def exposed(run: str, enc: tiktoken.Encoding, max_ratio: float) -> bool:
    if len(run) < MIN_RUN or kinds_mixed(run) < 2 or is_identifier(run):
        return False
    return len(run) < max_ratio * len(enc.encode_ordinary(run))


def stretches(text: str, start: int, end: int, enc: tiktoken.Encoding, max_ratio: float) -> list[tuple[int, int]]:
    """Exposed stretches of segments of text[start:end], overlapping ones as one."""
    segments = [m.span() for m in SEGMENT.finditer(text, start, end)]

    @cache
    def facts(k: int) -> tuple[int, int, bool]:
        word = text[slice(*segments[k])]
        return len(word), len(enc.encode_ordinary(word)), bool(WORDY.match(word))

    def ordinary(k: int) -> bool:
        n, tokens, word = facts(k)
        return word and n >= max_ratio * tokens

    def hides(i: int, j: int) -> bool:
        """Separators make many tokens of short words, so one of the segments' own measures must be a random string's."""
        if not exposed(text[segments[i][0] : segments[j][1]], enc, max_ratio):
            return False
        own = [facts(k) for k in range(i, j + 1)]
        n = sum(f[0] for f in own)
        return 2 * sum(f[0] for f in own if not f[2]) >= n or n < SHORT_RATIO * sum(f[1] for f in own)

    tight, loose = [], []  # without ordinary words at the ends; with some, as the rest is below MIN_RUN
    for i, (a, _) in enumerate(segments):
        for j in range(i, len(segments)):
            if j > i and segments[j - 1][1] - a >= 2 * MIN_RUN:
                break
            if not hides(i, j):
                continue
            low, high = i, j
            while low < high and ordinary(low):
                low += 1
            while low < high and ordinary(high):
                high -= 1
            core = (segments[low][0], segments[high][1])
            if hides(low, high):
                tight.append(core)
            else:
                loose.append((core, (a, segments[j][1])))
    whole = merged(tight)
    starts = [a for a, _ in whole]
    for core, wide in loose:
        k = bisect_left(starts, core[1]) - 1
        tight.append(core if k >= 0 and core[0] < whole[k][1] else wide)
    return merged(tight)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, by start."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def random_spans(text: str, base: list[tuple[int, int, str]], enc: tiktoken.Encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    found, first = [], 0
    for m in RUN.finditer(text):
        while first < len(base) and base[first][1] <= m.start():
            first += 1
        touched = []
        for a, b, _ in base[first:]:
            if a >= m.end():
                break
            if b > m.start():
                touched.append((a, b))
        run = m[0].strip("=-_/+")
        if not touched and exposed(run, enc, max_ratio):
            start = m.start() + m[0].index(run)
            found.append((start, start + len(run), KINDS[3]))
            continue
        at = m.start()
        for a, b in [*sorted(touched + [k.span() for k in KNOWN.finditer(text, m.start(), m.end())]), (m.end(), m.end())]:
            if a - at >= MIN_RUN and kinds_mixed(text[at:a]) > 1:
                found += [(x, y, KINDS[3]) for x, y in stretches(text, at, a, enc, max_ratio)]
            at = max(at, b)
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scanned(text: str | None, enc: tiktoken.Encoding, max_ratio: float) -> tuple[list, list]:
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, enc, max_ratio), key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row. vocabulary: path of a rank file, as the executors see it."""

    def start():
        enc = encoding(vocabulary or public_tokenizers.path(VOCABULARY))

        def make(texts: list) -> list[list]:
            rows = []
            for text in texts:
                base, spans = _scanned(text, enc, max_ratio)
                kinds = [k for _, _, k in spans]
                rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            return list(zip(*rows))

        return make

    fields = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_random": "long", "base_sha256": "string", "spans": "string"}
    return map_columns(docs, ["doc_id"], ["text"], start, fields)


def mask(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with every span of its texts replaced by [kind]; overlapping spans are replaced as one. n_chars, if there, follows the new text."""

    def start():
        enc = encoding(vocabulary or public_tokenizers.path(VOCABULARY))

        def make(texts: list) -> list[list]:
            masked = []
            for text in texts:
                spans = [] if text is None else _scanned(text, enc, max_ratio)[1]
                out, at = [], 0
                for a, b, kind in spans:
                    if a >= at:
                        out += [text[at:a], f"[{kind}]"]
                    at = max(at, b)
                masked.append("".join([*out, text[at:]]) if spans else text)
            return [masked, [None if t is None else len(t) for t in masked]]

        return make

    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    size = fresh(docs, "n_masked")
    out = map_columns(docs, rest, ["text"], start, {"text": "string", size: "long"})
    return out.select(*[F.col(size).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])

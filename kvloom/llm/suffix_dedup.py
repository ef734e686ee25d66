"""Removing repeated passages with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document
with a smaller id. For that, suffixes are told apart by their first LENGTH bytes
only: a suffix array here holds these strings in byte order, equal ones as one, with
the smallest document of each. Strings are compared as bytes, never by fingerprint.

Every string of LENGTH bytes has an anchor: the least hash among its strings of
KGRAM bytes. Equal strings have equal anchors, so work can be dealt out by anchor:

1. Anchors of every document are shuffled as numbers; those of one text only are
   dropped. A text of no other's anchors is done.
2. Of texts with shared anchors, the stretches under these anchors are sent to the
   anchor's partition. Equal stretches (128-bit digests) are combined before and
   after the shuffle: only the first document that has one is indexed, and later
   ones are covered by it from end to end. So a passage that a third of all
   documents share is one row a batch of documents.
3. A partition takes its stretches in batches by document id. A batch gets a suffix
   array and is merge-scanned against the levels of the family for strings that a
   smaller document has; then it becomes a level, and levels of like size merge
   geometrically. At n strings there are about log2(n / BATCH_STRINGS) levels.
4. Covered strings become spans of their documents.

Very common anchors, told from a bounded sample of texts (a hint that decides where
work is done, not what comes out), are dealt further: their numbers by a salt, since
they are shared for certain, and their stretches by a second anchor of other k-grams.

A partition's family holds LENGTH + 8 bytes for each distinct string under its
anchors, and there are four partitions for each of spark.sql.shuffle.partitions,
which so has to follow the input, as it does for any shuffle.

Exact copies are told by SHA-256 before that: all but the smallest id lose their
whole text if it has LENGTH bytes.

Defined results: a null text is as empty; a null id is no smaller than any id and
has no smaller one, so such rows keep their text and cover none; rows with one id
are one document and do not cover each other, and each loses what its own text
repeats of other documents; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import SLICE, map_columns, materialize, parts, release, small_or_shuffled
from .ngram_join import _lists, _mix, _weight

LENGTH = 50
KGRAM, SECOND_KGRAM = 20, 12
BATCH_STRINGS = 400_000
#: A longer run of strings under one anchor is more than one stretch.
MOST_STRINGS = 4_096
#: Texts that are looked at for common anchors; an anchor of HOT_TEXTS of them is common, and at most HOT_MOST are dealt further.
HOT_SAMPLE, HOT_TEXTS, HOT_MOST, SALTS = 8_192, 16, 100_000, 64
#: Short texts are run together up to so many bytes to find their anchors.
TOGETHER = 32_768
FAR = np.iinfo(np.int64).max


def _words8(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each position the next 2, 4 and 8 bytes as numbers."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    b2 = b[:-1] | (b[1:] << np.uint64(8))
    b4 = b2[:-2] | (b2[2:] << np.uint64(16))
    return b2, b4, b4[:-4] | (b4[4:] << np.uint64(32))


def fingerprints(raw: bytes, length: int) -> np.ndarray:
    """64-bit fingerprints of all strings of length bytes (a multiple of 2, 8 at least)."""
    n = len(raw) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    b2, b4, b8 = _words8(raw)
    h = np.full(n, np.uint64(length), np.uint64)
    at = 0
    # Each word of 8 bytes is mixed once, and weighed by its place in each string that holds it.
    words = _mix(b8 + _weight(0))
    for k in range(length // 8):
        h += words[at : at + n] * _weight(k)
        at += 8
    if length - at >= 4:
        h += b4[at : at + n] * _weight(30)
        at += 4
    if length - at >= 2:
        h += b2[at : at + n] * _weight(31)
    return _mix(h)


def anchors(raw: bytes, length: int = LENGTH, kgram: int = KGRAM) -> np.ndarray:
    """The anchor of each string of length bytes: the least fingerprint of its kgrams."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    least, have, need = fingerprints(raw, kgram), 1, length - kgram + 1
    while 2 * have <= need:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < need:
        least = np.minimum(least[: least.size - (need - have)], least[need - have :])
    return least


def each_anchors(raws: Iterable[bytes], length: int, kgram: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text with its anchors(): short texts together, as calls on short arrays take longer than the work; strings over a text's end are left out."""

    def some(held: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
        a, at = anchors(b"".join(held), length, kgram), 0
        for raw in held:
            yield raw, a[at : at + max(0, len(raw) - length + 1)]
            at += len(raw)

    held, size = [], 0
    for raw in raws:
        if held and size + len(raw) > TOGETHER:
            yield from some(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    yield from some(held)


def _run_starts(a: np.ndarray) -> np.ndarray:
    new = np.ones(a.size, bool)
    new[1:] = a[1:] != a[:-1]
    return np.flatnonzero(new)


def _once(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values of runs of them."""
    a = np.sort(a[_run_starts(a)])
    return a[_run_starts(a)]


def _raws(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


def _numbers(texts: DataFrame, length: int, kgram: int, common: np.ndarray) -> DataFrame:
    """texts(cls, text) -> anchor, cls, salt of every anchor of a text, once; a salt (1 to SALTS) tells a common anchor, 0 another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                found = [_once(a) for _, a in each_anchors(_raws(b.column(1)), length, kgram)]
                anchor = np.concatenate(found)
                cls = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [f.size for f in found])
                salt = np.where(_among(common, anchor), cls % SALTS + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(cls), pa.array(salt)], names=["anchor", "cls", "salt"])

    return texts.select("cls", "text").mapInArrow(run, "anchor long, cls long, salt int")


def _raw(text: str | None) -> bytes:
    return text.encode() if text else b""


def _shared(rows: DataFrame) -> DataFrame:
    """rows(anchor, cls, salt) -> (anchor, cls) of those whose anchor has more than one cls, or a salt (known to be common). Partitions are read in order of the anchor, holding one row back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flagged = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, cls, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            low, high = np.minimum.reduceat(cls, starts), np.maximum.reduceat(cls, starts)
            several = (low != high) | (salt[starts] > 0)
            extra = []
            if held is not None and anchor[0] == held[0]:
                if flagged:
                    several[0] = True
                elif several[0] or low[0] != held[1]:
                    several[0] = True
                    extra = [held]
            held, flagged = (anchor[-1], cls[-1]), bool(several[-1])
            keep = np.repeat(several, np.diff(np.append(starts, anchor.size)))
            a, c = (np.concatenate([x[keep], np.array([e[i] for e in extra], np.int64)]) for i, x in enumerate((anchor, cls)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["anchor", "cls"])

    return rows.repartition(4 * parts(rows.sparkSession), "anchor", "salt").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, cls long")


def _common(numbers: DataFrame) -> np.ndarray:
    """Sorted anchors of many of the sampled texts: numbers(cls, anchor), a text once."""
    rows = numbers.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_TEXTS).orderBy(F.desc("n"), "anchor").limit(HOT_MOST).select("anchor").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not sorted_.size:
        return np.zeros(x.size, bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), sorted_.size - 1)] == x


class Family:
    """Levels: strings in byte order with the smallest document of each; sizes at least double from level to level."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def first_docs(self, strings: np.ndarray) -> np.ndarray:
        """The smallest document that a level has each of the sorted strings from (FAR: none)."""
        least = np.full(strings.size, FAR)
        for known, first in self.levels:
            at = np.minimum(np.searchsorted(known, strings), known.size - 1)
            same = known[at] == strings
            least[same] = np.minimum(least[same], first[at[same]])
        return least

    def add(self, strings: np.ndarray, docs: np.ndarray) -> None:
        """A batch's suffix array (sorted, distinct) becomes a level; like-sized levels merge, and the smaller document stays."""
        while self.levels and self.levels[-1][0].size <= 2 * strings.size:
            known, first = self.levels.pop()
            strings, docs = distinct(np.concatenate([known, strings]), np.concatenate([first, docs]), "stable")[2:]
        self.levels.append((strings, docs))


def strings_at(raw: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """The strings of length bytes at these places. All have one length, so numpy's comparison, blind to trailing zeros, is one of bytes."""
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)[at].view(f"S{length}").ravel()


def distinct(strings: np.ndarray, docs: np.ndarray, sort: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, number of the distinct string of each in that order, distinct strings, smallest document of each). sort: stable merges two sorted runs in one pass."""
    order = np.argsort(strings, kind=sort)
    strings, docs = strings[order], docs[order]
    new = np.ones(strings.size, bool)
    new[1:] = strings[1:] != strings[:-1]
    starts = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, strings[starts], np.minimum.reduceat(docs, starts)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]]) if starts.size else np.zeros(0, bool)
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, starts.size - 1)] if starts.size else reach


def _covered(length: int):
    """stretches in order of their first document -> spans of each that smaller documents cover (start, end, start, end, ...)."""

    def spans(family: Family, texts: list[bytes], first_docs: np.ndarray) -> pa.Array:
        lengths = np.array([len(s) for s in texts], np.int64)
        sizes = lengths - length + 1
        row = np.repeat(np.arange(sizes.size), sizes)
        offset = np.arange(row.size) - (np.cumsum(sizes) - sizes)[row]
        docs = first_docs[row]
        # The suffix array of all stretches at once; strings that run over a stretch's end are not in it.
        order, which, strings, least = distinct(strings_at(b"".join(texts), (np.cumsum(lengths) - lengths)[row] + offset, length), docs, "quicksort")
        covered = np.zeros(row.size, bool)
        covered[order] = docs[order] > np.minimum(least, family.first_docs(strings))[which]
        family.add(strings, least)
        at_row, at_offset = row[covered], offset[covered]
        new = np.ones(at_row.size, bool)
        new[1:] = (at_row[1:] != at_row[:-1]) | (at_offset[1:] > at_offset[:-1] + length)
        last = np.roll(new, -1)
        last[-1:] = True
        flat = np.stack([at_offset[new], at_offset[last] + length], axis=1).ravel()
        ends = 2 * np.cumsum(np.bincount(at_row[new], minlength=sizes.size))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for whole in batches:
            if not whole.num_rows:
                continue
            texts = whole.column(3).to_pylist()
            upto = np.cumsum([len(s) - length + 1 for s in texts]) // BATCH_STRINGS
            edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
            for lo, hi in zip(edges, edges[1:]):
                batch = whole.slice(lo, hi - lo)
                found = spans(family, texts[lo:hi], batch.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], found], names=["anchor", "content", "first_doc", "spans"])

    return run


def cuts(raw: bytes, a: np.ndarray, shared: np.ndarray, common: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a: the text's anchors; shared: sorted -> (first string, end of the last string, key) of each stretch: a run of strings with one shared anchor, and under a common one with one second anchor."""
    none = np.zeros(0, np.int64)
    if not a.size:
        return none, none, none
    start = _run_starts(a)
    wanted = _among(shared, a[start])
    hot = _among(common, a[start]) & wanted
    if hot.any():
        second = anchors(raw, length, SECOND_KGRAM)
        in_hot = np.repeat(hot, np.diff(np.append(start, a.size)))
        wanted = np.repeat(wanted, np.diff(np.append(start, a.size)))
        a = np.where(in_hot, _mix(a + second * _weight(9)), a)
        start = _run_starts(a)
        wanted = wanted[start]
    end = np.append(start[1:], a.size)
    start, end = start[wanted], end[wanted]
    if not start.size or (end - start).max() <= MOST_STRINGS:
        return start, end + (length - 1), a[start].view(np.int64)
    pieces = -(-(end - start) // MOST_STRINGS)
    step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    key, end = np.repeat(a[start], pieces), np.repeat(end, pieces)
    start = np.repeat(start, pieces) + step * MOST_STRINGS
    return start, np.minimum(end, start + MOST_STRINGS) + length - 1, key.view(np.int64)


def _stretches(docs: DataFrame, length: int, kgram: int, common: np.ndarray) -> DataFrame:
    """docs(doc_id, cls, text, shared: anchors) -> doc_id, cls, anchor (key), content (digest), start, n, bytes of each stretch.

    Bytes go along once for each content of a batch, with its smallest document:
    a passage that every third document has is few rows with bytes.
    """
    fields = (("anchor", "long"), ("content", "binary"), ("start", "long"), ("n", "long"), ("bytes", "binary"))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["cls"], *[T.StructField(n, T._parse_datatype_string(k)) for n, k in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            index, anchor, content, start, size, out = [none], [none], [], [none], [none], []
            for i, (raw, a) in enumerate(each_anchors(_raws(batch.column(2)), length, kgram)):
                at, ends, key = cuts(raw, a, np.sort(batch.column(3)[i].values.to_numpy().view(np.uint64)), common, length)
                pieces = [raw[s:e] for s, e in zip(at.tolist(), ends.tolist())]
                index.append(np.full(at.size, i))
                start.append(at)
                size.append(ends - at)
                anchor.append(key)
                content += [hashlib.blake2b(p, digest_size=16).digest() for p in pieces]
                out += pieces
            index, anchor, start, size = (np.concatenate(x) for x in (index, anchor, start, size))
            docs_of = batch.column(0).to_numpy(zero_copy_only=False)[index]
            same = np.frombuffer(b"".join(content), np.int64).reshape(-1, 2)
            by = np.lexsort((docs_of, same[:, 1], same[:, 0], anchor))
            first = np.ones(by.size, bool)
            first[1:] = (anchor[by[1:]] != anchor[by[:-1]]) | (same[by[1:]] != same[by[:-1]]).any(axis=1)
            carry = np.zeros(by.size, bool)
            carry[by[first]] = True
            of = pa.array(index)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(of), batch.column(1).take(of), pa.array(anchor), pa.array(content, pa.binary()), pa.array(start), pa.array(size),
                    pa.array([b if k else None for b, k in zip(out, carry.tolist())], pa.binary()),
                ],
                names=["doc_id", "cls", "anchor", "content", "start", "n", "bytes"],
            )

    return docs.select("doc_id", "cls", "text", "shared").mapInArrow(run, schema)


def _cut(docs: DataFrame) -> DataFrame:
    """docs(doc_id, cls, text, starts, ends) -> what is left."""

    def make(texts: list, starts: list, ends: list) -> list[list]:
        rows = []
        for text, s, e in zip(texts, starts, ends):
            raw = _raw(text)
            a, b = merged(np.array(s, np.int64), np.array(e, np.int64))
            kept, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist()):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            rows.append((int((b - a).sum()), a.size, kept.hexdigest(), np.stack([a, b], axis=1).ravel().astype(np.uint64)))
        removed, n, digest, spans = list(zip(*rows)) or [[], [], [], []]
        return [removed, n, digest, _lists(list(spans))]

    return map_columns(docs, ["doc_id", "cls"], ["text", "starts", "ends"], lambda: make, {"n_removed": "long", "n_spans": "long", "kept_sha256": "string", "spans": "array<long>"})


def repeated_passages(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end, ... in bytes of UTF-8; null if the whole text or nothing goes) of every row."""
    plain = docs.select("doc_id", "text")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    info = materialize(plain.select("doc_id", F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"), F.xxhash64(raw).alias("cls")), "texts")
    firsts = materialize(info.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.first("cls").alias("cls")), "firsts")

    able = plain.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).withColumn("cls", F.xxhash64(raw))
    every = max(1, firsts.count() // HOT_SAMPLE)
    sample = able.where(F.pmod("cls", F.lit(every)) == 0).dropDuplicates(["cls"])
    common = _common(_numbers(sample, length, kgram, np.zeros(0, np.uint64)))
    dealt = _numbers(able, length, kgram, common)
    shared = _shared(dealt).groupBy("cls").agg(F.collect_set("anchor").alias("shared"))
    shared = materialize(shared.join(firsts.select("cls", F.col("first_id").alias("doc_id")), "cls"), "shared")
    touched = materialize(shared.select("doc_id").distinct(), "touched")
    texts = able.join(small_or_shuffled(touched), "doc_id", "left_semi").join(shared.select("doc_id", "cls", "shared"), ["doc_id", "cls"])
    rows = materialize(_stretches(texts, length, kgram, common), "stretches")
    # One shuffle by anchor serves the contents' first documents and the index.
    content = rows.where("bytes is not null").select("anchor", "content", "doc_id", "bytes").repartition(4 * parts(docs.sparkSession), "anchor")
    content = content.groupBy("anchor", "content").agg(F.min("doc_id").alias("first_doc"), F.min_by("bytes", "doc_id").alias("bytes")).sortWithinPartitions("first_doc")
    doc_kind = dict(rows.dtypes)["doc_id"]
    cover = materialize(content.mapInArrow(_covered(length), f"anchor long, content binary, first_doc {doc_kind}, spans array<long>"), "cover")
    at = rows.select("doc_id", "cls", "anchor", "content", "start", "n").join(cover, ["anchor", "content"])
    whole = F.array(F.lit(0).cast("long"), F.col("n").cast("long"))
    spans = at.select("doc_id", "cls", "start", F.when(F.col("doc_id") > F.col("first_doc"), whole).otherwise(F.col("spans")).alias("spans")).where(F.size("spans") > 0)
    even = lambda odd: F.filter(F.transform("spans", lambda x, i: F.when(i % 2 == odd, x + F.col("start"))), lambda x: x.isNotNull())
    spans = spans.select("doc_id", "cls", even(0).alias("s"), even(1).alias("e")).groupBy("doc_id", "cls").agg(F.flatten(F.collect_list("s")).alias("starts"), F.flatten(F.collect_list("e")).alias("ends"))
    spans = materialize(spans, "spans")
    release(rows)
    release(cover)
    cut = _cut(able.join(small_or_shuffled(spans.select("doc_id")), "doc_id", "left_semi").join(spans, ["doc_id", "cls"]))
    cut = materialize(cut.select(F.col("doc_id").alias("cut_id"), F.col("cls").alias("cut_cls"), "n_removed", "n_spans", "kept_sha256", "spans").dropDuplicates(["cut_id", "cut_cls"]), "cut")
    done = info.join(firsts.select("sha", "first_id"), "sha", "left")
    copy = (F.col("n_bytes") >= length) & (F.col("doc_id") > F.col("first_id"))
    done = done.join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("cls") == F.col("cut_cls")) & F.col("first_id").isNotNull(), "left")
    empty = hashlib.sha256(b"").hexdigest()
    out = materialize(
        done.select(
            "doc_id", "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            F.when(~F.coalesce(copy, F.lit(False)), F.col("spans")).alias("spans"),
        ),
        "passages",
    )
    for old in (info, firsts, shared, touched, spans, cut):
        release(old)
    return out

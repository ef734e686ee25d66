"""N-gram Jaccard self-join of word shingles by vertical partitioning.

The n-grams get one global order, rare ones first. The order is cut into
fragments, the overlaps of two documents are counted in each fragment by a task of
its own, and a pair's overlap is the sum over the fragments. Around that:

1. Equal sets (exact copies among them) are one class; its smallest id stands for it.
2. Two sets of 80 % similarity share at least l n-grams within the first
   n - ceil(0.8 n) + l of each in any global order. Taken in hash order, only this
   part of each class goes through a shuffle, and a class stays only if enough of
   its part is seen in another class. Most documents end here.
3. What stays is counted exactly; n-grams of one class only cannot overlap, and a
   class needs 80 % of its n-grams elsewhere. In the order by document frequency,
   two linked classes share one of their first n - ceil(0.8 n) + 1 n-grams (the
   deciding ones), so classes that share none of these are never compared. Classes
   are put into blocks of bounded size by the least class within some steps of shared
   deciding n-grams, and only pairs of blocks that have a deciding n-gram in common are
   candidates.
4. A fragment's task gets the fragment's part of two blocks and counts the partial
   overlaps of their classes. Pairs that lack more within the fragment than 80 %
   similarity lets them lack in all are left out: they cannot be linked any more.
   What it returns is one row for each pair of blocks, with the counts in an array.
5. A second shuffle sums the fragments' counts of each pair. It returns for each
   class its number of links and the root of a spanning tree of the links, not the
   pairs, so a group of thousands of near copies is as many rows.
6. The trees' edges are joined to components.

The comparison is exact: 5 * overlap >= 4 * union in integers. N-grams are 64-bit
fingerprints; two different ones of a pair of documents meet with a probability
of about |A| * |B| / 2^64, whatever the size of the corpus.

Defined results: null texts and texts without words have an empty set and are
their own component; a null id has a null component; fewer words than the n-gram's
are one n-gram; repeated rows are copies of each other; rows with one id and
different texts are judged text by text; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fresh, map_columns, materialize, parts, release, small_or_shuffled
from .components import components

N = 5
#: Similarity as a fraction, so that no rounding decides.
SIMILAR = (4, 5)
BLOCK_CLASSES = 512
BLOCK_NGRAMS = 1_000_000
#: Parts of the global order; each is counted by tasks of its own.
FRAGMENTS = 4
#: Steps from class to class by which blocks gather around a centre.
CENTRE_STEPS = 2
#: N-grams that a matrix of 0 and 1 holds at one time.
COLUMNS = 4096
CACHED_WORDS = 150_000
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _weight(k: int) -> np.uint64:
    return np.uint64((_ODD[k % 8] * (2 * (k // 8) + 1)) & 0xFFFFFFFFFFFFFFFF)


class Shingler:
    """Sorted distinct fingerprints of a text's word n-grams."""

    def __init__(self, n: int):
        self.n, self.known = n, _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, w.size)
        h = np.full(w.size - n + 1, np.uint64(n), np.uint64)
        for k in range(n):
            h += w[k : w.size - n + 1 + k] * _weight(k)
        return np.unique(_mix(h))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _slack(n: int, similar: tuple[int, int]) -> int:
    """How many n-grams a linked set of n may lack: n - ceil(similarity * n)."""
    return n - -(-n * similar[0] // similar[1])


def shingle_sets(docs: DataFrame, n: int = N, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), head: the first n-grams in hash order, a tenth more than a linked set may lack."""

    def start():
        shingle = Shingler(n)

        def make(texts: list) -> list:
            sets = [shingle(t) for t in texts]
            heads = [s[: _slack(s.size, similar) + max(1, s.size // 10)] for s in sets]
            return [[s.size for s in sets], [hashlib.md5(s.tobytes()).digest() for s in sets], _lists(heads)]

        return make

    return map_columns(docs, ["doc_id"], ["text"], start, {"n_shingles": "long", "digest": "binary", "head": "array<long>"})


def _may_link(classes: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(cls, rep, digest) of classes whose head is seen elsewhere often enough to be linked."""
    heads = sets.where("n_shingles > 0").select("doc_id", "n_shingles", F.col("digest").alias("d"), "head")
    reps = small_or_shuffled(classes.select("cls", "rep", "digest"))
    heads = heads.join(reps, (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("d")))
    seen = heads.select("cls", "n_shingles", F.explode("head").alias("gram"))
    twice = seen.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1").select("gram")
    least = F.greatest(F.lit(1), F.floor(F.floor(F.col("n_shingles") * similar[0] / similar[1]) / 10))
    able = seen.join(twice, "gram").groupBy("cls", "n_shingles").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("cls")
    return classes.join(small_or_shuffled(materialize(able, "able-classes")), "cls", "left_semi").select("cls", "rep", "digest")


def _digest_of(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes()).digest()


def _ordered(docs: DataFrame, able: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """(cls, n, grams): the n-grams of a class that another class has too, in the global order (df, fingerprint); classes with too few are left out."""

    def start():
        shingle = Shingler(n)

        def make(texts: list) -> list:
            sets = [shingle(t) for t in texts]
            return [[s.size for s in sets], list(map(_digest_of, sets)), _lists(sets)]

        return make

    texts = docs.select("doc_id", "text").join(small_or_shuffled(able.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = map_columns(texts, ["doc_id"], ["text"], start, {"n": "long", "d": "binary", "grams": "array<long>"})
    sets = sets.join(small_or_shuffled(able), (F.col("doc_id") == F.col("rep")) & (F.col("d") == F.col("digest"))).groupBy("cls").agg(F.max("n").alias("n"), F.first("grams").alias("grams"))
    rows = materialize(sets.select("cls", "n", F.explode("grams").alias("gram")), "grams")
    df = rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(df, "gram").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    out = materialize(shared.where(F.size("grams") * similar[1] >= F.col("n") * similar[0]), "ordered")
    release(rows)
    return out


def _candidates(ordered: DataFrame, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(cls, block) of the classes that share a deciding n-gram, and (i, j), i <= j, of the blocks that do."""
    slack = F.col("n") - F.ceil(F.col("n") * similar[0] / F.lit(similar[1]))
    # n-grams that no other class has come first in the order and use up part of the slack.
    deciding = (slack + 1 - (F.col("n") - F.size("grams"))).cast("int")
    heads = ordered.select("cls", F.explode(F.slice("grams", 1, F.greatest(deciding, F.lit(0)))).alias("g")).select("cls", F.col("g.gram").alias("gram"))
    heads = materialize(heads, "heads")
    first = heads.groupBy("gram").agg(F.min("cls").alias("least"), F.count("*").alias("df")).where("df > 1").select("gram", "least")
    near = materialize(heads.join(first, "gram"), "near")
    # The least class within some steps: a group of near copies comes to one centre and few blocks, a chain of groups does not become one.
    centre = near.groupBy("cls").agg(F.min("least").alias("centre"))
    for _ in range(CENTRE_STEPS):
        of_gram = near.select("cls", "gram").join(centre, "cls").groupBy("gram").agg(F.min("centre").alias("centre"))
        centre = materialize(near.select("cls", "gram").join(of_gram, "gram").groupBy("cls").agg(F.min("centre").alias("centre")), "centre")
    sized = ordered.select("cls", F.size("grams").alias("grams")).join(centre, "cls")
    many = sized.groupBy("centre").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("grams") / BLOCK_NGRAMS)).alias("parts"))
    # Two blocks with one number would be one larger block: no harm.
    block = F.xxhash64("centre", F.pmod(F.xxhash64("cls"), F.col("parts")))
    blocks = materialize(sized.join(small_or_shuffled(materialize(many, "centres")), "centre").select("cls", block.alias("block")), "blocks")
    at = materialize(near.join(blocks, "cls").select("gram", "block").distinct(), "block-grams")
    other = at.select("gram", F.col("block").alias("j"))
    across = at.withColumnRenamed("block", "i").join(other, "gram").where("i < j").select("i", "j").distinct()
    within = blocks.groupBy(F.col("block").alias("i")).agg(F.count("*").alias("n")).where("n > 1").select("i", F.col("i").alias("j"))
    pairs = materialize(across.union(within), "block-pairs")
    for done in (heads, near, at):
        release(done)
    return blocks, pairs


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of each index's component, for links a-b among 0 ... n-1."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal rows."""
    new = np.ones(keys[0].size, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), np.append(starts[1:], keys[0].size).tolist()))


def _counted(segments: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlaps of the left with the right segments, as products of 0-1 matrices of the n-grams that meet here."""
    grams, owner = np.concatenate(segments), np.repeat(np.arange(len(segments)), [x.size for x in segments])
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    met = times > 1
    number, inside = np.cumsum(met) - 1, met[column]
    owner, column = owner[inside], number[column[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros((left.size, right.size), np.float32)
    for at in range(0, int(met.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        a = np.zeros((len(segments), min(COLUMNS, int(met.sum()) - at)), np.float32)
        a[owner[lo:hi], column[lo:hi] - at] = 1
        overlap += a[left] @ a[right].T
    return overlap.astype(np.int32)


def _sides(block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(block == i)
    return left, left if i == j else np.flatnonzero(block == j)


def _partial(similar: tuple[int, int]):
    """One fragment's counts for pairs of blocks: a row each, of the places and overlaps of class pairs that may still be linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j", "cls"], kind="stable", ignore_index=True)
        i, j, block, fragment = (pdf[c].to_numpy() for c in ("i", "j", "block", "fragment"))
        n, have, cls, copies, segments = (pdf[c].to_numpy() for c in ("n", "have", "cls", "copies", "segment"))
        rows = []
        for lo, hi in _runs(i, j):
            left, right = _sides(block[lo:hi], i[lo], j[lo])
            own = list(segments[lo:hi])
            overlap = _counted(own, left, right)
            sizes, size, most = np.array([x.size for x in own]), n[lo:hi], have[lo:hi]
            need = -(-similar[0] * (size[left][:, None] + size[right][None, :]) // sum(similar))
            able = (overlap > 0) & (sizes[left][:, None] - overlap <= most[left][:, None] - need) & (sizes[right][None, :] - overlap <= most[right][None, :] - need)
            if i[lo] == j[lo]:
                able &= np.tri(left.size, k=-1, dtype=bool)
            place = np.flatnonzero(able)
            about = (cls[lo:hi], size, copies[lo:hi], block[lo:hi]) if not fragment[lo] else (None,) * 4
            if place.size or about[0] is not None:
                rows.append((i[lo], j[lo], place, overlap.ravel()[place], *about))
        return pd.DataFrame(rows, columns=["i", "j", "place", "overlap", "cls", "n", "copies", "block"])

    return run


PARTIAL = "i long, j long, place array<int>, overlap array<int>, cls array<long>, n array<long>, copies array<long>, block array<long>"


def _summed(similar: tuple[int, int]):
    """Overlaps of each pair of classes over all fragments -> cls, root, links of every class in every pair of blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"], kind="stable", ignore_index=True)
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        out = []
        for lo, hi in _runs(i, j):
            part = pdf.iloc[lo:hi]
            about = part[part["cls"].notna()].iloc[0]
            cls, n, copies = (np.asarray(about[c]) for c in ("cls", "n", "copies"))
            left, right = _sides(np.asarray(about["block"]), i[lo], j[lo])
            overlap = np.zeros(left.size * right.size, np.int64)
            for place, count in zip(part["place"], part["overlap"]):
                overlap[place] += count
            met = np.flatnonzero(overlap)
            a, b = left[met // right.size], right[met % right.size]
            linked = similar[1] * overlap[met] >= similar[0] * (n[a] + n[b] - overlap[met])
            a, b = a[linked], b[linked]
            links = np.bincount(a, copies[b], cls.size) + np.bincount(b, copies[a], cls.size)
            out.append(pd.DataFrame({"cls": cls, "root": cls[roots_of(a, b, cls.size)], "links": links.astype(np.int64)}))
        return pd.concat(out)

    return run


def _linked(ordered: DataFrame, classes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(cls, root, links) of every class in every pair of blocks that it is in."""
    blocks, pairs = _candidates(ordered, similar)
    spark = ordered.sparkSession
    # Cuts of the global order, so that each fragment has about as many n-grams; equal n-grams have equal places in it.
    place = lambda g: g["df"] + g["gram"] / float(1 << 64)
    cuts = ordered.select(F.explode("grams").alias("g")).agg(F.percentile_approx(place(F.col("g")), [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000)).first()[0] or []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    part = lambda a, b: F.transform(F.filter("grams", lambda g: (place(g) > a) & (place(g) <= b)), lambda g: g["gram"])
    segments = F.array(*[F.struct(F.lit(k).alias("fragment"), part(a, b).alias("segment")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    member = ordered.join(blocks, "cls").join(classes.select("cls", "copies"), "cls").select("cls", "n", "copies", "block", F.size("grams").cast("long").alias("have"), segments.alias("segments"))
    sides = pairs.select(F.col("i").alias("block"), "i", "j").union(pairs.where("i <> j").select(F.col("j").alias("block"), "i", "j"))
    pack = F.pmod(F.xxhash64("i", "j"), F.lit(8 * parts(spark))).cast("int").alias("pack")
    dealt = member.join(sides, "block").select(pack, "i", "j", "block", "cls", "n", "copies", "have", F.explode("segments").alias("s")).select("pack", "i", "j", "block", "cls", "n", "copies", "have", "s.fragment", "s.segment")
    partial = dealt.groupBy("pack", "fragment").applyInPandas(_partial(similar), PARTIAL)
    out = materialize(partial.withColumn("pack", pack).groupBy("pack").applyInPandas(_summed(similar), "cls long, root long, links long"), "linked")
    release(blocks)
    release(pairs)
    return out


def _classified(docs: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """doc_id, n_shingles, digest, component_id, n_links, keeper (the row is of the class that stands for its component) of every row."""
    plain = docs.select("doc_id", "text")
    sets = materialize(shingle_sets(plain, n, similar), "shingles")
    named = sets.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    able = materialize(_may_link(classes, sets, similar), "able")
    ordered = _ordered(plain.where("doc_id is not null"), able, n, similar)
    linked = _linked(ordered, classes, similar)
    found = components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("cls").agg(F.sum("links").alias("near"))
    of_class = classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    of_class = materialize(of_class, "class-components")
    least = of_class.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("first"))
    of_class = of_class.join(least, "component").select("digest", F.col("first.rep").alias("component_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("first.digest") == F.col("digest")).alias("keeper"))
    of_class = materialize(of_class, "components")
    out = materialize(
        sets.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(small_or_shuffled(of_class), "digest", "left")
        .select(
            "doc_id", "n_shingles", "digest", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            (F.coalesce("keeper", F.lit(True)) & F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("keeper"),
        ),
        "jaccard",
    )
    for done in (sets, classes, able, ordered, linked, of_class):
        release(done)
    return out


def jaccard_components(docs: DataFrame, n: int = N, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_links (other documents linked directly, copies included) of every row."""
    return _classified(docs, n, similar).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, n: int = N, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row of docs for each component; rows with a null id stay, and of repeated rows without words one stays for each id.

    Rows are told by id. Where an id has several rows, the right one is told by its
    set of n-grams, and of rows alike in both the first by hash of all columns stays.
    """
    rows = _classified(docs, n, similar).where("doc_id is not null")
    ids = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("keeper").alias("keepers")).where("keepers > 0"), "kept-ids")
    once = docs.join(small_or_shuffled(ids.where("rows = 1").select("doc_id")), "doc_id", "left_semi").select(*docs.columns)
    out = once.union(docs.where("doc_id is null"))
    several = ids.where("rows > 1").select("doc_id")
    if several.isEmpty():
        return out

    def start():
        shingle = Shingler(n)
        return lambda texts: [[_digest_of(s) if s.size else None for s in map(shingle, texts)]]

    mark = fresh(docs, "set_digest")
    keys = materialize(rows.where("keeper").join(small_or_shuffled(several), "doc_id", "left_semi").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct(), "kept-keys")
    marked = map_columns(docs.join(small_or_shuffled(several), "doc_id", "left_semi").select(*docs.columns), docs.columns, ["text"], start, {mark: "binary"})
    marked = marked.select(F.col("doc_id").alias("own_id"), F.col(mark).alias("own_digest"), F.struct(*docs.columns).alias("row"))
    right = marked.join(small_or_shuffled(keys), (F.col("own_id") == F.col("kept_id")) & F.col("own_digest").eqNullSafe(F.col("kept_digest")))
    first = right.groupBy("own_id", "own_digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.union(first.select("row.*"))

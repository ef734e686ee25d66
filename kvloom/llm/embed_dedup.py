"""Near-duplicate vectors by random-hyperplane signatures, exact cosines and connected components.

Equal vectors of a label are one class. Each class gets, in each of TABLES
tables, the signs of its products with BITS random hyperplanes; vectors that
share a table's signature are compared by cosine in double precision. At the
threshold 0.98 two signs agree with probability 1 - acos(0.98) / pi = 0.936, so a
table misses a pair at the threshold with 1 - 0.936 ** 14 = 0.60 and all 16 tables
with 0.0003; closer pairs are missed less.

A pair is counted in the first table in which it meets, which both vectors'
signatures tell, so nothing has to be made distinct. A task returns a vector's
number of links and the root of a spanning tree of its links, never the pairs.
Small buckets share a task; a bucket of more than BLOCK vectors is split into
blocks, and every pair of blocks is a task, so no task's size follows a bucket's.

Defined results: null labels, null, empty or zero vectors and vectors with null,
NaN or infinite components link with nothing and are their own component; vectors
of different lengths are not compared; repeated ids are one vertex; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialize, release
from .components import components
from .ngram_join import roots_of

COSINE = 0.98
BITS, TABLES, SEED = 14, 16, 11
BLOCK = 1024
PACK = 8192


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def scaled(rows: list) -> np.ndarray:
    """Vectors in double precision, each divided by a power of two near its largest component: exact, and no square leaves the double range."""
    x = np.stack(rows).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _signatures(bits: int, tables: int, seed: int):
    @F.pandas_udf("array<int>")
    def signs(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        lengths = vectors.map(len)
        for dim in lengths.unique():
            own = vectors[lengths == dim]
            above = scaled(own.to_list()) @ planes(dim, bits, tables, seed) >= 0
            codes = above.reshape(len(own), tables, bits) @ (1 << np.arange(bits))
            out[own.index] = list(codes.astype(np.int32))
        return out

    return signs


def _compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of whole small buckets, or of two blocks (i, j) of a large one."""
        pdf = pdf.sort_values(["label", "table", "code", "dim", "vec_id"], kind="stable", ignore_index=True)
        ids, copies, table = (pdf[c].to_numpy() for c in ("vec_id", "copies", "table"))
        keys = pdf[["label", "table", "code", "dim"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        links, roots = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for lo, hi in zip(starts, np.append(starts[1:], len(pdf))):
            if hi - lo < 2:
                continue
            x = scaled(pdf["embedding"].iloc[lo:hi].to_list())
            codes = np.stack(pdf["codes"].iloc[lo:hi].to_list())
            side, i, j = pdf["block"].to_numpy()[lo:hi], pdf["i"].iloc[lo], pdf["j"].iloc[lo]
            a = np.flatnonzero(side == i)
            b = a if i == j else np.flatnonzero(side == j)
            norm = np.sqrt((x * x).sum(axis=1))
            linked = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= cosine
            p, q = np.nonzero(linked)
            keep = a[p] < b[q] if i == j else np.ones(p.size, bool)
            p, q = a[p[keep]], b[q[keep]]
            t = int(table[lo])
            fresh = ~(codes[p, :t] == codes[q, :t]).any(axis=1)
            p, q = p[fresh], q[fresh]
            links[lo:hi] += np.bincount(p, copies[lo:hi][q], hi - lo).astype(np.int64) + np.bincount(q, copies[lo:hi][p], hi - lo).astype(np.int64)
            roots[lo:hi] = lo + roots_of(p, q, hi - lo)
        met = (links > 0) | (roots != np.arange(len(pdf)))
        return pd.DataFrame({"vec_id": ids[met], "root": ids[roots[met]], "links": links[met]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept of every row."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    able = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = plain.withColumn("digest", F.when(able, F.sha2(F.concat_ws(",", F.col("label"), F.to_json("embedding")), 256)))
    named = materialize(rows.where("digest is not null"), "vectors")
    classes = materialize(
        named.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("embedding", "vec_id").alias("embedding"), F.first("label").alias("label")), "vector-classes"
    )
    signed = classes.select(F.col("rep").alias("vec_id"), "copies", "label", "embedding", F.size("embedding").alias("dim"), _signatures(bits, tables, seed)("embedding").alias("codes"))
    signed = materialize(signed, "signed")
    bucket = ["label", "dim", "table", "code"]
    spots = signed.select("vec_id", "label", "dim", F.posexplode("codes").alias("table", "code"))
    full = materialize(spots.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    # Only vectors that meet another are sent, and those once a table that they meet one in.
    met = spots.join(full, bucket).join(signed.select("vec_id", "copies", "embedding", "codes"), "vec_id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    packs = max(1, -(-(full.agg(F.sum("n")).first()[0] or 0) // PACK))
    dealt = met.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    task = F.when(blocks == 1, F.concat(F.lit("p"), F.pmod(F.xxhash64(*bucket), F.lit(packs)).cast("string"))).otherwise(F.concat_ws("/", *bucket, "i", "j"))
    linked = materialize(dealt.withColumn("task", task).groupBy("task").applyInPandas(_compare(cosine), "vec_id long, root long, links long"), "vector-links")
    found = components(linked.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("vec_id").agg(F.sum("links").alias("near"))
    of_class = materialize(
        classes.select("digest", "rep", "copies")
        .join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .join(links.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .select("digest", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "vector-components",
    )
    out = rows.select("vec_id", "digest").join(of_class, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "near-vectors")
    for done in (named, classes, signed, full, linked, of_class):
        release(done)
    return out

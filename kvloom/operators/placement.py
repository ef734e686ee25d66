"""Placing keys on nodes by modulo, hash ring, rendezvous or jump hash, and what moves when nodes change."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.placement import _bytes, jump_col, murmur3, murmur3_col

#: A layout has at most so many ring points; they go to every task as two arrays.
MOST_POINTS = 5_000_000


def ring_points(nodes: list[str], vnodes: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners) of the ring, in order of (hash, node)."""
    if len(nodes) * vnodes > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} ring points")
    owner = np.repeat(np.arange(len(nodes)), vnodes)
    points = murmur3([f"{n}#{r}".encode() for n in nodes for r in range(vnodes)])
    order = np.lexsort((owner, points))
    return points[order], owner[order]


def place(keys: DataFrame, nodes: list[str], algorithm: str = "ring", vnodes: int = 160) -> DataFrame:
    """keys with node. A map over the keys: no shuffle, whatever the algorithm."""
    names = np.array(nodes)
    if algorithm == "modulo":
        index = murmur3_col("key") % len(nodes)
    elif algorithm == "jump":
        index = jump_col(len(nodes))("key")
    elif algorithm == "ring":
        points, owners = ring_points(nodes, vnodes)

        @F.pandas_udf("int")
        def owner_of(keys: pd.Series) -> pd.Series:
            at = np.searchsorted(points, murmur3(_bytes(keys)), "left") % points.size
            return pd.Series(owners[at].astype(np.int32), index=keys.index)

        index = owner_of("key")
    elif algorithm == "rendezvous":
        by_name = np.argsort(names, kind="stable")
        seeds = murmur3([n.encode() for n in nodes])

        @F.pandas_udf("int")
        def best_of(keys: pd.Series) -> pd.Series:
            rows = _bytes(keys)
            scores = np.stack([murmur3(rows, int(seeds[i])) for i in by_name])
            return pd.Series(by_name[scores.argmax(axis=0)].astype(np.int32), index=keys.index)

        index = best_of("key")
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    lookup = F.array(*[F.lit(n) for n in nodes])
    return keys.withColumn("node", F.element_at(lookup, index.cast("int") + 1))


def load_stats(placed: DataFrame, nodes: list[str]) -> DataFrame:
    """keys, mean, least, most, most_to_mean, deviation (of the population) over all nodes, empty ones too."""
    spark = placed.sparkSession
    every = spark.createDataFrame([(n,) for n in nodes], "node string")
    counts = every.join(placed.groupBy("node").agg(F.count("*").alias("n")), "node", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(F.sum("n").alias("keys"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") / F.avg("n")).alias("most_to_mean"), F.stddev_pop("n").alias("deviation"))


def movement(keys: DataFrame, before: list[str], after: list[str], algorithm: str = "ring") -> DataFrame:
    """keys, moved, needless: moved keys whose old node is still there and whose new node was there before."""
    both = place(place(keys.select("key"), before, algorithm).withColumnRenamed("node", "old"), after, algorithm)
    moved = F.col("old") != F.col("node")
    return both.agg(F.count("*").alias("keys"), F.count_if(moved).alias("moved"), F.count_if(moved & F.col("old").isin(after) & F.col("node").isin(before)).alias("needless"))

"""Sharding whole groups of equal texts with near-equal bytes, by Karmarkar-Karp differencing.

A group (all rows of one text) is indivisible. Differencing starts from one
partial partition for each group, (bytes, 0, ..., 0), and repeatedly combines
the two with the largest spread, oppositely ordered: the fullest part of one
joins the emptiest of the other. One heap over all groups would be one task, so
the groups are dealt by hash into cells of a bounded number of groups; each cell
is differenced in a task of its own and leaves one partial partition, and the
cells' partitions are differenced in the same way, level by level, until one is
left. A row's shard is found by following its cell's places upwards.

Defined results: a null text is one group, apart from the empty text, with 0
bytes; every row counts 1 more than its bytes; ties are broken by the group's
digest; rows with equal ids or null ids are rows of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, parts

SHARDS = 16
CELL_GROUPS = 20_000
FAN_IN = 2_000


def difference(vectors: list[tuple[int, ...]], n: int) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions of n sums until one is left.

    -> (places, sums): places[i][k] is the part of the result that holds part k
    of vectors[i].
    """
    ticket = itertools.count()
    heap, steps = [], []
    for i, v in enumerate(vectors):
        order = sorted(range(n), key=lambda k: -v[k])
        sums = [v[k] for k in order]
        steps.append(order)
        heap.append((sums[-1] - sums[0], next(ticket), sums, i))
    heapq.heapify(heap)
    children: dict[int, tuple] = {}
    made = len(vectors)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        joined = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(n), key=lambda k: -joined[k])
        sums = [joined[k] for k in order]
        children[made] = (ia, ib, order)
        heapq.heappush(heap, (sums[-1] - sums[0], next(ticket), sums, made))
        made += 1
    places: list[list[int]] = [[]] * made
    root = heap[0][3]
    places[root] = list(range(n))
    # Ranked place of a node -> part of the result, from the root down.
    for node in range(made - 1, len(vectors) - 1, -1):
        ia, ib, order = children[node]
        at = [0] * n
        for rank, k in enumerate(order):
            at[k] = places[node][rank]
        places[ia], places[ib] = at, at[::-1]
    out = []
    for i in range(len(vectors)):
        own = [0] * n
        for rank, k in enumerate(steps[i]):
            own[k] = places[i][rank]
        out.append(own)
    return out, list(heap[0][2])


def _cell(n: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_key", kind="stable")
        zero = (0,) * (n - 1)
        places, sums = difference([(int(b), *zero) for b in pdf["group_bytes"]], n)
        return pd.DataFrame({"group_key": pdf["group_key"], "cell": pdf["cell"], "place": [p[0] for p in places], "sums": [sums] * len(places)})

    return run


def _level(n: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", kind="stable")
        places, sums = difference([tuple(map(int, v)) for v in pdf["sums"]], n)
        return pd.DataFrame({"cell": pdf["cell"], "up": pdf["up"], "places": places, "sums": [sums] * len(places)})

    return run


def group_shards(groups: DataFrame, n_shards: int = SHARDS, cell_groups: int = CELL_GROUPS) -> DataFrame:
    """groups(group_key binary, group_bytes long) -> (group_key, shard)."""
    count = groups.count()
    cells = max(1, -(-count // cell_groups))
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("group_key"), F.lit(cells)).cast("long"))
    placed = materialize(
        dealt.groupBy("cell").applyInPandas(_cell(n_shards), "group_key binary, cell long, place int, sums array<long>"), "cells"
    )
    here = placed.groupBy("cell").agg(F.first("sums").alias("sums"))
    out = placed.select("group_key", "cell", F.col("place").alias("shard"))
    while cells > 1:
        fewer = -(-cells // FAN_IN)
        level = materialize(
            here.withColumn("up", F.pmod("cell", F.lit(fewer)).cast("long")).groupBy("up").applyInPandas(_level(n_shards), "cell long, up long, places array<int>, sums array<long>"), "level"
        )
        moved = level.select("cell", F.col("up").alias("_up"), "places")
        out = out.join(moved, "cell").select("group_key", F.col("_up").alias("cell"), F.element_at("places", F.col("shard") + 1).alias("shard"))
        here = level.groupBy(F.col("up").alias("cell")).agg(F.first("sums").alias("sums"))
        cells = fewer
    return out.select("group_key", "shard")


def shard(docs: DataFrame, n_shards: int = SHARDS, cell_groups: int = CELL_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; equal texts share a shard."""
    raw = F.col("text").cast("binary")
    rows = materialize(
        docs.select("doc_id", "text").select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"null")).alias("group_key"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("group_key").agg(F.sum("size").alias("group_bytes")), "shard-groups")
    # A group of copies may hold a third of all rows: the join may split it (adaptive skew join).
    placed = materialize(rows.join(group_shards(groups, n_shards, cell_groups), "group_key").select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """slot: gapless within a shard. Rows are numbered inside slices of a shard, dealt by id, and the slices' counts are summed."""
    slices = 4 * parts(placed.sparkSession)
    sliced = placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "slice", "start")
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return (
        sliced.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))
    )

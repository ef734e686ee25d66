"""Slots, nodes and key counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.keys import SLOTS, hash_tag, is_tagged, key_slot


def even_split(nodes: int) -> list[tuple[int, int, int]]:
    """(node, first slot, last slot) of an even layout, with the single-precision rounding that servers use."""
    ends = np.cumsum(np.full(nodes, SLOTS / nodes, np.float32), dtype=np.float32) - np.float32(1)
    lasts = np.floor(ends + np.float32(0.5)).astype(int)
    lasts[-1] = SLOTS - 1
    firsts = np.concatenate([[0], lasts[:-1] + 1])
    return [(k + 1, int(a), int(b)) for k, (a, b) in enumerate(zip(firsts, np.maximum(firsts, lasts)))]


def layout(spark: SparkSession, nodes: int) -> DataFrame:
    """node, lo, hi."""
    return spark.createDataFrame(even_split(nodes), "node int, lo int, hi int")


def with_slots(keys: DataFrame) -> DataFrame:
    return keys.withColumn("slot", key_slot(F.col("key")))


def owners(slotted: DataFrame, ranges: DataFrame) -> DataFrame:
    """slotted with its node (null if nobody owns the slot). At most 16384 ranges: they are broadcast as slots."""
    by_slot = ranges.select("node", F.explode(F.sequence("lo", "hi")).alias("slot"))
    return slotted.join(F.broadcast(by_slot), "slot", "left")


def node_counts(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """node, keys, used_slots, busiest, tagged. Keys are summed by slot before they meet the nodes."""
    per_slot = with_slots(keys).groupBy("slot").agg(F.count("*").alias("n"), F.count_if(is_tagged(F.col("key"))).alias("t"))
    return owners(per_slot, ranges).groupBy("node").agg(
        F.sum("n").alias("keys"), F.count("*").alias("used_slots"), F.max("n").alias("busiest"), F.sum("t").alias("tagged")
    )


def top_slots(keys: DataFrame, n: int = 10) -> DataFrame:
    return with_slots(keys).groupBy("slot").agg(F.count("*").alias("keys")).orderBy(F.desc("keys"), "slot").limit(n)


def top_tags(keys: DataFrame, n: int = 10) -> DataFrame:
    return keys.where(is_tagged(F.col("key"))).groupBy(hash_tag(F.col("key")).alias("tag")).agg(F.count("*").alias("keys")).orderBy(F.desc("keys"), "tag").limit(n)


def slot_ranges(slotted: DataFrame) -> DataFrame:
    """lo, hi of runs of used slots: gaps and islands over at most 16384 rows."""
    used = slotted.select("slot").distinct()
    island = F.col("slot") - F.row_number().over(Window.orderBy("slot"))
    return used.withColumn("island", island).groupBy("island").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).select("lo", "hi")


def cross_slot(commands: DataFrame) -> DataFrame:
    """commands(command_id, keys array) -> command_id, n_keys, n_slots, crossslot."""
    slots = F.array_distinct(F.transform("keys", key_slot))
    return commands.select("command_id", F.size("keys").alias("n_keys"), F.size(slots).alias("n_slots"), (F.size(slots) > 1).alias("crossslot"))


def apportion(weights: DataFrame, total: int) -> DataFrame:
    """weights(node, weight) -> node, share: largest remainders get what rounding down leaves; ties go to the first node."""
    everything = Window.partitionBy()
    exact = F.col("weight") * total / F.sum("weight").over(everything)
    rows = weights.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    rows = rows.withColumn("left", F.lit(total) - F.sum("base").over(everything))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "node"))
    return rows.withColumn("rank", rank).select("node", (F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long").alias("share"))


def slot_load(loads: DataFrame) -> DataFrame:
    """loads(lo, hi, load) -> slot, load: a range's load is spread evenly."""
    return loads.select(F.explode(F.sequence("lo", "hi")).alias("slot"), (F.col("load") / (F.col("hi") - F.col("lo") + 1)).alias("part")).groupBy("slot").agg(F.sum("part").alias("load"))

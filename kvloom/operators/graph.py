"""Graphs kept as ordered keys: n/<node>, o/<from>/<type>/<to>, i/<to>/<type>/<from>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def graph_keys(edges: DataFrame) -> DataFrame:
    """key (binary, so byte order is key order) of nodes and of both directions of edges."""
    src, kind, dst = (escaped(F.col(c)) for c in ("src", "type", "dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().select(F.concat(F.lit("n/"), escaped(F.col("n"))).alias("key"))
    out = edges.select(F.concat_ws("/", F.lit("o"), src, kind, dst).alias("key"))
    into = edges.select(F.concat_ws("/", F.lit("i"), dst, kind, src).alias("key"))
    return nodes.union(out).union(into).distinct().select(F.col("key").cast("binary").alias("key"))


def prefix_scan(keys: DataFrame, prefix: str) -> DataFrame:
    """Keys that start with prefix, as a range, so that files sorted by key are pruned by their statistics."""
    low = prefix.encode()
    stripped = low.rstrip(b"\xff")
    rows = keys.where(F.col("key") >= F.lit(low))
    return rows.where(F.col("key") < F.lit(stripped[:-1] + bytes([stripped[-1] + 1]))) if stripped else rows


def k_hop(edges: DataFrame, start: DataFrame, hops: int, cut=None) -> DataFrame:
    """node, hop: nodes within so many steps of start(node), with the fewest. Seen nodes are not walked again. cut: a function that materializes a step on a cluster."""
    steps = edges.select("src", "dst").distinct()
    seen = start.select("node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        found = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = found.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop"))
        if cut:
            frontier = cut(frontier)
        seen = seen.union(frontier)
    return seen

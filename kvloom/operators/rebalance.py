"""Slot moves that even out a layout, as interval joins of running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def surplus(owned: DataFrame, targets: DataFrame) -> DataFrame:
    """owned(node, slots), targets(node, share) -> node, surplus (negative: deficit)."""
    return owned.join(targets, "node", "full").select("node", (F.coalesce("slots", F.lit(0)) - F.coalesce("share", F.lit(0))).cast("long").alias("surplus"))


def moves(nodes: DataFrame) -> DataFrame:
    """nodes(node, surplus) -> donor, receiver, slots: the largest surplus serves the largest deficit first; ties go by node.

    Both sides are laid out on one line by running sums; a move is where a donor's
    stretch and a receiver's overlap. At most one row a node on either side.
    """

    def stretch(side: DataFrame, amount) -> DataFrame:
        order = Window.orderBy(F.desc("amount"), "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return side.select("node", amount.alias("amount")).withColumn("hi", F.sum("amount").over(order)).withColumn("lo", F.col("hi") - F.col("amount"))

    give = stretch(nodes.where("surplus > 0"), F.col("surplus")).alias("g")
    take = stretch(nodes.where("surplus < 0"), -F.col("surplus")).alias("t")
    overlap = F.least("g.hi", "t.hi") - F.greatest("g.lo", "t.lo")
    return give.join(take, (F.col("g.lo") < F.col("t.hi")) & (F.col("t.lo") < F.col("g.hi"))).select(F.col("g.node").alias("donor"), F.col("t.node").alias("receiver"), overlap.cast("long").alias("slots"))


def moved_slots(layout: DataFrame, plan: DataFrame) -> DataFrame:
    """layout(node, slot), plan(donor, receiver, slots) -> slot, donor, receiver: a donor gives its highest slots first."""
    ranked = layout.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("slot"))))
    order = Window.partitionBy("donor").orderBy(F.desc("slots"), "receiver").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stretches = plan.withColumn("hi", F.sum("slots").over(order)).withColumn("lo", F.col("hi") - F.col("slots"))
    return ranked.join(F.broadcast(stretches), (F.col("node") == F.col("donor")) & (F.col("place") > F.col("lo")) & (F.col("place") <= F.col("hi"))).select("slot", "donor", "receiver")


def find_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """nodes(id, host, port), refs(ref) -> ref, id, problem (null if one node is meant): by full id, host:port or a prefix of an id of six hex digits or more.

    Prefixes meet ids by their first six digits, so every join has an equality.
    """
    asked = refs.select("ref", F.lower(F.trim("ref")).alias("r")).distinct()
    named = nodes.select("id", F.lower(F.concat("host", F.lit(":"), F.col("port").cast("string"))).alias("address"))
    wanted = asked.select("r").distinct()
    exact = wanted.join(named.select("id", F.explode(F.array_distinct(F.array("id", "address"))).alias("r")), "r").groupBy("r").agg(F.count("*").alias("n_exact"), F.max("id").alias("exact"))
    prefixes = wanted.where(F.regexp_like("r", F.lit("^[0-9a-f]{6,}$"))).withColumn("six", F.substring("r", 1, 6))
    begun = prefixes.join(named.select("id", F.substring("id", 1, 6).alias("six")), "six").where(F.startswith("id", F.col("r"))).groupBy("r").agg(F.count("*").alias("n_begun"), F.max("id").alias("begun"))
    found = F.when(F.col("n_exact") == 1, F.col("exact")).when(F.col("n_begun") == 1, F.col("begun"))
    problem = F.when(found.isNull(), F.when(F.col("n_begun") > 1, "more than one node").otherwise("no such node"))
    return asked.join(exact, "r", "left").join(begun, "r", "left").select("ref", found.alias("id"), problem.alias("problem"))

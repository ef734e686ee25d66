"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every row gets a 24-bit key from a hash of its id and text. Tokens are summed by
(source, upper 12 bits); a running sum finds, for each source, the bucket in
which its token budget ends. Only that boundary bucket is summed again by the
lower 12 bits, and the budget ends at one of those. A row is taken once more
than the whole number of passes if its key lies below the threshold. Nothing is
sorted but the histograms, which have at most 4096 rows a source and level.

Budgets are nested: the pass count and the threshold only grow with the target,
so a larger budget takes every row that a smaller one takes.

Defined results: a null text has size 0 and is taken 0 words; a null source is a
source of its own and comes last; ties (equal id and text) share a key and are
taken alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, materialize

BITS = 12
BROADCAST_SOURCES = 20_000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """sizes(source, source_size) -> with target: share of all tokens by weight, held at max_repeats times the source's own.

    The targets are min(cap, level * weight) for the one level that spends the
    budget. Walking the sources by cap / weight, those whose cap is reached
    before the level are full, and the rest divide what is left.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    before = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.col("spent") + F.col("ratio") * F.col("open_weight") <= F.col("budget")
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", full)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
        .select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))
    )


def _boundary(histogram: DataFrame, bucket: str, need: str) -> DataFrame:
    """For each source, the first bucket whose running sum reaches need: (source, bucket, need left for it)."""
    running = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        histogram.withColumn("upto", F.sum("tokens").over(running))
        .where((F.col("upto") > F.col(need)) & (F.col("upto") - F.col("tokens") <= F.col(need)))
        .select("source", F.col(bucket), (F.col(need) - (F.col("upto") - F.col("tokens"))).alias("left"), "tokens")
    )


def _key() -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - 2 * BITS)


def _copies(max_repeats: int) -> Column:
    return F.least(F.col("passes") + F.when(F.col("mix_key") < F.col("threshold"), 1).otherwise(0), F.lit(max_repeats)).cast("int")


def _beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan. The plan has a row for each source; it is broadcast only if it is counted as small."""
    small = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return rows.alias("r").join(small.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, source, size, mix_key; plan: source, source_size, target, passes, threshold)."""
    rows = materialize(docs.select("doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), _key().alias("mix_key")), "mix")
    coarse = materialize(rows.groupBy("source", F.shiftright("mix_key", BITS).alias("hi")).agg(F.sum("size").alias("tokens")), "mix-coarse")
    targets = source_targets(coarse.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, share, max_repeats)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(max_repeats))).otherwise(F.lit(0)).cast("int")
    budgets = materialize(targets.withColumn("passes", passes).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size")), "mix-budget")
    c, b = coarse.alias("c"), budgets.alias("b")
    first = materialize(_boundary(c.join(b, F.col("c.source").eqNullSafe(F.col("b.source"))).select("c.source", "hi", "tokens", "need"), "hi", "need"), "mix-first")
    # Only the rows of the boundary buckets are summed again.
    inside = _beside(rows.withColumn("hi", F.shiftright("mix_key", BITS)), first.withColumnRenamed("hi", "end").drop("tokens")).where("hi = end")
    fine = inside.groupBy("r.source", "left", F.col("mix_key").bitwiseAND((1 << BITS) - 1).alias("lo")).agg(F.sum("size").alias("tokens"))
    last = _boundary(fine.select("source", "lo", "tokens", F.col("left").alias("need")), "lo", "need")
    # The last bucket joins if that comes nearer to the budget than leaving it out.
    lo = F.coalesce(F.col("lo") + F.when(F.col("l.left") * 2 > F.col("l.tokens"), 1).otherwise(0), F.lit(0))
    ends = first.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left").select("e.source", (F.shiftleft("hi", BITS) + lo).alias("threshold"))
    b, t = budgets.alias("b"), ends.alias("t")
    plan = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source")), "left").select("b.source", "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold"))
    return rows, materialize(plan, "mix-plan")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 ... max_repeats) of every row of docs."""
    rows, plan = mix_plan(docs, **how)
    return _beside(rows, plan).select("r.doc_id", "r.source", "size", "source_size", "target", _copies(how.get("max_repeats", MAX_REPEATS)).alias("copies"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. The texts are not shuffled: only the plan meets them."""
    _, plan = mix_plan(docs, **how)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("source"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).withColumn("mix_key", _key())
    taken = _beside(keyed.select("row", "source", "mix_key"), plan).withColumn("copies", _copies(how.get("max_repeats", MAX_REPEATS))).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

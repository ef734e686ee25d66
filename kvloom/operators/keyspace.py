"""Prefix trees, patterns and naming findings of a key space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import SEPARATORS, _quoted, key_pattern

STRONG, WEAK, LEAD = 0.3, 0.6, 0.15
#: Parts of a pattern's keys in which examples are looked for side by side.
SLICES = 64


def patterns(keys: DataFrame, separator: str = ":") -> DataFrame:
    return keys.groupBy(key_pattern(F.col("key"), separator).alias("pattern")).agg(F.count("*").alias("keys"), F.sum(F.octet_length("key")).alias("bytes"))


def prefix_tree(keys: DataFrame, separator: str = ":", examples: int = 3) -> DataFrame:
    """path, depth, keys, bytes, ends, examples of the node of every prefix, over the folded patterns.

    Keys are counted by whole pattern first, so each level is a rollup of patterns
    and not of keys. Examples are the first keys by index.
    """
    named = keys.withColumn("pattern", key_pattern(F.col("key"), separator))
    whole = named.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("b"))
    # First keys within slices of a pattern, then among those: a pattern with a third of all keys is many windows.
    slice_ = F.pmod(F.xxhash64("key_idx"), F.lit(SLICES))
    first = F.row_number().over(Window.partitionBy("pattern", "slice").orderBy("key_idx", "key"))
    few = named.select("pattern", "key_idx", "key", slice_.alias("slice")).withColumn("rank", first).where(F.col("rank") <= examples)
    shown = few.groupBy("pattern").agg(F.slice(F.sort_array(F.collect_list(F.struct("key_idx", "key"))), 1, examples).alias("e"))
    whole = whole.join(shown, "pattern")
    segments = F.split("pattern", _quoted(separator))
    nodes = whole.withColumn("segments", segments).withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("segments"))))
    nodes = nodes.withColumn("path", F.array_join(F.slice("segments", 1, F.col("depth")), separator)).withColumn("end", F.col("depth") == F.size("segments"))
    return nodes.groupBy("path", "depth").agg(
        F.sum("n").alias("keys"), F.sum("b").alias("bytes"), F.sum(F.when(F.col("end"), F.col("n")).otherwise(0)).alias("ends"),
        F.array_join(F.transform(F.slice(F.sort_array(F.flatten(F.collect_list("e"))), 1, examples), lambda x: x["key"]), " ").alias("examples"),
    )


def separator_shares(keys: DataFrame) -> DataFrame:
    """One row: the share of keys with each separator, and the separator that the vote picks (first wins ties)."""
    shares = keys.agg(*[F.avg(F.when(F.contains("key", F.lit(s)), 1.0).otherwise(0.0)).alias(f"s{i}") for i, s in enumerate(SEPARATORS)])
    best, chosen = F.lit(0.0), F.lit(None).cast("string")
    for i, s in enumerate(SEPARATORS):
        share = F.col(f"s{i}")
        wins = (share >= WEAK) & (share > best + LEAD) if s in "._-" else (share >= STRONG) & (share > best)
        best, chosen = F.when(wins, share).otherwise(best), F.when(wins, F.lit(s)).otherwise(chosen)
    return shares.select(chosen.alias("separator"), *[F.round(f"s{i}", 6).alias(f"share_{i}") for i in range(len(SEPARATORS))])


def naming_findings(keys: DataFrame, separator: str = ":", long_bytes: int = 256) -> DataFrame:
    """finding, n: keys without the separator, with another one, empty segments, long or unclean keys, and prefixes that differ in case only."""
    key = F.col("key")
    others = [s for s in (":", "/", "|", "#") if s != separator]
    first = F.substring_index(key, separator, 1)
    split = F.split(key, _quoted(separator))
    tests = {
        "no_separator": ~F.contains(key, F.lit(separator)),
        "other_separator": F.greatest(*[F.contains(first, F.lit(s)) for s in others]),
        "empty_segment": (F.size(split) > 1) & F.array_contains(split, ""),
        "long": F.octet_length(key) > long_bytes,
        "unclean": F.regexp_like(key, F.lit(r"[\x00-\x20\x7F]")),
    }
    counts = keys.agg(*[F.count_if(t).alias(n) for n, t in tests.items()]).unpivot([], list(tests), "finding", "n")
    prefix = keys.select(F.substring_index("key", separator, 1).alias("prefix")).distinct()
    collisions = prefix.groupBy(F.lower("prefix").alias("low")).agg(F.count("*").alias("spellings")).where("spellings > 1").agg(F.lit("case_collision").alias("finding"), F.count("*").alias("n"))
    return counts.select("finding", F.col("n").cast("long").alias("n")).union(collisions)


def near_names(names: DataFrame, most: int = 3000) -> DataFrame:
    """names(name, keys) -> pairs of the most common names one edit, or one swap of neighbouring characters, apart.

    Names have three characters at least and no class, and a pair differs in more
    than case. At most ``most`` names meet, by lengths that differ by one at most.
    """
    able = names.where((F.length("name") >= 3) & ~F.contains("name", F.lit("<")))
    top = able.orderBy(F.desc("keys"), "name").limit(most).withColumn("size", F.length("name"))
    swapped = F.expr("exists(sequence(1, greatest(length(a.name) - 1, 1)), i -> concat(left(a.name, i - 1), substr(a.name, i + 1, 1), substr(a.name, i, 1), substr(a.name, i + 2)) = b.name)")
    a, b = top.alias("a"), top.select("name", "keys", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")).alias("b")
    return (
        a.join(b, (F.col("a.size") == F.col("b.size")) & (F.col("a.name") < F.col("b.name")))
        .where((F.levenshtein("a.name", "b.name", 1) == 1) | (F.levenshtein("a.name", "b.name", 2) == 2) & (F.length("a.name") == F.length("b.name")) & swapped)
        .where(F.lower("a.name") != F.lower("b.name"))
        .select(F.col("a.name").alias("name"), F.col("b.name").alias("near"))
    )


def fold_busy_levels(patterns_: DataFrame, separator: str = ":", many: int = 50, share: float = 0.8, small: int = 2, cut=None) -> DataFrame:
    """patterns(pattern, keys) -> the same after folding: where a prefix has more than ``many`` children and ``share`` of them are small (``small`` keys at most) and no class, these become <*>.

    Levels are folded from the deepest up, one aggregation and one join each.
    cut: a function that materializes the patterns and each level on a cluster; without it each use counts the keys again.
    """
    rows = patterns_.select(F.split("pattern", _quoted(separator)).alias("path"), "keys")
    rows = cut(rows) if cut else rows
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        child = F.element_at("path", depth)
        here = rows.where(F.size("path") >= depth).withColumn("parent", F.slice("path", 1, depth - 1)).withColumn("child", child)
        kids = here.groupBy("parent", "child").agg(F.sum("keys").alias("n"))
        is_small = (F.col("n") <= small) & ~F.contains("child", F.lit("<"))
        busy = kids.groupBy("parent").agg(F.count("*").alias("kids"), F.count_if(is_small).alias("few")).where((F.col("kids") > many) & (F.col("few") >= share * F.col("kids"))).select("parent")
        folded = kids.where(is_small).join(busy, "parent").select("parent", "child", F.lit(True).alias("fold"))
        new = F.when(F.col("fold"), F.concat(F.col("parent"), F.array(F.lit("<*>")), F.slice("path", depth + 1, 1000))).otherwise(F.col("path"))
        here = here.join(folded, ["parent", "child"], "left").select(new.alias("path"), "keys")
        rows = here.union(rows.where(F.size("path") < depth)).groupBy("path").agg(F.sum("keys").alias("keys"))
        rows = cut(rows) if cut else rows
    return rows.select(F.array_join("path", separator).alias("pattern"), "keys")


def top_patterns(patterns_: DataFrame, n: int = 50) -> DataFrame:
    """The n most common patterns, and one row (more) for the rest."""
    top = patterns_.orderBy(F.desc("keys"), "pattern").limit(n).select("pattern", F.col("keys").cast("long").alias("keys"), F.lit(1).cast("long").alias("patterns"))
    rest = patterns_.join(F.broadcast(top.select("pattern")), "pattern", "left_anti").agg(F.sum("keys").cast("long").alias("keys"), F.count("*").alias("patterns"))
    return top.union(rest.where("patterns > 0").select(F.lit("(more)").alias("pattern"), "keys", "patterns"))


def browse(keys: DataFrame, prefix: str = "", within: str = "", by: str = "key", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the keys with a prefix and a substring."""
    rows = keys.where(F.startswith("key", F.lit(prefix)) & F.contains("key", F.lit(within)))
    return rows.orderBy(by, "key_idx").offset(offset).limit(limit)

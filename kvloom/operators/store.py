"""Snapshots, bulk loads, settings and permissions as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.keys import snapshot_prefix
from ..session import cut

#: Names of the buckets of time left, with the least milliseconds of each.
TTL_BUCKETS = ((None, "expired"), (1, "under 1 minute"), (60_000, "under 1 hour"), (3_600_000, "under 1 day"), (86_400_000, "under 1 week"), (604_800_000, "under 30 days"), (2_592_000_000, "longer"))
#: Buckets of idle seconds and of access frequency, with the least value of each.
IDLE_BUCKETS = ((0, "under 1 hour"), (3_600, "under 1 day"), (86_400, "under 1 week"), (604_800, "longer"))
FREQUENCY_BUCKETS = ((0, "0-4"), (5, "5-15"), (16, "16-63"), (64, "64-255"))


# --- snapshots ------------------------------------------------------------------


def snapshot_totals(entries: DataFrame) -> DataFrame:
    """level, item, keys, bytes, elements by type, encoding and database. A string is one element in all and none by type."""
    rows = entries.groupBy("db", "type", "encoding").agg(F.count("*").alias("keys"), F.sum("size").alias("bytes"), F.sum("length").alias("elements"))
    each = F.array(F.struct(F.lit("db").alias("level"), F.col("db").cast("string").alias("item")), F.struct(F.lit("type").alias("level"), F.col("type").alias("item")), F.struct(F.lit("encoding").alias("level"), F.col("encoding").alias("item")))
    return rows.withColumn("x", F.explode(each)).groupBy("x.level", "x.item").agg(F.sum("keys").alias("keys"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("type") == "string", 0).otherwise(F.col("elements"))).alias("elements"))


def ttl_bucket(left_ms: Column) -> Column:
    out = F.lit(TTL_BUCKETS[0][1])
    for least, name in TTL_BUCKETS[1:]:
        out = F.when(left_ms >= least, F.lit(name)).otherwise(out)
    return out


def ttl_histogram(entries: DataFrame, created_ms: int) -> DataFrame:
    rows = entries.where("expire_ms is not null")
    return rows.groupBy(ttl_bucket(F.col("expire_ms") - created_ms).alias("bucket")).agg(F.count("*").alias("keys"))


def value_histogram(entries: DataFrame, column: str, buckets: tuple) -> DataFrame:
    """bucket, keys of the entries that have the column (IDLE_BUCKETS, FREQUENCY_BUCKETS)."""
    name = F.lit(buckets[0][1])
    for least, label in buckets[1:]:
        name = F.when(F.col(column) >= least, F.lit(label)).otherwise(name)
    return entries.where(F.col(column).isNotNull()).groupBy(name.alias("bucket")).agg(F.count("*").alias("keys"))


def largest(entries: DataFrame, by: str = "size", n: int = 10) -> DataFrame:
    return entries.orderBy(F.desc(by), "offset").limit(n)


def snapshot_prefixes(entries: DataFrame) -> DataFrame:
    return entries.groupBy(snapshot_prefix(F.col("key")).alias("prefix")).agg(F.count("*").alias("keys"))


# --- bulk loads -----------------------------------------------------------------


def resp_command(*arguments: Column) -> Column:
    """One command in RESP, as binary."""
    pieces = [F.lit(f"*{len(arguments)}\r\n")]
    for a in arguments:
        pieces += [F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a, F.lit("\r\n")]
    return F.encode(F.concat(*pieces), "UTF-8")


def build_commands(records: DataFrame, key: Column, kind: str, value: Column, ttl: int | None = None, fresh: bool = False) -> DataFrame:
    """phase, idx, name, args: the commands that load records(idx, ...). fresh: DEL once for each new key (not for strings).

    A string's expiry rides in its SET; a hash gets EXPIRE with each row; lists and
    sets get one for each key at the end.
    """
    rows = records.select("idx", key.alias("key"), value.alias("value")).where("key is not null and key <> ''")
    first = F.row_number().over(Window.partitionBy("key").orderBy("idx")) == 1
    verb = {"string": "SET", "list": "RPUSH", "set": "SADD"}[kind]
    body = F.array("key", "value")
    if kind == "string" and ttl:
        body = F.array(F.col("key"), F.col("value"), F.lit("EX"), F.lit(str(ttl)))
    out = rows.select(F.lit(1).alias("phase"), "idx", F.lit(verb).alias("name"), body.alias("args"))
    firsts = rows.withColumn("first", first).where("first")
    if fresh and kind != "string":
        out = out.union(firsts.select(F.lit(0), "idx", F.lit("DEL"), F.array("key")))
    if ttl and kind != "string":
        out = out.union(firsts.select(F.lit(2), "idx", F.lit("EXPIRE"), F.array(F.col("key"), F.lit(str(ttl)))))
    return out


def csv_guard(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(F.regexp_like(cell, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), cell)).otherwise(cell)


def numbered(rows: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """rows with ``at``: 0, 1, ... in the order of the columns. Range slices are numbered side by side, from the counts of those before."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(slices or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_slice", F.spark_partition_id())
    dealt = cut(dealt)
    counts = dealt.groupBy("_slice").agg(F.count("*").alias("n"))
    # One row a slice.
    starts = counts.select("_slice", F.coalesce(F.sum("n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    return dealt.withColumn("at", inside).join(F.broadcast(starts), "_slice").withColumn("at", F.col("start") + F.col("at")).drop("start", "_slice")


def batches(items: DataFrame, size: int = 25) -> DataFrame:
    """request, items: write requests of ``size`` items in the order of item_id; only the last may be short."""
    rows = numbered(items, ["item_id"]).withColumn("request", F.floor(F.col("at") / size))
    return rows.groupBy("request").agg(F.sort_array(F.collect_list("item_id")).alias("items"))


# --- settings -------------------------------------------------------------------


def setting_differences(got: DataFrame, defaults: DataFrame) -> DataFrame:
    """name, status (changed, same, hidden, unknown): got(name, value) against a version's defaults(name, value)."""
    g, d = got.alias("g"), defaults.alias("d")
    status = F.when(F.col("d.name").isNull(), "unknown").when(F.col("g.name").isNull(), "hidden").when(F.col("g.value") == F.col("d.value"), "same").otherwise("changed")
    return g.join(d, F.col("g.name") == F.col("d.name"), "full").select(F.coalesce("g.name", "d.name").alias("name"), status.alias("status"))


def version_scores(got: DataFrame, defaults: DataFrame) -> DataFrame:
    """version, score: names in both less names in one of them only. defaults(version, name)."""
    known = defaults.join(got.select("name").distinct().withColumn("hit", F.lit(True)), "name", "left")
    total = got.select("name").distinct().agg(F.count("*").alias("total"))
    per = known.groupBy("version").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("extras"))
    return per.join(F.broadcast(total)).select("version", (F.col("hits") - (F.col("total") - F.col("hits")) - F.col("extras")).alias("score"))


def last_settings(lines: DataFrame) -> DataFrame:
    """lines(line, name, value) -> name, value, set_by: the last line wins; all lines that set it, in order."""
    return lines.groupBy("name").agg(F.max_by("value", "line").alias("value"), F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("set_by"))


def setting_lines(lines: DataFrame, ranges: int = 64) -> DataFrame:
    """lines(line, name, value) -> line, name, value (of the name's last line), place (1, 2, ... among the name's lines), a row for each line.

    No group is held whole: lines are numbered inside ranges of lines, and a name
    has at most ``ranges`` counts that are summed. Lines without a number are left out.
    """
    known = lines.where("line IS NOT NULL")
    bounds = sorted(set(known.approxQuantile("line", [k / ranges for k in range(1, ranges)], 0.5 / ranges)))
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("line"))) if bounds else F.lit(0)
    rows = known.withColumn("part", at)
    counts = rows.groupBy("name", "part").agg(F.count("*").alias("n"), F.max_by("value", "line").alias("last"))
    before, every = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("name")
    sums = counts.select("name", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.max_by("last", "part").over(every).alias("final"))
    own = rows.withColumn("n", F.row_number().over(Window.partitionBy("name", "part").orderBy("line"))).alias("r")
    return own.join(sums.alias("s"), F.col("r.name").eqNullSafe(F.col("s.name")) & (F.col("r.part") == F.col("s.part"))).select("r.line", "r.name", F.col("final").alias("value"), (F.col("before") + F.col("n")).alias("place"))


# --- permissions ----------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """A glob (* ? [a-z] [^a] \\x) as a regular expression over the whole text."""
    out, i = "", 0
    quote = lambda c: "\\" + c if c in r"\.[]{}()*+?^$|-&~#" else c
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += quote(pattern[i])
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inner = pattern[i + 1 : end]
            negated = inner.startswith("^")
            body = "".join(x if x == "-" and 0 < k < len(inner[negated:]) - 1 else quote(x) for k, x in enumerate(inner[negated:]))
            out += f"[{'^' if negated else ''}{body}]"
            i = end
        else:
            out += quote(c)
        i += 1
    return f"(?s)^{out}$"


def allowed_keys(keys: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """keys with allowed: does one pattern with all the asked-for flags match? patterns: (flags, glob). Literal patterns are an equality, globs one expression each, all in one pass over the keys."""
    hit = F.lit(False)
    for flags, glob in patterns:
        plain = not any(c in glob for c in "*?[\\")
        own = F.col("key") == glob if plain else F.regexp_like("key", F.lit(glob_regex(glob)))
        asks = F.lit(True)
        for f in "RW":
            if f not in flags:
                asks = asks & ~F.contains(F.col("needs"), F.lit(f))
        hit = hit | (own & asks)
    return keys.withColumn("allowed", hit)


def last_rule(rules: DataFrame) -> DataFrame:
    """rules(rule_idx, command, on) -> command, on: per command the last rule wins."""
    return rules.groupBy("command").agg(F.max_by("on", "rule_idx").alias("on"))


def least_privilege(accesses: DataFrame, separator: str = ":") -> DataFrame:
    """accesses(key, flags: 1 read, 2 write) -> pattern, flags, keys: keys grouped by first segment; the longest common prefix, cut at a separator."""
    per = accesses.groupBy("key").agg(F.bit_or("flags").alias("flags"))
    groups = per.groupBy(F.substring_index("key", separator, 1).alias("head")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.bit_or("flags").alias("flags"), F.count("*").alias("keys"))
    lengths = F.sequence(F.lit(0), F.least(F.length("low"), F.length("high")))
    common = F.array_max(F.filter(lengths, lambda n: F.substr("low", F.lit(1), n) == F.substr("high", F.lit(1), n)))
    shared = F.substr("low", F.lit(1), common)
    cut = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.concat(F.regexp_extract(shared, f"^(.*{separator})", 1), F.lit("*")))
    return groups.select(cut.alias("pattern"), "flags", "keys")


def reference_versions(spark: SparkSession) -> DataFrame:
    """version, name, value: a few settings of invented store versions, for tests and queries."""
    base = {"maxmemory": "0", "appendonly": "no", "timeout": "0", "databases": "16"}
    rows = [(v, n, x) for v, extra in (("a1", {}), ("a2", {"lazyfree": "no"}), ("b1", {"lazyfree": "yes", "io-threads": "1"})) for n, x in (base | extra).items()]
    return spark.createDataFrame(rows, "version string, name string, value string")

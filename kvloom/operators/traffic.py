"""Command traffic: totals, key accesses, patterns, series, findings, hit-rate curve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.commands import command_keys, crosses_slots
from ..functions.keys import client_host, key_pattern, key_slot
from ..session import cut

#: Command families, options that set a time to live, steps of a series in seconds (the first with fewer than MOST_BUCKETS is used).
DELETES = ("DEL", "UNLINK", "GETDEL")
EXPIRES = ("EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT")
TTL_OPTIONS = ("EX", "PX", "EXAT", "PXAT", "KEEPTTL")
LADDER = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 21600, 43200, 86400)
MOST_BUCKETS = 1500


def _kind(flags: Column) -> Column:
    flags = F.coalesce(flags, F.lit(""))
    return F.when(F.contains(flags, F.lit("x")), "script").when(F.contains(flags, F.lit("p")), "pubsub").when(F.contains(flags, F.lit("w")), "write").when(F.contains(flags, F.lit("r")), "read").otherwise("other")


def with_kind(commands: DataFrame, dimension: DataFrame) -> DataFrame:
    """commands with kind (script, pubsub, write, read, other; by the first flag that applies) and unknown. The dimension has a row a command."""
    joined = commands.join(F.broadcast(dimension), F.upper("command") == F.col("name"), "left")
    return joined.withColumn("kind", _kind(F.col("flags"))).withColumn("unknown", F.col("name").isNull()).drop("name", "flags")


def with_keys(commands: DataFrame, table: DataFrame) -> DataFrame:
    """commands(args) with base, command, kind, unknown, keys (array) and key (the first).

    table(name, flags, first, last, step) has a row a command, a few hundred, and is
    broadcast; a subcommand with a row of its own ("CLIENT SETNAME") is the command,
    and its first word the base.
    """
    info = F.struct("name", "flags", "first", "last", "step").alias("_info")
    base = F.upper(F.get("args", F.lit(0)))
    sub = F.concat(base, F.lit(" "), F.upper(F.get("args", F.lit(1))))
    rows = commands.withColumn("base", base).withColumn("_sub", sub)
    rows = rows.join(F.broadcast(table.select(F.col("name").alias("_sub"), info.alias("_own"))), "_sub", "left").join(F.broadcast(table.select(F.col("name").alias("base"), info.alias("_whole"))), "base", "left")
    rows = rows.withColumn("_info", F.coalesce("_own", "_whole"))
    found = F.col("_info")
    keys = command_keys(F.col("args"), *[found[c] for c in ("first", "last", "step", "flags")])
    return rows.select(*commands.columns, "base", F.coalesce(found["name"], F.col("base")).alias("command"), _kind(found["flags"]).alias("kind"), found.isNull().alias("unknown"), keys.alias("keys")).withColumn("key", F.get("keys", F.lit(0)))


def volumes(commands: DataFrame) -> DataFrame:
    """dimension (command, host), item, n, bytes (of all arguments), connections (calls from scripts have none).

    Counted by connection and command first, so the second shuffle has no row a command line. commands as from with_keys.
    """
    size = F.aggregate("args", F.lit(0).cast("long"), lambda total, a: total + F.length(a))
    per = commands.groupBy("client", "command").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    items = {"command": F.col("command"), "host": client_host(F.col("client"))}
    rows = per.select("client", "n", "bytes", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("item")) for n, c in items.items()])).alias("x"))
    return rows.groupBy("x.dimension", "x.item").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count_distinct(F.when(F.col("client") != "lua", F.col("client"))).alias("connections"))


def totals(commands: DataFrame) -> DataFrame:
    """dimension, item, n: commands by name, kind, database, host and second, in one pass."""
    rows = commands.select("command", "kind", F.col("db").cast("string").alias("db"), client_host(F.col("client")).alias("host"), F.col("sec").cast("string").alias("second"))
    names = ("command", "kind", "db", "host", "second")
    return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("item")) for n in names])).alias("x")).groupBy("x.dimension", "x.item").agg(F.count("*").alias("n"))


def _op(command: Column, kind: Column) -> Column:
    return F.when(command.isin(*DELETES), "delete").when(kind == "write", "write").when(kind == "read", "read")


def key_accesses(commands: DataFrame) -> DataFrame:
    """db, key, reads, writes, deletes of commands that read or write: of each of their keys if there is a column keys, else of key."""
    op = _op(F.col("command"), F.col("kind"))
    rows = commands.where(F.col("kind").isin("read", "write")).withColumn("op", op)
    if "keys" in commands.columns:
        rows = rows.select("db", "op", F.explode("keys").alias("key"))
    return rows.groupBy("db", "key").agg(*[F.count_if(F.col("op") == o).alias(f"{o}s") for o in ("read", "write", "delete")])


def busiest_keys(accesses: DataFrame, n: int = 10) -> DataFrame:
    total = F.col("reads") + F.col("writes") + F.col("deletes")
    return accesses.withColumn("total", total).orderBy(F.desc("total"), "db", "key").limit(n)


def pattern_rollup(accesses: DataFrame, separator: str = ":") -> DataFrame:
    return accesses.groupBy(key_pattern(F.col("key"), separator).alias("pattern")).agg(
        F.count("*").alias("keys"), F.sum("reads").alias("reads"), F.sum("writes").alias("writes"), F.sum("deletes").alias("deletes"),
        F.count_if((F.col("reads") == 1) & (F.col("writes") == 0) & (F.col("deletes") == 0)).alias("read_once"),
    )


def slot_spread(accesses: DataFrame, ranges: DataFrame) -> DataFrame:
    """node, accesses, keys of the node that owns each key's slot."""
    by_slot = ranges.select("node", F.explode(F.sequence("lo", "hi")).alias("slot"))
    per = accesses.withColumn("slot", key_slot(F.col("key"))).groupBy("slot").agg(F.sum(F.col("reads") + F.col("writes") + F.col("deletes")).alias("n"), F.count("*").alias("k"))
    return per.join(F.broadcast(by_slot), "slot", "left").groupBy("node").agg(F.sum("n").alias("accesses"), F.sum("k").alias("keys"))


def series(commands: DataFrame) -> DataFrame:
    """bucket (its first second), n: zero-filled, in the smallest step of the ladder that gives fewer than MOST_BUCKETS."""
    per = commands.groupBy("sec").agg(F.count("*").alias("n"))
    span = per.agg(F.min("sec").alias("first"), F.max("sec").alias("last"))
    step = F.coalesce(*[F.when(F.floor((F.col("last") - F.col("first")) / s) + 1 < MOST_BUCKETS, F.lit(s)) for s in LADDER], F.lit(LADDER[-1]))
    span = span.withColumn("step", step)
    grid = span.select(F.explode(F.sequence("first", "last", F.col("step").cast("long"))).alias("bucket"))
    sums = per.join(F.broadcast(span)).groupBy((F.col("first") + F.floor((F.col("sec") - F.col("first")) / F.col("step")) * F.col("step")).alias("bucket")).agg(F.sum("n").alias("n"))
    return grid.join(sums, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def peak_second(commands: DataFrame) -> DataFrame:
    """The busiest second without the first and the last, which may be partial; the earliest of equals."""
    per = commands.groupBy("sec").agg(F.count("*").alias("n"))
    ends = per.agg(F.min("sec").alias("first"), F.max("sec").alias("last"))
    return per.join(F.broadcast(ends)).where((F.col("sec") > F.col("first")) & (F.col("sec") < F.col("last"))).orderBy(F.desc("n"), "sec").limit(1).select("sec", "n")


def set_then_expire(commands: DataFrame) -> DataFrame:
    """client, n: SETs whose next command on the same connection expires the same key; one could have done both.

    A SET with an option for its time to live does not count, nor one inside MULTI;
    SETNX does. Calls from scripts ("lua") and connections by Unix socket have no
    connection of their own. commands(client, line_no, db, command, key), args (array) if there.
    """
    line = Window.partitionBy("client").orderBy("line_no")
    own = (F.col("client") != "lua") & ~F.startswith("client", F.lit("unix:"))
    options = F.slice("args", 4, 1 << 30) if "args" in commands.columns else F.array().cast("array<string>")
    timed = (F.col("command") == "SET") & F.exists(options, lambda x: F.upper(x).isin(*TTL_OPTIONS))
    sets = F.col("command").isin("SET", "SETNX") & ~timed & ~F.col("in_multi")
    rows = in_transaction(commands.where(own)).withColumn("sets", sets)
    rows = rows.withColumn("set_before", F.lag("sets").over(line)).withColumn("same_key", (F.col("key") == F.lag("key").over(line)) & (F.col("db") == F.lag("db").over(line)))
    return rows.where(F.col("set_before") & F.col("command").isin(*EXPIRES) & F.col("same_key")).groupBy("client").agg(F.count("*").alias("n"))


def in_transaction(commands: DataFrame) -> DataFrame:
    """commands with in_multi: between MULTI and EXEC or DISCARD of their connection."""
    change = F.when(F.col("command") == "MULTI", True).when(F.col("command").isin("EXEC", "DISCARD"), False)
    line = Window.partitionBy("client").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return commands.withColumn("in_multi", F.coalesce(F.last(change, ignorenulls=True).over(line), F.lit(False)))


def last_script_client(commands: DataFrame, capture: str = "db", lines: int = 100_000) -> DataFrame:
    """commands with caller: the client of the last script call before them in their capture.

    Chunks of ``lines`` line numbers are windows of their own; what a chunk starts
    with is carried over from the chunks' last calls, a row each.
    """
    chunk = F.floor(F.col("line_no") / lines)
    script = F.when(F.col("kind") == "script", F.col("client"))
    rows = commands.withColumn("_chunk", chunk)
    ends = rows.groupBy(capture, "_chunk").agg(F.max_by("client", F.when(F.col("kind") == "script", F.col("line_no"))).alias("_last"))
    carry = Window.partitionBy(capture).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(capture, "_chunk", F.last("_last", ignorenulls=True).over(carry).alias("_carried"))
    line = Window.partitionBy(capture, "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("caller", F.last(script, ignorenulls=True).over(line))
    return inside.join(ends, [capture, "_chunk"]).withColumn("caller", F.coalesce("caller", "_carried")).drop("_chunk", "_carried").select(*commands.columns, "caller")


def findings(accesses: DataFrame, share: float = 0.10, least: int = 100) -> DataFrame:
    """db, key, total of hot keys: at least ``least`` accesses and ``share`` of all."""
    total = F.col("reads") + F.col("writes") + F.col("deletes")
    rows = accesses.withColumn("total", total)
    everything = rows.agg(F.sum("total").alias("everything"))
    return rows.join(F.broadcast(everything)).where((F.col("total") >= least) & (F.col("total") >= share * F.col("everything"))).select("db", "key", "total")


#: Commands that read a whole collection, and those that set a connection up.
WHOLE = ("SMEMBERS", "HGETALL", "HKEYS", "HVALS", "SUNION", "SINTER", "SDIFF")
SETUP = ("AUTH", "HELLO", "SELECT", "CLIENT SETNAME", "CLIENT SETINFO")
RANGES = ("LRANGE", "ZRANGE", "ZREVRANGE")
#: Fixed value: bytes of a large argument.
LARGE = 100 * 1024
#: Level of each finding; those of one count are listed in this order.
LEVELS = {"keys": "warn", "flush": "warn", "whole": "info", "large": "warn", "cross-slot": "warn", "hot-key": "warn", "set-expire": "info", "eval": "info", "setup": "info", "databases": "info", "unknown": "info"}


def traffic_findings(commands: DataFrame) -> DataFrame:
    """finding, level, n of what is worth a second look, most frequent first. commands as from with_kind, or with_keys.

    One aggregation over the commands; hot keys and SET followed by EXPIRE are
    aggregates of their own. Large values, ranges over
    a whole list and keys across slots need the columns args and keys.
    """
    name = F.col("command")
    tests = {
        "keys": name == "KEYS", "flush": name.isin("FLUSHALL", "FLUSHDB"), "whole": name.isin(*WHOLE),
        "eval": name.isin("EVAL", "EVAL_RO"), "setup": name.isin(*SETUP), "databases": (F.col("db") != 0) & (name != "SELECT"), "unknown": F.col("unknown"),
    }
    if "args" in commands.columns:
        whole_range = name.isin(*RANGES) & (F.get("args", F.lit(2)) == "0") & (F.get("args", F.lit(3)) == "-1")
        tests["whole"] = tests["whole"] | F.coalesce(whole_range, F.lit(False))
        tests["large"] = F.exists("args", lambda a: F.length(a) >= LARGE)
    if "keys" in commands.columns:
        tests["cross-slot"] = (F.size("keys") > 1) & crosses_slots(F.col("keys"))
    scripts = F.count_if((F.col("kind") == "script") & name.rlike("^(EVAL|FCALL)"))
    sums = commands.agg(*[F.count_if(t).alias(n) for n, t in tests.items()], scripts.alias("_scripts"), F.count("*").alias("_all"))
    told = {n: F.col(n) > 0 for n in tests}
    told["eval"] = (F.col("eval") >= 10) & (2 * F.col("eval") > F.col("_scripts"))
    told["setup"] = (F.col("setup") >= 20) & (10 * F.col("setup") >= F.col("_all"))
    one = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), told[n].alias("told"), F.col(n).alias("n")) for n in tests])).alias("x")).where("x.told").select("x.finding", "x.n")
    total = F.col("reads") + F.col("writes") + F.col("deletes")
    hot = key_accesses(commands).agg(F.max(total).alias("n"), F.sum(total).alias("everything")).where("everything >= 100 and 10 * n >= everything").select(F.lit("hot-key").alias("finding"), "n")
    expire = set_then_expire(commands).agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("set-expire").alias("finding"), "n")
    level = F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p])
    place = F.array_position(F.array(*[F.lit(n) for n in LEVELS]), F.col("finding"))
    return one.union(hot).union(expire).orderBy(F.desc("n"), place).select("finding", level[F.col("finding")].alias("level"), "n")


#: Accesses of a chunk of the time axis, and chunks at most: longer captures get longer chunks.
CHUNK, MOST_CHUNKS = 1 << 16, 2048


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, how many before it are smaller. Ranks are split bit by bit, all at once."""
    n = values.size
    rank = np.empty(n, np.int64)
    rank[np.lexsort((-np.arange(n), values))] = np.arange(n)
    out, order = np.zeros(n, np.int64), np.arange(n)
    for k in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        own = rank[order]
        bit, group = (own >> k) & 1, own >> (k + 1)
        zeros = np.cumsum(1 - bit)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.repeat(zeros[starts] - (1 - bit[starts]), np.diff(np.append(starts, n)))
        out[order] += np.where(bit == 1, zeros - before, 0)
        order = order[np.argsort(own >> k, kind="stable")]
    return out


def _neighbours(accesses: DataFrame) -> DataFrame:
    """capture, t, key, chunk, prev, next (of the same key). A key's uses are ordered within chunks; its chunks, a row each, tell the rest."""
    inside = Window.partitionBy("capture", "key", "chunk").orderBy("t")
    rows = accesses.withColumn("prev", F.lag("t").over(inside)).withColumn("next", F.lead("t").over(inside))
    chunks = accesses.groupBy("capture", "key", "chunk").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    along = Window.partitionBy("capture", "key").orderBy("chunk")
    chunks = chunks.select("capture", "key", "chunk", F.lag("last").over(along).alias("came"), F.lead("first").over(along).alias("comes"))
    rows = rows.join(chunks, ["capture", "key", "chunk"])
    return rows.select("capture", "t", "key", "chunk", F.coalesce("prev", "came").alias("prev"), F.coalesce("next", "comes").alias("next"))


def stack_distances(accesses: DataFrame) -> DataFrame:
    """accesses(capture, t, key), t in order -> capture, t, key, distance: distinct other keys used since the last use (null: first use).

    distance = keys known at t - 1 - |{j < p: next(j) > t}| with p the last use. The
    time axis is cut into chunks, and the j are told apart by theirs: those of p's
    chunk are counted in a task for that chunk (next uses larger than p's own), those
    of earlier chunks whose next use is in t's chunk in a task for that one, and the
    rest from a table of counts by pairs of chunks, of at most MOST_CHUNKS squared
    rows. A task holds one chunk, so no task sees a capture, and no pair of accesses
    is ever formed.
    """
    longest = accesses.groupBy("capture").agg((F.max("t") - F.min("t") + 1).alias("n")).agg(F.max("n")).first()[0] or 1
    size = max(CHUNK, -(-longest // MOST_CHUNKS))
    a = cut(_neighbours(accesses.withColumn("chunk", F.floor(F.col("t") / size))))

    def of_time(pdf: pd.DataFrame) -> pd.DataFrame:
        """Uses before t in the chunk that were first ones; later uses in it whose last use is in an earlier chunk than t's last one."""
        pdf = pdf.sort_values("t", ignore_index=True)
        fresh = pdf["prev"].isna().to_numpy()
        again = np.flatnonzero(~fresh)
        since = np.floor_divide(pdf["prev"].to_numpy()[again].astype(np.int64), size)
        counted = np.zeros(len(pdf), np.int64)
        counted[again[::-1]] = smaller_before(since[::-1])
        return pd.DataFrame({"capture": pdf["capture"], "t": pdf["t"], "key": pdf["key"], "prev": pdf["prev"].astype("Int64"), "fresh": np.cumsum(fresh) - fresh, "later": counted})

    def of_last_use(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each use with a next one: earlier uses of the chunk whose next one is later or never."""
        pdf = pdf.sort_values("t", ignore_index=True)
        following = pdf["next"].fillna(np.inf).to_numpy(np.float64)
        counted = smaller_before(-following)
        on = np.isfinite(following)
        return pd.DataFrame({"capture": pdf["capture"][on], "t": following[on].astype(np.int64), "near": counted[on]})

    kinds = {f.name: f.dataType.simpleString() for f in a.schema}
    first = a.groupBy("capture", "chunk").applyInPandas(of_time, f"capture {kinds['capture']}, t long, key {kinds['key']}, prev long, fresh long, later long")
    second = a.groupBy("capture", "chunk").applyInPandas(of_last_use, f"capture {kinds['capture']}, t long, near long")
    last_chunk = F.floor(F.col("prev") / size)
    # By pairs of chunks (i of a use, j of its next one): uses before chunk i whose next one is after chunk j.
    so_far = Window.partitionBy("capture").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = a.groupBy("capture", "chunk").agg(F.count("*").alias("n"), F.count_if(F.col("prev").isNull()).alias("new"))
    chunks = cut(chunks.select("capture", "chunk", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("uses"), F.coalesce(F.sum("new").over(so_far), F.lit(0)).alias("known")))
    counts = a.where("prev is not null").groupBy("capture", last_chunk.alias("i"), F.col("chunk").alias("j")).agg(F.count("*").alias("n"))
    bounds = chunks.groupBy("capture").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    cells = chunks.select("capture", F.col("chunk").alias("i")).join(bounds, "capture").select("capture", "i", F.explode(F.sequence("i", "high")).alias("j"))
    up_to = Window.partitionBy("capture", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.partitionBy("capture", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    grid = cells.join(counts, ["capture", "i", "j"], "left").withColumn("ended", F.sum(F.coalesce("n", F.lit(0))).over(up_to))
    grid = grid.select("capture", "i", "j", F.coalesce(F.sum("ended").over(below), F.lit(0)).alias("ended"))
    grid = grid.join(chunks.select("capture", F.col("chunk").alias("i"), "uses"), ["capture", "i"]).select("capture", "i", "j", (F.col("uses") - F.col("ended")).alias("open"))
    rows = first.withColumn("i", last_chunk).withColumn("j", F.floor(F.col("t") / size)).join(second, ["capture", "t"], "left").join(grid, ["capture", "i", "j"], "left")
    rows = rows.join(chunks.select("capture", F.col("chunk").alias("j"), "known"), ["capture", "j"])
    old = F.col("open") + F.col("later") + F.col("near")
    return rows.select("capture", "t", "key", F.when(F.col("prev").isNotNull(), F.col("known") + F.col("fresh") - 1 - old).alias("distance"))


def hit_curve(distances: DataFrame) -> DataFrame:
    """capture, size, hits: accesses that an LRU cache of each size serves; sizes where the curve rises."""
    per = distances.where("distance is not null").groupBy("capture", (F.col("distance") + 1).alias("size")).agg(F.count("*").alias("n"))
    return per.select("capture", "size", F.sum("n").over(Window.partitionBy("capture").orderBy("size")).alias("hits"))

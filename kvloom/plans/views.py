"""Keys, command traffic, documents and graphs derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table

#: What each kind of event does to the store.
COMMANDS = {"view": "GET", "click": "HGETALL", "purchase": "SET", "signup": "HSET", "error": "DEL"}


def keys(spark: SparkSession, d: str) -> DataFrame:
    """key_idx, key: order keys, hash-tagged carts, one key per user and kind of event."""
    orders, events = table(spark, d, "orders"), table(spark, d, "events")
    text = lambda c: F.col(c).cast("string")
    return (
        orders.select(F.col("o_orderkey").alias("key_idx"), F.concat(F.lit("order:"), text("o_custkey"), F.lit(":"), text("o_orderkey")).alias("key"))
        .union(events.select(F.col("event_id") + 1_000_000_000, F.concat(F.lit("cart:{"), text("user_id"), F.lit("}:items"))))
        .union(events.select(F.col("event_id") + 2_000_000_000, F.concat(F.lit("user:"), text("user_id"), F.lit(":"), F.col("event_type"))))
    )


KEYS = """keys AS (
  SELECT o_orderkey AS key_idx, 'order:' || CAST(o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS key FROM orders
  UNION ALL SELECT 1000000000 + event_id, 'cart:{' || CAST(user_id AS VARCHAR) || '}:items' FROM events
  UNION ALL SELECT 2000000000 + event_id, 'user:' || CAST(user_id AS VARCHAR) || ':' || event_type FROM events)"""

#: CRC-16 table by eight recursive steps, and slots of keys.
SLOTS = f"""RECURSIVE step(i, c, n) AS (
  SELECT i, i * 256, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN (c & 32768) <> 0 THEN xor((c * 2) & 65535, 4129) ELSE (c * 2) & 65535 END, n + 1 FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM step WHERE n = 8),
{KEYS},
tagged AS (SELECT key_idx, key, regexp_matches(key, '^[^{{]*\\{{[^}}]+\\}}') AS is_tagged,
  CASE WHEN regexp_matches(key, '^[^{{]*\\{{[^}}]+\\}}') THEN regexp_extract(key, '^[^{{]*\\{{([^}}]+)\\}}', 1) ELSE key END AS hk FROM keys),
slots AS (SELECT key_idx, key, is_tagged, hk, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(hk, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor((c * 256) & 65535, l[(xor(c // 256, b) & 255) + 1])) % 16384 AS INTEGER) AS slot FROM tagged, tab)"""


def traffic(spark: SparkSession, d: str) -> DataFrame:
    """line_no, sec, usec, db, client, command, key: one command of each event."""
    e = table(spark, d, "events")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    command = F.create_map(*[F.lit(x) for pair in COMMANDS.items() for x in pair])[F.col("event_type")]
    return e.select(
        F.col("event_id").alias("line_no"),
        seconds.alias("sec"),
        F.when(F.col("event_type") == "error", 2).otherwise(0).alias("db"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string"), F.lit(":"), F.col("user_id").cast("string")).alias("client"),
        command.alias("command"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        "value",
    )


TRAFFIC = """traffic AS (SELECT event_id AS line_no, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
  CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS db,
  '10.0.0.' || CAST(user_id % 7 AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) AS client,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'HGETALL' WHEN 'purchase' THEN 'SET' WHEN 'signup' THEN 'HSET' WHEN 'error' THEN 'DEL' END AS command,
  'user:' || CAST(user_id AS VARCHAR) AS key, value FROM events)"""


#: Common commands by what they do (r: read, w: write, p: publish and subscribe, x: script). A longer table is a parameter.
COMMON = {
    "r": "GET MGET STRLEN GETRANGE EXISTS TTL PTTL TYPE HGET HMGET HGETALL HKEYS HVALS HLEN HEXISTS LRANGE LLEN LINDEX SMEMBERS SISMEMBER SCARD SUNION SINTER SDIFF ZRANGE ZREVRANGE ZSCORE ZRANK ZCARD ZCOUNT XRANGE XLEN",
    "w": "SET SETNX MSET GETSET GETDEL APPEND INCR DECR INCRBY DECRBY DEL UNLINK EXPIRE PEXPIRE EXPIREAT PEXPIREAT PERSIST RENAME HSET HMSET HDEL HINCRBY LPUSH RPUSH LPOP RPOP LTRIM SADD SREM SPOP ZADD ZREM ZINCRBY XADD XTRIM XREADGROUP SORT GEORADIUS",
    "p": "PUBLISH SUBSCRIBE UNSUBSCRIBE PSUBSCRIBE",
    "x": "EVAL EVALSHA FCALL",
    "": "PING SELECT AUTH HELLO INFO MULTI EXEC DISCARD KEYS SCAN FLUSHALL FLUSHDB",
}
_ROWS = [(name, flags) for flags, names in COMMON.items() for name in names.split()]


def dimension(spark: SparkSession, path: str | None = None) -> DataFrame:
    """name, flags: commands that traffic is looked up in: a table file of these columns (all commands of a server), or the common ones."""
    return spark.read.parquet(path).select("name", "flags") if path else spark.createDataFrame(_ROWS, "name string, flags string")


#: First, last and step of keys where they are not 1, 1, 1.
PLACES = {
    "MGET": (1, -1, 1), "MSET": (1, -1, 2), "DEL": (1, -1, 1), "UNLINK": (1, -1, 1), "EXISTS": (1, -1, 1), "RENAME": (1, 2, 1),
    "SUNION": (1, -1, 1), "SINTER": (1, -1, 1), "SDIFF": (1, -1, 1),
}
SUBCOMMANDS = ("CLIENT SETNAME", "CLIENT SETINFO")


def command_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """name, flags, first, last, step: a table file of these columns (all commands of a server), or the common ones."""
    if path:
        return spark.read.parquet(path).select("name", "flags", "first", "last", "step")
    rows = [(n, f, *(PLACES.get(n, (1, 1, 1)) if f in ("r", "w") else (0, 0, 0))) for n, f in _ROWS] + [(n, "", 0, 0, 0) for n in SUBCOMMANDS]
    return spark.createDataFrame(rows, "name string, flags string, first int, last int, step int")


def argument_lines(spark: SparkSession, d: str) -> DataFrame:
    """line_no, db, client, args: commands whose keys are told by counts and options, one of each event; some scripts are large."""
    e = table(spark, d, "events")
    user = lambda prefix, add=0: F.concat(F.lit(prefix), (F.col("user_id") + add).cast("string"))
    words = lambda *w: F.array(*[F.lit(x) if isinstance(x, str) else x for x in w])
    script = F.when(F.col("event_id") % 500 == 0, F.repeat(F.lit("x"), F.lit(102400))).otherwise("return 1")
    kind = F.col("event_type")
    args = (
        F.when(kind == "view", words("mget", user("user:"), user("user:", 1)))
        .when(kind == "click", words("XREADGROUP", "GROUP", "STREAMS", "c", "COUNT", "1", "STREAMS", F.concat(user("s:{"), F.lit("}:a")), F.concat(user("s:{"), F.lit("}:b")), ">", ">"))
        .when(kind == "purchase", words("EVAL", script, "2", user("cart:"), F.concat(F.lit("stock:"), (F.col("user_id") % 10).cast("string")), "2"))
        .when(kind == "signup", words("SORT", user("list:"), "BY", "STORE", "LIMIT", "0", "5", "STORE", user("out:")))
        .otherwise(words("GEORADIUS", user("geo:"), "1", "2", "3", "km", "STORE", user("geo:")))
    )
    client = F.when(F.col("user_id") % 11 == 0, "lua").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string"), F.lit(":"), F.col("user_id").cast("string")))
    return e.select(F.col("event_id").alias("line_no"), F.lit(0).alias("db"), client.alias("client"), args.alias("args"))


#: The same commands with the keys that they have, written out by hand.
ARGUMENT_LINES = """calls AS (SELECT event_id AS key_idx, CASE WHEN user_id % 11 = 0 THEN 'lua' ELSE '10.0.0.' || CAST(user_id % 7 AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) END AS client,
  CASE event_type WHEN 'view' THEN 'MGET' WHEN 'click' THEN 'XREADGROUP' WHEN 'purchase' THEN 'EVAL' WHEN 'signup' THEN 'SORT' ELSE 'GEORADIUS' END AS command,
  CASE event_type WHEN 'view' THEN ['user:' || user_id, 'user:' || (user_id + 1)] WHEN 'click' THEN ['s:{' || user_id || '}:a', 's:{' || user_id || '}:b']
    WHEN 'purchase' THEN ['cart:' || user_id, 'stock:' || (user_id % 10)] WHEN 'signup' THEN ['list:' || user_id, 'out:' || user_id] ELSE ['geo:' || user_id, 'geo:' || user_id] END AS names,
  CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 38 WHEN 'purchase' THEN 6 + CASE WHEN event_id % 500 = 0 THEN 102400 ELSE 8 END WHEN 'signup' THEN 23 ELSE 19 END AS words,
  event_type = 'purchase' AND event_id % 500 = 0 AS large FROM events),
keys AS (SELECT key_idx, unnest(names) AS key FROM calls)"""

DIMENSION = "dimension(name, flags) AS (VALUES " + ", ".join(f"('{n}','{f}')" for n, f in _ROWS) + ")"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """src, type, dst: customer -> nation -> region, order -> customer."""
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return (
        o.select(name("order:", "o_orderkey").alias("src"), F.lit("placed_by").alias("type"), name("customer:", "o_custkey").alias("dst"))
        .union(c.select(name("customer:", "c_custkey"), F.lit("lives_in"), name("nation:", "c_nationkey")))
        .union(n.select(name("nation:", "n_nationkey"), F.lit("part_of"), name("region:", "n_regionkey")))
    )


EDGES = """edges AS (SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS src, 'placed_by' AS type, 'customer:' || CAST(o_custkey AS VARCHAR) AS dst FROM orders
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'lives_in', 'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), 'part_of', 'region:' || CAST(n_regionkey AS VARCHAR) FROM nation)"""


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """key, main, sub, deleted, bytes, value: lineitems as records of a versioned store."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("/registry/parts/"), F.col("l_partkey").cast("string")).alias("key"),
        F.col("l_orderkey").alias("main"), F.col("l_linenumber").alias("sub"), F.col("l_suppkey").alias("supp"),
        (F.col("l_returnflag") == "R").alias("deleted"), F.col("l_quantity").cast("long").alias("size"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit("|"), F.col("l_linestatus")).alias("value"),
    )


REVISIONS = """revisions AS (SELECT '/registry/parts/' || CAST(l_partkey AS VARCHAR) AS key, l_orderkey AS main, l_linenumber AS sub, l_suppkey AS supp,
  l_returnflag = 'R' AS deleted, CAST(l_quantity AS BIGINT) AS size, CAST(l_suppkey AS VARCHAR) || '|' || l_linestatus AS value FROM lineitem)"""

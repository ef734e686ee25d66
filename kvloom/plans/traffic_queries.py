"""Queries over command traffic, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.commands import crosses_slots
from ..operators import slots, traffic
from ..streaming import traffic as stream
from . import views
from .views import DIMENSION, TRAFFIC

KIND = f"""{TRAFFIC}, {DIMENSION}, kinds AS (SELECT t.*, d.name IS NULL AS unknown,
  CASE WHEN flags IS NULL THEN 'other' WHEN contains(flags, 'x') THEN 'script' WHEN contains(flags, 'p') THEN 'pubsub' WHEN contains(flags, 'w') THEN 'write' WHEN contains(flags, 'r') THEN 'read' ELSE 'other' END AS kind
  FROM traffic t LEFT JOIN dimension d ON upper(t.command) = d.name),
acc AS (SELECT db, key, count_if(command <> 'DEL' AND kind = 'read') AS reads, count_if(command <> 'DEL' AND kind = 'write') AS writes, count_if(command = 'DEL') AS deletes
  FROM kinds WHERE kind IN ('read', 'write') GROUP BY db, key)"""
#: Connections as the window queries see them: every third event of a user is EXPIRE, MULTI and EXEC come by number.
LINES = """lines AS (SELECT event_id AS line_no, CAST(user_id AS VARCHAR) AS client, user_id % 5 AS db, 'k' || CAST(event_id // 40 % 3 AS VARCHAR) AS key,
  CASE event_type WHEN 'view' THEN 'SET' WHEN 'click' THEN 'EXPIRE' WHEN 'purchase' THEN 'MULTI' WHEN 'signup' THEN 'EXEC' ELSE 'EVAL' END AS command FROM events)"""


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return traffic.with_kind(views.traffic(spark, d), views.dimension(spark))


def _accesses(spark, d):
    return traffic.key_accesses(_kinds(spark, d))


def _lines(spark, d):
    e = views.table(spark, d, "events")
    names = {"view": "SET", "click": "EXPIRE", "purchase": "MULTI", "signup": "EXEC"}
    command = F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("event_type")], F.lit("EVAL"))
    key = F.concat(F.lit("k"), F.expr("(event_id div 40) % 3").cast("string"))
    return e.select(F.col("event_id").alias("line_no"), F.col("user_id").cast("string").alias("client"), (F.col("user_id") % 5).alias("db"), key.alias("key"), command.alias("command"), F.when(command == "EVAL", "script").otherwise("other").alias("kind"))


def joi_02_command_dimension(spark, d):
    return _kinds(spark, d).groupBy("command", "kind", "unknown").agg(F.count("*").alias("n"))


def agg_08_traffic_totals(spark, d):
    return traffic.totals(_kinds(spark, d))


def agg_09_key_accesses(spark, d):
    return _accesses(spark, d)


def srt_03_busiest_keys(spark, d):
    return traffic.busiest_keys(_accesses(spark, d))


def agg_10_pattern_rollup(spark, d):
    return traffic.pattern_rollup(_accesses(spark, d))


def agg_11_slot_spread(spark, d):
    return traffic.slot_spread(_accesses(spark, d), slots.layout(spark, 3))


def agg_12_hot_keys(spark, d):
    return traffic.findings(_accesses(spark, d), share=0.005, least=20)


def agg_12_findings(spark, d):
    return traffic.traffic_findings(_kinds(spark, d))


def agg_13_series(spark, d):
    return traffic.series(views.traffic(spark, d))


def agg_14_peak_second(spark, d):
    return traffic.peak_second(views.traffic(spark, d))


def fn_16_hosts(spark, d):
    return views.traffic(spark, d).groupBy(traffic.client_host(F.col("client")).alias("host")).agg(F.count("*").alias("n"))


def joi_14_set_then_expire(spark, d):
    return traffic.set_then_expire(_lines(spark, d))


def win_03_transactions(spark, d):
    return traffic.in_transaction(_lines(spark, d)).groupBy("client", "in_multi").agg(F.count("*").alias("n"))


def joi_15_last_script(spark, d):
    return traffic.last_script_client(_lines(spark, d)).groupBy("caller").agg(F.count("*").alias("n"))


def _reads(spark, d):
    e = views.table(spark, d, "events")
    return e.select(F.lit(0).alias("capture"), F.col("event_id").alias("t"), F.concat("event_type", F.lit(":"), (F.col("user_id") % 40).cast("string")).alias("key"))


def win_07_stack_distance(spark, d):
    return traffic.stack_distances(_reads(spark, d)).groupBy("distance").agg(F.count("*").alias("n"))


def win_07_hit_curve(spark, d):
    return traffic.hit_curve(traffic.stack_distances(_reads(spark, d))).select("size", "hits")


def _calls(spark, d):
    return traffic.with_keys(views.argument_lines(spark, d), views.command_table(spark))


def fn_12_special_keys(spark, d):
    return _calls(spark, d).select("command", F.explode("keys").alias("key")).groupBy("command", "key").agg(F.count("*").alias("n"))


def fn_14_cross_slot(spark, d):
    crossed = (F.size("keys") > 1) & crosses_slots(F.col("keys"))
    return _calls(spark, d).groupBy("command").agg(F.count("*").alias("n"), F.count_if(crossed).alias("crossed"))


def agg_08_volumes(spark, d):
    return traffic.volumes(_calls(spark, d))


def agg_12_argument_findings(spark, d):
    return traffic.traffic_findings(_calls(spark, d))


def str_03_tumbling_seconds(spark, d):
    return stream.windowed_counts(spark, d)


QUERIES = {f.__name__: f for f in (
    joi_02_command_dimension, agg_08_traffic_totals, agg_09_key_accesses, srt_03_busiest_keys, agg_10_pattern_rollup, agg_11_slot_spread, agg_12_hot_keys, agg_12_findings, agg_13_series,
    agg_14_peak_second, fn_16_hosts, joi_14_set_then_expire, win_03_transactions, joi_15_last_script, win_07_stack_distance, win_07_hit_curve, str_03_tumbling_seconds, fn_12_special_keys, fn_14_cross_slot,
    agg_08_volumes, agg_12_argument_findings,
)}

HOST = "regexp_replace(client, ':[0-9]+$', '')"
SPAN = "span AS (SELECT min(sec) AS f, max(sec) AS l FROM traffic)"
STEPS = " ".join(f"WHEN (l - f) // {s} + 1 < 1500 THEN {s}" for s in traffic.LADDER)
STACK = """a AS (SELECT event_id AS t, event_type || ':' || CAST(user_id % 40 AS VARCHAR) AS key FROM events),
n AS (SELECT t, key, lag(t) OVER (PARTITION BY key ORDER BY t) AS p, coalesce(lead(t) OVER (PARTITION BY key ORDER BY t), 1000000000000) AS x FROM a),
dist AS (SELECT n.t, CASE WHEN n.p IS NULL THEN NULL ELSE count(j.t) END AS distance FROM n LEFT JOIN n j ON j.t > n.p AND j.t < n.t AND j.x > n.t GROUP BY n.t, n.p)"""

CALL_SLOTS = views.SLOTS.replace(views.KEYS, views.ARGUMENT_LINES)
CROSSED = f"{CALL_SLOTS}, crossing AS (SELECT key_idx, count(DISTINCT slot) > 1 AS crossed FROM slots GROUP BY key_idx)"
VOLUME = "count(*) AS n, CAST(sum(words + length(names[1]) + length(names[2])) AS BIGINT) AS bytes, count(DISTINCT client) FILTER (client <> 'lua') AS connections FROM calls GROUP BY 2"

ORACLES = {
    "fn_12_special_keys": f"WITH {views.ARGUMENT_LINES} SELECT command, key, count(*) AS n FROM calls JOIN keys USING (key_idx) GROUP BY ALL",
    "fn_14_cross_slot": f"WITH {CROSSED} SELECT command, count(*) AS n, CAST(count_if(crossed) AS BIGINT) AS crossed FROM calls JOIN crossing USING (key_idx) GROUP BY command",
    "agg_08_volumes": f"WITH {views.ARGUMENT_LINES} SELECT 'command' AS dimension, command AS item, {VOLUME} UNION ALL SELECT 'host', {HOST}, {VOLUME}",
    "agg_12_argument_findings": f"""WITH {CROSSED}, u AS (SELECT key, count(*) AS n FROM keys JOIN calls USING (key_idx) WHERE command <> 'EVAL' GROUP BY key), h AS (SELECT max(n) AS n, sum(n) AS everything FROM u)
SELECT 'large' AS finding, 'warn' AS level, count(*) AS n FROM calls WHERE large HAVING count(*) > 0 UNION ALL SELECT 'cross-slot', 'warn', count(*) FROM crossing WHERE crossed HAVING count(*) > 0
UNION ALL SELECT 'hot-key', 'warn', n FROM h WHERE everything >= 100 AND 10 * n >= everything UNION ALL SELECT 'eval', 'info', count(*) FROM calls WHERE command = 'EVAL' HAVING count(*) >= 10""",
    "joi_02_command_dimension": f"WITH {KIND} SELECT command, kind, unknown, count(*) AS n FROM kinds GROUP BY ALL",
    "agg_08_traffic_totals": f"""WITH {KIND} SELECT 'command' AS dimension, command AS item, count(*) AS n FROM kinds GROUP BY 2
UNION ALL SELECT 'kind', kind, count(*) FROM kinds GROUP BY 2 UNION ALL SELECT 'db', CAST(db AS VARCHAR), count(*) FROM kinds GROUP BY 2
UNION ALL SELECT 'host', {HOST}, count(*) FROM kinds GROUP BY 2 UNION ALL SELECT 'second', CAST(sec AS VARCHAR), count(*) FROM kinds GROUP BY 2""",
    "agg_09_key_accesses": f"WITH {KIND} SELECT * FROM acc",
    "srt_03_busiest_keys": f"WITH {KIND} SELECT *, reads + writes + deletes AS total FROM acc ORDER BY total DESC, db, key LIMIT 10",
    "agg_10_pattern_rollup": f"""WITH {KIND} SELECT 'user:<id>' AS pattern, count(*) AS keys, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(writes) AS BIGINT) AS writes, CAST(sum(deletes) AS BIGINT) AS deletes,
  count_if(reads = 1 AND writes = 0 AND deletes = 0) AS read_once FROM acc""",
    "agg_11_slot_spread": f"""WITH {views.SLOTS.replace(views.KEYS, "keys AS (SELECT row_number() OVER () AS key_idx, 'user:' || CAST(user_id AS VARCHAR) AS key FROM (SELECT DISTINCT user_id FROM events))")},
{KIND}, nodes(node, lo, hi) AS (VALUES (1, 0, 5460), (2, 5461, 10922), (3, 10923, 16383))
SELECT CAST(node AS INTEGER) AS node, CAST(sum(reads + writes + deletes) AS BIGINT) AS accesses, count(*) AS keys FROM acc JOIN slots USING (key) JOIN nodes ON slot BETWEEN lo AND hi GROUP BY node""",
    "agg_12_hot_keys": f"""WITH {KIND} SELECT db, key, reads + writes + deletes AS total FROM acc
WHERE reads + writes + deletes >= 20 AND reads + writes + deletes >= 0.005::DOUBLE * (SELECT sum(reads + writes + deletes) FROM acc)""",
    "agg_12_findings": f"""WITH {KIND}, h AS (SELECT max(reads + writes + deletes) AS n, sum(reads + writes + deletes) AS everything FROM acc)
SELECT 'whole' AS finding, 'info' AS level, count(*) AS n FROM kinds WHERE command = 'HGETALL' HAVING count(*) > 0
UNION ALL SELECT 'databases', 'info', count(*) FROM kinds WHERE db <> 0 HAVING count(*) > 0
UNION ALL SELECT 'hot-key', 'warn', n FROM h WHERE everything >= 100 AND 10 * n >= everything
UNION ALL SELECT 'unknown', 'info', count(*) FROM kinds WHERE unknown HAVING count(*) > 0""",
    "agg_13_series": f"""WITH {TRAFFIC}, {SPAN}, st AS (SELECT f, l, CASE {STEPS} ELSE 86400 END AS s FROM span),
g AS (SELECT unnest(range(f, l + 1, s)) AS bucket FROM st), c AS (SELECT f + (sec - f) // s * s AS bucket, count(*) AS n FROM traffic, st GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (bucket)""",
    "agg_14_peak_second": f"WITH {TRAFFIC}, {SPAN} SELECT sec, count(*) AS n FROM traffic, span WHERE sec > f AND sec < l GROUP BY sec ORDER BY n DESC, sec LIMIT 1",
    "fn_16_hosts": f"WITH {TRAFFIC} SELECT {HOST} AS host, count(*) AS n FROM traffic GROUP BY 1",
    "joi_14_set_then_expire": f"""WITH {LINES}, m AS (SELECT *, coalesce(last(CASE command WHEN 'MULTI' THEN true WHEN 'EXEC' THEN false END IGNORE NULLS) OVER (PARTITION BY client ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS multi FROM lines),
w AS (SELECT client, command, key, lag(command) OVER (PARTITION BY client ORDER BY line_no) AS b, lag(key) OVER (PARTITION BY client ORDER BY line_no) AS kb, lag(multi) OVER (PARTITION BY client ORDER BY line_no) AS mb FROM m)
SELECT client, count(*) AS n FROM w WHERE b = 'SET' AND NOT mb AND command = 'EXPIRE' AND key = kb GROUP BY client""",
    "win_03_transactions": f"""WITH {LINES}, w AS (SELECT client, last(CASE command WHEN 'MULTI' THEN true WHEN 'EXEC' THEN false END IGNORE NULLS) OVER (PARTITION BY client ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lines)
SELECT client, coalesce(m, false) AS in_multi, count(*) AS n FROM w GROUP BY ALL""",
    "joi_15_last_script": f"""WITH {LINES}, w AS (SELECT last(CASE WHEN command = 'EVAL' THEN client END IGNORE NULLS) OVER (PARTITION BY db ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caller FROM lines)
SELECT caller, count(*) AS n FROM w GROUP BY caller""",
    "win_07_stack_distance": f"WITH {STACK} SELECT distance, count(*) AS n FROM dist GROUP BY distance",
    "win_07_hit_curve": f"WITH {STACK}, c AS (SELECT distance + 1 AS size, count(*) AS n FROM dist WHERE distance IS NOT NULL GROUP BY 1) SELECT size, CAST(sum(n) OVER (ORDER BY size) AS BIGINT) AS hits FROM c",
    "str_03_tumbling_seconds": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

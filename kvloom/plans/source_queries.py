"""Queries over the text sources: lines are derived from the driver's tables and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import records, text as sources
from . import views
from .views import EDGES, TRAFFIC


def _text(c: str):
    return F.col(c).cast("string")


def src_01_key_list(spark, d):
    """Numbered and quoted keys, as a command line shows them."""
    p = views.table(spark, d, "part")
    line = F.concat(_text("p_partkey"), F.lit(') "'), F.col("p_name"), F.lit('\\x21\\""\r'))
    lines = p.select(F.when(F.col("p_partkey") % 3 == 0, line).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("  7) "), F.col("p_name"))).alias("value"))
    return sources.key_list(spark, lines).groupBy(F.decode("key", "UTF-8").alias("key")).agg(F.count("*").alias("n"))


def src_02_plain_keys(spark, d):
    """The same lines as they are: only line ends and blank lines go."""
    p = views.table(spark, d, "part")
    lines = p.select(F.when(F.col("p_partkey") % 5 == 0, F.lit("\r")).otherwise(F.concat(_text("p_partkey"), F.lit(') "'), F.col("p_name"), F.lit('"'))).alias("value"))
    return sources.key_list(spark, lines, raw=True).select(F.decode("key", "UTF-8").alias("key"))


def _monitor(spark, d):
    t = views.traffic(spark, d)
    good = F.concat(F.lpad(_text("sec"), 10, "0"), F.lit(".000042 ["), _text("db"), F.lit(" "), F.col("client"), F.lit('] "'), F.col("command"), F.lit('" "'), F.col("key"), F.lit('\\x0a\\""'))
    return t.select("line_no", F.when(F.col("line_no") % 10 == 0, F.concat(F.lit("-ERR "), F.col("key"))).when(F.col("line_no") % 10 == 1, "OK").otherwise(good).alias("value"))


def src_04_commands(spark, d):
    """A capture's lines: time, database, client, host and arguments; lines of other kinds give none."""
    c = sources.commands(_monitor(spark, d))
    return c.select("line_no", "sec", "usec", "db", "host", F.element_at("args", 1).alias("command"), F.element_at("args", 2).alias("key"))


def src_04_bad_lines(spark, d):
    return sources.bad_lines(_monitor(spark, d)).select("line_no", "value")


def src_06_cluster_nodes(spark, d):
    """Slot ranges of masters from a layout's lines."""
    s = views.table(spark, d, "supplier")
    role = F.when(F.col("s_suppkey") % 4 == 0, "slave").when(F.col("s_suppkey") % 4 == 1, "myself,master").otherwise("master")
    ranges = F.concat(_text("s_suppkey"), F.lit("-"), (F.col("s_suppkey") + 5).cast("string"), F.lit(" "), (F.col("s_suppkey") + 9).cast("string"), F.lit(" [77->-abc]"))
    line = F.concat(F.lit("id"), _text("s_suppkey"), F.lit(" 10.0.0.1:7000@17000 "), role, F.lit(" - 0 0 1 connected "), ranges)
    return sources.cluster_nodes(s.select(line.alias("value")))


def src_07_cluster_errors(spark, d):
    s = views.table(spark, d, "supplier")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("id"), _text("s_suppkey"), F.lit(" short"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("id"), _text("s_suppkey"), F.lit(" a:1@2 king - 0 0 1 connected"))).otherwise("id a:1@2 master - 0 0 1 connected")
    return sources.cluster_errors(s.select(line.alias("value"))).groupBy("problem").agg(F.count("*").alias("n"))


def src_10_edge_list(spark, d):
    e = views.edges(spark, d)
    line = F.when(F.startswith("src", F.lit("order")), F.concat_ws(" ", "src", "type", "dst", F.lit("# placed"))).when(F.startswith("src", F.lit("customer")), F.concat_ws(" , ", "src", "type", "dst")).otherwise(F.concat_ws(" ", "src", "dst"))
    return sources.edge_list(e.select(line.alias("value")))


def src_18_json_lines(spark, d):
    """Lines that are JSON, counted beside those that are not."""
    e = views.table(spark, d, "events")
    lines = e.select(F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).when(F.col("event_id") % 7 == 1, F.lit("  ")).otherwise(F.col("props")).alias("value"))
    return records.json_records(lines).agg(F.count("record").alias("records"), F.count("error").alias("errors"))


def src_19_wrapped(spark, d):
    """Documents in lists, wrapped one by one, and bare."""
    o = views.table(spark, d, "orders")
    one = F.concat(F.lit('{"k": '), _text("o_orderkey"), F.lit("}"))
    k = F.col("o_orderkey") % 4
    doc = F.when(k == 0, F.concat(F.lit('{"Item": '), one, F.lit("}"))).when(k == 1, F.concat(F.lit('{"Items": ['), one, F.lit(", "), one, F.lit("]}"))).when(k == 2, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    return records.unwrapped(o.select(F.parse_json(doc).alias("record"))).groupBy(F.try_variant_get("item", "$.k", "long").alias("k")).agg(F.count("*").alias("n"))


def src_20_command_file(spark, d):
    p = views.table(spark, d, "part")
    lines = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  # "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.lit(" ")).otherwise(F.concat(F.lit(" SET "), F.col("p_name"), F.lit(" 1 "))).alias("value"))
    return records.command_file(lines)


QUERIES = {f.__name__: f for f in (
    src_01_key_list, src_02_plain_keys, src_04_commands, src_04_bad_lines, src_06_cluster_nodes, src_07_cluster_errors, src_10_edge_list, src_18_json_lines, src_19_wrapped, src_20_command_file,
)}

ORACLES = {
    "src_01_key_list": """SELECT key, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name || '!"' ELSE p_name END AS key FROM part) GROUP BY key""",
    "src_02_plain_keys": """SELECT CAST(p_partkey AS VARCHAR) || ') "' || p_name || '"' AS key FROM part WHERE p_partkey % 5 <> 0""",
    "src_04_commands": f"""WITH {TRAFFIC} SELECT line_no, sec, CAST(42 AS INTEGER) AS usec, CAST(db AS INTEGER) AS db, regexp_replace(client, ':[0-9]+$', '') AS host, command, key || chr(10) || '"' AS key FROM traffic WHERE line_no % 10 > 1""",
    "src_04_bad_lines": f"WITH {TRAFFIC} SELECT line_no, '-ERR ' || key AS value FROM traffic WHERE line_no % 10 = 0",
    "src_06_cluster_nodes": """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT 'id' || CAST(k AS VARCHAR) AS id, '10.0.0.1:7000' AS address, CAST(k AS INTEGER) AS lo, CAST(k + 5 AS INTEGER) AS hi FROM s UNION ALL SELECT 'id' || CAST(k AS VARCHAR), '10.0.0.1:7000', CAST(k + 9 AS INTEGER), CAST(k + 9 AS INTEGER) FROM s""",
    "src_07_cluster_errors": "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'too few fields' ELSE 'unknown flag' END AS problem, count(*) AS n FROM supplier WHERE s_suppkey % 3 < 2 GROUP BY 1",
    "src_10_edge_list": f"WITH {EDGES} SELECT src, CASE WHEN starts_with(src, 'nation') THEN 'link' ELSE type END AS type, dst FROM edges",
    "src_18_json_lines": "SELECT count_if(event_id % 7 > 1 AND props IS NOT NULL) AS records, count_if(event_id % 7 = 0) AS errors FROM events",
    "src_19_wrapped": "SELECT o_orderkey AS k, CAST(sum(CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM orders GROUP BY o_orderkey",
    "src_20_command_file": "SELECT 'SET ' || p_name || ' 1' AS command FROM part WHERE p_partkey % 3 = 2",
}

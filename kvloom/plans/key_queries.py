"""Queries over keys, placement and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import keys as K
from ..operators import graph, keyspace, placement, slots
from ..session import cut
from . import placement_sql, views
from .views import EDGES, KEYS, SLOTS

EVEN3 = "nodes(node, lo, hi) AS (VALUES (1, 0, 5460), (2, 5461, 10922), (3, 10923, 16383))"
def _class(x: str) -> str:
    """The class of a text in SQL, null for none. RE2 knows no look-ahead, so what a text must contain is asked for by itself."""
    has = lambda chars: f"regexp_matches({x}, '[{chars}]')"
    full = lambda pattern: f"regexp_full_match({x}, '{pattern}')"
    return f"""CASE WHEN {full("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")} THEN '<uuid>' WHEN {full("[0-9]+")} THEN '<id>'
  WHEN {full("[0-9]{4}-[0-9]{2}(-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?Z?)?)?")} THEN '<date>' WHEN {full("[^@[:space:]]+@[^@[:space:]]+[.][^@[:space:]]+")} THEN '<email>'
  WHEN {full("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}")} THEN '<ip>' WHEN {full("[0-9a-fA-F]{12,}")} AND {has("0-9")} AND {has("a-fA-F")} THEN '<hex>'
  WHEN {full("[A-Za-z0-9_+=/-]{20,}")} AND {has("0-9")} AND {has("A-Za-z")} THEN '<token>' END"""


def _folded(x: str) -> str:
    """A segment's class, in the braces of a hash tag if it has them, else the segment."""
    return f"CASE WHEN regexp_full_match({x}, '[{{].+[}}]') THEN coalesce('{{' || {_class(x + '[2:-2]')} || '}}', {x}) ELSE coalesce({_class(x)}, {x}) END"


#: The segment classes and patterns of keys, in SQL.
PATTERNS = f"""{KEYS},
segs AS (SELECT key_idx, key, string_split(key, ':') AS s FROM keys),
pats AS (SELECT key_idx, key, list_transform(s, lambda x: {_folded('x')}) AS p FROM segs)"""

#: The even layouts of a server for 4 to 10 nodes.
EVEN_LAYOUTS = {
    4: "0-4095 4096-8191 8192-12287 12288-16383",
    5: "0-3276 3277-6553 6554-9829 9830-13106 13107-16383",
    6: "0-2730 2731-5460 5461-8191 8192-10922 10923-13652 13653-16383",
    7: "0-2340 2341-4680 4681-7021 7022-9361 9362-11702 11703-14042 14043-16383",
    8: "0-2047 2048-4095 4096-6143 6144-8191 8192-10239 10240-12287 12288-14335 14336-16383",
    9: "0-1819 1820-3640 3641-5460 5461-7281 7282-9101 9102-10922 10923-12742 12743-14563 14564-16383",
    10: "0-1637 1638-3276 3277-4914 4915-6553 6554-8191 8192-9829 9830-11468 11469-13106 13107-14745 14746-16383",
}

NODES = ["alpha", "beta", "gamma"]


def agg_01_slot_counts(spark: SparkSession, d: str) -> DataFrame:
    return slots.node_counts(views.keys(spark, d), slots.layout(spark, 3))


def agg_01_top_slots(spark, d):
    return slots.top_slots(views.keys(spark, d))


def agg_01_top_tags(spark, d):
    return slots.top_tags(views.keys(spark, d))


def fn_02_hash_tags(spark, d):
    k = views.keys(spark, d)
    return k.groupBy(K.is_tagged(F.col("key")).alias("tagged")).agg(F.count("*").alias("keys"), F.countDistinct(K.hash_tag(F.col("key"))).alias("tags"))


def fn_03_key_slots(spark, d):
    return slots.with_slots(views.keys(spark, d))


def joi_01_unowned(spark, d):
    """Keys of slots that nobody owns in a layout with a hole."""
    ranges = spark.createDataFrame([(1, 0, 5000), (2, 6000, 16383)], "node int, lo int, hi int")
    owned = slots.owners(slots.with_slots(views.keys(spark, d)).groupBy("slot").agg(F.count("*").alias("n")), ranges)
    return owned.groupBy("node").agg(F.sum("n").alias("keys"))


def win_08_slot_ranges(spark, d):
    """Runs of slots that hold keys with a hash tag."""
    return slots.slot_ranges(slots.with_slots(views.keys(spark, d).where(K.is_tagged(F.col("key")))))


def fn_14_crossslot(spark, d):
    li = views.table(spark, d, "lineitem")
    key = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    commands = li.groupBy(F.col("l_orderkey").alias("command_id")).agg(F.collect_set(key).alias("keys"))
    return slots.cross_slot(commands).groupBy("crossslot").agg(F.count("*").alias("commands"), F.sum("n_keys").alias("keys"), F.sum("n_slots").alias("slots"))


def win_09_even_split(spark, d):
    rows = [(n, *r) for n in EVEN_LAYOUTS for r in slots.even_split(n)]
    return spark.createDataFrame(rows, "nodes int, node int, lo int, hi int")


def win_10_apportion(spark, d):
    w = views.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count("*").alias("weight"))
    return slots.apportion(w, 16384)


def src_08_slot_load(spark, d):
    o = views.table(spark, d, "orders")
    lo = F.pmod("o_orderkey", F.lit(1000)).cast("int")
    loads = o.select(lo.alias("lo"), (lo + F.pmod("o_custkey", F.lit(4)).cast("int")).alias("hi"), F.lit(12).alias("load"))
    return slots.slot_load(loads).select("slot", F.round("load", 6).alias("load"))


def src_09_key_sizes(spark, d):
    k = views.keys(spark, d).withColumn("size", F.octet_length("key"))
    return slots.with_slots(k).groupBy("slot").agg(F.sum("size").alias("load"))


def fn_10_key_patterns(spark, d):
    return keyspace.patterns(views.keys(spark, d))


def fn_09_segment_classes(spark, d):
    """Segments of the keys, and of each order a date, hash, address and so on."""
    k = views.keys(spark, d)
    parts = k.select(F.explode(F.split("key", ":")).alias("segment"))
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("n"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    uuid = F.concat_ws("-", *[F.substr("h", F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    made = ("day", F.concat("day", F.lit("T10:20Z")), "h", F.concat(F.lit("u"), "n", F.lit("@x.org")), F.concat(F.lit("10.0.0."), F.pmod(F.col("n").cast("long"), F.lit(256)).cast("string")), F.concat(F.lit("-"), "n"), F.concat(F.upper("h"), F.lit("+/=")), uuid, F.concat(F.lit("{"), uuid, F.lit("}")))
    parts = parts.union(o.select(F.explode(F.array(*made))))
    return parts.groupBy(K.segment_class(F.col("segment")).alias("class")).agg(F.count("*").alias("n"))


def agg_02_prefix_tree(spark, d):
    return keyspace.prefix_tree(views.keys(spark, d))


def agg_05_naming_findings(spark, d):
    return keyspace.naming_findings(views.keys(spark, d))


def agg_06_separator_vote(spark, d):
    return keyspace.separator_shares(views.keys(spark, d))


def joi_16_near_names(spark, d):
    names = views.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("keys"))
    more = names.unionByName(names.select(F.concat("name", F.lit("s")).alias("name"), "keys"))
    return keyspace.near_names(more)


def fn_17_graph_keys(spark, d):
    return graph.graph_keys(views.edges(spark, d)).select(F.decode("key", "UTF-8").alias("key"))


def joi_20_prefix_scan(spark, d):
    return graph.prefix_scan(graph.graph_keys(views.edges(spark, d)), "i/customer:1").select(F.decode("key", "UTF-8").alias("key"))


def srt_02_key_order(spark, d):
    """Place of each key in byte order among the keys of its node."""
    from pyspark.sql import Window

    text = F.decode("key", "UTF-8")
    keys = graph.graph_keys(views.edges(spark, d)).withColumn("node", F.substring_index(text, "/", 2))
    return keys.select(text.alias("key"), F.row_number().over(Window.partitionBy("node").orderBy("key")).alias("place"))


def joi_17_k_hop(spark, d):
    start = spark.createDataFrame([("order:7",), ("order:11",)], "node string")
    both = views.edges(spark, d)
    both = both.select("src", "dst").union(both.where("type <> 'placed_by'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.k_hop(both, start, 4, cut)


def fn_04_murmur3(spark, d):
    from ..functions.placement import murmur3_col

    return views.keys(spark, d).select("key_idx", murmur3_col("key").alias("hash"))


def fn_07_modulo(spark, d):
    return placement.place(views.keys(spark, d), NODES, "modulo")


def fn_07_ring(spark, d):
    return placement.place(views.keys(spark, d), NODES, "ring")


def fn_07_rendezvous(spark, d):
    return placement.place(views.keys(spark, d), NODES, "rendezvous")


def fn_05_jump(spark, d):
    return placement.place(views.keys(spark, d), NODES, "jump")


def agg_07_load_stats(spark, d):
    return placement.load_stats(placement.place(views.keys(spark, d), NODES, "ring"), NODES)


def joi_11_movement(spark, d):
    out = None
    for a in ("modulo", "ring", "rendezvous", "jump"):
        one = placement.movement(views.keys(spark, d), NODES, [*NODES, "delta"], a).select(F.lit(a).alias("algorithm"), "keys", "moved", "needless")
        out = one if out is None else out.union(one)
    return out


def joi_12_ring_asof(spark, d):
    """The as-of join of a ring in relations: each hash to the first point at or after it, wrapping round."""
    points = views.table(spark, d, "supplier").select((F.col("s_suppkey") * 977 % 16384).alias("h"), F.col("s_suppkey").alias("owner"))
    per = slots.with_slots(views.keys(spark, d)).groupBy("slot").agg(F.count("*").alias("n"))
    span = points.groupBy("h").agg(F.min("owner").alias("owner"))
    from pyspark.sql import Window

    before = F.coalesce(F.lag("h").over(Window.orderBy("h")) + 1, F.lit(0))
    arcs = span.withColumn("lo", before).select("owner", "lo", F.col("h").alias("hi"))
    last = span.agg(F.max("h").alias("top"), F.min_by("owner", "h").alias("owner"))
    wrap = last.select("owner", (F.col("top") + 1).alias("lo"), F.lit(16383).cast("long").alias("hi")).where("lo <= hi")
    by_slot = arcs.union(wrap).select("owner", F.explode(F.sequence("lo", "hi")).alias("slot"))
    return per.join(by_slot, "slot").groupBy("owner").agg(F.sum("n").alias("keys"))


QUERIES = {f.__name__: f for f in (
    agg_01_slot_counts, agg_01_top_slots, agg_01_top_tags, fn_02_hash_tags, fn_03_key_slots, joi_01_unowned, win_08_slot_ranges, fn_14_crossslot, win_09_even_split,
    win_10_apportion, src_08_slot_load, src_09_key_sizes, fn_10_key_patterns, fn_09_segment_classes, agg_02_prefix_tree, agg_05_naming_findings, agg_06_separator_vote,
    joi_16_near_names, fn_17_graph_keys, joi_20_prefix_scan, srt_02_key_order, joi_17_k_hop, fn_04_murmur3, fn_07_modulo, fn_07_ring, fn_07_rendezvous, fn_05_jump,
    agg_07_load_stats, joi_11_movement, joi_12_ring_asof,
)}

GRAPH_KEYS = f"""{EDGES}, gk AS (
  SELECT 'n/' || n AS key FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges)
  UNION SELECT 'o/' || src || '/' || type || '/' || dst FROM edges
  UNION SELECT 'i/' || dst || '/' || type || '/' || src FROM edges)"""

ORACLES = {
    "agg_01_slot_counts": f"""WITH {SLOTS}, {EVEN3},
per AS (SELECT slot, count(*) AS n, count_if(is_tagged) AS t FROM slots GROUP BY slot)
SELECT CAST(node AS INTEGER) AS node, CAST(sum(n) AS BIGINT) AS keys, count(*) AS used_slots, max(n) AS busiest, CAST(sum(t) AS BIGINT) AS tagged
FROM per JOIN nodes ON slot BETWEEN lo AND hi GROUP BY node""",
    "agg_01_top_slots": f"WITH {SLOTS} SELECT slot, count(*) AS keys FROM slots GROUP BY slot ORDER BY keys DESC, slot LIMIT 10",
    "agg_01_top_tags": f"WITH {SLOTS} SELECT hk AS tag, count(*) AS keys FROM slots WHERE is_tagged GROUP BY hk ORDER BY keys DESC, tag LIMIT 10",
    "fn_02_hash_tags": f"WITH {SLOTS} SELECT is_tagged AS tagged, count(*) AS keys, count(DISTINCT hk) AS tags FROM tagged GROUP BY is_tagged",
    "fn_03_key_slots": f"WITH {SLOTS} SELECT key_idx, key, slot FROM slots",
    "joi_01_unowned": f"""WITH {SLOTS}, nodes(node, lo, hi) AS (VALUES (1, 0, 5000), (2, 6000, 16383))
SELECT CAST(node AS INTEGER) AS node, count(*) AS keys FROM slots LEFT JOIN nodes ON slot BETWEEN lo AND hi GROUP BY node""",
    "win_08_slot_ranges": f"""WITH {SLOTS}, used AS (SELECT DISTINCT slot FROM slots WHERE is_tagged),
isl AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS g FROM used) SELECT min(slot) AS lo, max(slot) AS hi FROM isl GROUP BY g""",
    "fn_14_crossslot": f"""WITH {SLOTS.replace(KEYS, "keys AS (SELECT DISTINCT l_orderkey AS key_idx, 'part:' || CAST(l_partkey AS VARCHAR) AS key FROM lineitem)")},
per AS (SELECT key_idx, count(*) AS k, count(DISTINCT slot) AS s FROM slots GROUP BY key_idx)
SELECT s > 1 AS crossslot, count(*) AS commands, CAST(sum(k) AS BIGINT) AS keys, CAST(sum(s) AS BIGINT) AS slots FROM per GROUP BY 1""",
    "win_10_apportion": """WITH w AS (SELECT c_nationkey AS node, count(*) AS weight FROM customer GROUP BY 1),
e AS (SELECT node, weight * 16384.0::DOUBLE / sum(weight) OVER () AS x FROM w),
f AS (SELECT node, x, floor(x) AS b, 16384 - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, node) AS r FROM e)
SELECT node, CAST(b + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""",
    "src_08_slot_load": """WITH l AS (SELECT CAST(o_orderkey % 1000 AS INTEGER) AS lo, CAST(o_orderkey % 1000 + o_custkey % 4 AS INTEGER) AS hi FROM orders),
x AS (SELECT unnest(range(lo, hi + 1)) AS slot, 12.0::DOUBLE / (hi - lo + 1) AS part FROM l)
SELECT CAST(slot AS INTEGER) AS slot, round(sum(part), 6) AS load FROM x GROUP BY slot""",
    "src_09_key_sizes": f"WITH {SLOTS} SELECT slot, CAST(sum(strlen(key)) AS BIGINT) AS load FROM slots GROUP BY slot",
    "fn_10_key_patterns": f"WITH {PATTERNS} SELECT array_to_string(p, ':') AS pattern, count(*) AS keys, CAST(sum(strlen(key)) AS BIGINT) AS bytes FROM pats GROUP BY 1",
    "fn_09_segment_classes": f"""WITH {KEYS}, o AS (SELECT CAST(o_orderkey AS VARCHAR) AS n, md5(CAST(o_orderkey AS VARCHAR)) AS h, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
u AS (SELECT *, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS u FROM o),
x AS (SELECT unnest(string_split(key, ':')) AS x FROM keys UNION ALL SELECT unnest([d, d || 'T10:20Z', h, 'u' || n || '@x.org', '10.0.0.' || CAST(CAST(n AS BIGINT) % 256 AS VARCHAR), '-' || n, upper(h) || '+/=', u, '{{' || u || '}}']) FROM u)
SELECT {_folded('x')} AS class, count(*) AS n FROM x GROUP BY 1""",
    "agg_02_prefix_tree": f"""WITH {PATTERNS},
lv AS (SELECT key_idx, key, p, unnest(range(1, len(p) + 1)) AS depth FROM pats),
nd AS (SELECT array_to_string(p[1:depth], ':') AS path, depth, key_idx, key, depth = len(p) AS e FROM lv)
SELECT path, CAST(depth AS INTEGER) AS depth, count(*) AS keys, CAST(sum(strlen(key)) AS BIGINT) AS bytes, count_if(e) AS ends,
  array_to_string(list_slice(list(key ORDER BY key_idx), 1, 3), ' ') AS examples FROM nd GROUP BY path, depth""",
    "agg_05_naming_findings": f"""WITH {KEYS}, p AS (SELECT DISTINCT split_part(key, ':', 1) AS x FROM keys)
SELECT 'no_separator' AS finding, count_if(NOT contains(key, ':')) AS n FROM keys
UNION ALL SELECT 'other_separator', count_if(regexp_matches(split_part(key, ':', 1), '[/|#]')) FROM keys
UNION ALL SELECT 'empty_segment', count_if(contains(key, ':') AND list_contains(string_split(key, ':'), '')) FROM keys
UNION ALL SELECT 'long', count_if(strlen(key) > 256) FROM keys
UNION ALL SELECT 'unclean', count_if(regexp_matches(key, '[\\x00-\\x20\\x7F]')) FROM keys
UNION ALL SELECT 'case_collision', count(*) FROM (SELECT lower(x) FROM p GROUP BY lower(x) HAVING count(*) > 1)""",
    "agg_06_separator_vote": f"""WITH {KEYS} SELECT ':' AS separator, {", ".join(f"round(avg(CASE WHEN contains(key, '{s}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_{i}" for i, s in enumerate(K.SEPARATORS))} FROM keys""",
    "joi_16_near_names": """WITH n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT name FROM n UNION ALL SELECT name || 's' FROM n)
SELECT x.name AS name, y.name AS near FROM a x JOIN a y ON x.name < y.name WHERE damerau_levenshtein(x.name, y.name) = 1 AND least(length(x.name), length(y.name)) >= 3 AND lower(x.name) <> lower(y.name)""",
    "fn_17_graph_keys": f"WITH {GRAPH_KEYS} SELECT key FROM gk",
    "joi_20_prefix_scan": f"WITH {GRAPH_KEYS} SELECT key FROM gk WHERE starts_with(key, 'i/customer:1')",
    "srt_02_key_order": f"WITH {GRAPH_KEYS} SELECT key, CAST(row_number() OVER (PARTITION BY split_part(key, '/', 1), split_part(key, '/', 2) ORDER BY key) AS INTEGER) AS place FROM gk",
    "joi_17_k_hop": f"""WITH RECURSIVE {EDGES}, e AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE type <> 'placed_by'),
w(node, hop) AS (SELECT 'order:7', 0 UNION SELECT 'order:11', 0 UNION SELECT dst, hop + 1 FROM w JOIN e ON node = src WHERE hop < 4)
SELECT node, min(hop) AS hop FROM w GROUP BY node""",
    "joi_12_ring_asof": f"""WITH {SLOTS}, pts AS (SELECT s_suppkey * 977 % 16384 AS h, min(s_suppkey) AS owner FROM supplier GROUP BY 1),
j AS (SELECT slot, p.owner FROM slots s ASOF LEFT JOIN pts p ON s.slot <= p.h)
SELECT coalesce(owner, (SELECT arg_min(owner, h) FROM pts)) AS owner, count(*) AS keys FROM j GROUP BY 1""",
    "win_09_even_split": "SELECT * FROM (VALUES " + ", ".join(f"({n}, {k}, {r.replace('-', ', ')})" for n, text in EVEN_LAYOUTS.items() for k, r in enumerate(text.split(), 1)) + ") t(nodes, node, lo, hi)",
    **placement_sql.ORACLES,
}

"""Queries over versions, snapshots, bulk loads, documents, settings and permissions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K, values as V
from ..functions.conditions import Attr, number_key, utf16_size
from ..operators import documents as D, revisions as R, store as S
from . import views
from .views import KEYS, REVISIONS

LATEST = f"""{REVISIONS}, last AS (SELECT key, count(*) AS revisions, sum(strlen(key) + size) AS everything, arg_max(main, (main, sub)) AS m,
  arg_max(strlen(key) + size, (main, sub)) AS own, arg_max(deleted, (main, sub)) AS gone, arg_max(supp, (main, sub)) AS lease FROM revisions GROUP BY key)"""
#: One record for each (key, main, sub): the driver's lineitems repeat some.
DEDUP = """revisions AS (SELECT key, main, sub, max(supp) AS supp, max(deleted) AS deleted, max(size) AS size, max(value) AS value FROM (
  SELECT '/registry/parts/' || CAST(l_partkey AS VARCHAR) AS key, l_orderkey AS main, l_linenumber AS sub, l_suppkey AS supp, l_returnflag = 'R' AS deleted,
  CAST(l_quantity AS BIGINT) AS size, CAST(l_suppkey AS VARCHAR) || '|' || l_linestatus AS value FROM lineitem) GROUP BY ALL)"""
DEDUP = DEDUP.replace("GROUP BY ALL", "GROUP BY key, main, sub")
LATEST = LATEST.replace(REVISIONS, DEDUP)


def _records(spark, d):
    return views.revisions(spark, d).groupBy("key", "main", "sub").agg(*[F.max(c).alias(c) for c in ("supp", "deleted", "size", "value")])


def joi_13_as_of_revision(spark, d):
    return R.as_of(_records(spark, d), 4000)


def agg_19_mvcc_rollup(spark, d):
    return R.rollup(_records(spark, d))


def win_02_history(spark, d):
    return R.history(_records(spark, d))


def agg_21_prefix_sizes(spark, d):
    r = _records(spark, d).withColumn("key", F.regexp_replace("key", r"/([0-9])([0-9]*)$", "/$1/$2"))
    return R.prefix_sizes(R.rollup(r.groupBy("key", "main", "sub").agg(*[F.max(c).alias(c) for c in ("supp", "deleted", "size", "value")])), 3)


def _cluster(spark, d):
    """Events as records of a cluster's store: pods, secrets (every other one encrypted), events."""
    e = views.table(spark, d, "events")
    text = lambda c: F.col(c).cast("string")
    resource = F.when(F.col("user_id") % 3 == 0, "pods").when(F.col("user_id") % 3 == 1, "secrets").otherwise("events")
    plain = F.format_string('{"apiVersion":"v1","kind":"%s","metadata":{"managedFields":[{"manager":"%s"}],"name":"%s"}}', F.initcap(F.rtrim(resource, F.lit("s"))), F.col("event_type"), text("user_id"))
    value = F.when(F.col("user_id") % 6 == 1, F.concat(F.lit("k8s:enc:aescbc:v1:key1:"), F.col("event_type"))).otherwise(plain)
    return e.select(F.concat(F.lit("/registry/"), resource, F.lit("/default/"), text("user_id")).alias("key"), F.col("event_id").alias("main"), F.lit(0).alias("sub"), (F.col("event_id") % 5 == 0).alias("deleted"), value.alias("value"))


def agg_20_kinds(spark, d):
    return R.kinds(R.objects(_cluster(spark, d)))


def agg_20_secrets(spark, d):
    return R.secrets(R.objects(_cluster(spark, d)))


def agg_22_store_findings(spark, d):
    """A database of 1.8 GB, half of it free, with these records."""
    return R.findings(R.objects(_cluster(spark, d)), 1_800_000_000, 900_000_000)


def joi_10_resources(spark, d):
    return _records(spark, d).groupBy(R.resource(F.col("key")).alias("resource")).agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"))


def joi_09_lease_counts(spark, d):
    leases = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("lease"))
    last = _records(spark, d).groupBy("key").agg(F.max_by(F.struct(F.col("supp").alias("lease"), (~F.col("deleted")).alias("live")), F.struct("main", "sub")).alias("r")).select("r.*")
    return R.lease_counts(leases, last)


def srt_05_top_keys(spark, d):
    return R.top_keys(R.rollup(_records(spark, d)), "history_bytes")


def _entries(spark, d):
    o = views.table(spark, d, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("string", "hash", "list", "set", "zset")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select(
        (F.col("o_custkey") % 3).cast("int").alias("db"), F.concat(F.col("o_orderstatus"), F.lit(":"), F.col("o_orderkey").cast("string")).alias("key"), kind.alias("type"),
        F.when(F.col("o_orderkey") % 2 == 0, "listpack").otherwise("raw").alias("encoding"), F.col("o_orderkey").alias("offset"),
        F.floor("o_totalprice").cast("long").alias("size"), F.when(kind == "string", 1).otherwise(F.col("o_orderkey") % 100).cast("long").alias("length"),
        F.when(F.col("o_orderkey") % 3 == 0, F.pmod(F.col("o_orderkey") * F.lit(7919) * 60000, F.lit(5000000000)) - 100000).alias("expire_ms"),
    )


ENTRIES = """entries AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS db, o_orderstatus || ':' || CAST(o_orderkey AS VARCHAR) AS key,
  (['string','hash','list','set','zset'])[CAST(o_custkey % 5 + 1 AS INTEGER)] AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'listpack' ELSE 'raw' END AS encoding, o_orderkey AS "offset",
  CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE o_orderkey % 100 END AS length,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 7919 * 60000) % 5000000000 - 100000 END AS expire_ms FROM orders)"""


def agg_15_snapshot_totals(spark, d):
    return S.snapshot_totals(_entries(spark, d))


def agg_16_ttl_histogram(spark, d):
    return S.ttl_histogram(_entries(spark, d), 0)


def srt_04_largest(spark, d):
    return S.largest(_entries(spark, d)).select("key", "size")


def agg_17_snapshot_prefixes(spark, d):
    return S.snapshot_prefixes(views.keys(spark, d))


def _loads(spark, d):
    e = views.table(spark, d, "events")
    return e.select(F.col("event_id").alias("idx"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("k"), F.col("event_type").alias("v"))


def snk_01_resp(spark, d):
    r = _loads(spark, d)
    return r.select("idx", F.decode(S.resp_command(F.lit("SET"), F.col("k"), F.col("v")), "UTF-8").alias("resp"))


def snk_02_build(spark, d):
    out = S.build_commands(_loads(spark, d), F.col("k"), "set", F.col("v"), ttl=60, fresh=True)
    return out.select("phase", "idx", "name", F.array_join("args", " ").alias("args"))


def agg_26_build_summary(spark, d):
    out = S.build_commands(_loads(spark, d), F.col("k"), "string", F.col("v"), ttl=60)
    return out.groupBy("name").agg(F.count("*").alias("commands"), F.countDistinct(F.element_at("args", 1)).alias("keys"))


def win_01_first_per_key(spark, d):
    from pyspark.sql import Window

    return _loads(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("idx"))).where("n = 1").select("idx", "k", "v")


def snk_03_csv_guard(spark, d):
    p = views.table(spark, d, "part")
    cell = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "x")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_name"))
    return p.select("p_partkey", S.csv_guard(cell).alias("cell"))


def snk_06_batches(spark, d):
    b = S.batches(views.table(spark, d, "part").select(F.col("p_partkey").alias("item_id")))
    return b.select("request", F.size("items").alias("n"), F.element_at("items", 1).alias("first"))


def _items(spark, d):
    c = views.table(spark, d, "customer")
    odd = F.col("c_custkey") % 4 == 0
    return D.to_items(c.select("c_custkey", F.col("c_name").alias("name"), F.when(~odd, F.col("c_acctbal").cast("decimal(12,2)")).alias("balance"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("home"), F.array(F.col("c_name"), F.col("c_mktsegment")).alias("tags"), odd.alias("odd")), "c_custkey")


ITEMS = "items AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS balance, c_mktsegment AS segment, c_nationkey AS nation, c_custkey % 4 = 0 AS odd FROM customer)"


def _ids(rows):
    return rows.select("c_custkey")


def fil_02_comparisons(spark, d):
    """<> is true where the attribute is missing; the other comparisons are false."""
    a = Attr("balance")
    tests = {"eq": a.eq(1863.84), "ne": a.ne(1863.84), "lt": a.lt(500), "ge": a.ge(500), "text": a.eq("x"), "not_ge": ~a.ge(500)}
    return _items(spark, d).agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def fil_01_and_or_not(spark, d):
    return _ids(_items(spark, d).where((Attr("home.segment").eq("BUILDING") | Attr("odd").eq(True)) & ~(Attr("home.nation").lt(5))))


def fil_03_between(spark, d):
    return _ids(_items(spark, d).where(Attr("balance").between(-100, 1000)))


def fil_04_in(spark, d):
    return _ids(_items(spark, d).where(Attr("home.segment").is_in(["BUILDING", "MACHINERY"])))


def fil_05_functions(spark, d):
    a = Attr
    tests = {
        "exists": a("balance").exists(), "not_exists": a("balance").not_exists(), "is_number": a("balance").is_type("N"), "is_text": a("balance").is_type("S"),
        "begins": a("name").begins_with("Customer#00000001"), "contains": a("name").contains("11"), "element": a("tags[1]").eq("BUILDING"), "size": a("home.segment").size() == 8,
    }
    return _items(spark, d).agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def fn_20_utf16_size(spark, d):
    t = views.table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("😀")).alias("text"))
    return t.select("doc_id", utf16_size(F.col("text")).alias("units"))


def prj_01_projection(spark, d):
    return D.project(_items(spark, d), "c_custkey", ["home.segment", "tags[0]"]).select("c_custkey", F.col("`home.segment`").alias("segment"), F.col("`tags[0]`").alias("tag"))


def srt_01_sorted_query(spark, d):
    out = D.query(_items(spark, d), Attr("home.segment").eq("BUILDING"), Attr("balance"), where=Attr("balance").exists(), limit=20)
    return out.select("c_custkey", Attr("balance").number().alias("balance"))


def prj_05_update(spark, d):
    """SET balance = balance when there, flag = yes; REMOVE odd: names that changed, all read from the image before."""
    c = views.table(spark, d, "customer")
    before = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("odd"), (F.col("c_custkey") % 2).cast("string"))
    after = D.update_map(before, {"segment": F.lit("BUILDING"), "flag": F.when(F.col("c_nationkey") > 9, F.lit("yes"))}, ("odd",))
    return c.select("c_custkey", F.array_join(D.changed(before, after), ",").alias("changed"))


def set_01_number_sets(spark, d):
    c = views.table(spark, d, "customer")
    n = lambda x, s="": F.concat(x.cast("string"), F.lit(s))
    a = F.array(n(F.col("c_custkey")), n(F.col("c_nationkey") + 100000))
    b = F.array(n(F.col("c_custkey"), ".0"), F.lit("1e9"))
    return c.select("c_custkey", F.array_join(D.numbers_union(a, b), " ").alias("both"), F.array_join(D.numbers_except(a, b), " ").alias("rest"))


def _tagged(tag, column):
    return F.to_json(F.struct(column.cast("string").alias(tag)))


def ex_09_arithmetic(spark, d):
    """SET a = balance + 10^20, b = balance - balance, exact."""
    c = views.table(spark, d, "customer")
    n = F.concat((F.col("c_acctbal") * 100).cast("long").cast("string"), F.lit("e-2"))
    return c.select("c_custkey", V.plus(n, F.lit("1e20")).alias("more"), V.minus(n, n).alias("none"), V.plus(n, F.lit("1e60")).alias("too_exact"))


def ex_10_list_elements(spark, d):
    """SET l[0], l[9]; REMOVE l[1], l[7] of a list of three."""
    c = views.table(spark, d, "customer")
    one = lambda x: F.struct(x.cast("string").alias("S"))
    before = F.to_json(F.struct(F.array(one(F.col("c_name")), one(F.col("c_nationkey")), one(F.col("c_mktsegment"))).alias("L")))
    return c.select("c_custkey", D.update_list(before, {9: _tagged("S", F.lit("end")), 0: _tagged("S", F.col("c_custkey"))}, (1, 7)).alias("after"))


def ex_11_add(spark, d):
    """ADD to a number, to a set, to nothing, and to another type."""
    c = views.table(spark, d, "customer")
    k, nation = F.col("c_custkey") % 4, F.col("c_nationkey")
    texts = lambda *x: F.to_json(F.struct(F.array(*[y.cast("string") for y in x]).alias("SS")))
    now = F.when(k == 0, _tagged("N", nation)).when(k == 1, texts(F.col("c_name"), F.lit("a"))).when(k == 2, _tagged("S", nation))
    value = F.when(k == 1, texts(F.lit("a"), F.col("c_mktsegment"))).otherwise(_tagged("N", F.lit("0.5")))
    return c.select("c_custkey", D.added(now, value).alias("after"))


def ex_13_deep_equality(spark, d):
    """Maps in another order, sets in another order, numbers in another spelling; lists keep theirs."""
    c = views.table(spark, d, "customer")
    number, name = F.col("c_nationkey").cast("string"), F.col("c_name")
    left = F.format_string('{"M": {"a": {"NS": ["%s", "100"]}, "b": {"L": [{"S": "%s"}, {"N": "%s"}]}}}', number, name, number)
    right = F.format_string('{"M": {"b": {"L": [{"S": "%s"}, {"N": "%s.0"}]}, "a": {"NS": ["1e2", "%s"]}}}', name, number, number)
    turned = F.format_string('{"M": {"a": {"NS": ["%s", "100"]}, "b": {"L": [{"N": "%s"}, {"S": "%s"}]}}}', number, number, name)
    other = F.when(F.col("c_custkey") % 3 == 0, turned).otherwise(right)
    return c.select("c_custkey", V.same_value(left, other).alias("equal"), V.same_value(_tagged("N", number), _tagged("S", number)).alias("of_two_types"))


def fn_18_number_order(spark, d):
    """Place of each number within its nation, by value: '12345e-2' is 123.45."""
    from pyspark.sql import Window

    c = views.table(spark, d, "customer").select("c_custkey", "c_nationkey", F.concat((F.col("c_acctbal") * 100).cast("long").cast("string"), F.lit("e-2")).alias("n"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(number_key(F.col("n")), "c_custkey"))
    return c.select("c_custkey", "n", place.alias("place"))


def _got(spark):
    return spark.createDataFrame([("maxmemory", "0"), ("appendonly", "yes"), ("timeout", "0"), ("lazyfree", "no"), ("odd-name", "1")], "name string, value string")


GOT = "got(name, value) AS (VALUES ('maxmemory','0'), ('appendonly','yes'), ('timeout','0'), ('lazyfree','no'), ('odd-name','1'))"
VERSIONS = "defs(version, name, value) AS (VALUES " + ", ".join(f"('{v}','{n}','{x}')" for v, extra in (("a1", {}), ("a2", {"lazyfree": "no"}), ("b1", {"lazyfree": "yes", "io-threads": "1"})) for n, x in ({"maxmemory": "0", "appendonly": "no", "timeout": "0", "databases": "16"} | extra).items()) + ")"


def joi_03_setting_differences(spark, d):
    return S.setting_differences(_got(spark), S.reference_versions(spark).where("version = 'b1'"))


def joi_04_version_scores(spark, d):
    return S.version_scores(_got(spark), S.reference_versions(spark))


def win_05_last_setting(spark, d):
    e = views.table(spark, d, "events")
    return S.last_settings(e.select(F.col("event_id").alias("line"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("value")))


def joi_06_glob_permissions(spark, d):
    k = views.keys(spark, d).withColumn("needs", F.when(F.col("key_idx") % 2 == 0, "R").otherwise("RW"))
    rules = [("RW", "cart:{1*}:items"), ("R", "user:[2-4]?:*"), ("RW", "order:7:20"), ("R", "order:1?[^5]:*")]
    return S.allowed_keys(k, rules).groupBy("allowed", "needs").agg(F.count("*").alias("keys"))


def set_06_last_rule(spark, d):
    e = views.table(spark, d, "events")
    return S.last_rule(e.select(F.col("event_id").alias("rule_idx"), F.concat(F.lit("cmd"), (F.col("user_id") % 50).cast("string")).alias("command"), F.col("event_type").isin("view", "click").alias("on")))


def agg_27_least_privilege(spark, d):
    k = views.keys(spark, d).withColumn("flags", F.when(F.col("key_idx") % 7 == 0, 3).otherwise(1))
    return S.least_privilege(k)


QUERIES = {f.__name__: f for f in (
    joi_13_as_of_revision, agg_19_mvcc_rollup, win_02_history, agg_21_prefix_sizes, agg_20_kinds, agg_20_secrets, agg_22_store_findings, joi_10_resources, joi_09_lease_counts, srt_05_top_keys, agg_15_snapshot_totals, agg_16_ttl_histogram,
    srt_04_largest, agg_17_snapshot_prefixes, snk_01_resp, snk_02_build, agg_26_build_summary, win_01_first_per_key, snk_03_csv_guard, snk_06_batches, fil_01_and_or_not, fil_02_comparisons,
    fil_03_between, fil_04_in, fil_05_functions, fn_20_utf16_size, prj_01_projection, srt_01_sorted_query, prj_05_update, set_01_number_sets, ex_09_arithmetic, ex_10_list_elements, ex_11_add, ex_13_deep_equality, fn_18_number_order, joi_03_setting_differences,
    joi_04_version_scores, win_05_last_setting, joi_06_glob_permissions, set_06_last_rule, agg_27_least_privilege,
)}

#: The records of _cluster() and the last one of each key.
CLUSTER = """records AS (SELECT CASE user_id % 3 WHEN 0 THEN 'pods' WHEN 1 THEN 'secrets' ELSE 'events' END AS resource, user_id, event_id AS main, event_id % 5 = 0 AS deleted, user_id % 6 = 1 AS secret,
  length('[{"manager":"' || event_type || '"}]') AS managed, CASE WHEN user_id % 6 = 1 THEN 'k8s:enc:aescbc:v1:key1:' || event_type
  ELSE '{"apiVersion":"v1","kind":"' || CASE user_id % 3 WHEN 0 THEN 'Pod' WHEN 1 THEN 'Secret' ELSE 'Event' END || '","metadata":{"managedFields":[{"manager":"' || event_type || '"}],"name":"' || user_id || '"}}' END AS value FROM events),
sized AS (SELECT *, strlen(value) AS size, strlen('/registry/' || resource || '/default/' || user_id) + strlen(value) AS own FROM records),
objects AS (SELECT resource, user_id, secret, NOT arg_max(deleted, main) AS live, arg_max(size, main) AS size, arg_max(managed, main) AS managed, arg_max(own, main) AS own, sum(own) AS everything FROM sized GROUP BY resource, user_id, secret)"""

LOADS = "loads AS (SELECT event_id AS idx, 'u:' || CAST(user_id AS VARCHAR) AS k, event_type AS v FROM events)"
BUCKETS = "CASE " + " ".join(f"WHEN expire_ms >= {least} THEN '{name}'" for least, name in reversed(S.TTL_BUCKETS[1:])) + " ELSE 'expired' END"

ORACLES = {
    "joi_13_as_of_revision": f"""WITH {DEDUP}, r AS (SELECT key, arg_max(main, (main, sub)) AS main, arg_max(sub, (main, sub)) AS sub, arg_max(value, (main, sub)) AS value, arg_max(deleted, (main, sub)) AS gone
FROM revisions WHERE main <= 4000 GROUP BY key) SELECT key, main, sub, value FROM r WHERE NOT gone""",
    "agg_19_mvcc_rollup": f"""WITH {LATEST} SELECT key, revisions, NOT gone AS live, m AS mod_revision, CAST(CASE WHEN gone THEN 0 ELSE own END AS BIGINT) AS bytes,
CAST(everything - CASE WHEN gone THEN 0 ELSE own END AS BIGINT) AS history_bytes FROM last""",
    "win_02_history": f"""WITH {DEDUP} SELECT key, main, sub, deleted, value, last(CASE WHEN NOT deleted THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY main, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM revisions""",
    "agg_21_prefix_sizes": f"""WITH {LATEST}, live AS (SELECT '/registry/parts/' || left(split_part(key, '/', 4), 1) AS prefix, own + 1 AS own FROM last WHERE NOT gone)
SELECT prefix, count(*) AS keys, CAST(sum(own) AS BIGINT) AS bytes FROM live GROUP BY prefix""",
    "agg_20_kinds": f"""WITH {CLUSTER} SELECT CASE resource WHEN 'pods' THEN 'Pod' WHEN 'secrets' THEN 'Secret' ELSE 'Event' END AS kind, 'v1' AS api_version, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes,
CAST(sum(managed) AS BIGINT) AS managed_bytes FROM objects WHERE live AND NOT secret GROUP BY 1""",
    "agg_20_secrets": f"WITH {CLUSTER} SELECT CASE WHEN secret THEN 'aescbc:v1' END AS provider, count(*) AS secrets FROM objects WHERE live AND resource = 'secrets' GROUP BY 1",
    "agg_22_store_findings": f"""WITH {CLUSTER}, t AS (SELECT count_if(live AND resource = 'secrets') AS secrets, count_if(live AND resource = 'secrets' AND NOT secret) AS plain, sum(CASE WHEN live THEN own ELSE 0 END) AS now, sum(everything) AS al,
  sum(CASE WHEN resource = 'events' THEN everything ELSE 0 END) AS ev, sum(CASE WHEN live AND NOT secret THEN managed ELSE 0 END) AS managed, sum(CASE WHEN live AND NOT secret THEN size ELSE 0 END) AS vals FROM objects),
f AS (SELECT 'warn' AS level, 'quota' AS code, 1800000000 AS amount, 2147483648 AS total UNION ALL SELECT 'info', 'free', 900000000, 1800000000 UNION ALL SELECT 'warn', 'secrets', plain, secrets FROM t WHERE plain > 0
UNION ALL SELECT 'ok', 'secrets', secrets, secrets FROM t WHERE plain = 0 AND secrets > 0 UNION ALL SELECT 'info', 'history', al - now, now FROM t WHERE al - now > now
UNION ALL SELECT 'info', 'events', ev, al FROM t WHERE ev > 0.3 * al UNION ALL SELECT 'info', 'managed-fields', managed, vals FROM t WHERE managed > 0.2 * vals AND vals > 0)
SELECT level, code, CAST(amount AS BIGINT) AS amount, CAST(total AS BIGINT) AS total FROM f""",
    "joi_10_resources": f"WITH {DEDUP} SELECT split_part(key, '/', 3) AS resource, count(*) AS records, count(DISTINCT key) AS keys FROM revisions GROUP BY 1",
    "joi_09_lease_counts": f"WITH {LATEST}, u AS (SELECT lease, count(*) AS n FROM last WHERE NOT gone GROUP BY lease) SELECT s_suppkey AS lease, coalesce(n, 0) AS keys FROM supplier LEFT JOIN u ON lease = s_suppkey",
    "srt_05_top_keys": f"WITH {LATEST} SELECT key, CAST(everything - CASE WHEN gone THEN 0 ELSE own END AS BIGINT) AS measure FROM last ORDER BY measure DESC, key LIMIT 10",
    "agg_15_snapshot_totals": f"""WITH {ENTRIES}, x AS (SELECT 'db' AS level, CAST(db AS VARCHAR) AS item, size, length, type FROM entries UNION ALL SELECT 'type', type, size, length, type FROM entries UNION ALL SELECT 'encoding', encoding, size, length, type FROM entries)
SELECT level, item, count(*) AS keys, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(CASE WHEN type = 'string' THEN 0 ELSE length END) AS BIGINT) AS elements FROM x GROUP BY level, item""",
    "agg_16_ttl_histogram": f"WITH {ENTRIES} SELECT {BUCKETS} AS bucket, count(*) AS keys FROM entries WHERE expire_ms IS NOT NULL GROUP BY 1",
    "srt_04_largest": f'WITH {ENTRIES} SELECT key, size FROM entries ORDER BY size DESC, "offset" LIMIT 10',
    "agg_17_snapshot_prefixes": f"WITH {KEYS} SELECT left(key, instr(key, ':')) AS prefix, count(*) AS keys FROM keys GROUP BY 1",
    "snk_01_resp": f"WITH {LOADS} SELECT idx, '*3' || chr(13) || chr(10) || '$3' || chr(13) || chr(10) || 'SET' || chr(13) || chr(10) || '$' || strlen(k) || chr(13) || chr(10) || k || chr(13) || chr(10) || '$' || strlen(v) || chr(13) || chr(10) || v || chr(13) || chr(10) AS resp FROM loads",
    "snk_02_build": f"""WITH {LOADS}, f AS (SELECT k, min(idx) AS idx FROM loads GROUP BY k) SELECT 1 AS phase, idx, 'SADD' AS name, k || ' ' || v AS args FROM loads
UNION ALL SELECT 0, idx, 'DEL', k FROM f UNION ALL SELECT 2, idx, 'EXPIRE', k || ' 60' FROM f""",
    "agg_26_build_summary": f"WITH {LOADS} SELECT 'SET' AS name, count(*) AS commands, count(DISTINCT k) AS keys FROM loads",
    "win_01_first_per_key": f"WITH {LOADS} SELECT min(idx) AS idx, k, arg_min(v, idx) AS v FROM loads GROUP BY k",
    "snk_03_csv_guard": "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN '''' ELSE '' END || (['=','+','-','@','x'])[CAST(p_partkey % 5 + 1 AS INTEGER)] || p_name AS cell FROM part",
    "snk_06_batches": "WITH r AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 25 AS request FROM part) SELECT request, CAST(count(*) AS INTEGER) AS n, min(p_partkey) AS first FROM r GROUP BY request",
    "fil_01_and_or_not": f"WITH {ITEMS} SELECT c_custkey FROM items WHERE (segment = 'BUILDING' OR odd) AND NOT nation < 5",
    "fil_02_comparisons": f"""WITH {ITEMS} SELECT count_if(coalesce(balance = 1863.84, false)) AS eq, count_if(NOT coalesce(balance = 1863.84, false)) AS ne, count_if(coalesce(balance < 500, false)) AS lt,
  count_if(coalesce(balance >= 500, false)) AS ge, CAST(0 AS BIGINT) AS text, count_if(NOT coalesce(balance >= 500, false)) AS not_ge FROM items""",
    "fil_03_between": f"WITH {ITEMS} SELECT c_custkey FROM items WHERE balance BETWEEN -100 AND 1000",
    "fil_04_in": f"WITH {ITEMS} SELECT c_custkey FROM items WHERE segment IN ('BUILDING', 'MACHINERY')",
    "fil_05_functions": f"""WITH {ITEMS} SELECT count(balance) AS "exists", count_if(balance IS NULL) AS not_exists, count(balance) AS is_number, CAST(0 AS BIGINT) AS is_text, count_if(starts_with(c_name, 'Customer#00000001')) AS begins,
  count_if(contains(c_name, '11')) AS contains, count_if(segment = 'BUILDING') AS element, count_if(length(segment) = 8) AS size FROM items""",
    "fn_20_utf16_size": "SELECT doc_id, CAST(length(text) + 2 + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS units FROM documents",
    "prj_01_projection": f"""WITH {ITEMS} SELECT c_custkey, '{{"S":"' || segment || '"}}' AS segment, '{{"S":"' || c_name || '"}}' AS tag FROM items""",
    "srt_01_sorted_query": f"WITH {ITEMS} SELECT c_custkey, CAST(balance AS VARCHAR) AS balance FROM items WHERE segment = 'BUILDING' AND balance IS NOT NULL ORDER BY items.balance, c_custkey LIMIT 20",
    "prj_05_update": """SELECT c_custkey, CASE WHEN c_nationkey > 9 THEN 'flag,' ELSE '' END || 'odd' || CASE WHEN c_mktsegment <> 'BUILDING' THEN ',segment' ELSE '' END AS changed FROM customer""",
    "set_01_number_sets": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ' ' || CAST(c_nationkey + 100000 AS VARCHAR) || CASE WHEN c_custkey = c_nationkey + 100000 THEN '' ELSE '' END || ' 1e9' AS both, CAST(c_nationkey + 100000 AS VARCHAR) AS rest FROM customer",
    "ex_09_arithmetic": """WITH n AS (SELECT c_custkey, CAST(trunc(c_acctbal * 100) AS BIGINT) AS c FROM customer),
t AS (SELECT *, CAST(c AS HUGEINT) + CAST('10000000000000000000000' AS HUGEINT) AS total FROM n)
SELECT c_custkey, CAST(total // 100 AS VARCHAR) || CASE WHEN total % 100 = 0 THEN '' WHEN total % 10 = 0 THEN '.' || CAST(total % 100 // 10 AS VARCHAR) ELSE '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') END AS more,
CASE WHEN c % 100 = 0 THEN '0' WHEN c % 10 = 0 THEN '0.0' ELSE '0.00' END AS none, CASE WHEN c = 0 THEN '1' || repeat('0', 60) END AS too_exact FROM t""",
    "ex_10_list_elements": """SELECT c_custkey, '{"L":[{"S":"' || CAST(c_custkey AS VARCHAR) || '"},{"S":"' || c_mktsegment || '"},{"S":"end"}]}' AS after FROM customer""",
    "ex_11_add": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{"N":"' || CAST(c_nationkey AS VARCHAR) || '.5"}' WHEN 1 THEN '{"SS":["' || c_name || '","a","' || c_mktsegment || '"]}' WHEN 3 THEN '{"N":"0.5"}' END AS after FROM customer""",
    "ex_13_deep_equality": "SELECT c_custkey, c_custkey % 3 <> 0 AS equal, false AS of_two_types FROM customer",
    "fn_18_number_order": "SELECT c_custkey, CAST(CAST(trunc(c_acctbal * 100) AS BIGINT) AS VARCHAR) || 'e-2' AS n, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY trunc(c_acctbal * 100), c_custkey) AS INTEGER) AS place FROM customer",
    "joi_03_setting_differences": f"""WITH {GOT}, {VERSIONS}, d AS (SELECT * FROM defs WHERE version = 'b1') SELECT coalesce(g.name, d.name) AS name,
  CASE WHEN d.name IS NULL THEN 'unknown' WHEN g.name IS NULL THEN 'hidden' WHEN g.value = d.value THEN 'same' ELSE 'changed' END AS status FROM got g FULL JOIN d ON g.name = d.name""",
    "joi_04_version_scores": f"""WITH {GOT}, {VERSIONS}, p AS (SELECT version, count(g.name) AS hits, count(*) - count(g.name) AS extras FROM defs LEFT JOIN got g USING (name) GROUP BY version)
SELECT version, hits - ((SELECT count(*) FROM got) - hits) - extras AS score FROM p""",
    "win_05_last_setting": "SELECT 'user-' || CAST(user_id AS VARCHAR) AS name, arg_max(event_type, event_id) AS value, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS set_by FROM events GROUP BY 1",
    "joi_06_glob_permissions": f"""WITH {KEYS}, n AS (SELECT key, CASE WHEN key_idx % 2 = 0 THEN 'R' ELSE 'RW' END AS needs FROM keys)
SELECT key LIKE 'cart:{{1%}}:items' OR (needs = 'R' AND regexp_full_match(key, 'user:[2-4].:.*')) OR key = 'order:7:20' OR (needs = 'R' AND regexp_full_match(key, 'order:1.[^5]:.*')) AS allowed, needs, count(*) AS keys FROM n GROUP BY 1, 2""",
    "set_06_last_rule": """SELECT 'cmd' || CAST(user_id % 50 AS VARCHAR) AS command, arg_max(event_type IN ('view', 'click'), event_id) AS "on" FROM events GROUP BY 1""",
    "agg_27_least_privilege": f"""WITH {KEYS}, k AS (SELECT split_part(key, ':', 1) AS head, key, max(key_idx % 7 = 0) AS w FROM keys GROUP BY ALL)
SELECT head || ':*' AS pattern, CASE WHEN max(w) THEN 3 ELSE 1 END AS flags, count(DISTINCT key) AS keys FROM k GROUP BY head""".replace("GROUP BY ALL", "GROUP BY 1, 2"),
}

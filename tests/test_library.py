"""Placement hashes, sources, streams, number order and ring properties against naive versions."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvloom.functions import commands, keys as K, placement as P, values
from kvloom.functions.conditions import Attr, number_key
from kvloom.operators import documents, keyspace, placement, rebalance, revisions, slots, store, traffic
from kvloom.plans import views
from kvloom.session import cut
from kvloom.sources import text as sources
from kvloom.streaming import traffic as stream


def naive_murmur3(data: bytes, seed: int) -> int:
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    h = seed
    for i in range(0, len(data) // 4 * 4, 4):
        k = rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
    tail = data[len(data) // 4 * 4 :]
    if tail:
        h ^= rot(int.from_bytes(tail, "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def test_murmur3():
    r = random.Random(1)
    rows = [r.randbytes(r.randrange(20)) for _ in range(500)] + [b""]
    for seed in (0, 7, 0xFFFFFFFF):
        assert P.murmur3(rows, seed).tolist() == [naive_murmur3(x, seed) for x in rows]
    assert P.murmur3([b"hello"]).tolist() == [0x248BFA47]


def test_jump_moves_few():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64)
    a, b = P.jump(keys, 9), P.jump(keys, 10)
    assert ((a == b) | (b == 9)).all() and 0.08 < (b == 9).mean() < 0.12 and P.jump(keys, 1).max() == 0


@pytest.mark.parametrize("text,slot", [("123456789", 12739), ("{user1000}.following", 3443), ("foo{}{bar}", 8363), ("", 0)])
def test_known_slots(spark, text, slot):
    assert spark.createDataFrame([(text,)], "key string").select(K.key_slot(F.col("key"))).first()[0] == slot


def test_even_split():
    assert slots.even_split(3) == [(1, 0, 5460), (2, 5461, 10922), (3, 10923, 16383)]


def test_movement_needless(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    nodes = ["a", "b", "c"]
    got = {a: placement.movement(keys, nodes, [*nodes, "d"], a).first() for a in ("modulo", "ring", "rendezvous", "jump")}
    assert got["modulo"].moved > 2000
    for a in ("ring", "rendezvous", "jump"):
        assert got[a].needless == 0 and 500 < got[a].moved < 1000


def test_number_order(spark):
    r = random.Random(4)
    texts = ["0", "-0.0", "1", "1.0", "10e-1", "1E-130", "9.9E125", "-9.9E125", "-1E-130", "00012", "+12", ".5"]
    texts += [f"{'-' if r.random() < 0.5 else ''}{r.randrange(10 ** r.randrange(1, 20))}e{r.randrange(-30, 30)}" for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("k", number_key(F.col("t")))
    got = [Decimal(x.t) for x in df.orderBy("k").collect()]
    assert got == sorted(got)
    keys = {x.t: x.k for x in df.collect()}
    assert keys["1"] == keys["1.0"] == keys["10e-1"] and keys["0"] == keys["-0.0"] and keys["00012"] == keys["+12"]


def lines(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "line_no long, value string")


def test_capture(spark):
    rows = [
        'OK', '1700000000.000001 [0 10.0.0.1:5000] "SET" "a\\x00b" "v \\"q\\""', '+1700000001.5 bad', '1700000002.999999 [3 [::1]:77] "get" "k"\r', "junk",
    ]
    got = sources.commands(lines(spark, rows)).orderBy("line_no").collect()
    assert [(r.sec, r.usec, r.db, r.client, r.args) for r in got] == [(1700000000, 1, 0, "10.0.0.1:5000", ["SET", "a\x00b", 'v "q"']), (1700000002, 999999, 3, "[::1]:77", ["get", "k"])]
    assert got[1].host == "::1" and sources.bad_lines(lines(spark, rows)).count() == 2


def test_key_list(spark, tmp_path):
    (tmp_path / "keys").write_bytes(b'1) "a\\xffb"\r\n 2) plain\n\n"q"\n')
    assert [bytes(r.key) for r in sources.key_list(spark, str(tmp_path / "keys")).collect()] == [b"a\xffb", b"plain", b"q"]


def test_cluster_and_edges(spark):
    rows = ["07c 127.0.0.1:1@2,h myself,master - 0 0 1 connected 0-5 7 [9->-x]", "08c 127.0.0.1:3@4 slave 07c 0 0 1 connected", "09c 127.0.0.1:3@4 odd - 0 0 1 connected", "short"]
    assert [(r.id, r.lo, r.hi) for r in sources.cluster_nodes(lines(spark, rows)).collect()] == [("07c", 0, 5), ("07c", 7, 7)]
    assert sorted(r.problem for r in sources.cluster_errors(lines(spark, rows)).collect()) == ["too few fields", "unknown flag"]
    got = sources.edge_list(lines(spark, ["a likes b", "a,b", "# c", "x y # z"])).collect()
    assert [tuple(r) for r in got] == [("a", "likes", "b"), ("a", "link", "b"), ("x", "link", "y")]


def test_globs():
    import re

    for glob, yes, no in (("a*c", "abc", "abd"), ("a?c", "a.c", "ac"), ("[a-c]x", "bx", "dx"), ("[^a]x", "bx", "ax"), (r"a\*", "a*", "ab"), ("a.b", "a.b", "axb")):
        assert re.match(store.glob_regex(glob), yes) and not re.match(store.glob_regex(glob), no)


@pytest.mark.parametrize("chunk", [1 << 16, 64])
def test_stack_distance_is_naive_lru(spark, monkeypatch, chunk):
    monkeypatch.setattr(traffic, "CHUNK", chunk)
    r = random.Random(2)
    keys = {c: [f"k{int(r.paretovariate(0.8)) % 50}" for _ in range(700)] for c in (0, 1)}
    rows = [(c, t, k) for c in keys for t, k in enumerate(keys[c])]
    got = {(x.capture, x.t): x.distance for x in traffic.stack_distances(spark.createDataFrame(rows, "capture int, t long, key string")).collect()}
    for c in keys:
        stack = []
        for t, k in enumerate(keys[c]):
            assert got[c, t] == (stack.index(k) if k in stack else None)
            if k in stack:
                stack.remove(k)
            stack.insert(0, k)


def test_key_of_two_murmurs(spark):
    """The 64-bit key's halves have the seeds 0 and 0x9747b28c."""
    keys = [f"user:{i}" for i in range(300)] + ["x" * 5000]
    want = P.jump(np.array([(naive_murmur3(k.encode(), 0) << 32) | naive_murmur3(k.encode(), 0x9747B28C) for k in keys], np.uint64), 7).tolist()
    got = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").select("i", P.jump_col(7)("k").alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("0b6f2c1e-9a7d-4c3b-8f21-5d6e7a8b9c0d", "<uuid>"), ("abcdefab-abcd-abcd-abcd-abcdefabcdef", "<uuid>"), ("42", "<id>"), ("-5", "-5"), ("2024-01", "<date>"), ("2024-01-02T10:20:30.5Z", "<date>"), ("2024-01-02 10", "<date>"),
        ("a@b.co", "<email>"), ("10.0.0.255", "<ip>"), ("deadbeef0123", "<hex>"), ("Ab1+/=_-Ab1+/=_-Ab1+", "<token>"), ("{42}", "{<id>}"), ("{}", "{}"), ("profile", "profile"), ("", ""),
    ],
)
def test_segment_classes(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(K.segment_class(F.col("s"))).first()[0] == want


def test_near_names(spark):
    names = [("user", 9), ("suer", 3), ("users", 2), ("User", 5), ("ab", 4), ("ac", 4), ("<id>x", 2), ("<id>y", 2), ("cart", 1)]
    got = {tuple(sorted(r)) for r in keyspace.near_names(spark.createDataFrame(names, "name string, keys long")).collect()}
    assert got == {("suer", "user"), ("user", "users")}


def test_set_then_expire(spark):
    rows = [
        ("a", 1, "SET", "k", ["SET", "k", "v"]), ("a", 2, "EXPIRE", "k", ["EXPIRE", "k", "9"]), ("a", 3, "SETNX", "k", ["SETNX", "k", "EX"]), ("a", 4, "PEXPIRE", "k", []), ("a", 5, "SET", "k", ["SET", "k", "v", "ex", "5"]),
        ("a", 6, "EXPIRE", "k", []), ("a", 7, "MULTI", None, []), ("a", 8, "SET", "k", ["SET", "k", "v"]), ("a", 9, "EXPIRE", "k", []), ("a", 10, "EXEC", None, []), ("lua", 11, "SET", "k", ["SET", "k", "v"]), ("lua", 12, "EXPIRE", "k", []),
        ("unix:/s", 13, "SET", "k", ["SET", "k", "v"]), ("unix:/s", 14, "EXPIRE", "k", []), ("b", 15, "SET", "k", ["SET", "k", "EX"]), ("b", 16, "EXPIREAT", "k", []), ("b", 17, "SET", "k", ["SET", "k", "v"]), ("b", 18, "EXPIRE", "j", []),
    ]
    got = traffic.set_then_expire(spark.createDataFrame([(*r[:2], 0, *r[2:]) for r in rows], "client string, line_no long, db int, command string, key string, args array<string>"))
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("b", 1)}


def test_requests_are_full_but_the_last(spark):
    got = store.batches(spark.range(1030).select((F.col("id") * 7 % 1030).alias("item_id")).repartition(5)).orderBy("request").collect()
    assert [r["items"] for r in got] == [list(range(at, min(at + 25, 1030))) for at in range(0, 1030, 25)]


def test_callers_are_carried_over_chunks(spark):
    rows = [(i, i % 2, f"c{i}", "script" if i % 7 == 0 else "read") for i in range(200)]
    df = spark.createDataFrame(rows, "line_no long, db int, client string, kind string")
    whole, cut = ({tuple(r) for r in traffic.last_script_client(df, lines=n).collect()} for n in (1000, 9))
    assert whole == cut and len(cut) == 200


def test_connection_state(spark, tmp_path):
    rows = [("a", 1, "MULTI"), ("a", 2, "EXEC"), ("b", 3, "MULTI"), ("a", 4, "GET"), ("b", 5, "EXEC"), ("b", 6, "MULTI")]
    spark.createDataFrame(rows, "client string, line_no long, command string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("client string, line_no long, command string").parquet(str(tmp_path / "in"))
    got = {r.client: (r.commands, r.transactions, r.in_multi) for r in stream.drained(stream.connection_state(source), "update").collect()}
    assert got == {"a": (3, 1, False), "b": (3, 1, True)}


def test_records(spark, tmp_path):
    from kvloom.sources import records

    (tmp_path / "a.csv").write_text('﻿id;"na;me"\n1;"x ""y"";\nz"\n2\n', encoding="utf-8")
    got = records.csv_records(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "na;me"] and [tuple(r) for r in got.collect()] == [("1", 'x "y";\nz'), ("2", "")]
    assert records.guess_delimiter("a|b|c,d") == "|" and records.guess_delimiter("a") == ","
    lines_ = lines(spark, ['{"Items":[{"a":{"N":"1.50"}},{"a":{"N":"2"}}]}', '{"Item":{"a":{"N":"3"}}}', "", "[{\"a\":{\"N\":\"4\"}}]", '{"a":{"N":"5"}}', "{bad"])
    parsed = records.json_records(lines_)
    assert [r.error for r in parsed.where("error is not null").collect()] == ["{bad"]
    items = records.unwrapped(parsed.where("error is null"))
    assert sorted(r[0] for r in items.select(F.try_variant_get("item", "$.a.N", "string")).collect()) == ["1.50", "2", "3", "4", "5"]
    assert [r.command for r in records.command_file(lines(spark, ["# c", " SET a b ", ""])).collect()] == ["SET a b"]
    keys = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xff\x00"),)], "key binary")
    assert [r[0] for r in keys.select(records.key_text(F.col("key"))).collect()] == ["é", "0xFF00"]


def test_near_names_are_an_edit_or_a_swap_apart(spark):
    names = ["user", "suer", "usre", "users", "uesr", "resu", "euser", "a", "b", "ab", "ba", ""]
    edit = lambda a, b: any(a == b[:i] + b[i + 1 :] for i in range(len(b))) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    swap = lambda a, b: any(a == b[:i] + b[i + 1] + b[i] + b[i + 2 :] for i in range(len(b) - 1))
    want = {(a, b) for a in names for b in names if a < b and min(len(a), len(b)) >= 3 and (edit(a, b) or edit(b, a) or swap(a, b))}
    got = keyspace.near_names(spark.createDataFrame([(n, 1) for n in names], "name string, keys long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and ("suer", "user") in want


def test_setting_lines_give_what_last_settings_joins(spark):
    r = random.Random(13)
    rows = [(i, r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice("xyz")) for i in r.sample(range(10_000), 600)]
    lines = spark.createDataFrame(rows, "line long, name string, value string")
    want = {x.name: (x.value, x.set_by) for x in store.last_settings(lines).collect()}
    got = {}
    for x in sorted(store.setting_lines(lines, 7).collect(), key=lambda x: x.place):
        got.setdefault(x.name, []).append(x)
    assert {n: (own[0].value, ",".join(str(x.line) for x in own)) for n, own in got.items()} == want
    assert all([x.place for x in own] == list(range(1, len(own) + 1)) for own in got.values())
    assert store.setting_lines(lines.limit(0)).count() == 0


#: A command, its table row (first, last, step, flags; none: unknown) and the keys it has.
FORMS = [
    ("SET k v EX 5", (1, 1, 1, "w"), ["k"]),
    ("mset a 1 b 2 c 3", (1, -1, 2, "w"), ["a", "b", "c"]),
    ("RENAME a b", (1, 2, 1, "w"), ["a", "b"]),
    ("BLPOP a b 0", (1, -2, 1, "w"), ["a", "b"]),
    ("SPUBLISH channel text", (1, 1, 1, "p"), []),
    ("GET", (1, 1, 1, "r"), []),
    ("NOSUCH a b", None, []),
    ("EVAL script 2 a b c", None, ["a", "b"]),
    ("EVAL script 3 a b", None, []),
    ("EVAL script 0 a", None, []),
    ("EVAL script", None, []),
    ("FCALL f x a", None, []),
    ("BLMPOP 0 2 a b LEFT", None, ["a", "b"]),
    ("ZUNIONSTORE d 2 a b WEIGHTS 1 2", None, ["d", "a", "b"]),
    ("ZUNIONSTORE d 9 a", None, ["d"]),
    ("XREAD COUNT 2 BLOCK 0 STREAMS a b 0 0", None, ["a", "b"]),
    ("XREADGROUP GROUP STREAMS streams COUNT STREAMS NOACK streams a >", None, ["a"]),
    ("XREAD STREAMS a b 0", None, []),
    ("XREAD other STREAMS a 0", None, []),
    ("SORT a BY STORE GET STORE STORE d", None, ["a", "d"]),
    ("SORT a LIMIT 0 STORE DESC", None, ["a"]),
    ("SORT a STORE b STORE c", None, ["a", "c"]),
    ("SORT a STORE", None, ["a"]),
    ("SORT_RO a STORE b", None, ["a"]),
    ("GEORADIUS a 1 2 3 km STORE b STOREDIST c", None, ["a", "c"]),
    ("GEORADIUSBYMEMBER a m 3 km STOREDIST b", None, ["a", "b"]),
    ("MIGRATE h 1 k 0 5 AUTH KEYS", None, ["k"]),
    ("MIGRATE h 1 '' 0 5 COPY AUTH2 KEYS KEYS KEYS a b", None, ["a", "b"]),
    ("MIGRATE h 1 k 0 5 KEYS a", None, []),
    ("CLUSTERSCAN 0", (1, 1, 1, "r"), []),
    ("MSETEX 2 a 1 b 2 EX 5", None, ["a", "b"]),
    ("MSETEX 2 a 1 b", None, []),
]


def test_keys_of_command_forms(spark):
    rows = [(i, [w.strip("'") for w in f.split(" ")], *(row or (None,) * 4)) for i, (f, row, _) in enumerate(FORMS)]
    df = spark.createDataFrame(rows, "i int, args array<string>, first int, last int, step int, flags string")
    got = {r.i: r.k for r in df.select("i", commands.command_keys(*[F.col(c) for c in ("args", "first", "last", "step", "flags")]).alias("k")).collect()}
    assert [got[i] for i in range(len(FORMS))] == [want for _, _, want in FORMS]


def test_subcommands_bytes_and_findings_of_arguments(spark):
    lines = [
        ("client", ["client", "setname", "x"]), ("client", ["CLIENT", "LIST"]), ("lua", ["GET", "a"]), ("1.1.1.1:5", ["LRANGE", "l", "0", "-1"]),
        ("1.1.1.1:6", ["MGET", "a", "b"]), ("1.1.1.1:6", ["MGET", "{t}a", "{t}b"]), ("1.1.1.1:6", ["SET", "a", "x" * (100 * 1024)]), ("1.1.1.1:6", []),
    ]
    df = spark.createDataFrame([(i, 0, c, a) for i, (c, a) in enumerate(lines)], "line_no int, db int, client string, args array<string>")
    calls = traffic.with_keys(df, views.command_table(spark))
    assert [(r.base, r.command, r.unknown) for r in calls.orderBy("line_no").limit(2).collect()] == [("CLIENT", "CLIENT SETNAME", False), ("CLIENT", "CLIENT", True)]
    host = traffic.volumes(calls).where("item = '1.1.1.1'").first()
    assert (host.n, host.connections, host.bytes) == (5, 2, 10 + 6 + 12 + 4 + 100 * 1024)
    assert traffic.volumes(calls).where("item = 'GET'").first().connections == 0
    found = {r.finding: r.n for r in traffic.traffic_findings(calls).collect()}
    assert found["whole"] == found["large"] == found["cross-slot"] == 1
    accesses = {(r.key): (r.reads, r.writes) for r in traffic.key_accesses(calls).collect()}
    assert accesses["a"] == (2, 1) and accesses["b"] == (1, 0)


def test_find_nodes(spark):
    nodes = spark.createDataFrame([("abcdef01", "h1", 1), ("abcdef02", "h2", 1), ("0123456789", "h2", 2), ("fedcba", "H3", 1)], "id string, host string, port int")
    refs = ["ABCDEF01", "abcdef", "012345", "01234", "h2:2", "h3:1 ", "h9:1", None]
    got = {r.ref: (r.id, r.problem) for r in rebalance.find_nodes(nodes, spark.createDataFrame([(r,) for r in refs], "ref string")).collect()}
    none = (None, "no such node")
    assert got == {"ABCDEF01": ("abcdef01", None), "abcdef": (None, "more than one node"), "012345": ("0123456789", None), "01234": none, "h2:2": ("0123456789", None), "h3:1 ": ("fedcba", None), "h9:1": none, None: none}


def test_list_append(spark):
    rows = [('{"L":[]}', '{"L":[{"N":"1.50"}]}'), ('{"L":[{"M":{"a":{"S":"x"}}}]}', '{"L":[{"BOOL":true}]}'), ('{"S":"x"}', '{"L":[]}'), (None, '{"L":[]}'), ("no json", '{"L":[]}')]
    got = spark.createDataFrame(rows, "a string, b string").select(documents.list_append(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ['{"L":[{"N":"1.50"}]}', '{"L":[{"M":{"a":{"S":"x"}}},{"BOOL":true}]}', None, None, None]


def test_exact_arithmetic():
    """Sums of stored numbers against fractions; what cannot be stored is null."""
    from fractions import Fraction

    r = random.Random(9)
    numbers = [f"{r.choice(['', '-', '+'])}{r.randrange(10**r.randrange(1, 20))}{r.choice(['', '.5', '.', '.070'])}{r.choice(['', 'e3', 'E-7', 'e+2'])}" for _ in range(300)]
    for a, b in zip(numbers, numbers[1:]):
        assert Fraction(values._sum(a, b, 1)) == Fraction(Decimal(a)) + Fraction(Decimal(b)), (a, b)
        assert Fraction(values._sum(a, b, -1)) == Fraction(Decimal(a)) - Fraction(Decimal(b)), (a, b)
    assert values._sum("1", "1e37", 1) == "1" + "0" * 36 + "1" and values._sum("1", "1e38", 1) is None
    assert values._sum("9e125", "1e125", 1) is None and values._sum("1e125", "-1e125", 1) == "0"
    assert values._sum("1E-130", "1E-130", -1) == "0." + "0" * 130 and values._sum("1.50", "1.5", -1) == "0.0"
    for odd in ("", "x", "1_0", "NaN", "Infinity", "1e126", "1e-131", "1e99999999999", "1" * 39, "\u0661", None):
        assert values._sum(odd, "1", 1) is None, odd


def test_added_lists_and_deep_equality(spark):
    rows = [
        ('{"N":"1.5"}', '{"N":"-0.50"}', '{"N":"1"}', False),
        ('{"NS":["1","2"]}', '{"NS":["2.0","3"]}', '{"NS":["1","2","3"]}', False),
        ('{"SS":["a"]}', '{"SS":["b","a"]}', '{"SS":["a","b"]}', False),
        ('{"BS":["YQ=="]}', '{"BS":["Yg=="]}', '{"BS":["YQ==","Yg=="]}', False),
        ('{"N":"1e125"}', '{"N":"9e125"}', None, False),
        ('{"SS":["1"]}', '{"NS":["1"]}', None, False),
        (None, '{"N":"7"}', '{"N":"7"}', False),
        ('{"M":{"a":{"N":"1"},"b":{"NULL":true}}}', '{"M":{"b":{"NULL":true},"a":{"N":"10e-1"}}}', None, True),
        ('{"NS":["-0","10"]}', '{"NS":["1e1","0.0"]}', '{"NS":["-0","10"]}', True),
        ('{"L":[{"S":"a"},{"S":"b"}]}', '{"L":[{"S":"b"},{"S":"a"}]}', None, False),
        ('{"S":"1"}', '{"N":"1"}', None, False),
        ("not json", "not json", None, False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, total string, same boolean")
    for x in df.select("*", documents.added(F.col("a"), F.col("b")).alias("got"), values.same_value(F.col("a"), F.col("b")).alias("equal")).collect():
        assert (x.got, x.equal) == (x.total, x.same), x
    lists = spark.createDataFrame([('{"L":[{"S":"a"},{"S":"b"},{"S":"c"}]}',), ('{"L":[]}',), ('{"S":"a"}',), (None,)], "l string")
    new = {4: F.lit('{"S":"y"}'), 1: F.lit('{"S":"x"}')}
    got = [r[0] for r in lists.select(documents.update_list(F.col("l"), new, (0, 9))).collect()]
    assert got == ['{"L":[{"S":"x"},{"S":"c"},{"S":"y"}]}', '{"L":[{"S":"x"},{"S":"y"}]}', None, None]


def test_store_findings(spark):
    big = "x" * (1 << 20)
    rows = [
        ("/registry/secrets/a", 1, 0, False, "k8s:enc:kms:v2:k:..."), ("/registry/secrets/b", 2, 0, False, "k8s:enc:?"), ("/registry/secrets/c", 3, 0, False, "plain"), ("/registry/secrets/c", 4, 0, True, None),
        ("/registry/pods/p", 5, 0, False, '{"kind":"Pod","apiVersion":"v1","metadata":{"managedFields":[{"a":1},{"b":2}]}}'), ("/registry/pods/q", 6, 0, False, '{"kind":'), ("/registry/pods/r", 7, 0, False, big), ("other", 8, 0, False, "[]"),
    ]
    schema = "key string, main int, sub int, deleted boolean, value string"
    o = revisions.objects(spark.createDataFrame(rows, schema))
    got = {r.key: r for r in o.collect()}
    assert {k: r.format for k, r in got.items()} == {"/registry/secrets/a": "encrypted", "/registry/secrets/b": "encrypted", "/registry/secrets/c": None, "/registry/pods/p": "json", "/registry/pods/q": "text", "/registry/pods/r": "text", "other": "text"}
    assert got["/registry/pods/p"].managed == len('[{"a":1},{"b":2}]') and got["/registry/secrets/c"].history_bytes == 2 * len("/registry/secrets/c") + len("plain")
    assert {(r.provider, r.secrets) for r in revisions.secrets(o).collect()} == {("kms:v2", 1), ("unknown", 1)}
    assert [(r.kind, r.objects) for r in revisions.kinds(o).collect()] == [("Pod", 1)]
    found = [tuple(r) for r in revisions.findings(o, size=99, free=10, quota=100).collect()]
    assert [f[:2] for f in found] == [("bad", "quota"), ("warn", "big-values"), ("info", "managed-fields"), ("ok", "secrets")] and found[3][2:] == (2, 2)
    assert revisions.findings(revisions.objects(spark.createDataFrame([], schema))).count() == 0


def test_conditions_on_bytes(spark):
    rows = ['{"a":{"B":"AAEC"}}', '{"a":{"BS":["AAE=","/w=="]}}', '{"a":{"S":"AAEC"}}', '{"a":{"B":"?"}}', "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", F.parse_json("t").alias("item"))
    a = Attr("a")
    got = df.select(a.begins_with(b"\x00\x01").alias("b"), a.contains(b"\x01\x02").alias("c"), a.contains(b"\xff").alias("m"), a.size().alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, True, False, 3), (False, False, True, 2), (False, False, False, 4), (False, False, False, None), (False, False, False, None)]


def test_conditions_read_a_document_once(spark):
    """A filter's plan builds the document once and each condition computes its number once, with the results of plain decimals."""
    rows = [(i, None if i % 7 == 0 else Decimal(i - 40) / 4, i % 3 == 0) for i in range(80)]
    items = documents.to_items(spark.createDataFrame(rows, "i int, n decimal(12,2), odd boolean"), "i")
    n, odd = Attr("n"), Attr("odd")
    tests = {
        "between": (n.between(-2.5, 3), lambda x, o: x is not None and -2.5 <= x <= 3),
        "outside": (~n.between(0, 0) & odd.eq(True), lambda x, o: x != 0 and o),
        "in": (n.is_in([1, "x", 2.5, True, float("nan")]), lambda x, o: x in (1, 2.5)),
        "mixed": (n.between("a", 1), lambda x, o: False),
        "below": (n.lt(float("inf")) | n.ge(Decimal("0.25E1")), lambda x, o: x is not None and x >= 2.5),
    }
    for name, (test, want) in tests.items():
        chosen = items.where(test).select("i")
        assert sorted(r.i for r in chosen.collect()) == [i for i, x, o in rows if want(x, o)], name
        plan = chosen._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("StructsToJsonEvaluator") <= 1, name
        assert plan.count("RLIKE") <= 2, name


def test_number_sets_by_value(spark):
    rows = [
        (["1", "2.50", "-3"], ["1.0", "25e-1", "7"], ["1", "2.50", "-3", "7"], ["-3"]),
        (["0"], ["-0.0"], ["0"], None),
        ([], ["1e9"], ["1e9"], None),
        (["1e9"], [], ["1e9"], ["1e9"]),
        (None, ["1"], None, None),
        (["1"], None, None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "a array<string>, b array<string>")
    out = df.select(documents.numbers_union(F.col("a"), F.col("b")).alias("u"), documents.numbers_except(F.col("a"), F.col("b")).alias("e"))
    assert [(r.u, r.e) for r in out.collect()] == [(u, e) for *_, u, e in rows]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 4


def test_folding_counts_the_keys_once(spark):
    """The keys are read once, not for each level and use, and a segment's classes are tried once."""
    read = spark.sparkContext.accumulator(0)

    def counted(key):
        read.add(1)
        return key

    names = [f"order:n{i}x:{i}" for i in range(60)] + ["user:1:view", "user:2:view", "cart:{7}:items"]
    keys = spark.createDataFrame([(n,) for n in names], "key string").repartition(3).select(F.udf(counted, "string").asNondeterministic()("key").alias("key"))
    patterns = keys.groupBy(K.key_pattern(F.col("key")).alias("pattern")).agg(F.count("*").alias("keys"))
    got = {r.pattern: r["keys"] for r in keyspace.fold_busy_levels(patterns, cut=cut).collect()}
    assert got == {"order:<*>:<id>": 60, "user:<id>:view": 2, "cart:{<id>}:items": 1}
    assert read.value == len(names)
    plan = patterns._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 1 + len(K.CLASSES)

"""Text sources: key lists, command captures, cluster layouts, edge lists, settings output."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import client_host

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b"}
_QUOTED = re.compile(r"\\x([0-9a-fA-F]{2})|\\(.)", re.DOTALL)
_ARG = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)', re.DOTALL)


def unquoted(inner: str) -> str:
    """What a quoted text stands for; bytes are characters U+0000 to U+00FF."""
    return _QUOTED.sub(lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), inner)


def _strings(path_or_lines, spark: SparkSession) -> DataFrame:
    return spark.read.text(path_or_lines) if isinstance(path_or_lines, (str, list)) else path_or_lines


def key_list(spark: SparkSession, path, raw: bool = False) -> DataFrame:
    """key: one key a line, as binary. Numbering ('1) ') and quotes are taken off unless raw; blank lines are dropped."""
    lines = _strings(path, spark).select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")
    if raw:
        return lines.select(F.encode("value", "UTF-8").alias("key"))
    bare = lines.select(F.regexp_replace("value", r"^( *[0-9]+\) +)+", "").alias("value"))

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unquoted(v[1:-1]) if len(v) > 1 and v[0] == v[-1] == '"' else v)

    simple = F.contains("value", F.lit("\\"))
    quoted = F.regexp_like("value", F.lit('^".*"$'))
    stripped = F.when(quoted & ~simple, F.encode(F.expr("substring(value, 2, length(value) - 2)"), "UTF-8")).when(quoted, F.encode(plain("value"), "ISO-8859-1")).otherwise(F.encode("value", "UTF-8"))
    return bare.select(stripped.alias("key"))


#: Head of a capture's line: time, database, client, arguments.
HEAD = r'^\+?([0-9]{10})\.([0-9]{6}) \[([0-9]+) ([^\]]+(?:\])?[^\]]*)\] (".*)$'


def commands(lines: DataFrame) -> DataFrame:
    """lines(line_no, value) -> line_no, sec, usec, db, client, host, args (texts of one character a byte). Works on a stream too."""
    value = F.regexp_replace("value", "\r$", "")
    part = lambda i: F.regexp_extract(value, HEAD, i)

    @F.pandas_udf("array<string>")
    def split(rest: pd.Series) -> pd.Series:
        return rest.map(lambda v: [unquoted(q) if q or not w else w for q, w in _ARG.findall(v)])

    rows = lines.where(F.regexp_like(value, F.lit(HEAD)))
    return rows.select("line_no", part(1).cast("long").alias("sec"), part(2).cast("int").alias("usec"), part(3).cast("int").alias("db"), part(4).alias("client"), split(part(5)).alias("args")).withColumn("host", client_host(F.col("client")))


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither commands nor OK nor blank."""
    value = F.regexp_replace("value", "\r$", "")
    return lines.where(~F.regexp_like(value, F.lit(HEAD)) & ~F.trim(value).isin("", "OK", "+OK"))


def cluster_nodes(lines: DataFrame) -> DataFrame:
    """value -> id, address, flags, master, lo, hi: a row for each slot range of masters (lenient: other lines give none)."""
    f = F.split(F.trim(F.regexp_replace("value", "\r$", "")), " +")
    rows = lines.select(f.alias("f")).where(F.size("f") >= 8)
    rows = rows.select(F.element_at("f", 1).alias("id"), F.regexp_extract(F.element_at("f", 2), r"^([^@,]*)", 1).alias("address"), F.split(F.element_at("f", 3), ",").alias("flags"), F.slice("f", 9, 20000).alias("ranges"))
    rows = rows.where(F.array_contains("flags", "master")).select("id", "address", F.explode("ranges").alias("r")).where(F.regexp_like("r", F.lit("^[0-9]+(-[0-9]+)?$")))
    return rows.select("id", "address", F.split_part("r", F.lit("-"), F.lit(1)).cast("int").alias("lo"), F.split_part("r", F.lit("-"), F.lit(-1)).cast("int").alias("hi"))


def cluster_errors(lines: DataFrame) -> DataFrame:
    """value, problem: one row for each line that a strict reading refuses."""
    flags = F.array(*[F.lit(x) for x in ("myself", "master", "slave", "fail?", "fail", "handshake", "noaddr", "nofailover", "noflags")])
    f = F.split(F.trim("value"), " +")
    problem = F.when(F.size(f) < 8, "too few fields").when(F.size(F.array_except(F.split(F.element_at(f, 3), ","), flags)) > 0, "unknown flag")
    return lines.where(F.trim("value") != "").select("value", problem.alias("problem")).where("problem is not null")


def edge_list(lines: DataFrame) -> DataFrame:
    """value -> src, type, dst: 'from type to', the same with commas, or two fields (type: link). # starts a comment."""
    clean = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    parts = F.split(clean, r"\s*,\s*|\s+")
    rows = lines.select(parts.alias("p")).where(F.size("p").isin(2, 3))
    return rows.select(F.element_at("p", 1).alias("src"), F.when(F.size("p") == 3, F.element_at("p", 2)).otherwise("link").alias("type"), F.element_at("p", -1).alias("dst"))


def config_get(lines: DataFrame) -> DataFrame:
    """lines(idx, value) -> name, value: output in pairs, plain or numbered. Pairs are told by the place of a line; order is the file's."""
    bare = F.regexp_replace("value", r'^ *[0-9]+\) +"?|"$', "")
    rows = lines.select(F.floor(F.col("idx") / 2).alias("pair"), (F.col("idx") % 2).alias("side"), bare.alias("value"))
    return rows.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("name"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("value")).select("name", "value")

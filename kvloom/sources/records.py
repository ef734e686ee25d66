"""Record sources: delimited text, JSON and JSON Lines, wrapped document results, command files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DELIMITERS = (",", "\t", ";", "|")


def guess_delimiter(line: str) -> str:
    """The delimiter that is most often outside quotes in a header line; the first of equals."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
    return max(DELIMITERS, key=counts.get)


def csv_records(spark: SparkSession, path: str, header: bool = True, delimiter: str | None = None) -> DataFrame:
    """Delimited text by RFC 4180, all columns texts; short rows are filled with ''. Without a header columns are column1, column2, ...

    Only the first line is looked at to guess the delimiter. Quoted line ends need
    multiLine, so a file is one task here; files are read side by side.
    """
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()
        delimiter = guess_delimiter(first[0][0].lstrip("﻿") if first else "")
    rows = spark.read.csv(path, sep=delimiter, header=header, multiLine=True, escape='"', encoding="UTF-8")
    if not header:
        rows = rows.toDF(*[f"column{i + 1}" for i in range(len(rows.columns))])
    return rows.na.fill("")


def json_records(lines: DataFrame) -> DataFrame:
    """value (JSON Lines) -> record (VARIANT), error: lines that are no JSON keep their text in error. Blank lines are dropped."""
    parsed = F.try_parse_json("value")
    return lines.where(F.trim("value") != "").select(parsed.alias("record"), F.when(parsed.isNull(), F.col("value")).alias("error"))


def unwrapped(items: DataFrame, column: str = "record") -> DataFrame:
    """item (VARIANT): the items inside {"Items": [...]}, {"Item": {...}}, [...], or the record itself."""
    c = F.col(column)
    get = lambda path, kind: F.try_variant_get(c, path, kind)
    inner = F.coalesce(get("$.Items", "array<variant>"), F.when(get("$.Item", "variant").isNotNull(), F.array(get("$.Item", "variant"))), get("$", "array<variant>"), F.array(c))
    return items.where(c.isNotNull()).select(F.explode(inner).alias("item"))


def command_file(lines: DataFrame) -> DataFrame:
    """value -> command lines without comments and blanks."""
    text = F.trim("value")
    return lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(text.alias("command"))


def key_text(key: Column) -> Column:
    """A binary key as text: UTF-8 where it is valid, else hex with a mark."""
    text = F.try_validate_utf8(key.cast("string"))
    return F.when(text.isNotNull(), text).otherwise(F.concat(F.lit("0x"), F.hex(key)))

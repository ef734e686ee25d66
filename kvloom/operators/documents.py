"""Typed documents: conversion from rows, projections, updates, sets, ordered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.conditions import Attr, number_key
from ..functions.keys import let
from ..functions.values import plus


def typed_value(column: Column, kind: T.DataType) -> Column | None:
    """Typed JSON of a column of a fixed schema: the shape {tag: value} as a struct."""
    if isinstance(kind, T.StringType):
        return F.when(column.isNotNull(), F.struct(column.alias("S")))
    if isinstance(kind, T.BooleanType):
        return F.when(column.isNotNull(), F.struct(column.alias("BOOL")))
    if isinstance(kind, T.NumericType):
        return F.when(column.isNotNull(), F.struct(column.cast("string").alias("N")))
    if isinstance(kind, T.BinaryType):
        return F.when(column.isNotNull(), F.struct(F.base64(column).alias("B")))
    if isinstance(kind, T.ArrayType):
        return F.when(column.isNotNull(), F.struct(F.transform(column, lambda x: typed_value(x, kind.elementType)).alias("L")))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(F.struct(*[typed_value(column[f.name], f.dataType).alias(f.name) for f in kind]).alias("M")))
    raise TypeError(f"no document type for {kind}")


def to_items(rows: DataFrame, key: str) -> DataFrame:
    """rows -> key, item (VARIANT of typed JSON). Null columns are left out.

    Exploded from an array of one, so that a filter is not moved below it and no condition builds the document anew.
    """
    item = F.struct(*[typed_value(rows[f.name], f.dataType).alias(f.name) for f in rows.schema if f.name != key])
    return rows.select(key, F.explode(F.array(F.parse_json(F.to_json(item)))).alias("item"))


def plain(item: Column, names: dict[str, str]) -> list[Column]:
    """Columns of scalar attributes; names: attribute -> tag (S, N, BOOL)."""
    return [F.try_variant_get(item, f"$['{n}'].{tag}", "boolean" if tag == "BOOL" else "string").alias(n) for n, tag in names.items()]


def project(items: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """key and the typed JSON (text) of each path; null where it is missing."""
    return items.select(key, *[F.to_json(F.try_variant_get("item", Attr(p).at, "variant")).alias(p) for p in paths])


def query(items: DataFrame, partition: Column, sort: Attr | None = None, number: bool = True, forward: bool = True, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Items of a key condition, by the sort attribute (numbers by value, texts by bytes), then filtered."""
    rows = items.where(partition)
    if sort is not None:
        by = number_key(sort.number()) if number else sort.text()
        rows = rows.orderBy(by.asc() if forward else by.desc())
    rows = rows.where(where) if where is not None else rows
    return rows.limit(limit) if limit is not None else rows


def update_map(attributes: Column, sets: dict[str, Column] | None = None, removes: tuple[str, ...] = ()) -> Column:
    """attributes: map of name to typed JSON text. All values are read from the image before the update; null values set nothing."""
    kept = F.map_filter(attributes, lambda k, v: ~k.isin(*removes, *(sets or {}))) if removes or sets else attributes
    if not sets:
        return kept
    new = F.map_filter(F.create_map(*[c for k, v in sets.items() for c in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return F.map_concat(kept, new)


def changed(before: Column, after: Column) -> Column:
    """Sorted names of attributes that differ between two maps of typed JSON text."""
    names = F.array_union(F.map_keys(before), F.map_keys(after))
    return F.sort_array(F.filter(names, lambda n: ~F.try_element_at(before, n).eqNullSafe(F.try_element_at(after, n))))


def _not_among(numbers: Column, others: Column) -> Column:
    """Numbers that others do not hold by value. The key of each member is computed once."""
    keyed = F.transform(numbers, lambda x: F.struct(x.alias("x"), number_key(x).alias("key")))
    return let(F.transform(others, number_key), lambda keys: F.transform(F.filter(keyed, lambda e: ~F.exists(keys, lambda k: k == e.key)), lambda e: e.x))


def numbers_union(a: Column, b: Column) -> Column:
    """Union of two number sets: equal values (1.0 and 1) are one, with the first spelling."""
    return F.concat(a, _not_among(b, a))


def numbers_except(a: Column, b: Column) -> Column:
    """Members of a that b does not hold by value; null if none is left, as an empty set cannot be kept."""
    return let(_not_among(a, b), lambda left: F.when(F.size(left) > 0, left))


def list_append(a: Column, b: Column) -> Column:
    """Typed JSON text of the list a followed by b; null unless both are lists."""
    first, second = (F.try_variant_get(F.try_parse_json(x), "$.L", "array<variant>") for x in (a, b))
    both = F.concat(first, second)
    return F.when(both.isNotNull(), F.to_json(F.struct(both.alias("L"))))


def _member(typed: Column, tag: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(typed), f"$.{tag}", kind)


def added(current: Column, value: Column) -> Column:
    """ADD: typed JSON text of a number plus a number, or a set with the members of another; the value itself where there is nothing yet.

    Null for values of different or other types, and for a sum that cannot be stored.
    """
    total = plus(_member(current, "N", "string"), _member(value, "N", "string"))
    sets = {t: (_member(current, t, "array<string>"), _member(value, t, "array<string>")) for t in ("SS", "NS", "BS")}
    out = F.when(current.isNull(), value).when(total.isNotNull(), F.to_json(F.struct(total.alias("N"))))
    for tag, (a, b) in sets.items():
        both = numbers_union(a, b) if tag == "NS" else F.concat(a, F.array_except(b, a))
        out = out.when(both.isNotNull(), F.to_json(F.struct(both.alias(tag))))
    return out


def update_list(typed: Column, sets: dict[int, Column] | None = None, removes: tuple[int, ...] = ()) -> Column:
    """Typed JSON text of a list with elements set and removed, by their places before the update.

    sets: place -> typed JSON text. Places past the end are appended in order of place; removing there does nothing. Null for what is no list.
    """
    sets = sets or {}
    old = _member(typed, "L", "array<variant>")
    element = lambda x, i: F.struct(i.alias("i"), reduce(lambda rest, k: F.when(i == k, F.try_parse_json(sets[k])).otherwise(rest), sets, x).alias("x"))
    kept = F.filter(F.transform(old, element), lambda e: ~e.i.isin(*removes)) if removes else F.transform(old, element)
    out = F.transform(kept, lambda e: e.x)
    for place in sorted(sets):
        out = F.when(F.size(old) <= place, F.concat(out, F.array(F.try_parse_json(sets[place])))).otherwise(out)
    return F.when(old.isNotNull(), F.to_json(F.struct(out.alias("L"))))

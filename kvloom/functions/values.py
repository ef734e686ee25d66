"""Exact arithmetic and deep equality of typed document values, as Arrow UDFs.

Numbers have 38 digits and magnitudes from 1e-130 to below 1e126; aligned, two of
them span more digits than any SQL decimal, and values nest without a fixed
schema, so these two are Python. Order and equality of numbers alone are native
(conditions.number_key).
"""

from __future__ import annotations

import json
import re
from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import Column, functions as F

#: Fixed limits of a stored number.
DIGITS, HIGHEST, LOWEST = 38, 125, -130
_EXACT = Context(prec=600)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,10})?", re.ASCII)


def _stored(number: Decimal) -> Decimal | None:
    """The number without trailing zeros; None if it cannot be stored."""
    if not number:
        return Decimal(0)
    if not LOWEST <= number.adjusted() <= HIGHEST or len(number.as_tuple().digits) > 500:
        return None
    number = number.normalize(_EXACT)
    return number if len(number.as_tuple().digits) <= DIGITS else None


def _number(text: str | None) -> Decimal | None:
    return _stored(_EXACT.create_decimal(text)) if isinstance(text, str) and len(text) <= 500 and _NUMBER.fullmatch(text) else None


def _places(number: Decimal) -> int:
    return max(0, -number.as_tuple().exponent)


def _sum(a: str | None, b: str | None, sign: int) -> str | None:
    x, y = _number(a), _number(b)
    if x is None or y is None:
        return None
    total = _stored(_EXACT.add(x, y if sign > 0 else -y))
    if total is None:
        return None
    # A sum that comes to zero keeps the places its terms had.
    return f"{total:f}" if total else f"{0:.{max(_places(x), _places(y))}f}"


def _adder(sign: int):
    @F.pandas_udf("string")
    def added(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_sum(x, y, sign) for x, y in zip(a, b)], index=a.index, dtype=object)

    return added


def plus(a: Column, b: Column) -> Column:
    """Exact sum of two number texts in plain digits; null if one is no number or the sum cannot be stored."""
    return _adder(1)(a, b)


def minus(a: Column, b: Column) -> Column:
    """Exact difference, as plus()."""
    return _adder(-1)(a, b)


def _canonical(value: dict):
    ((tag, x),) = value.items()
    if tag == "N":
        x = _key(x)
    elif tag == "NS":
        x = sorted(map(_key, x))
    elif tag in ("SS", "BS"):
        x = sorted(x)
    elif tag == "L":
        x = [_canonical(v) for v in x]
    elif tag == "M":
        x = {k: _canonical(v) for k, v in x.items()}
    elif tag == "NULL":
        x = True
    return {tag: x}


def _key(text: str) -> str:
    number = _number(text)
    if number is None:
        raise ValueError("no number that can be stored")
    return f"{number:E}"


def _canonical_text(text: str | None) -> str | None:
    try:
        return json.dumps(_canonical(json.loads(text)), sort_keys=True) if isinstance(text, str) else None
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None


def canonical(typed: Column) -> Column:
    """One spelling for all equal values of typed JSON text, to compare, group or join by: members of maps and sets in order, numbers by value.

    Null for what is no typed value.
    """

    @F.pandas_udf("string")
    def spelled(texts: pd.Series) -> pd.Series:
        return pd.Series([_canonical_text(t) for t in texts], index=texts.index, dtype=object)

    return spelled(typed)


def same_value(a: Column, b: Column) -> Column:
    """Deep equality of two typed JSON texts; false if one is null or no typed value."""
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))

"""Conditions and updates on typed documents, as native columns.

A document is a VARIANT of typed JSON ({"S": ...}, {"N": "..."}, {"BOOL": ...},
{"L": [...]}, {"M": {...}}, {"SS": [...]} ...). Logic has two values: a comparison
with something missing, or of different types, is false, and ``ne`` is its exact
opposite. Numbers keep 38 digits and exponents from -130 to 125, which no SQL
decimal has: they are compared by an order-preserving key.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, functions as F

from .keys import let, utf16_size

_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def variant_path(path: str) -> str:
    """a.b[2] -> $['a'].M['b'].L[2]"""
    out, first = "$", True
    for name, index in _STEP.findall(path):
        if index:
            out += f".L[{index}]"
        else:
            out += ("" if first else ".M") + f"['{name}']"
        first = False
    return out


class Attr:
    """An attribute of the document column ``item``."""

    def __init__(self, path: str, item: str = "item"):
        self.path, self.item = path, item
        self.at = variant_path(path)

    def _get(self, tag: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col(self.item), f"{self.at}.{tag}", kind)

    def exists(self) -> Column:
        return F.try_variant_get(F.col(self.item), self.at, "variant").isNotNull()

    def not_exists(self) -> Column:
        return ~self.exists()

    def is_type(self, tag: str) -> Column:
        return F.try_variant_get(F.col(self.item), f"{self.at}.{tag}", "variant").isNotNull()

    def _test(self, kind: str, test: Callable[[Column], Column]) -> Column:
        """A test of the value of a kind (see _kind); false where it is missing. The value is read once."""
        if kind == "N":
            return F.coalesce(let(number_key(self._get("N")), test), F.lit(False))
        return F.coalesce(test(self._get(kind, "boolean" if kind == "BOOL" else "string")), F.lit(False))

    def _compare(self, value, how) -> Column:
        return self._test(_kind(value), lambda a: how(a, _operand(value)))

    def eq(self, value) -> Column:
        return self._compare(value, lambda a, b: a == b)

    def ne(self, value) -> Column:
        return ~self.eq(value)

    def lt(self, value) -> Column:
        return self._compare(value, lambda a, b: a < b)

    def le(self, value) -> Column:
        return self._compare(value, lambda a, b: a <= b)

    def gt(self, value) -> Column:
        return self._compare(value, lambda a, b: a > b)

    def ge(self, value) -> Column:
        return self._compare(value, lambda a, b: a >= b)

    def between(self, low, high) -> Column:
        if _kind(low) != _kind(high):
            return self.ge(low) & self.le(high)
        return self._test(_kind(low), lambda a: (a >= _operand(low)) & (a <= _operand(high)))

    def is_in(self, values: list) -> Column:
        of = {kind: [_operand(v) for v in values if _kind(v) == kind] for kind in map(_kind, values)}
        one_of = lambda among: lambda a: reduce(lambda x, y: x | y, [a == v for v in among])
        tests = [self._test(kind, one_of(among)) for kind, among in of.items()]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def _bytes(self) -> Column:
        return F.try_to_binary(self._get("B"), F.lit("base64"))

    def begins_with(self, prefix: str | bytes) -> Column:
        if isinstance(prefix, bytes):
            return F.coalesce(F.startswith(self._bytes(), F.lit(prefix)), F.lit(False))
        return F.coalesce(F.startswith(self._get("S"), F.lit(prefix)), F.lit(False))

    def contains(self, value) -> Column:
        """A substring of a text or of bytes, or a member of a set."""
        if isinstance(value, bytes):
            member = F.exists(self._get("BS", "array<string>"), lambda b: F.try_to_binary(b, F.lit("base64")) == F.lit(value))
            return F.coalesce(F.contains(self._bytes(), F.lit(value)), F.lit(False)) | F.coalesce(member, F.lit(False))
        if isinstance(value, str):
            member = F.array_contains(self._get("SS", "array<string>"), value)
            return F.coalesce(F.contains(self._get("S"), F.lit(value)), F.lit(False)) | F.coalesce(member, F.lit(False))
        key = _operand(value)
        return F.coalesce(F.exists(self._get("NS", "array<string>"), lambda n: number_key(n) == key), F.lit(False))

    def size(self) -> Column:
        """UTF-16 units of a text, bytes of a binary, members of a set, list or map; null otherwise."""
        members = F.coalesce(*[F.size(self._get(t, "array<variant>")) for t in ("SS", "NS", "BS", "L")], F.size(self._get("M", "map<string,variant>")))
        return F.coalesce(utf16_size(self._get("S")), F.octet_length(self._bytes()), F.when(members >= 0, members))

    def text(self) -> Column:
        return self._get("S")

    def number(self) -> Column:
        return self._get("N")


def _kind(value) -> str:
    return "BOOL" if isinstance(value, bool) else "S" if isinstance(value, str) else "N"


def _operand(value) -> Column:
    """What an attribute is compared with: a literal, of a number its key (null for what is none)."""
    if _kind(value) != "N":
        return F.lit(value)
    try:
        number = Decimal(str(value))
    except InvalidOperation:
        number = Decimal("NaN")
    if not number.is_finite():
        return F.lit(None).cast("struct<sign:int,exponent:int,digits:string>")
    digits = "".join(map(str, number.as_tuple().digits)).strip("0")
    if not digits:
        return _key(0, F.lit(0), F.lit(""))
    exponent = number.adjusted() + 1
    if number < 0:
        return _key(-1, F.lit(-exponent), F.lit(digits.translate(str.maketrans("0123456789", "9876543210")) + "~"))
    return _key(1, F.lit(exponent), F.lit(digits))


def _key(sign: int, exponent: Column, digits: Column) -> Column:
    return F.struct(F.lit(sign).alias("sign"), exponent.alias("exponent"), digits.alias("digits"))


def number_key(text: Column) -> Column:
    """A struct that orders and equates decimal numbers of any size: (sign, exponent, digits), turned round for negatives.

    '1.50' and '15e-1' give the same key. Null for what is no number. The text is computed once.
    """
    return let(text, lambda t: F.when(F.regexp_like(t, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), _key_of_number(t)))


def _key_of_number(text: Column) -> Column:
    """The key of a text that is a number, by steps that each name the one before."""
    signless = F.ltrim(text, F.lit("+-"))
    power = lambda low: F.coalesce(F.when(F.contains(low, F.lit("e")), F.try_to_number(F.ltrim(F.substring_index(low, "e", -1), F.lit("+")), F.lit("S999999")).cast("int")), F.lit(0))
    first = lambda low: F.struct(F.substring_index(low, "e", 1).alias("mantissa"), power(low).alias("power"))
    second = lambda m: F.struct(F.length(F.substring_index(m.mantissa, ".", 1)).alias("whole"), F.replace(m.mantissa, F.lit("."), F.lit("")).alias("digits"), m.power.alias("power"))
    third = lambda d: F.struct((d.whole - F.length(d.digits) + d.power).alias("places"), F.ltrim(d.digits, F.lit("0")).alias("led"))

    def key(p: Column) -> Column:
        significant = F.rtrim(p.led, F.lit("0"))
        exponent = p.places + F.length(p.led)
        # Digits of a negative are complemented, so that more digits come first; '~' ends them after every digit.
        turned = F.concat(F.translate(significant, "0123456789", "9876543210"), F.lit("~"))
        return F.when(p.led == "", _key(0, F.lit(0), F.lit(""))).when(F.startswith(text, F.lit("-")), _key(-1, -exponent, turned)).otherwise(_key(1, exponent, significant))

    return let(F.lower(signless), lambda low: let(first(low), lambda m: let(second(m), lambda d: let(third(d), key))))

"""Scalar functions of keys, as native columns: hash slot, tag, classes, patterns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

SLOTS = 16384
#: Separators in the order in which a tie is decided; the last three are weak.
SEPARATORS = (":", "/", "|", "#", ".", "_", "-")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often ``use`` names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _crc_row(i: int) -> int:
    """CRC-16 of one byte, polynomial 0x1021, from the definition."""
    crc = i << 8
    for _ in range(8):
        crc = ((crc << 1) ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def hash_tag(key: Column) -> Column:
    """What the slot is taken of: the text between the first '{' and the next '}' if there is any, else the key."""
    return F.when(F.regexp_like(key, F.lit(r"^[^{]*\{[^}]+\}")), F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)).otherwise(key)


def is_tagged(key: Column) -> Column:
    return F.regexp_like(key, F.lit(r"^[^{]*\{[^}]+\}"))


def crc16(text: Column) -> Column:
    """CRC-16/XMODEM of the bytes of a text (UTF-8), by table, in one fold."""
    table = F.array(*[F.lit(_crc_row(i)) for i in range(256)])
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    codes = F.transform(F.filter(F.split(latin, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda crc, b: F.shiftleft(crc, 8).bitwiseXOR(F.element_at(table, F.shiftrightunsigned(crc, 8).bitwiseXOR(b).bitwiseAND(255) + 1)).bitwiseAND(65535))


def key_slot(key: Column) -> Column:
    return crc16(hash_tag(key)) % SLOTS


#: The classes and their patterns, first match wins. A class replaces the segment in a pattern.
CLASSES = (
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("id", r"^\d+$"),
    ("date", r"^\d{4}-\d{2}(-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?Z?)?)?$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("ip", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("hex", r"^(?=.*\d)(?=.*[a-fA-F])[0-9a-fA-F]{12,}$"),
    ("token", r"^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_+=\/-]{20,}$"),
)


#: Characters that a segment of a class has at least; shorter ones need no pattern.
LEAST = {"uuid": 36, "date": 7, "email": 5, "ip": 7, "hex": 12, "token": 20}


def segment_class(segment: Column) -> Column:
    """<class> for segments that look generated, else the segment. Braces of a hash tag stay. Each pattern is tried once."""

    def classed(s: Column) -> Column:
        tagged = F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}")) & (F.length(s) > 2)

        def named(core: Column) -> Column:
            is_ = lambda name, pattern: (F.length(core) >= LEAST.get(name, 0)) & F.regexp_like(core, F.lit(pattern))
            first = reduce(lambda rest, c: F.when(is_(*c), F.lit(f"<{c[0]}>")).otherwise(rest), reversed(CLASSES), F.lit(None).cast("string"))
            return F.when(F.regexp_like(core, F.lit("[0-9@-]")), first)

        found = let(F.when(tagged, F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s), named)
        return let(found, lambda f: F.when(f.isNull(), s).when(tagged, F.concat(F.lit("{"), f, F.lit("}"))).otherwise(f))

    return let(segment, classed)


def key_pattern(key: Column, separator: str = ":") -> Column:
    return F.array_join(F.transform(F.split(key, _quoted(separator)), segment_class), separator)


def _quoted(separator: str) -> str:
    return f"\\{separator}" if separator in ".|-/#" else separator


def client_host(client: Column) -> Column:
    """The host of host:port, without the brackets of an IPv6 address."""
    return F.regexp_replace(F.regexp_replace(client, r":[0-9]+$", ""), r"^\[|\]$", "")


def utf16_size(text: Column) -> Column:
    """Length in UTF-16 units, as document stores count strings."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def snapshot_prefix(key: Column) -> Column:
    """Through the first ':', else the first of '.', '/', '|'; none for a separator at the start."""
    colon = F.instr(key, ":")
    other = F.regexp_instr(key, F.lit(r"[./|]"))
    at = F.when(colon > 0, colon).otherwise(other)
    return F.when(at > 1, F.substr(key, F.lit(1), at)).otherwise(F.lit("(keys without a separator)"))


_UNITS = {"": 1, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}


def parse_size(text: Column) -> Column:
    """'10k' is 10,000 and '10kb' 10,240; null for what is no size."""
    low = F.lower(F.trim(text))
    unit = F.regexp_extract(low, r"^[0-9]+([kmg]?b?)$", 1)
    scale = F.create_map(*[F.lit(x) for p in (_UNITS | {"b": 1}).items() for x in p])[unit]
    return F.when(F.regexp_like(low, F.lit(r"^[0-9]{1,12}([kmg]?b?)$")), F.regexp_extract(low, r"^([0-9]+)", 1).cast("long") * scale)


def human_size(n: Column, largest: str = "TB") -> Column:
    """Bytes with a binary unit (KB, MB, GB or TB, no larger than ``largest``) and one decimal, rounded down."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    units = ("KB", "MB", "GB", "TB")
    for power, unit in zip((10, 20, 30, 40), units[: units.index(largest) + 1]):
        out = F.when(n >= 1 << power, F.format_string(f"%d.%d {unit}", F.shiftright(n, power), F.shiftright((n % (1 << power)) * 10, power))).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    """1h2m3s; leading zero units are left out."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(""), F.when(seconds >= 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(""), s.cast("string"), F.lit("s"))


def significant_digits(text: Column) -> Column:
    """Digits of a decimal number without leading and trailing zeros (0 has one)."""
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9.]*)", 1), r"\.", "")
    return F.greatest(F.length(F.regexp_replace(F.regexp_replace(mantissa, "^0+", ""), "0+$", "")), F.lit(1))


def encoding_of(text: Column) -> Column:
    """hex, base64 or text. Base64 only if it decodes to mostly letters, digits and spaces."""
    is_hex = F.regexp_like(text, F.lit("^([0-9a-fA-F]{2}){4,}$"))
    shape = F.regexp_like(text, F.lit(r"^(?:[A-Za-z0-9+/]{4}){2,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"))
    inner = F.decode(F.when(shape & (F.length(text) % 4 == 0), F.unbase64(text)), "ISO-8859-1")
    plain = F.length(F.regexp_replace(inner, "[^A-Za-z0-9 ]", "")) >= 0.7 * F.length(inner)
    return F.when(is_hex, "hex").when(F.coalesce(plain, F.lit(False)), "base64").otherwise("text")


def key_positions(args: Column, first: Column, last: Column, step: Column) -> Column:
    """Arguments at first, first + step, ... last (negative: from the end). Arguments count from 1 after the command's name."""
    n = F.size(args) - 1
    end = F.when(last < 0, n + last + 1).otherwise(F.least(last, n))
    places = F.when((first > 0) & (end >= first), F.sequence(first, end, step)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.element_at(args, i + 1))

"""Scalar functions on keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with(key: Column, prefix: Column | str | bytes) -> Column:
    return key.startswith(prefix if isinstance(prefix, Column) else F.lit(prefix))


def size(x: Column) -> Column:
    """Bytes; null has none."""
    return F.coalesce(F.octet_length(x), F.lit(0))


def is_empty(x: Column) -> Column:
    return F.octet_length(x) == 0


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, bytewise."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def text(x: Column) -> Column:
    """UTF-8 text of bytes; bytes that aren't become U+FFFD."""
    return F.make_valid_utf8(x.cast("binary").cast("string"))


def parse_integer(x: Column) -> Column:
    """[+-]?[0-9]+ within 64 bits, else null; white space isn't a number."""
    return F.when(x.cast("string").rlike(r"^[+-]?[0-9]+\z"), x.cast("string").try_cast("bigint"))


def checksum(x: Column) -> Column:
    return F.crc32(x.cast("binary"))


def big_endian(x: Column, width: int) -> Column:
    """An unsigned integer as width bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 2 * width, "0"))


def internal_key(key: Column, seq: Column, op: Column) -> Column:
    """Bytes that sort by key, then newest first, then operation: key, 0 doubled as 00FF and closed by 0000, then ~seq, op.

    The escape keeps the order of keys of any length, with any bytes.
    """
    escaped = F.regexp_replace(F.hex(key.cast("binary")), "(..)", "$1 ")
    escaped = F.regexp_replace(F.regexp_replace(escaped, r"\b00 ", "00FF "), " ", "")
    return F.unhex(F.concat(escaped, F.lit("0000"), F.lpad(F.hex(F.bitwise_not(seq)), 16, "0"), F.lpad(F.hex(op), 2, "0")))


def varint(x: Column) -> Column:
    """Seven bits a byte, the lowest first, the high bit set on all but the last. x: not negative."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: (i == 0) | (F.call_function("shiftright", x, (i * 7).cast("int")) > 0))
    byte = F.transform(steps, lambda i: F.call_function("shiftright", x, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < F.size(steps) - 1, 128).otherwise(0))
    return F.unhex(F.array_join(F.transform(byte, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def from_varint(x: Column) -> Column:
    """The integer that leading bytes encode, or null if they end early."""
    raw = F.hex(x)
    byte = F.transform(F.filter(F.sequence(F.lit(1), F.lit(9)), lambda i: i * 2 <= F.length(raw)), lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    last = F.array_position(F.transform(byte, lambda b: b < 128), True).cast("int")
    used = F.slice(byte, 1, F.greatest(last, F.lit(0)))
    value = F.aggregate(F.reverse(used), F.lit(0).cast("bigint"), lambda a, b: a * 128 + b % 128)
    return F.when(last > 0, value)

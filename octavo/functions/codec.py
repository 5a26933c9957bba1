"""Integers in bytes: any width, four sign formats, two byte orders; strings; fixed-width lists.

Widths up to 8 bytes are DECIMAL(20,0) arithmetic, up to 15 bytes DECIMAL(38,0); wider ones are decimal
strings through an Arrow UDF, as no SQL type holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import flat_bytes, in_slices

UNSIGNED, ONES, TWOS, MAGNITUDE = range(4)
BIG, LITTLE = range(2)
#: The labels of the sign formats and byte orders.
SIGN_LABELS = ("Unsigned", "One's complement", "Two's complement", "Sign-and-magnitude", "Reserved sign bit")
ORDER_LABELS = ("Network byte-order (big endian)", "Little endian")


def reverse_bytes(x: Column, width: int | None = None) -> Column:
    """The bytes in opposite order.  (``reverse`` of BINARY would go through text.)"""
    n = F.lit(width) if width else F.octet_length(x)
    index = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(index, lambda i: F.hex(F.substring(x, n - i + 1, F.lit(1))))
    return F.unhex(F.array_join(pairs, ""))


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _unsigned(x: Column, width: int) -> Column:
    """Big-endian bytes as DECIMAL(38,0), width up to 15."""
    if width <= 7:
        return F.conv(F.hex(x), 16, 10).cast("long").cast("decimal(38,0)")
    if width == 8:
        return F.conv(F.hex(x), 16, 10).cast("decimal(38,0)")
    low = F.conv(F.hex(F.substring(x, width - 6, 7)), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.hex(F.substring(x, 1, width - 7)), 16, 10).cast("decimal(20,0)")
    return (high * F.lit(str(1 << 56)).cast("decimal(17,0)")).cast("decimal(38,0)") + low


def decode_int(x: Column, width: int, sign: int = TWOS, order: int = BIG) -> Column:
    """The integer in ``width`` bytes: long up to 7 bytes (and for signed 8), DECIMAL(38,0) up to 15, decimal string beyond.

    Null unless ``x`` has exactly ``width`` bytes; a width of 0 is the number 0.
    """
    if width == 0:
        return F.when(x.isNotNull(), F.lit(0).cast("long"))
    x = F.when(F.octet_length(x) == width, x)
    if width > 15:
        return _decode_wide(x, F.lit(sign), F.lit(order))
    if order == LITTLE:
        x = reverse_bytes(x, width)
    bits = 8 * width
    u = _unsigned(x, width)
    if sign == UNSIGNED:
        got = u
    else:
        top = u >= _big(1 << bits - 1)
        negative = {ONES: u - _big((1 << bits) - 1), TWOS: u - _big(1 << bits), MAGNITUDE: _big(1 << bits - 1) - u}[sign]
        got = F.when(top, negative).otherwise(u)
    return got.cast("long") if width < 8 or width == 8 and sign != UNSIGNED else got.cast("decimal(20,0)") if width == 8 else got.cast("decimal(38,0)")


def encode_int(v: Column, width: int, sign: int = TWOS, order: int = BIG, checked: bool = True) -> Column:
    """``v`` in exactly ``width`` bytes (1 to 8; more for decimal strings).  Too large a number is an error, or null unless ``checked``."""
    if width > 8:
        got = _encode_wide(v.cast("string"), F.lit(width), F.lit(sign), F.lit(order))
        if not checked:
            return got
        return F.when(v.isNotNull() & got.isNull(), F.raise_error(F.lit("number too big to fit"))).otherwise(got)
    bits = 8 * width
    v = v.cast("decimal(38,0)")
    half, full = _big(1 << bits - 1), _big(1 << bits)
    least = {UNSIGNED: _big(0), TWOS: -half, ONES: -half + 1, MAGNITUDE: -half + 1}[sign]
    most = full - 1 if sign == UNSIGNED else half - 1
    u = v if sign == UNSIGNED else F.when(v < 0, {ONES: v + full - 1, TWOS: v + full, MAGNITUDE: half - v}[sign]).otherwise(v)
    # conv reads decimal text as unsigned 64-bit
    got = F.unhex(F.lpad(F.conv(u.cast("string"), 10, 16), 2 * width, "0"))
    got = reverse_bytes(got, width) if order == LITTLE else got
    fits = v.between(least, most)
    return F.when(fits, got).otherwise(F.when(v.isNotNull(), F.raise_error(F.lit("number too big to fit")).cast("binary"))) if checked else F.when(fits, got)


def least_width(v: Column) -> Column:
    """Bytes that the two's complement form of a long needs: the width of an encoding that may resize."""
    magnitude = F.when(v < 0, -(v + 1)).otherwise(v)
    bits = F.length(F.conv(magnitude.cast("string"), 10, 2))
    return F.floor(F.when(magnitude == 0, F.lit(0)).otherwise(bits) / 8).cast("int") + 1


def _to_int(b: bytes | None, sign: int, order: int) -> str | None:
    if b is None:
        return None
    b = b if order == BIG else b[::-1]
    u, bits = int.from_bytes(b, "big"), 8 * len(b)
    if sign != UNSIGNED and bits and u >> bits - 1:
        u = {ONES: u - (1 << bits) + 1, TWOS: u - (1 << bits), MAGNITUDE: (1 << bits - 1) - u}[sign]
    return str(u)


def _to_bytes(v: str | None, width: int, sign: int, order: int) -> bytes | None:
    if v is None:
        return None
    n, bits = int(v), 8 * width
    u = n if n >= 0 else {UNSIGNED: -1, ONES: n + (1 << bits) - 1, TWOS: n + (1 << bits), MAGNITUDE: (1 << bits - 1) - n}[sign]
    most = (1 << bits) - 1 if sign == UNSIGNED else (1 << bits - 1) - 1
    least = {UNSIGNED: 0, TWOS: -(1 << bits - 1)}.get(sign, -(1 << bits - 1) + 1)
    if not least <= n <= most:
        return None
    return u.to_bytes(width, "big" if order == BIG else "little")


@F.pandas_udf(T.StringType())
def _decode_wide(x: pd.Series, sign: pd.Series, order: pd.Series) -> pd.Series:
    return pd.Series([_to_int(b, s, o) for b, s, o in zip(x, sign, order, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _encode_wide(v: pd.Series, width: pd.Series, sign: pd.Series, order: pd.Series) -> pd.Series:
    return pd.Series([_to_bytes(*x) for x in zip(v, width, sign, order, strict=True)], dtype=object)


def int32_pack(v: Column) -> Column:
    """The low 32 bits, big-endian."""
    return F.unhex(F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def int32_unpack(x: Column) -> Column:
    return decode_int(x, 4, TWOS, BIG)


def parse_int(text: Column) -> Column:
    """Integer text as DECIMAL(38,0); null if it is none."""
    return F.when(text.rlike("^[+-]?[0-9]{1,60}$"), text.try_cast("decimal(38,0)"))


def narrow(v: Column, bits: int) -> Column:
    """The low-order bits of an integer as a signed one."""
    full, half = F.lit(str(1 << bits)).cast("decimal(20,0)"), F.lit(str(1 << bits - 1)).cast("decimal(20,0)")
    low = F.pmod(v.cast("decimal(38,0)"), full)
    return F.when(low >= half, low - full).otherwise(low).cast("long")


def list_at(items: Column, index: Column) -> Column:
    """The item a list pointer leads to; null outside the list."""
    return F.get(items, index.cast("int"))


def list_resized(items: Column, size: int, fill: Column) -> Column:
    """A list cut or filled up to a size."""
    return F.slice(F.concat(items, F.array_repeat(fill, size)), 1, size)


def list_assigned(items: Column, index: Column, value: Column) -> Column:
    """A list with one item replaced."""
    return F.transform(items, lambda v, k: F.when(k == index, value).otherwise(v))


def byte_text(text: Column) -> Column:
    """One signed byte from text: decimal, 0x or # hex, leading-zero octal; null outside -128 to 127."""
    t = F.trim(text)
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    body = F.regexp_replace(t, "^[+-]", "")
    hexes = F.regexp_replace(body, "^(0[xX]|#)", "")
    number = (
        F.when(body.rlike("^(0[xX]|#)[0-9a-fA-F]{1,8}$"), F.conv(hexes, 16, 10).try_cast("long"))
        .when(body.rlike("^0[0-7]{1,8}$"), F.conv(body, 8, 10).try_cast("long"))
        .when(body.rlike("^[0-9]{1,9}$"), body.try_cast("long"))
    )
    got = sign * number
    return F.when(got.between(-128, 127), got)


def decode_text(x: Column) -> Column:
    """Bytes as UTF-8; malformed bytes become U+FFFD, never an error."""
    return F.make_valid_utf8(x.cast("string"))


def encode_text(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def list_count(x: Column, item: int = 4) -> Column:
    """Whole items of ``item`` bytes."""
    return F.floor(F.octet_length(x) / item).cast("long")


def _list_items(x: pa.Array, item: int, sign: int, order: int) -> pa.Array:
    data, ends = flat_bytes(x)
    n = np.diff(ends) // item
    whole = np.concatenate([data[:0], *[data[a : a + k * item] for a, k in zip(ends, n, strict=False) if k]]).reshape(-1, item)
    u = np.zeros(len(whole), np.uint64)
    for column in whole.T if order == BIG else whole.T[::-1]:
        u = u << np.uint64(8) | column
    got, bits = u.view(np.int64), 8 * item
    if sign != UNSIGNED:
        # wraps around where 64 bits are full, as it should
        full, half = np.array([(1 << bits) % (1 << 64), 1 << bits - 1], np.uint64).view(np.int64)
        negative = {ONES: got - full + 1, TWOS: got - full, MAGNITUDE: half - got}[sign]
        got = np.where(u >> np.uint64(bits - 1) == 1, negative, got)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(got))


def list_items(x: Column, item: int = 4, sign: int = UNSIGNED, order: int = BIG) -> Column:
    """The items as integers; none for an empty sequence.

    Items that fit a long are decoded in Arrow batches: per item, expressions cost far more.
    """
    if item < 8 or item == 8 and sign != UNSIGNED:

        def items(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return (_list_items(part, item, sign, order) for (part,) in in_slices((batch,) for batch in batches))

        return F.arrow_udf(items, "array<bigint>")(x)
    n = F.floor(F.octet_length(x) / item).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: decode_int(F.substring(x, i * item + 1, F.lit(item)), item, sign, order))


def list_set(x: Column, index: Column | int, value: Column, item: int = 4, sign: int = UNSIGNED, order: int = BIG) -> Column:
    """The sequence with one item overwritten; unchanged where there is no such item."""
    at = index if isinstance(index, Column) else F.lit(index)
    new = F.overlay(x, encode_int(value, item, sign, order), (at * item + 1).cast("int"), F.lit(item))
    return F.when((at >= 0) & (at < list_count(x, item)), new).otherwise(x)


def magic_matches(x: Column, magic: bytes, at: int = 0) -> Column:
    return F.substring(x, at + 1, len(magic)) == F.lit(magic)


def region(address: Column, length: Column) -> Column:
    """The closed interval of an address and a length; null when empty."""
    return F.when(length > 0, F.struct(address.cast("long").alias("first"), (address + length - 1).cast("long").alias("last")))

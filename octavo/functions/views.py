"""Views of a BINARY column: length, slice, shift, gather, bit reads.

Positions are 0-based.  A view is a projection; views of views collapse in the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | int
#: Bytes of sequences that a Python worker takes apart at once.
SLICE = 1 << 20


def _long(x: C) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def byte_length(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def bit_length(x: Column) -> Column:
    return F.octet_length(x).cast("long") * 8


def byte_slice(x: Column, start: C, length: C, base: C = 0) -> Column:
    """``length`` bytes from address ``start`` of a sequence whose first byte is at ``base``; what lies outside is left out."""
    at = _long(start) - _long(base)
    first = F.greatest(at, F.lit(0).cast("long"))
    size = F.greatest(_long(length) + F.least(at, F.lit(0).cast("long")), F.lit(0).cast("long"))
    return F.substring(x, (first + 1).cast("int"), size.cast("int"))


def checked_slice(x: Column, start: C, length: C, base: C = 0) -> Column:
    """As ``byte_slice``, but an error where the slice leaves the sequence."""
    at = _long(start) - _long(base)
    bad = (at < 0) | (_long(length) < 0) | (at + _long(length) > byte_length(x))
    return F.when(bad, F.raise_error(F.lit("slice outside its source"))).otherwise(byte_slice(x, start, length, base))


def read_range(x: Column, start: C, length: C, base: C = 0) -> Column:
    """Exactly ``length`` bytes, or null: a short read has no value."""
    got = byte_slice(x, start, length, base)
    return F.when((_long(start) >= _long(base)) & (F.octet_length(got) == _long(length)), got)


def tail(x: Column, start: C, base: C = 0) -> Column:
    """From an address to the end."""
    return byte_slice(x, start, F.octet_length(x), base)


def shifted(start: C, by: C) -> Column:
    """The start of the same bytes moved ``by`` addresses up; shifts of shifts add."""
    return _long(start) + _long(by)


def slid(x: Column, start: C, length: C, by: C, base: C = 0) -> Column:
    """What address ``start`` reads when the source is moved ``by`` down under it."""
    return byte_slice(x, _long(start) + _long(by), length, base)


def gather(x: Column, segments: Column) -> Column:
    """The bytes of an array of closed segments ``struct<first, last>``, packed in its order."""
    empty = F.lit(b"").cast("binary")
    return F.aggregate(segments, empty, lambda a, s: F.concat(a, byte_slice(x, s["first"], s["last"] - s["first"] + 1)))


def read_bits(x: Column, bit: C, count: int) -> Column:
    """``count`` (1 to 32) bits from bit ``bit`` on, most significant first, as an unsigned long; null past the end."""
    if not 1 <= count <= 32:
        raise ValueError("1 to 32 bits")
    at = _long(bit)
    # five bytes hold any 32 bits; zeros behind the end only fill the window
    window = F.rpad(F.substring(x, (F.floor(at / 8) + 1).cast("int"), F.lit(5)), 5, b"\0")
    number = F.conv(F.hex(window), 16, 10).cast("long")
    shift = (F.lit(40 - count) - F.pmod(at, F.lit(8))).cast("int")
    got = F.call_function("shiftright", number, shift).bitwiseAND(F.lit((1 << count) - 1))
    return F.when((at >= 0) & (at + count <= bit_length(x)), got)


def nibble(x: Column, n: C) -> Column:
    """The n-th half byte, high one first: one hex digit."""
    return F.conv(F.substring(F.hex(x), (_long(n) + 1).cast("int"), F.lit(1)), 16, 10).cast("long")


def _ends(x: pa.Array) -> np.ndarray:
    """Where each sequence of an Arrow column starts in its buffer, and where the last one ends."""
    kind = np.dtype(np.int64 if pa.types.is_large_binary(x.type) else np.int32)
    return np.frombuffer(x.buffers()[1], kind, len(x) + 1, x.offset * kind.itemsize).astype(np.int64)


def flat_bytes(x: pa.Array, behind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all sequences of an Arrow column, with so many zeros behind them, and where in them each one starts (and the last one ends)."""
    ends, data = _ends(x), x.buffers()[2]
    got = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]) if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([got, np.zeros(behind, np.uint8)]) if behind else got, ends - ends[0]


def in_slices(batches: Iterable[tuple[pa.Array, ...]], most: int = SLICE) -> Iterator[tuple[pa.Array, ...]]:
    """Rows of Arrow batches in slices with ``most`` bytes in the first column, or one row: what a worker makes at once is bounded."""
    for columns in batches:
        n = len(columns[0])
        ends, at = _ends(columns[0]) if n else None, 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield tuple(c.slice(at, end - at) for c in columns)
            at = end


def _whole(x: pa.Array) -> np.ndarray:
    return x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bit_units(x: pa.Array, units: pa.Array, first: pa.Array, offset: pa.Array, k: int) -> pa.Array:
    data, ends = flat_bytes(x, 8)
    none = np.array([c.is_null().to_numpy(zero_copy_only=False) for c in (x, units, first, offset)]).any(0)
    n = np.where(none, 0, np.maximum(_whole(units), 0))
    start = _whole(first) * k + _whole(offset)
    # units that lie whole in the sequence; the others are null
    low = np.minimum(np.maximum(-(start // k), 0), n)
    high = np.minimum(np.maximum((8 * np.diff(ends) - start) // k, low), n)
    places = np.concatenate([[0], np.cumsum(n)])
    out, missing = np.zeros(places[-1], np.int64), None
    if (high - low < n).any():
        missing = np.ones(places[-1], bool)
    mask = np.uint64((1 << k) - 1)
    for at, a, b, begin in zip(places, low, high, 8 * ends[:-1] + start + low * k, strict=False):
        got = out[at + a : at + b]
        # eight units later is k bytes later: every eighth unit is a strided view of 64-bit windows
        for j in range(min(8, b - a)):
            bit = int(begin) + j * k
            view = np.ndarray((-(-(b - a - j) // 8),), ">u8", data, bit // 8, (k,))
            got[j::8] = (view >> np.uint64(64 - k - bit % 8)) & mask
        if missing is not None:
            missing[at + a : at + b] = False
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(out, mask=missing), mask=pa.array(none))


def read_bit_array(x: Column, count: int, units: C, first_unit: C = 0, bit_offset: C = 0) -> Column:
    """``units`` units of ``count`` (1 to 32) bits, unit i at bit ``(first_unit + i) * count + bit_offset``; null past the ends.

    Bits of a slice of a batch's sequences are taken apart at once: per unit, expressions cost far more.
    """
    if not 1 <= count <= 32:
        raise ValueError("1 to 32 bits")

    def take_apart(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return (_bit_units(*part, count) for part in in_slices(batches))

    return F.arrow_udf(take_apart, "array<bigint>")(x, _long(units), _long(first_unit), _long(bit_offset))


def _byte_lists(x: pa.Array) -> pa.Array:
    data, ends = flat_bytes(x)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(data.astype(np.int32)), mask=x.is_null())


def byte_values(x: Column) -> Column:
    """The bytes of a BINARY as an array of numbers, in Arrow batches: expressions would make a string of each byte first."""

    def lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return (_byte_lists(part) for (part,) in in_slices((batch,) for batch in batches))

    return F.arrow_udf(lists, "array<int>")(x)


def _byte_sums(x: pa.Array, table: np.ndarray) -> pa.Array:
    data, ends = flat_bytes(x)
    sums = [np.bincount(data[a:b], minlength=256) @ table for a, b in zip(ends[:-1], ends[1:], strict=True)]
    places = np.arange(len(x) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(sums)), mask=x.is_null())


def byte_sums(x: Column, *of: Callable[[int], int]) -> Column:
    """For each function of a byte's value the sum over the sequence, as an array; 0 for an empty one.

    The functions give a table each; the sequence's bytes are counted by value, in Arrow batches.
    """
    table = np.array([[f(b) for f in of] for b in range(256)], np.int64)

    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return (_byte_sums(part, table) for (part,) in in_slices((batch,) for batch in batches))

    return F.arrow_udf(sums, "array<bigint>")(x)


def get_bit(x: Column, n: C) -> Column:
    """Bit ``n`` of the sequence, least significant first within each byte."""
    at = _long(n)
    byte = F.conv(F.hex(F.substring(x, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.call_function("getbit", byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def set_bit(x: Column, n: C, on: Column | bool) -> Column:
    """The sequence with bit ``n`` set or cleared; unchanged past its end."""
    at = _long(n)
    place = (F.floor(at / 8) + 1).cast("int")
    byte = F.conv(F.hex(F.substring(x, place, F.lit(1))), 16, 10).cast("long")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(8)).cast("int"))
    flag = on if isinstance(on, Column) else F.lit(on)
    new = F.when(flag, byte.bitwiseOR(mask)).otherwise(byte.bitwiseAND(F.bitwise_not(mask)))
    return F.when(at < bit_length(x), F.overlay(x, F.unhex(F.lpad(F.hex(new), 2, "0")), place, F.lit(1))).otherwise(x)


def describe(start: C, length: C, source: Column) -> Column:
    """``[first-last] source``."""
    return F.format_string("[%d-%d] source: %s", _long(start), _long(start) + _long(length) - 1, source)

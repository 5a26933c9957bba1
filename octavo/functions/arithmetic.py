"""Integer arithmetic and bit positions (one BIGINT: byte * 8 + bit)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Preset sizes.
SIZES = (6, 7, 8, 11, 12, 14, 18, 24, 48, 64, 127, 256)
DEFAULT_SIZE = 5


def multiply(x: Column, y: Column) -> Column:
    """Exact product."""
    return x.cast("decimal(19,0)") * y.cast("decimal(19,0)")


def divide(x: Column, y: Column) -> Column:
    """Quotient towards zero; 0 for a zero divisor."""
    safe = F.when(y != 0, y)
    return F.when(y == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", x.cast("long"), safe.cast("long")))


def to_bits(byte: Column, bit: Column) -> Column:
    return byte.cast("long") * 8 + bit


def byte_of(bits: Column) -> Column:
    return F.call_function("shiftright", bits.cast("long"), F.lit(3))


def bit_of(bits: Column) -> Column:
    return F.pmod(bits, F.lit(8)).cast("int")


def cursor_subtract(a: Column, b: Column) -> Column:
    """Never below zero."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def bits_for(symbols: int) -> int:
    """Bits that tell so many symbols apart."""
    return max(symbols - 1, 0).bit_length()


def rounded(x: Column, mode: str) -> Column:
    """``before``: floor, ``after``: ceiling, ``nearest``: halves up."""
    return {"before": F.floor(x), "after": F.ceil(x), "nearest": F.floor(x + 0.5)}[mode].cast("long")


def step_size(index: Column, by: int) -> Column:
    """Another preset's index, within the ladder."""
    return F.greatest(F.least(index + by, F.lit(len(SIZES) - 1)), F.lit(0))


def size_at(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SIZES]), (index + 1).cast("int"))


def pi_fraction(n: int) -> bytes:
    """The first ``n`` bytes of pi's fraction, by Machin's formula in integers."""
    guard = 64
    one = 1 << 8 * n + guard

    def arctan(k: int) -> int:
        term, total, i = one // k, 0, 1
        while term:
            total += term // i if i % 4 == 1 else -(term // i)
            term, i = term // (k * k), i + 2
        return total

    pi = 4 * (4 * arctan(5) - arctan(239)) >> guard
    return (pi - (3 << 8 * n)).to_bytes(n, "big")


def cursor_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as bit position ``a`` is before, at or after ``b``: by byte, then by bit."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def is_zero(a: Column) -> Column:
    return a == 0

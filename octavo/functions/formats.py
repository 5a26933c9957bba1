"""Byte values as text and colours.  ``b`` is a byte as a number from 0 to 255."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .views import byte_values

#: What code page 437 shows for the control codes 1 to 31.
CONTROL_GLYPHS = "☺☻♥♦♣♠•◘○◙♂♀♪♫☼►◄↕‼¶§▬↨↑↓→←∟↔▲▼"
#: Escapes by byte.
ESCAPES = {0: "\\0", 7: "\\a", 8: "\\b", 9: "\\t", 10: "\\n", 11: "\\v", 12: "\\f", 13: "\\r"}
VIEW_NAMES = {16: "Hex", 10: "Decimal", 8: "Octal", 2: "Binary"}
SEPARATOR = "  "
DIGITS = "0123456789abcdef"


def code_page_437() -> str:
    """The page's 256 characters: the codec's, but for glyphs in place of controls and a house for DEL."""
    rest = bytes(range(128, 256)).decode("cp437")
    return "\0" + CONTROL_GLYPHS + "".join(map(chr, range(32, 127))) + "⌂" + rest


def digits_of(base: int) -> int:
    """Places of the largest byte."""
    n, places = 255, 0
    while n:
        n, places = n // base, places + 1
    return places


def _padded(text: Column, width: int, pad: str) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, pad))


def _looked_up(b: Column, of: Callable[[int], str]) -> Column:
    """A text per byte value, from a table that is built once per plan."""
    return F.get(F.array(*[F.lit(of(k)) for k in range(256)]), b.cast("int"))


def in_base(value: int, base: int) -> str:
    out = ""
    while value or not out:
        value, digit_ = divmod(value, base)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit_] + out
    return out


def radix(b: Column, base: int, pad: str = "0") -> Column:
    return _looked_up(b, lambda k: in_base(k, base).rjust(digits_of(base), pad))


def is_printable(b: Column) -> Column:
    return b.between(32, 126)


def printable(b: Column, base: int = 16, pad: str = "0") -> Column:
    """Printable bytes as characters padded with spaces, others in the base."""
    width = digits_of(base)
    return _looked_up(b, lambda k: chr(k).rjust(width) if 32 <= k <= 126 else in_base(k, base).rjust(width, pad))


def escaped(b: Column, base: int = 16, pad: str = "0") -> Column:
    """Bytes that have an escape as that, others in the base."""
    width = digits_of(base)
    return _looked_up(b, lambda k: ESCAPES[k].rjust(width) if k in ESCAPES else in_base(k, base).rjust(width, pad))


def hex_text(x: Column) -> Column:
    return F.lower(F.hex(x))


def address(pos: Column, base: int = 16) -> Column:
    """Right-justified in ten places, longer ones whole."""
    return _padded(F.lower(F.conv(pos.cast("string"), 10, base)), 10, " ")


def address_with_colon(bits: Column) -> Column:
    """``hhhh:hhhh`` of the byte, ``.b`` added for a bit other than 0."""
    byte, bit = F.call_function("shiftright", bits.cast("long"), F.lit(3)), F.pmod(bits, F.lit(8))
    digits = _padded(F.lower(F.hex(byte)), 8, "0")
    text = F.concat(F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, F.lit(5), F.length(digits)))
    return F.concat(text, F.when(bit != 0, F.concat(F.lit("."), bit.cast("string"))).otherwise(""))


def cursor(bits: Column) -> Column:
    byte, bit = F.call_function("shiftright", bits.cast("long"), F.lit(3)), F.pmod(bits, F.lit(8))
    return F.concat(F.lower(F.hex(byte)), F.when(bit != 0, F.concat(F.lit("."), bit.cast("string"))).otherwise(""))


def latin_text(x: Column, mask_high_bit: bool = False) -> Column:
    """One character per byte."""
    if not mask_high_bit:
        return F.decode(x, "ISO-8859-1")
    return F.array_join(F.transform(byte_values(x), lambda b: F.char(b.bitwiseAND(F.lit(127)))), "")


def dotted_text(x: Column) -> Column:
    """One character per byte: printable ones as they are, dots for the others."""
    return F.regexp_replace(F.decode(x, "ISO-8859-1"), "[^ -~]", ".")


def code_page_char(b: Column) -> Column:
    return _looked_up(b, code_page_437().__getitem__)


def code_page_text(x: Column) -> Column:
    """The page's character for each byte, a space for 0."""
    page = " " + code_page_437()[1:]
    other = [k for k in range(256) if page[k] != chr(k)]
    return F.translate(F.decode(x, "ISO-8859-1"), "".join(map(chr, other)), "".join(page[k] for k in other))


def digit(v: Column, alphabet: str = DIGITS) -> Column:
    return F.substring(F.lit(alphabet), (v + 1).cast("int"), F.lit(1))


def grey(b: Column | int) -> Column | int:
    return 255 - b


def tint(level: Column) -> Column:
    """A selected grey level as red, green, blue."""
    third, half = F.floor(level / 3).cast("int") * 2, F.floor(level / 2).cast("int") + 128
    return F.struct(third.alias("r"), third.alias("g"), half.alias("b"))


def tint_of(level: int) -> tuple[int, int, int]:
    """``tint`` of a number."""
    return level // 3 * 2, level // 3 * 2, level // 2 + 128


def grey_pair(b: Column) -> Column:
    """Levels of the high and the low half, each digit doubled."""
    high, low = 15 - F.floor(b / 16).cast("int"), 15 - b % 16
    return F.struct((high * 17).alias("outer"), (low * 17).alias("inner"))


def grey_pair_of(b: int) -> tuple[int, int]:
    """``grey_pair`` of a number."""
    return (15 - b // 16) * 17, (15 - b % 16) * 17


def channel(line: Column, pos: Column, channels: int) -> Column:
    """The colour channel of a byte."""
    return F.pmod(line + pos, F.lit(channels)).cast("int")


def signed(b: Column) -> Column:
    return F.when(b > 127, b - 256).otherwise(b)


def samples(x: Column, sample_bits: int = 16, as_signed: bool = True) -> Column:
    """The last byte of each whole sample."""
    width = sample_bits // 8
    last = F.filter(byte_values(x), lambda b, i: (i + 1) % width == 0)
    return F.transform(last, signed) if as_signed else last


def bar(sample: Column) -> Column:
    """Start and length of a wave's bar around 128."""
    return F.struct(F.when(sample > 0, F.lit(128)).otherwise(128 + sample).alias("at"), F.abs(sample).alias("length"))


def view_name(base: int) -> str:
    return VIEW_NAMES.get(base, f"base {base}")


def short_type(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def value_text(name: Column, value: Column, points_to: Column | None = None) -> Column:
    """``name=value``; references are marked ``(->target)``, unset ones ``(*)``."""
    text = F.concat(name, F.lit("="), value)
    if points_to is None:
        return text
    return F.concat(text, F.when(points_to.isNull(), F.lit("(*)")).otherwise(F.concat(F.lit("(->"), points_to, F.lit(")"))))

"""Sequences as grids: rows of fixed width, cells, offsets of columns, hit tests, the default page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats

#: Bytes of a line; gaps, in character widths, after every so many units.
COLUMNS = 16
GAPS = ((1, 1), (2, 0), (4, 1), (8, 1))


def row_count(length: Column, columns: int = COLUMNS) -> Column:
    return F.ceil(length / columns).cast("long")


def cell(x: Column, row: Column | int, col: Column | int, columns: int = COLUMNS) -> Column:
    """The byte in a cell as a number (columns from 1); null past the end."""
    at = (F.lit(row) if isinstance(row, int) else row) * columns + (F.lit(col) if isinstance(col, int) else col)
    return F.conv(F.hex(F.when(at <= F.octet_length(x), F.substring(x, at.cast("int"), F.lit(1)))), 16, 10).cast("int")


def rows_of(table: DataFrame, content: str, columns: int = COLUMNS, first_row: int = 0, last_row: int | None = None) -> DataFrame:
    """One row per line of ``columns`` bytes: ``row_no`` and ``line``; only the lines of a window, if one is given."""
    n = F.octet_length(content)
    last = F.floor((n - 1) / columns).cast("int")
    last = F.least(last, F.lit(last_row)) if last_row is not None else last
    index = F.when((n > 0) & (last >= first_row), F.sequence(F.lit(first_row), last))
    cut = F.substring(F.col(content), F.col("row_no") * columns + 1, F.lit(columns))
    return table.withColumn("row_no", F.explode(index)).withColumn("line", cut)


def hex_dump(table: DataFrame, content: str, columns: int = COLUMNS, *keys: str) -> DataFrame:
    """Keys, ``addr``, ``addr_hex`` and ``hex_bytes`` of every line."""
    lines = rows_of(table.select(*keys, content), content, columns)
    addr = F.col("row_no").cast("long") * columns
    return lines.select(*keys, addr.alias("addr"), F.format_string("%08x", addr).alias("addr_hex"), formats.hex_text(F.col("line")).alias("hex_bytes"))


def page(table: DataFrame, content: str, *keys: str) -> DataFrame:
    """The default page: address, hex, printable text and code page 437 of 16 bytes a line.

    Everything is made from whole lines and texts; a function called per byte costs several times as much.
    """
    # one character per byte of the whole sequence, all of them ASCII: lines are cut from its bytes
    shown = formats.dotted_text(F.col(content)).cast("binary")
    lines = rows_of(table.select(*keys, content, shown.alias("_shown")), content)
    lines = lines.withColumn("_text", F.substring("_shown", F.col("row_no") * COLUMNS + 1, F.lit(COLUMNS)))
    # the code page shows printable bytes as they are
    page437 = F.when(F.col("_text") == F.col("line"), F.col("_text").cast("string")).otherwise(formats.code_page_text(F.col("line")))
    pairs = formats.hex_text(F.col("line")).cast("binary")
    hexes = F.rtrim(F.concat_ws(" ", *[F.substring(pairs, 2 * k + 1, 2).cast("string") for k in range(COLUMNS)]))
    address = formats.address_with_colon(F.col("row_no").cast("long") * COLUMNS * 8)
    return lines.select(*keys, "row_no", F.concat_ws(formats.SEPARATOR, address, hexes, F.col("_text").cast("string"), page437).alias("line_text"))


def heading(col: int) -> str:
    return "addr" if col == 0 else format(col - 1, "x")


def column_offsets(spark, columns: int, unit: int = 3, gaps: tuple[tuple[int, int], ...] = GAPS) -> DataFrame:
    """``col`` and the character where it starts: units of ``unit`` characters, and gaps after every so many of them."""
    gap = sum((F.when((F.col("col") + 1) % every == 0, F.lit(size)).otherwise(0) for every, size in gaps[1:]), F.lit(unit))
    order = Window.orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    return spark.range(columns).select(F.col("id").alias("col")).withColumn("start", F.coalesce(F.sum(gap).over(order), F.lit(0)).cast("long"))


def repeats(bits: Column, unit: int, most: int | None = None) -> Column:
    """Whole units, no more than ``most``, and the bits left over."""
    whole = F.call_function("div", bits.cast("long"), F.lit(unit).cast("long"))
    whole = whole if most is None else F.least(whole, F.lit(most).cast("long"))
    return F.struct(whole.alias("repeats"), (bits - whole * unit).alias("left"))


def group_size(parts: DataFrame, keys: list[str], along: str = "width", across: str = "height") -> DataFrame:
    return parts.groupBy(*keys).agg(F.sum(along).alias(along), F.max(across).alias(across))


def hit(x: Column, y: Column, cell_width: int, cell_height: int, unit: int, columns: int = COLUMNS) -> Column:
    """The bit under a point of a grid of equal cells."""
    row, col = F.floor(y / cell_height), F.least(F.floor(x / cell_width), F.lit(columns - 1))
    return ((row * columns + col) * unit).cast("long")


def place(bit: Column, cell_width: int, cell_height: int, unit: int, columns: int = COLUMNS) -> Column:
    """The corner of the cell of a bit."""
    n = F.call_function("div", bit.cast("long"), F.lit(unit).cast("long"))
    row = F.call_function("div", n, F.lit(columns).cast("long"))
    return F.struct((F.pmod(n, F.lit(columns)) * cell_width).alias("x"), (row * cell_height).alias("y"))


def columns_under(points: DataFrame, offsets: DataFrame, x: str = "x") -> DataFrame:
    """For each point the last column that starts at or before it: the offsets are few (one per column), so they travel as one array."""
    table = offsets.agg(F.array_sort(F.collect_list(F.struct("start", "col"))).alias("_o"))
    below = F.filter("_o", lambda o: o["start"] <= F.col(x))
    return points.crossJoin(F.broadcast(table)).withColumn("col", F.try_element_at(below, F.lit(-1))["col"]).drop("_o")


def unit_size(tiles: Column, bits: Column) -> Column:
    """Width and height of a unit: the largest of its tiles' (an array of ``struct<width, height>``), nothing without bits."""
    size = lambda side: F.when(bits > 0, F.array_max(F.transform(tiles, lambda t: t[side]))).otherwise(0).alias(side)
    return F.struct(size("width"), size("height"))

"""Schema on read: a layout of typed fields becomes one projection over a BINARY column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, views


@dataclass(frozen=True)
class Field:
    """``offset`` and ``length`` are bytes; of a ``bit`` the offset counts bits."""

    name: str
    type: str
    offset: int
    length: int = 1
    sign: int = codec.UNSIGNED
    order: int = codec.BIG
    item: int = 4
    magic: bytes = b""


#: Type name -> builder of its column from the content and the field.
TYPES = {
    "int": lambda x, f: codec.decode_int(views.read_range(x, f.offset, f.length), f.length, f.sign, f.order),
    "bit": lambda x, f: F.when(views.bit_length(x) > f.offset, views.get_bit(x, f.offset)),
    "bits": lambda x, f: views.read_bits(x, f.offset, f.length),
    "string": lambda x, f: codec.decode_text(views.read_range(x, f.offset, f.length)),
    "bytes": lambda x, f: views.read_range(x, f.offset, f.length),
    "list": lambda x, f: codec.list_items(views.byte_slice(x, f.offset, f.length), f.item, f.sign, f.order),
    "magic": lambda x, f: codec.magic_matches(x, f.magic, f.offset),
    "region": lambda x, f: codec.region(F.lit(f.offset).cast("long"), F.lit(f.length).cast("long")),
}


def register_type(name: str, builder) -> None:
    """Add a type: ``builder(content, field)`` gives its column."""
    TYPES[name] = builder


def column(x: Column, field: Field) -> Column:
    if field.type not in TYPES:
        raise ValueError(f"no type {field.type}")
    return TYPES[field.type](x, field).alias(field.name)


def records(table: DataFrame, content: str, layout: list[Field], *keys: str) -> DataFrame:
    """Keys and one column per field; a field that does not fit is null."""
    return table.select(*keys, *[column(F.col(content), f) for f in layout])


def layout_table(spark: SparkSession, layout: list[Field]) -> DataFrame:
    """The layout as rows, as it is kept with a file."""
    rows = [(f.name, f.type, f.offset, f.length, f.sign, f.order, f.item) for f in layout]
    return spark.createDataFrame(rows, "field string, type string, offset long, length long, sign int, `order` int, item int")


def layout_from(table: DataFrame) -> list[Field]:
    """A layout from its rows, as many as it has fields."""
    return [Field(r["field"], r["type"], r["offset"], r["length"], r["sign"], r["order"], r["item"]) for r in table.orderBy("offset", "field").collect()]


def choice_label(index: Column, labels: tuple[str, ...]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), (index + 1).cast("int"))


def dimension(spark: SparkSession, labels: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(labels)), "idx int, label string")


def save_modified(pages: DataFrame) -> DataFrame:
    """The modified pages ``(modified, valid)``; an error as soon as one of them is not valid."""
    bad = F.col("modified") & ~F.col("valid")
    return pages.where("modified").withColumn("valid", F.when(bad, F.raise_error(F.lit("a modified page is not valid")).cast("boolean")).otherwise(F.col("valid")))

"""Sources and sinks of byte sequences."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arithmetic import pi_fraction

SCHEMA = "data_id string, start long, length long, content binary"
BLOCK = 16


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as sequences, one a row; content is only read where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select(F.col("path").alias("data_id"), F.lit(0).cast("long").alias("start"), "length", "content")


def from_text(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text column's UTF-8 bytes as sequences."""
    content = F.encode(text_col, "UTF-8")
    return table.select(F.col(id_col).alias("data_id"), F.lit(0).cast("long").alias("start"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def from_bytes(spark: SparkSession, *contents: bytes) -> DataFrame:
    """Arrays of the driver as sequences."""
    return spark.createDataFrame([(str(k), 0, len(x), bytearray(x)) for k, x in enumerate(contents)], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    """One sequence of no bytes."""
    return from_bytes(spark, b"")


def framed_random(n: int, seed: int) -> bytes:
    """``n`` bytes, the first 00, the last FF, the others from the seed."""
    import random

    got = bytearray(random.Random(seed).randbytes(n))
    if n:
        got[0], got[-1] = 0, 255
    return bytes(got)


def padded(x: bytes) -> bytes:
    return x + bytes(-len(x) % BLOCK)


def nibble_spectrum() -> bytes:
    return bytes(2 * k << 4 | 2 * k + 1 for k in range(8))


def byte_spectrum() -> bytes:
    return bytes(range(256))


def counter(first: int, n: int = 64) -> bytes:
    """Consecutive big-endian 32-bit integers."""
    return b"".join(((first + k) & 0xFFFFFFFF).to_bytes(4, "big") for k in range(n))


def grey_image(rgba: list[tuple[int, int, int, int]], under: int = 0) -> bytes:
    """Pixels as grey levels: opaque bits from the inverted mean, transparent ones from what lies under."""
    return bytes((under & ~a | ~((r + g + b) // 3) & a) & 255 for r, g, b, a in rgba)


def demo(seed: int = 42, title: str = "Binary demo file") -> bytes:
    """Titled sections of every kind of block, titles padded to 16 bytes."""
    import random

    start = random.Random(seed).getrandbits(32)
    parts: list[str | bytes] = [title, "4-bit spectrum", nibble_spectrum(), nibble_spectrum(), "1-byte spectrum", byte_spectrum()]
    parts += ["32-bit integer counter", counter(start), "Random data", random.Random(seed + 1).randbytes(256)]
    parts += ["Binary digits of pi: three point", pi_fraction(240)]
    return b"".join(padded(x.encode()) if isinstance(x, str) else x for x in parts)


def generated(spark: SparkSession, seed: int = 42) -> DataFrame:
    """The generators' blocks as sequences."""
    blocks = {"framed_random": framed_random(64, seed), "nibbles": nibble_spectrum(), "bytes": byte_spectrum(), "counter": counter(seed), "pi": pi_fraction(240), "demo": demo(seed)}
    return spark.createDataFrame([(k, 0, len(v), bytearray(v)) for k, v in blocks.items()], SCHEMA)


def zip_entries(archives: DataFrame) -> DataFrame:
    """Every file in archives ``(data_id, content)`` as a sequence ``archive!name``; what is no archive has none."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, x in zip(f["data_id"], f["content"], strict=True):
                if x is None or not zipfile.is_zipfile(io.BytesIO(x)):
                    continue
                with zipfile.ZipFile(io.BytesIO(x)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            got = z.read(name)
                            yield pd.DataFrame({"data_id": [f"{key}!{name}"], "start": [0], "length": [len(got)], "content": [got]})

    return archives.select("data_id", "content").mapInPandas(read, SCHEMA)


def opened(base: DataFrame, mods: DataFrame) -> DataFrame:
    """A sequence with its log of edits applied, which may be empty."""
    from ..operators.edits import fold_log

    return fold_log(base, mods)


def save(table: DataFrame, path: str, content: str = "content", *keys: str) -> None:
    """Write the sequences as they are now, replacing what is there."""
    table.select(*(keys or ("data_id",)), content).write.mode("overwrite").parquet(path)


class FileSet:
    """Open sequences by name, as views of the session; a guard may forbid closing."""

    def __init__(self, spark: SparkSession):
        self.spark, self.open_names, self.active, self.guards = spark, [], None, []

    def activate(self, name: str, table: DataFrame) -> None:
        table.createOrReplaceTempView(name)
        if name not in self.open_names:
            self.open_names.append(name)
        self.active = name

    def close(self, name: str) -> bool:
        if not all(guard(name) for guard in self.guards):
            return False
        self.spark.catalog.dropTempView(name)
        self.open_names.remove(name)
        if self.active == name:
            self.active = self.open_names[-1] if self.open_names else None
        return True

    def close_all(self) -> bool:
        """Nothing is closed unless everything may be."""
        if not all(guard(n) for n in self.open_names for guard in self.guards):
            return False
        return all([self.close(n) for n in list(self.open_names)])


def ordered(table: DataFrame) -> DataFrame:
    """By start, length and name."""
    return table.orderBy("start", "length", "data_id")


def same_view(a: Column, b: Column) -> Column:
    """Views as structs of source, start and length are equal if all of these are."""
    return a.eqNullSafe(b)

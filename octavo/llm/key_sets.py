"""Sets of 64-bit keys as bitmaps of bounded size, and tables joined with a set of keys.

A bitmap errs on one side only: a row whose bit is not set has no such key.  Those rows are done without
being moved; only the others, about as many as there are keys, are joined with the keys themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import rows_per_batch

#: A bitmap has 2 ** KEY_BITS bits at most.
KEY_BITS = 28


def key_bitmap(keys: DataFrame) -> tuple[np.ndarray, bool]:
    """A bitmap that has the bit of every ``key``, made in pieces by the executors; and whether it still tells keys apart."""
    n = keys.count()
    width = max(16, min(KEY_BITS, (16 * n).bit_length()))
    piece = 16

    def mark(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << piece, np.uint8)
        bits[table["at"].to_numpy() & ((1 << piece) - 1)] = 1
        return pa.table({"piece": pa.array([table["piece"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = F.col("key").bitwiseAND(F.lit((1 << width) - 1))
    placed = keys.select(at.alias("at"), F.call_function("shiftright", at, F.lit(piece)).alias("piece"))
    made = np.zeros((1 << width - piece, 1 << piece - 3), np.uint8)
    for r in placed.groupBy("piece").applyInArrow(mark, "piece long, bits binary").collect():
        made[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return made.ravel(), 4 * n <= 1 << width


def may_be_in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (8 * len(bitmap) - 1)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def split_by(table: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The rows of ``table`` whose column ``key`` (never null) can't be among ``keys(key)``, and the others; no first part if there are too many keys to tell."""
    bitmap, telling = key_bitmap(keys)
    if not telling:
        return None, table
    rows_per_batch(table.sparkSession)
    sent = table.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(sent.value, np.uint8)
            for b in batches:
                yield b.filter(pa.array(may_be_in(bits, b[key].to_numpy()) == wanted))

        return table.mapInArrow(run, table.schema)

    return part(False), part(True)


def matched(table: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The rows of ``table`` whose ``key`` (never null) can't be among ``keys``, if that can be told; and the others with
    ``octavo_key`` and the further columns of ``keys(key, ...)``, a written table with each key once, null where it lacks the key.

    A table is split once for all that is to be done with its rows: two such steps chained in a task would each have a
    Python worker, and twice as many workers would stay for whatever runs next.
    """
    same, maybe = split_by(table.withColumn("octavo_key", key), "octavo_key", keys)
    rest = maybe.join(keys.withColumnRenamed("key", "octavo_key"), "octavo_key", "left")
    return None if same is None else same.select(*table.columns), rest

"""Shared storage and small helpers of the corpus operators.

Everything that has to outlive a task is written as a table where driver and executors both find it;
a lost executor then costs a re-read.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..store import fresh_dir, keep, shared_dir  # noqa: F401

_WORD = re.compile("[^\x20\x09-\x0d]+")
#: Characters besides space and \t to \r at which str.split() would split.
_OTHER_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII_OTHER = re.compile("[\x1c-\x1f]")

_tables: list[tuple[SparkSession, str, DataFrame]] = []
_holder: list[tuple[str, Callable[[], None]]] = []


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Keep ``df`` as a table bucketed and sorted by ``key`` in the warehouse, which driver and executors share: joins on ``key`` leave it in place."""
    spark, name = df.sparkSession, f"octavo_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).sortBy(key).format("parquet").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    _tables.append((spark, name, table))
    return table


def drop(table: DataFrame) -> None:
    """Remove a table that ``bucketed`` gave, once nothing reads it any more."""
    for k, (spark, name, made) in enumerate(_tables):
        if made is table:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            del _tables[k]
            return


@atexit.register
def _clean() -> None:
    for spark, name, _ in _tables:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows_per_batch(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the Arrow batches that Python workers see (texts may be long), and sees to it that they find this package.

    The session's setting is only ever lowered.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def take_memory(owner: str, release: Callable[[], None] = lambda: None) -> None:
    """Called in a Python worker, which outlives its tasks: what another operator still remembers there (words, models) is
    released before ``owner`` fills a memory of its own, that ``release`` empties."""
    if _holder and _holder[0][0] == owner:
        return
    if _holder:
        _holder[0][1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)
    _holder[:] = [(owner, release)]


def hash_cutoff(hashes: DataFrame, k: int) -> int | None:
    """Of the one column's distinct 64-bit hashes the k-th least, the greatest if there are fewer, None without any.

    Whatever the table's size, only about ``2 k`` hashes are sorted: those below a threshold made from the row count in
    integers, which is raised if copies leave too few.
    """
    h, n = hashes.columns[0], hashes.count()
    share = 2 * k / max(n, 1)
    while True:
        most = min((1 << 63) - 1, -(1 << 63) + int(share * 2**64))
        least = hashes.where(F.col(h) <= most).distinct().orderBy(h).limit(k)
        found, last = least.agg(F.count(h), F.max(h)).first()
        if found >= k or share >= 1:
            return last
        share *= 16


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id`` long, ``text`` string, and ``more``; whatever else the table has is left out."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in more]
    )


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def split_words(text: str) -> list[str]:
    """The runs of characters other than space and \\t to \\r."""
    return _WORD.findall(text) if not text.isascii() and _OTHER_BLANK.search(text) or _ASCII_OTHER.search(text) else text.split()

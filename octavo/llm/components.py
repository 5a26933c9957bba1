"""Connected components of an edge table, by alternating star operations.

Each round hangs every node's larger neighbours on its least neighbour, then every node and its smaller
neighbours on their least one.  Minima are pre-aggregated; a node with very many neighbours is only ever
one side of a join whose other side is a written table, so adaptive execution can split it.

A table of at most ``ONE_TASK`` edges, by count, is joined up by a single task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep

ONE_TASK = 200_000


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for b in batches:
        for x, y in zip(b["hi"].to_pylist(), b["lo"].to_pylist(), strict=True):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
    got = [(x, r) for x in up if (r := find(x)) != x]
    yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in got], pa.int64()), "root": pa.array([r for _, r in got], pa.int64())})


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """``node``, ``root`` (the least node it is connected to) of every node that has an edge and is not the root itself."""
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    e = keep(e, "edges")
    was = _digest(e)
    if was[0] <= one_task:
        return keep(e.coalesce(1).mapInArrow(_join_up, "node long, root long"), "components")
    while was[0]:
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = keep(both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m")), "large_star")
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        large = keep(large, "large")
        least = keep(large.groupBy("hi").agg(F.min("lo").alias("m")), "small_star")
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = keep(small.unionByName(least.withColumnRenamed("m", "lo")).distinct(), "edges")
        now = _digest(e)
        if now == was:
            break
        was = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))

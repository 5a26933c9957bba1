"""Token counts: one exact histogram of encoded lengths answers every context limit.

Documents are counted by encoded length; suffix sums over the lengths then give, for each length taken
as a context limit, totals, ranks and truncated totals.  The sums run in two levels (blocks of lengths,
then lengths within a block), so no task sees more than one block's lengths.

Defined cases: null and empty texts have length 0; repeated rows count each time; an empty table has an
empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, rows_per_batch, texts
from .word_tokens import word_tokens

#: Lengths in a block of the second level.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for b in batches:
            n = [len(tokens.encode(x.as_py())) // 4 for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows_per_batch(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Per distinct length ``n_tokens`` (and per row of ``limits(n_tokens)``, which may name lengths no document has):

    ``n_docs`` of that length, ``docs_longer`` (cut by this limit), ``docs_up_to``, ``tokens_up_to`` (in
    documents that fit), ``truncated_total`` (ids left when every document is cut to this limit), and the
    corpus's ``total_docs`` and ``total_tokens``.  The q-quantile of lengths is the least ``n_tokens`` with
    ``docs_up_to >= q * total_docs``.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    if limits is not None:
        asked = limits.select(F.col("n_tokens").cast("long"), F.lit(0).cast("long").alias("n_docs"))
        counts = counts.unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    # one row per length: written, as both levels of sums need it and the texts should be encoded once
    counts = keep(counts, "lengths")
    counts = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n").alias("block_n"))
    later, every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    none = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), none).alias("later_docs"),
        F.coalesce(F.sum("block_n").over(later), none).alias("later_n"),
        F.sum("block_docs").over(every).alias("total_docs"),
        F.sum("block_n").over(every).alias("total_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    got = counts.select(
        "block", "n_tokens", "n_docs", F.coalesce(F.sum("n_docs").over(longer), none).alias("docs"), F.coalesce(F.sum("n").over(longer), none).alias("tokens")
    ).join(blocks, "block")
    longer_docs, longer_tokens = F.col("docs") + F.col("later_docs"), F.col("tokens") + F.col("later_n")
    return got.select(
        "n_tokens",
        "n_docs",
        longer_docs.alias("docs_longer"),
        (F.col("total_docs") - longer_docs).alias("docs_up_to"),
        (F.col("total_tokens") - longer_tokens).alias("tokens_up_to"),
        (F.col("total_tokens") - longer_tokens + F.col("n_tokens") * longer_docs).alias("truncated_total"),
        "total_docs",
        "total_tokens",
    )

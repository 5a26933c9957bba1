"""Packing: concatenate all documents' ids and cut them into fixed windows.

Two passes.  The first encodes every document once and writes its ids with the place they take within
their task's output; the second adds up the tasks' totals into global offsets and cuts each document
where a window ends.  Neither pass shuffles a row, and nothing larger than one total per task is
brought together.

Defined cases: a null or empty text is the end id alone; repeated rows are packed again; a null
document id stays null; an empty table gives no pieces; other columns, whatever their names, are not
carried.  Only the last sequence can be short: it alone is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, rows_per_batch, texts
from .word_tokens import word_tokens

ENCODED = "part int, place long, doc_id long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Bytes of ids after which a batch is handed on.
BATCH_BYTES = 8 << 20


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and end id (little-endian unsigned 32-bit), its task, and the ids before it in that task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, end, tokens = TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little"), word_tokens(tokenizer)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = tokens.encode(text.as_py()) + end
                rows.append((part, place, doc_id, len(ids) // 4, ids))
                place, size = place + len(ids) // 4, size + len(ids)
                if size > BATCH_BYTES:
                    yield _batch(rows, _ENCODED)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, _ENCODED)

    rows_per_batch(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(encode, ENCODED)


_ENCODED = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their ids: ``PIECES``.

    Sequence ``s`` is the ``window`` ids from ``s * window`` on of the concatenation; a row is the part of
    one document that lies in one sequence, so the rows that begin or end inside a document are the
    boundary records.
    """
    encoded = keep(encode_documents(docs, tokenizer, end_id, id_col, text_col), "packing")
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per task of the first pass, whatever the tables hold
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, n, at, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "doc_tokens", "at")), batch["ids"], strict=True):
                view, start = memoryview(ids.as_buffer()), 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    rows.append((doc_id, start, length, n, sequence, offset, bytes(view[4 * start : 4 * (start + length)])))
                    start, size = start + length, size + 4 * length
                    if size > BATCH_BYTES:
                        yield _batch(rows, _PIECES)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, _PIECES)

    placed = encoded.join(F.broadcast(offsets), "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("place")).alias("at"), "ids")
    return placed.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``length``, ``ids`` and the boundary records in order.  At most one window of ids meets in a group."""
    part = F.struct("offset", "length", "doc_id", "start", "ids")
    got = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return got.select(
        "sequence_id",
        F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"),
        F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"),
        F.transform("p", lambda x: x.dropFields("ids")).alias("boundaries"),
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

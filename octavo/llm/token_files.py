"""Token-id output: documents' ids written to files of directly addressable codes, and read back.

Rows are dealt out by ranges of document id and text (the only shuffle, of the texts themselves), sorted,
encoded and written by the same task; a file holds whole documents in ascending order.  A file appears under
its final name only when whole, and a task that runs again writes the same bytes to the same name.

Files are read back document by document: rank directories lead to each one's chunks on every level.  Where
a file begins among all ids is summed in two levels, files within their task and tasks among each other.

Defined cases: a null or empty text has the end id alone; null document ids come first; repeated rows are
written each time; an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .direct_codes import NULL_ID, TokenFile, to_bytes
from .shared import fresh_dir, keep, rows_per_batch, texts
from .word_tokens import word_tokens

#: Ids after which a file is closed.  A longer document has a file of its own.
FILE_TOKENS = 2 << 20
_MANIFEST = pa.schema([("first_id", pa.int64()), ("part", pa.int32()), ("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def open_store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns the manifest: per file its first id, path, documents, ids and bytes."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens, end = TaskContext.get().partitionId(), word_tokens(tokenizer), end_id.to_bytes(4, "little")
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        names: list[int | None] = []
        parts: list[bytes] = []
        size = done = 0

        def close() -> pa.RecordBatch:
            nonlocal names, parts, size, done
            path = f"{at}/tokens-{part:06d}-{done:05d}.dac"
            content = to_bytes(names, [len(x) // 4 for x in parts], np.frombuffer(b"".join(parts), "<u4"))
            with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as f:
                f.write(content)
            store.move(own, path)
            row = [NULL_ID if names[0] is None else names[0], part, done, path, len(names), size, len(content)]
            names, parts, size, done = [], [], 0, done + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _MANIFEST, strict=True)], schema=_MANIFEST)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = tokens.encode(text.as_py()) + end
                if names and size + len(ids) // 4 > FILE_TOKENS:
                    yield close()
                names.append(doc_id)
                parts.append(ids)
                size += len(ids) // 4
        if names:
            yield close()

    rows_per_batch(spark)
    # ranges of the text's hash too, so that rows of one id can be dealt out
    rows = texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    schema = "first_id long, part int, file_no int, path string, n_docs long, n_tokens long, n_bytes long"
    return keep(dealt.mapInArrow(write, schema), "manifest").withColumn("folder", F.lit(folder))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    # tasks are in the order of ids: one row per task, then the files of one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("folder", "path", "part", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("file_base"))
    placed = files.join(parts, "part").select("folder", "path", (F.col("part_base") + F.col("file_base")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path, base in zip(*(batch[c].to_pylist() for c in ("folder", "path", "base")), strict=True):
                store, _ = open_store(folder)
                with store.open_input_file(path) as f:
                    file = TokenFile(f.read_buffer())
                starts = file.starts.astype(np.int64)
                crc = [zlib.crc32(file.document(k).astype("<u4", copy=False)) for k in range(len(file.doc_ids))]
                named = pa.array(file.doc_ids, mask=file.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([named, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], schema=_READ)

    n = manifest.count()
    n = max(1, min(n, 4096), n // 16)
    return placed.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Files of any length as rows of chunks, through Spark's Python data source interface.

``register(spark)``, then ``spark.read.format("octavo_chunks").option("chunk", 1 << 20).load(path)``.  A file is split into
ranges of ``split`` bytes, one task each; a task opens the file at its range and reads chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(self.path)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", 1 << 20))
        self.split = max(int(options.get("split", 64 << 20)) // self.chunk, 1) * self.chunk

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = _store(self.path)
        info = store.get_file_info(at)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        return [Range(f.path, k, min(k + self.split, f.size)) for f in found if f.is_file for k in range(0, f.size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as f:
            for start in range(partition.first, partition.last, self.chunk):
                f.seek(start)
                yield partition.path, start // self.chunk, start, f.read(min(self.chunk, partition.last - start))


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "octavo_chunks"

    def schema(self) -> str:
        return "data_id string, chunk_no long, chunk_start long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkSource)

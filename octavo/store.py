"""Tables that outlive a task: written into the folder named by ``spark.checkpoint.dir``, which driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set and all tasks run in this machine's one process, one of our own, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[(?!.*cluster)|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="octavo-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/octavo-{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage, computes it once."""
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

"""Shared scratch tables: the place where lineage is cut.

Everything lands below ``spark.checkpoint.dir``, the folder that the driver and all
executors share. Only where a session on one machine has none (as in tests) is one made; on a cluster
the setting is asked for. What an operator no longer reads it discards itself; the tables behind a result stay until
``discard_all``, which a long session calls once its results are written.
"""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

#: Folders that this process has had written and not discarded.
_written: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*settled: DataFrame) -> None:
    """Delete tables just as ``settle`` returned them that nothing will read again."""
    for df in settled:
        _delete(df.sparkSession, df._settled_at)
        _written.remove(df._settled_at)


def discard_all(spark: SparkSession) -> None:
    """Delete all tables that this process has settled; results that are still to be read from them can't be read then."""
    while _written:
        _delete(spark, _written.pop())


def release() -> None:
    """Give freed memory of a Python worker back to the system, as idle workers are kept beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 3000, size: str = "2m") -> None:
    """Bound the rows and the bytes of an Arrow batch, as whole texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

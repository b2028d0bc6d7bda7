"""Where tables are kept that several steps or queries read: below ``spark.checkpoint.dir``, which the driver and all executors see."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a session on one machine that names none gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def made_once(spark: SparkSession, source: str, tag: str, make: Callable[[str], None], version: str = "", further: Sequence[str] = ()) -> str:
    """The folder that ``make`` has written from the tables at ``source`` and ``further``; it is made anew when their files or the ``version`` of the maker have changed.

    It is written beside its place and then moved there, so it is whole or absent, whoever else makes it meanwhile.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tables = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, *further)]
    files = [f for at in tables for f in at.getFileSystem(conf).listStatus(at)]
    state = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    place = f"{shared_dir(spark)}/{tag}-{hashlib.sha256(chr(10).join([source, version, *state]).encode()).hexdigest()[:32]}"
    target = jvm.org.apache.hadoop.fs.Path(place)
    store = target.getFileSystem(conf)
    if not store.exists(target):
        own = f"{place}-{uuid.uuid4().hex}"
        try:
            make(own)
        except Exception:
            store.delete(jvm.org.apache.hadoop.fs.Path(own), True)
            raise
        if not store.rename(jvm.org.apache.hadoop.fs.Path(own), target):
            if not store.exists(target):
                raise OSError(f"{own} can't be moved to {place}")
            store.delete(jvm.org.apache.hadoop.fs.Path(own), True)  # another run was first
    return place


def settle(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once below the shared folder and read from there: what several steps read is computed once, and lost executors cost no more than a step."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing stands at."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def files_in(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """The files of a folder whose names begin with ``prefix``, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.isFile() and f.getPath().getName().startswith(prefix))

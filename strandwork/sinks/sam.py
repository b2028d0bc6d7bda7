"""SAM files: one valid gzip file with its header for each input file (or each of its parts), put in place when the whole job has succeeded.

Each output is written by one task, line by line, under a name of its attempt. The driver's commit gives the names of the attempts that
count their places and removes what other attempts have left, and an abort removes everything; both only move names. So a task that was killed and
ran again, or ran twice, leaves one whole file.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.report import sam_header, sam_lines
from ..sources.sequences import store


@dataclass
class Written(WriterCommitMessage):
    """The files of a task's attempt: (name, path as written)."""

    files: list[tuple[str, str]]


class SamWriter(DataSourceArrowWriter):
    """Rows ``(out, value)``, those of one ``out`` together and in order, as gzip text in ``path``/``out``."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.aside = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, aside = store(self.aside)
        task = TaskContext.get()
        own = f"{aside}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(own, recursive=True)
        files: list[tuple[str, str]] = []
        raw = text = None
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("out"))
            values = batch.column(batch.schema.get_field_index("value"))
            runs = pc.run_end_encode(names)
            start = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if not files or files[-1][0] != name:
                    if text:
                        text.close()
                        raw.close()
                    files.append((name, f"{own}/{len(files)}"))
                    raw = system.open_output_stream(files[-1][1])
                    text = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0)
                text.write("".join(line + "\n" for line in values.slice(start, end - start).to_pylist()).encode())
                start = end
        if text:
            text.close()
            raw.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = store(self.path)
        for message in messages:
            for name, at in message.files if message else ():
                to = f"{path}/{name}"
                if system.get_file_info(to).type.name != "NotFound":
                    if not self.overwrite:
                        self.abort(messages)
                        raise FileExistsError(to)
                    system.delete_file(to)
                if "/" in name:
                    system.create_dir(to.rpartition("/")[0], recursive=True)
                system.move(at, to)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, aside = store(self.aside)
        if system.get_file_info(aside).type.name != "NotFound":
            system.delete_dir(aside)


class SamSink(DataSource):
    """``df.write.format("samfile").mode("append").save(path)`` of rows ``(out, value)``."""

    @classmethod
    def name(cls) -> str:
        return "samfile"

    def writer(self, schema, overwrite: bool) -> SamWriter:
        return SamWriter(self.options["path"], overwrite)


def outputs(files: list[str]) -> dict[str, str]:
    """The name of each input file's output below the output folder: the file's own, with as many of its folders as tell all of them apart."""
    split = {f: f.rstrip("/").split("://")[-1].strip("/").split("/") for f in files}
    depth = 1
    while len({tuple(x[-depth:]) for x in split.values()}) < len(split) and depth < max(map(len, split.values())):
        depth += 1
    return {f: "/".join(x[-depth:]) for f, x in split.items()}


def write_sam(records: DataFrame, contigs: DataFrame, path: str, reads: DataFrame | None = None, parts: int = 1, overwrite: bool = False, name: str = "mapped") -> list[str]:
    """Write ``records`` (of ``report.sam_records``) as SAM files below ``path``; returns their names.

    ``reads (read_id, file)`` says which file a read is from, and each file has its own output; without it there is one, ``name``. ``parts``: outputs of each file, each with the
    whole header, so that one large input needn't be written by one task. Records keep to their reads by ``read_id``, so equal names don't mix.
    """
    spark = records.sparkSession
    spark.dataSource.register(SamSink)
    if reads is None:
        named = records.withColumn("_base", F.lit(name))
        bases = [name]
    else:
        names = outputs([r[0] for r in reads.select("file").distinct().collect()])  # a row for each input file
        bases = list(names.values())
        named = records.join(reads.select("read_id", "file").join(spark.createDataFrame(list(names.items()), "file string, _base string"), "file").drop("file"), "read_id")
    ending = lambda base, part: F.concat(base, F.format_string("_%04d.sam.gz", part) if parts > 1 else F.lit(".sam.gz"))
    own = sam_lines(named.withColumn("out", ending(F.col("_base"), F.pmod(F.xxhash64("read_id"), F.lit(parts)).cast("int"))), "out").select("out", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), "value")
    each = F.explode(F.array(*[F.lit(b) for b in bases]).cast("array<string>")).alias("_base")
    heads = sam_header(contigs).select("n", "value", each).select("n", "value", "_base", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    heads = heads.select(ending(F.col("_base"), F.col("_part")).alias("out"), F.lit(0).alias("kind"), "n", "value")
    dealt = heads.unionByName(own).repartition(max(1, len(bases) * parts), "out").sortWithinPartitions("out", "kind", "n")
    dealt.select("out", "value").write.format("samfile").mode("overwrite" if overwrite else "append").save(path)
    return [f"{b}{f'_{p:04d}' if parts > 1 else ''}.sam.gz" for b in bases for p in range(parts)]

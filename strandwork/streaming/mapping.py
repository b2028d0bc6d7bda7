"""Mapping a stream of reads: each micro-batch is mapped against the fixed index and written as SAM files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.report import sam_lines
from ..plans.mapping import sam
from ..shared import settle


def map_stream(reads: DataFrame, index: Index, out: str, checkpoint: str, errors: int = 4, available_now: bool = True) -> StreamingQuery:
    """Start the query over ``reads (name, seq, qual)``, whose read_id, if there is none, numbers those of a batch. A batch that is run again replaces its own folder, so nothing is written twice.

    The seed length is the index's. ``available_now``: end when what there is has been mapped.
    """

    def one(batch: DataFrame, number: int) -> None:
        if "read_id" not in batch.columns:
            batch = settle(batch.withColumn("read_id", F.monotonically_increasing_id()), "reads")
        sam_lines(sam(index, batch, errors)).write.mode("overwrite").text(f"{out}/batch={number}")

    writer = reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

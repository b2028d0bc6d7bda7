"""What a mapping is reported as: primary flags, SAM rows, header, unmapped reads, places by global coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def flagged(alignments: DataFrame) -> DataFrame:
    """Alignments with primary (the least nm, contig and place of an oriented read) and the SAM flag."""
    own = Window.partitionBy("read_id", "strand").orderBy("nm", "contig_id", "pos", "end")
    rows = alignments.withColumn("primary", F.row_number().over(own) == 1)
    flag = F.when(F.col("strand") == 1, 16).otherwise(0) + F.when(F.col("primary"), 0).otherwise(256)
    return rows.withColumn("flag", flag.cast("int"))


def unmapped(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Reads without a hit on either strand."""
    return reads.join(hits.select("read_id"), "read_id", "left_anti")


def sam_records(alignments: DataFrame, reads: DataFrame, strands: DataFrame, contigs: DataFrame) -> DataFrame:
    """A row per alignment and per unmapped read: the eleven SAM columns, nm, xm and read_id."""
    rows = flagged(alignments).join(reads.select("read_id", "name"), "read_id").join(strands.select("read_id", "strand", F.col("seq").alias("bases"), F.col("qual").alias("quality")), ["read_id", "strand"])
    rows = rows.join(contigs.select("contig_id", F.col("name").alias("rname")), "contig_id")
    shown = lambda c: F.when(F.col("primary"), F.col(c)).otherwise("*")
    rest = [F.lit("*").alias("rnext"), F.lit(0).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen")]
    mapped = rows.select(F.col("name").alias("qname"), "flag", "rname", (F.col("pos") + 1).alias("pos"), F.lit(255).alias("mapq"), "cigar", *rest, shown("bases").alias("seq"), shown("quality").alias("qual"), "nm", F.col("nm").alias("xm"), "read_id")
    none = F.lit(None).cast("int")
    others = unmapped(reads, alignments).select(F.col("name").alias("qname"), F.lit(4).alias("flag"), F.lit("*").alias("rname"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), *rest, "seq", "qual", none.alias("nm"), none.alias("xm"), "read_id")
    return mapped.unionByName(others)


def sam_lines(records: DataFrame, *further: str) -> DataFrame:
    """One text column, value: tab-separated fields with the tags NM and XM; and ``further`` columns."""
    tag = lambda c, name: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:i:"), F.col(c).cast("string")))
    return records.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in SAM], tag("nm", "NM"), tag("xm", "XM")).alias("value"), *further)


def sam_header(contigs: DataFrame, program: str = "strandwork") -> DataFrame:
    """n, value: the header lines in order of n."""
    spark = contigs.sparkSession
    first = spark.range(1).select(F.lit(-1).cast("long").alias("n"), F.lit("@HD\tVN:1.4\tSO:unsorted").alias("value"))
    lines = contigs.select(F.col("contig_id").cast("long").alias("n"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    last = spark.range(1).select(F.lit((1 << 63) - 1).alias("n"), F.lit(f"@PG\tID:{program}\tPN:{program}").alias("value"))
    return first.union(lines).union(last)


def locate(points: DataFrame, contigs: DataFrame, bin_size: int = 1 << 16) -> DataFrame:
    """``points (g_pos)`` with contig_id and pos. Both sides meet in bins of the global axis, so it is an equi-join."""
    spans = contigs.where("length > 0").select("contig_id", "g_start", (F.col("g_start") + F.col("length")).alias("g_end"))
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("g_start") / bin_size), F.floor((F.col("g_end") - 1) / bin_size))))
    own = points.withColumn("bin", F.floor(F.col("g_pos") / bin_size))
    return own.join(binned, "bin").where("g_pos >= g_start and g_pos < g_end").select(*points.columns, "contig_id", (F.col("g_pos") - F.col("g_start")).alias("pos"))

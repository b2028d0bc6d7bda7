"""Command line: ``python -m strandwork index -i genome.fa -p index`` and ``python -m strandwork map -p index -i reads.fq -o out``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.dna import SEED
from .operators.index import STEP, read_index
from .plans.mapping import sam
from .sinks.sam import write_sam
from .sources.contigs import SPLIT_BYTES, index_of_files
from .sources.sequences import listed, numbered_reads


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strandwork", description="Maps reads to a genome on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="write the index of FASTA files")
    index.add_argument("-i", dest="fasta", nargs="+", required=True, help="FASTA files, plain or gzip")
    index.add_argument("-p", dest="prefix", required=True, help="folder of the index, which must not exist")
    index.add_argument("-s", dest="seed", type=int, default=SEED, help="bases of a seed")
    index.add_argument("--step", type=int, default=STEP, help="bases between two seeds: 1, 2 or 4")
    index.add_argument("--split-bytes", type=int, default=SPLIT_BYTES, help="bytes of a file that one task reads")
    index.add_argument("--buckets", type=int, help="files of the posting lists")
    mapper = commands.add_parser("map", help="map FASTA or FASTQ reads and write SAM files")
    mapper.add_argument("-p", dest="prefix", required=True, help="folder of the index")
    mapper.add_argument("-o", dest="out", required=True, help="folder of the SAM files")
    given = mapper.add_mutually_exclusive_group(required=True)
    given.add_argument("-i", dest="reads", nargs="+", help="files of reads, plain or gzip")
    given.add_argument("-f", dest="list", help="a text file that names a file of reads in each line")
    mapper.add_argument("-e", dest="errors", type=int, default=4, help="edits of an alignment at most")
    mapper.add_argument("-s", dest="seed", type=int, help="bases of a seed, to check the index against")
    mapper.add_argument("-l", dest="longest", type=int, help="bases of a read at most; longer ones end the job (default: any length)")
    mapper.add_argument("--parts", type=int, default=1, help="SAM files for each file of reads")
    mapper.add_argument("--split-bytes", type=int, default=0, help="bytes of a file that one task reads (0: whole files)")
    mapper.add_argument("--overwrite", action="store_true", help="replace SAM files of the same names")
    return parser


def main(argv: list[str] | None = None) -> list[str]:
    """Runs a command; returns the names of what it has written."""
    given = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("strandwork").getOrCreate()
    if given.command == "index":
        index_of_files(spark, given.fasta, given.prefix, given.step, given.seed, given.split_bytes, given.buckets)
        return [given.prefix]
    index = read_index(spark, given.prefix, given.seed)
    reads = numbered_reads(spark, given.reads or listed(spark, given.list), given.split_bytes)
    if given.longest:
        too_long = F.raise_error(F.concat(F.lit("longer than the reads may be: "), "name")).cast("string")
        reads = reads.withColumn("seq", F.when(F.length("seq") > given.longest, too_long).otherwise(F.col("seq")))
    return write_sam(sam(index, reads, given.errors), index["contigs"], given.out, reads, given.parts, given.overwrite)


if __name__ == "__main__":
    main()

"""Mapping reads end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import FURTHER, SEED
from ..operators import index as ix
from ..operators import report, seeding, verify
from ..operators.index import Index
from ..shared import settle


def build_index(spark: SparkSession, sequences: DataFrame, path: str, step: int = ix.STEP, seed: int = SEED, buckets: int | None = None) -> Index:
    """Write the index of ``sequences (contig_id, name, seq)`` below ``path`` and read it back."""
    ix.write_index(sequences, path, step, seed, buckets)
    return ix.read_index(spark, path, seed)


def candidates(index: Index, strands: DataFrame, errors: int, seed: int | None = None) -> DataFrame:
    """Different places where an oriented read may begin. The probes are written once; where they ask for few seeds, only these pages of the index are read."""
    index.own_seed(seed)
    asked = settle(seeding.located(seeding.probes(strands, index, errors), index), "probes")
    return seeding.candidates(seeding.filtered_hits(seeding.seed_hits(asked, seeding.pruned(index, asked), index.buckets)), index.seed)


def windows(index: Index, reads: DataFrame, strands: DataFrame, errors: int, n_policy: str = "as-a") -> DataFrame:
    longest = (reads.agg(F.max(F.length("seq"))).first()[0] or 0) + 2 * errors
    return verify.windows(candidates(index, strands, errors), strands, index["tiles"], index["contigs"], errors, n_policy, longest)


def verified(index: Index, reads: DataFrame, errors: int, n_policy: str = "as-a") -> DataFrame:
    """The hits of ``verify.hits``; the windows are written once and read by both ways of verifying."""
    rows = settle(windows(index, reads, seeding.oriented(reads), errors, n_policy), "windows")
    return verify.hits(verify.verified(rows, errors))


def map_reads(index: Index, reads: DataFrame, errors: int = 4, n_policy: str = "as-a", seed: int | None = None) -> DataFrame:
    """All alignments of ``reads (read_id, name, seq, qual)`` within ``errors`` edits: read_id, strand, contig_id, pos, end, nm, cigar.

    Reads of at least (index.seed + 3) (errors + 1) bases miss none; shorter ones are searched by all seeds they have. Reads may have any length.
    The seed length is the index's; another ``seed`` is refused. Probes, windows and hits are written to the shared folder once each.
    """
    index.own_seed(seed)
    found = settle(verified(index, reads, errors, n_policy), "hits")
    return verify.aligned(found, errors).select("read_id", "strand", "contig_id", "pos", "end", "nm", "cigar")


def complete(reads: DataFrame, errors: int, seed: int = SEED) -> DataFrame:
    """read_id, complete: whether a read is long enough for the guarantee."""
    return reads.select("read_id", (F.length("seq") >= (seed + FURTHER) * (errors + 1)).alias("complete"))


def explain_reads(index: Index, reads: DataFrame, places: DataFrame, errors: int = 4, seed: int | None = None) -> DataFrame:
    """What the seeds of reads say of ``places (read_id, contig_id, at)``: these with strand, ls, j, seed, start (where the read would begin, within ``errors`` of ``at``) and passes (the flank filter).

    All seeds of the reads are looked up, rare or not.
    """
    seed = index.own_seed(seed)
    strands = seeding.oriented(reads.join(places.select("read_id"), "read_id", "left_semi"))
    subs = seeding.counted(seeding.sub_seeds(seeding.long_seeds(strands, seed), seed), index["seed_count"]).where("blocks > 0")
    asked = settle(seeding.located(subs, index), "probes")
    found = seeding.seed_hits(asked, seeding.pruned(index, asked), index.buckets)
    start = F.col("pos") - (F.col("ls") * (seed + FURTHER) + F.col("j"))
    near = found.withColumn("start", start).join(places, ["read_id", "contig_id"]).where(F.abs(F.col("start") - F.col("at")) <= errors)
    return near.select("read_id", "contig_id", "at", "strand", "ls", "j", "seed", "start", seeding.agrees().alias("passes"))


def explain_read(index: Index, reads: DataFrame, read_id: int, contig_id: int, pos: int, errors: int = 4, seed: int | None = None) -> DataFrame:
    """``explain_reads`` of one read near one place: strand, ls, j, seed, start, passes."""
    place = reads.sparkSession.createDataFrame([(read_id, contig_id, pos)], "read_id long, contig_id long, at long")
    return explain_reads(index, reads, place, errors, seed).select("strand", "ls", "j", "seed", "start", "passes")


def sam(index: Index, reads: DataFrame, errors: int = 4, n_policy: str = "as-a") -> DataFrame:
    """``report.sam_records`` of ``map_reads``; the alignments are written once."""
    found = settle(map_reads(index, reads, errors, n_policy), "alignments")
    return report.sam_records(found, reads, seeding.oriented(reads), index["contigs"])

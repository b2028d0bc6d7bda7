"""From reads to candidates: both strands, long seeds, the rarest of them, and the join with the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import FURTHER, SEED, flank_part, residual_code, reverse_complement, seed_code
from .index import Index, places_of

#: Different blocks of seeds up to which a join reads only their pages of the index, and ranges of seeds that are sent to the scan.
FEW_SEEDS, RANGES = 4096, 256


def oriented(reads: DataFrame) -> DataFrame:
    """read_id, strand (0 forward, 1 reverse complement), seq, qual."""
    both = F.array(F.struct(F.lit(0).alias("strand"), F.col("seq").alias("seq"), F.col("qual").alias("qual")), F.struct(F.lit(1).alias("strand"), reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual")))
    return reads.select("read_id", F.explode(both).alias("x")).select("read_id", "x.*")


def long_seeds(strands: DataFrame, seed: int = SEED) -> DataFrame:
    """read_id, strand, ls, bases: disjoint seeds of three bases more than an indexed one, from the read's start."""
    return strands.select("read_id", "strand", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{{seed + FURTHER}}}"), 0)).alias("ls", "bases"))


def sub_seeds(longs: DataFrame, seed: int = SEED) -> DataFrame:
    """read_id, strand, ls, j, seed, resid: the windows of ``seed`` bases of a long seed and its 3 further bases; those with N give none."""
    j = F.explode(F.sequence(F.lit(0), F.lit(FURTHER))).alias("j")
    cut = longs.select("read_id", "strand", "ls", "bases", j).withColumn("kmer", F.substr("bases", F.col("j") + 1, F.lit(seed)))
    resid = F.concat(F.substr("bases", F.lit(1), F.col("j")), F.substr("bases", F.col("j") + seed + 1, F.lit(FURTHER) - F.col("j")))
    return cut.where(~F.col("kmer").rlike("[^ACGT]")).select("read_id", "strand", "ls", "j", seed_code(F.col("kmer")).alias("seed"), resid.alias("resid"))


def counted(subs: DataFrame, seed_count: DataFrame) -> DataFrame:
    """``subs`` with n and blocks of their seeds, 0 where a seed isn't indexed. The counts lie in buckets of the seed and aren't moved."""
    return subs.join(seed_count, "seed", "left").select(*subs.columns, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def long_seed_frequency(longs: DataFrame, subs: DataFrame, seed_count: DataFrame) -> DataFrame:
    """read_id, strand, ls, n: index positions of a long seed's sub-seeds, 0 if none is indexed."""
    known = counted(subs, seed_count).groupBy("read_id", "strand", "ls").agg(F.sum("n").alias("n"))
    return longs.select("read_id", "strand", "ls").join(known, ["read_id", "strand", "ls"], "left").select("read_id", "strand", "ls", F.coalesce("n", F.lit(0)).alias("n"))


def rare_seeds(frequency: DataFrame, errors: int) -> DataFrame:
    """The errors + 1 rarest long seeds of each oriented read; ties to the first. ``complete`` if there are as many."""
    own = Window.partitionBy("read_id", "strand")
    ranked = frequency.withColumn("rank", F.row_number().over(own.orderBy("n", "ls"))).where(F.col("rank") <= errors + 1)
    return ranked.select("read_id", "strand", "ls", "n", "rank")


def probes(strands: DataFrame, index: Index, errors: int) -> DataFrame:
    """read_id, strand, ls, j, seed, resid, n, blocks: the indexed sub-seeds of each oriented read's errors + 1 rarest long seeds.

    One join with the counts serves both the choice and the numbers of blocks, and the choice is one window: long seeds without an indexed sub-seed
    come first and take their places, so they are ranked with the others.
    """
    longs = long_seeds(strands, index.seed)
    subs = counted(sub_seeds(longs, index.seed), index["seed_count"])
    bare = longs.select("read_id", "strand", "ls", F.lit(None).cast("int").alias("j"), F.lit(None).cast("long").alias("seed"), F.lit(None).cast("string").alias("resid"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("blocks"))
    own = Window.partitionBy("read_id", "strand")
    summed = subs.unionByName(bare).withColumn("all", F.sum("n").over(Window.partitionBy("read_id", "strand", "ls")))
    ranked = summed.withColumn("rank", F.dense_rank().over(own.orderBy("all", "ls"))).where(F.col("rank") <= errors + 1)
    return ranked.where("blocks > 0").drop("all", "rank")


def _near(asked: list[tuple[int, int]]) -> Column:
    """Whether (part, seed) lies in one of some ``RANGES`` ranges of seeds within a part that hold all of ``asked``: those between the widest gaps.

    A balanced tree of tests, so that it stays shallow.
    """
    ordered = sorted(asked)
    ends = [i for i in range(1, len(ordered)) if ordered[i][0] != ordered[i - 1][0]]
    inner = sorted(set(range(1, len(ordered))) - set(ends), key=lambda i: ordered[i - 1][1] - ordered[i][1])
    cuts = sorted(ends + inner[: max(0, RANGES - 1 - len(ends))])
    tests = []
    for a, z in zip([0, *cuts], [*cuts, len(ordered)]):
        (part, low), (_, high) = ordered[a], ordered[z - 1]
        tests.append((F.col("part") == part) & (F.col("seed") == low if low == high else F.col("seed").between(low, high)))
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def located(asked: DataFrame, index: Index) -> DataFrame:
    """A row for each block of each probe's seed, with block, part, the number of its bucket, and code, the packed ``resid``, worked out here and not for each place."""
    return index.with_part(asked.withColumn("code", residual_code(F.col("resid"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))


def pruned(index: Index, asked: DataFrame, few: int = FEW_SEEDS) -> DataFrame:
    """The posting lists; where ``asked`` (of ``located``) has at most ``few`` different seeds, only the pages where these would be are read."""
    wanted = [tuple(r) for r in asked.select("part", "seed").distinct().limit(few + 1).collect()]
    if not wanted:
        return index["postings"].where(F.lit(False))
    if len(wanted) > few or len({part for part, _ in wanted}) > RANGES:
        return index["postings"]
    return index["postings"].where(_near(wanted))


def seed_hits(asked: DataFrame, lists: DataFrame, buckets: int | None = None) -> DataFrame:
    """read_id, strand, ls, j, seed, resid, code, contig_id, pos, flank: all places of the seeds of ``asked`` (of ``located``).

    The blocks of a heavy seed are met in different tasks; the lists lie in buckets and aren't moved.
    """
    each = asked.select("read_id", "strand", "ls", "j", "resid", "code", "seed", "block")
    each = each.repartition(buckets, "seed", "block") if buckets else each
    met = each.join(lists.drop("part"), ["seed", "block"])
    return places_of(met, "read_id", "strand", "ls", "j", "seed", "resid", "code")


def agrees() -> Column:
    """Whether the flank of a row of ``seed_hits`` agrees with the rest of the long seed."""
    return flank_part(F.col("flank"), F.lit(FURTHER) - F.col("j")) == F.col("code")


def filtered_hits(hits: DataFrame) -> DataFrame:
    """Those whose flanks agree with the rest of the long seed."""
    return hits.where(agrees())


def candidates(hits: DataFrame, seed: int = SEED) -> DataFrame:
    """Different (read_id, strand, contig_id, start)."""
    start = F.greatest(F.col("pos") - (F.col("ls") * (seed + FURTHER) + F.col("j")), F.lit(0).cast("long"))
    return hits.select("read_id", "strand", "contig_id", start.alias("start")).dropDuplicates()


def long_seed_hits(longs: DataFrame, positions: DataFrame, seed: int = SEED) -> DataFrame:
    """The same candidates from an index of the long seed at every position: one equi-join and no flank filter. ``positions (bases, contig_id, pos)``."""
    return longs.join(positions, "bases").select("read_id", "strand", "contig_id", F.greatest(F.col("pos") - F.col("ls") * (seed + FURTHER), F.lit(0).cast("long")).alias("start")).dropDuplicates()

"""The seed index: contigs, tiles, words of bits, and posting lists of sampled seeds with their flanks.

Contigs may be as long as chromosomes, so none is ever shuffled whole: a linear pass cuts it into tiles
that overlap their neighbours (``sources.contigs`` reads tiles from byte ranges of files, without a row for a contig), and all later
steps work on tiles.

A posting list is a row for each seed and block of up to ``BLOCK`` places, in order of contig and position. Lists are kept in
buckets of (seed, block), so that a join with probes moves no list and a hot seed's blocks lie in different buckets. A bucket is a file
that is sorted and cut into small pages, and its number stands in each row, so that a scan for few seeds reads just the pages where they would be.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dna import EDGE, MOST_SEED, SEED, STEP, flank_text

TILE, OVERLAP = 1024, 512
WORD = 32
#: Places of a posting list's row, and rows of a page of its files.
BLOCK, PAGE_ROWS = 256, 256
#: Places of a range that is sorted, and of a bucket, when there are more of them than shuffle partitions.
TASK_PLACES = 1 << 23
#: Format of the folder that ``write_index`` makes.
FORMAT = 2


@dataclass(frozen=True)
class Index(Mapping):
    """The tables of an index by name (contigs, tiles, postings, seed_count, and seed_pos as a view of postings), its seed length, step and buckets."""

    tables: dict[str, DataFrame]
    seed: int
    step: int
    buckets: int | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return seed_positions_of(self.tables["postings"]) if name == "seed_pos" and name not in self.tables else self.tables[name]

    def __iter__(self):
        return iter({**self.tables, "seed_pos": None})

    def __len__(self) -> int:
        return len(self.tables | {"seed_pos": None})

    def with_part(self, rows: DataFrame) -> DataFrame:
        """``rows (seed, block)`` with part, the number of their bucket."""
        return _with_part(rows, self.buckets) if self.buckets else rows.withColumn("part", F.lit(0))

    def own_seed(self, seed: int | None) -> int:
        """The index's seed length; refuses another one."""
        if seed not in (None, self.seed):
            raise ValueError(f"the index has seeds of {self.seed} bases, not {seed}")
        return self.seed


def contigs(sequences: DataFrame) -> DataFrame:
    """contig_id, name, length, g_start (length of all contigs before it) of ``sequences (contig_id, name, seq)``.

    The catalogue has a row per contig; g_start comes from subtotals of id ranges, so no task holds all of it.
    """
    return with_prefix(_lengths(sequences), "contig_id", "length", "g_start")


def _lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("contig_id", "name", F.length("seq").cast("long").alias("length"))


def _below(key: Column, bounds: list[int], first: int = 0) -> Column:
    """How many of the ascending ``bounds`` lie below the key, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key <= bounds[mid], _below(key, bounds[:mid], first)).otherwise(_below(key, bounds[mid + 1 :], first + mid + 1))


def with_prefix(rows: DataFrame, key: str, value: str, out: str, ranges: int = 64) -> DataFrame:
    """``rows`` with the sum of ``value`` over all smaller keys: within ranges of about equal counts of keys, plus the subtotals of earlier ranges."""
    cuts = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]  # a number per range
    ranged = rows.withColumn("_range", _below(F.col(key), sorted(set(cuts or ()))))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(before), "_range").withColumn(out, (F.col("_before") + own).cast("long")).drop("_range", "_before")


#: Bases in upper case, and N for what isn't one.
GENOME_BYTES = bytes(b if b in b"ACGT" else b - 32 if b in b"acgt" else ord("N") for b in range(256))
TILES = pa.schema([("contig_id", pa.int64()), ("tile", pa.int32()), ("start", pa.int64()), ("size", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())])
TILE_COLUMNS = "contig_id long, tile int, start long, size int, before string, body string, after string"


def in_batches(rows: Iterator[tuple], schema: pa.Schema, many: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``many`` rows."""
    while held := list(itertools.islice(rows, many)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def tiles(sequences: DataFrame, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """contig_id, tile, start, size, before (3 bases), body (size bases), after (overlap bases, fewer at the end)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for contig, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (seq.as_py() or "").encode("ascii", "replace").translate(GENOME_BYTES)
                for k, start in enumerate(range(0, len(text), tile)):
                    body = text[start : start + tile]
                    yield contig, k, start, len(body), text[max(0, start - 3) : start].decode(), body.decode(), text[start + tile : start + tile + overlap].decode()

    return sequences.select(F.col("contig_id").cast("long"), "seq").mapInArrow(lambda batches: in_batches(cut(batches), TILES), TILE_COLUMNS)


def _checked(seed: int, step: int) -> None:
    if not 1 <= seed <= MOST_SEED:
        raise ValueError(f"a seed has 1 to {MOST_SEED} bases, not {seed}")
    if step not in (1, 2, 4):
        raise ValueError(f"the four windows of a long seed meet every sampled place for steps of 1, 2 or 4, not {step}")


_CODES = np.full(256, 6, np.uint8)
_CODES[[ord(c) for c in f"ACGTN{EDGE}"]] = range(6)
#: Tiles whose seeds are worked out at once.
_TOGETHER = 512


def _codes_of(texts: list[str]) -> np.ndarray:
    """Codes as those of ``dna.planes``, a byte for each base of all texts."""
    return _CODES[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)]


def _runs(codes: np.ndarray, many: int, bits: int) -> np.ndarray:
    """For each place the number that ``many`` codes of ``bits`` bits make up from there on, the first least; of 1, 2, 4, ... codes by doubling, and put together."""
    kind = np.min_scalar_type((1 << bits * many) - 1)
    power, out, had, size = codes.astype(kind), None, 0, 1
    while True:
        if many & size:
            n = max(0, len(codes) - had - size + 1)
            out = power if out is None else out[:n] | power[had : had + n] << kind.type(bits * had)
            had += size
        if 2 * size > many:
            return out
        n = max(0, len(codes) - 2 * size + 1)
        power = power[:n] | power[size : size + n] << kind.type(bits * size)
        size *= 2


#: Bits of a map of seeds: seeds of up to 12 bases have one each, longer ones share it with those that begin with the same 12.
MAP_BITS = 1 << 24


def seed_map(seeds: DataFrame) -> np.ndarray:
    """The map of bits of ``seeds (seed)``, put together on the executors; the driver gets at most 2 MB, however many seeds there are."""
    bit = (F.col("seed").bitwiseAND(F.lit(MAP_BITS - 1)) + 1).alias("bit")
    packed = seeds.select(bit).distinct().groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for at, bits in packed.collect():
        out[(at - 1) * len(bits) : at * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _places(batches: Iterator[pa.RecordBatch], step: int, seed: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(seed, contig, position, flank) of the sampled windows without N of ``contig_id, start, size, before, body, after``, some tiles at a time; with ``wanted`` of the seeds on that ``seed_map`` only."""
    for batch in batches:
        for at in range(0, batch.num_rows, _TOGETHER):
            part = batch.slice(at, _TOGETHER)
            contig, start, size = (part.column(i).to_numpy() for i in range(3))
            before, body, after = (part.column(i).to_pylist() for i in range(3, 6))
            texts = [b.rjust(3, EDGE) + t + a[: seed + 2] + EDGE * 3 for b, t, a in zip(before, body, after)]
            codes = _codes_of(texts)
            first = np.cumsum([0, *map(len, texts)])[:-1] + 3  # where the tile's own bases begin
            last = np.minimum(size + np.fromiter((len(a[: seed - 1]) for a in after), np.int64, len(after)) - seed, size - 1)
            many = np.where(last >= 0, last // step + 1, 0)
            tile = np.repeat(np.arange(len(many)), many)
            own = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * step  # place in the tile
            at_code = first[tile] + own
            bad = np.r_[0, np.cumsum(codes > 3, dtype=np.int32)]
            fine = bad[at_code + seed] == bad[at_code]
            tile, own, at_code = tile[fine], own[fine], at_code[fine]
            value = _runs(codes & 3, seed, 2)[at_code].astype(np.int64)
            if wanted is not None:
                low = value & (MAP_BITS - 1)
                asked = np.flatnonzero(wanted[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                tile, own, at_code, value = tile[asked], own[asked], at_code[asked], value[asked]
            bases, others = _runs(codes & 3, 3, 2), _runs(codes >> 2, 3, 1)
            flank = np.zeros(len(tile), np.int32)
            for i, at_side in ((0, at_code - 3), (3, at_code + seed)):
                flank |= bases[at_side].astype(np.int32) << 2 * i | others[at_side].astype(np.int32) << 12 + i
            yield value, contig[tile], start[tile] + own, flank


_PLACED = ("contig_id", "start", "size", "before", "body", "after")


def _for_places(tiled: DataFrame) -> DataFrame:
    return tiled.select(F.col("contig_id").cast("long"), F.col("start").cast("long"), F.col("size").cast("long"), *_PLACED[3:])


def seed_flanks(tiled: DataFrame, step: int = STEP, seed: int = SEED, wanted: np.ndarray | None = None) -> DataFrame:
    """seed, contig_id, pos, flank of every ``step``-th window of ``seed`` bases that holds no N; with ``wanted`` of all seeds on that ``seed_map`` and no others."""
    _checked(seed, step)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _places(batches, step, seed, wanted):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "contig_id", "pos", "flank"])

    return _for_places(tiled).mapInArrow(work, "seed long, contig_id long, pos long, flank int")


def count_seeds(tiled: DataFrame, step: int = STEP, seed: int = SEED) -> DataFrame:
    """seed, n, straight from tiles: some tiles are counted at a time, then all."""
    _checked(seed, step)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, *_ in _places(batches, step, seed):
            seeds, n = np.unique(value, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(n.astype(np.int64))], names=["seed", "n"])

    return _for_places(tiled).mapInArrow(work, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def seed_positions(tiled: DataFrame, step: int = STEP, seed: int = SEED) -> DataFrame:
    """``seed_flanks`` with the flanks as texts left3 and right3."""
    return _as_texts(seed_flanks(tiled, step, seed))


def _as_texts(rows: DataFrame) -> DataFrame:
    return rows.select("seed", "contig_id", "pos", flank_text(F.col("flank"), 0, 3).alias("left3"), flank_text(F.col("flank"), 3, 3).alias("right3"))


def postings(flanked: DataFrame, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """seed, part, own, contig_ids, places, flanks: up to ``block`` places of a seed in order, cut from sorted ranges of (seed, contig, position).

    A hot seed may span any number of ranges (``part``) and is never whole in one task; ``own`` numbers its blocks within a range.
    """
    values = [("contig_ids", pa.int64()), ("places", pa.int64()), ("flanks", pa.int32())]
    schema = pa.schema([("seed", pa.int64()), ("part", pa.int32()), ("own", pa.int32()), *[(n, pa.list_(t)) for n, t in values]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, last_own = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds = batch.column(0).to_numpy()
            fresh = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]])  # where a seed begins
            sizes = np.diff(np.r_[fresh, len(seeds)])
            many = -(-sizes // block)
            own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            starts = np.repeat(fresh, many) + own * block
            if seeds[0] == last:  # goes on from the batch before
                own[: many[0]] += last_own + 1
            last, last_own = seeds[-1], int(own[-1])
            ends = pa.array(np.r_[starts, len(seeds)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch.column(i + 1).cast(t)) for i, (_, t) in enumerate(values)]
            yield pa.RecordBatch.from_arrays([pa.array(seeds[starts]), pa.array(np.full(len(starts), part, np.int32)), pa.array(own.astype(np.int32)), *lists], schema=schema)

    parts = parts or int(flanked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = flanked.select("seed", "contig_id", "pos", "flank").repartitionByRange(parts, "seed", "contig_id", "pos").sortWithinPartitions("seed", "contig_id", "pos")
    return ranged.mapInArrow(cut, "seed long, part int, own int, contig_ids array<long>, places array<long>, flanks array<int>")


def seed_positions_of(lists: DataFrame) -> DataFrame:
    """seed, contig_id, pos, left3, right3 of ``postings`` rows."""
    return _as_texts(places_of(lists, "seed"))


def places_of(lists: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with contig_id, pos and flank of each place of ``postings`` rows."""
    each = F.inline(F.arrays_zip(F.col("contig_ids").alias("contig_id"), F.col("places").alias("pos"), F.col("flanks").alias("flank"))).alias("contig_id", "pos", "flank")
    return lists.select(*columns, each)


def seed_counts(positions: DataFrame) -> DataFrame:
    """seed, n."""
    return positions.groupBy("seed").agg(F.count("*").alias("n"))


def seed_offsets(counts: DataFrame) -> DataFrame:
    """seed, n, first: how many positions all smaller seeds have."""
    return with_prefix(counts.select("seed", "n"), "seed", "n", "first")


def base_words(tiled: DataFrame) -> DataFrame:
    """contig_id, w, lo, hi, nmask: 32 bases in two planes of bits and a mask of N (which counts as A in the planes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                contig, start, size = (part.column(i).to_numpy() for i in range(3))
                many = -(-size // WORD)  # words of a tile
                tile = np.repeat(np.arange(len(many)), many)
                own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                codes = np.zeros(many.sum() * WORD, np.uint8)
                codes[np.repeat((np.cumsum(many) - many) * WORD - (np.cumsum(size) - size), size) + np.arange(size.sum())] = _codes_of(part.column(3).to_pylist())
                planes = [np.packbits(bits, bitorder="little").view("<u4").astype(np.int64) for bits in (codes & 1, codes >> 1 & 1, codes >> 2)]
                columns = [contig[tile], (start[tile] // WORD + own).astype(np.int32), *planes]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["contig_id", "w", "lo", "hi", "nmask"])

    return _for_places(tiled).select("contig_id", "start", "size", "body").mapInArrow(work, "contig_id long, w int, lo long, hi long, nmask long")


def unpacked(words: DataFrame, lengths: DataFrame) -> DataFrame:
    """contig_id, w, bases: the bases of ``base_words`` rows again; the last word of a contig is cut to its length."""
    bit = lambda c, k: F.call_function("shiftright", F.col(c), k).bitwiseAND(F.lit(1))
    letter = lambda k: F.when(bit("nmask", k) == 1, "N").otherwise(F.substr(F.lit("ACGT"), (bit("lo", k) + 2 * bit("hi", k) + 1).cast("int"), F.lit(1)))
    many = F.least(F.lit(WORD), F.col("length") - F.col("w") * WORD).cast("int")
    rows = words.join(lengths.select("contig_id", "length"), "contig_id")
    return rows.select("contig_id", "w", F.array_join(F.transform(F.sequence(F.lit(0), many - 1), letter), "").alias("bases"))


#: Columns, and those that deal the rows to buckets and sort a bucket.
_BUCKETED = {
    "postings": ("part INT, seed BIGINT, block INT, contig_ids ARRAY<BIGINT>, places ARRAY<BIGINT>, flanks ARRAY<INT>", ("seed", "block")),
    "seed_count": ("seed BIGINT, n BIGINT, blocks INT", ("seed",)),
}


def _with_part(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.hash("seed", "block"), F.lit(buckets)))  # as Spark deals rows to buckets


def _write_bucketed(rows: DataFrame, path: str, table: str, buckets: int) -> None:
    """``rows`` as sorted buckets below ``path``: one file each, in small pages with statistics."""
    spark, (_, keys) = rows.sparkSession, _BUCKETED[table]
    name = f"strandwork_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.page.row.count.limit", str(PAGE_ROWS)).option("parquet.bloom.filter.enabled", "false").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay


@functools.cache
def _registered(spark: SparkSession, path: str, table: str, buckets: int) -> str:
    """The session's name of a bucketed table's files."""
    columns, keys = _BUCKETED[table]
    name, by = f"strandwork_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS")
    return name


def write_index(sequences: DataFrame, path: str, step: int = STEP, seed: int = SEED, buckets: int | None = None) -> None:
    """The tables of an index of ``sequences (contig_id, name, seq)`` below ``path``."""
    write_contigs(sequences, path)
    write_lists(sequences.sparkSession.read.parquet(f"{path}/tiles"), path, step, seed, buckets)


def write_contigs(sequences: DataFrame, path: str) -> None:
    """The tables contigs and tiles, which don't depend on the seed."""
    spark = sequences.sparkSession
    _lengths(sequences).write.parquet(f"{path}/lengths")  # small, and read several times for the sums before
    with_prefix(spark.read.parquet(f"{path}/lengths"), "contig_id", "length", "g_start").write.parquet(f"{path}/contigs")
    tiles(sequences).repartition("contig_id", "tile").write.parquet(f"{path}/tiles")
    _delete(spark, f"{path}/lengths")


def write_tiled_index(catalogue: DataFrame, tiled: DataFrame, path: str, step: int = STEP, seed: int = SEED, buckets: int | None = None) -> None:
    """The tables contigs and tiles, and those of ``write_lists``."""
    _checked(seed, step)
    catalogue.write.parquet(f"{path}/contigs")
    tiled.write.parquet(f"{path}/tiles")
    write_lists(tiled.sparkSession.read.parquet(f"{path}/tiles"), path, step, seed, buckets)


def write_lists(tiled: DataFrame, path: str, step: int = STEP, seed: int = SEED, buckets: int | None = None, wanted: np.ndarray | None = None) -> None:
    """The tables postings and seed_count (in ``buckets``) and meta, which comes last; with ``wanted`` of the seeds on that ``seed_map`` only, each with all its places.

    Unless told, there are as many buckets as shuffle partitions, or one for ``TASK_PLACES`` if these are more. Ranges go by the same number, so what a task sorts doesn't grow with the genome.
    """
    _checked(seed, step)
    spark = tiled.sparkSession
    places = (tiled.agg(F.sum("size")).first()[0] or 0) // step
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places // TASK_PLACES))
    buckets = buckets or parts
    postings(seed_flanks(tiled, step, seed, wanted), parts=parts).write.parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    # A seed that spans several ranges has its blocks numbered on from the ranges before.
    held = lists.select("seed", "part", F.size("places").alias("n")).repartition(buckets, "seed").groupBy("seed", "part").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"))
    before = F.coalesce(F.sum("blocks").over(Window.partitionBy("seed").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    further = F.broadcast(held.withColumn("before", before).where("before > 0").select("seed", "part", "before"))  # at most a row for each range
    numbered = lists.join(further, ["seed", "part"], "left").select("seed", (F.col("own") + F.coalesce("before", F.lit(0))).cast("int").alias("block"), "contig_ids", "places", "flanks")
    _write_bucketed(_with_part(numbered, buckets).select("part", *numbered.columns), f"{path}/postings", "postings", buckets)
    _write_bucketed(held.groupBy("seed").agg(F.sum("n").cast("long").alias("n"), F.sum("blocks").cast("int").alias("blocks")), f"{path}/seed_count", "seed_count", buckets)
    _delete(spark, f"{path}/lists")
    meta = [F.lit(v).alias(n) for n, v in (("seed_length", seed), ("step", step), ("format_version", FORMAT), ("buckets", buckets), ("some_seeds", wanted is not None))]
    spark.range(1).select(*meta).write.parquet(f"{path}/meta")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_index(spark: SparkSession, path: str, seed: int | None = SEED, tiled: str | None = None, some_seeds: bool = False) -> Index:
    """The index that ``write_index`` wrote; refuses another format, and another seed length than ``seed`` (None: whatever it has). ``tiled``: where ``write_contigs`` wrote, if elsewhere.

    One with the lists of some seeds serves only the reads whose seeds these are, so it is refused unless ``some_seeds``.
    """
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["format_version"] != FORMAT or seed not in (None, meta["seed_length"]):
        raise ValueError(f"the index has seeds of {meta['seed_length']} bases in format {meta['format_version']}")
    if meta.get("some_seeds") and not some_seeds:
        raise ValueError("the index has lists of some seeds only")
    plain = read_contigs(spark, tiled or path)
    names = {t: _registered(spark, f"{path}/{t}", t, meta["buckets"]) for t in _BUCKETED}
    for name in names.values():
        spark.catalog.refreshTable(name)  # in case the folder was written anew
    # A bucket is one sorted file, so joins by its keys take it as it comes: lists are neither moved nor sorted, which would spill them.
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    bucketed = {t: spark.table(name) for t, name in names.items()}
    return Index(plain | bucketed, meta["seed_length"], meta["step"], meta["buckets"])


def read_contigs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``write_contigs`` wrote."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("contigs", "tiles")}


def index_of(sequences: DataFrame, step: int = STEP, seed: int = SEED) -> Index:
    """The same tables, planned and not written; every list is one block."""
    tiled = tiles(sequences)
    flanked = seed_flanks(tiled, step, seed)
    lists = flanked.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("contig_id", "pos", "flank"))).alias("x"))
    lists = lists.select(F.lit(0).alias("part"), "seed", F.lit(0).alias("block"), F.col("x.contig_id").alias("contig_ids"), F.col("x.pos").alias("places"), F.col("x.flank").alias("flanks"))
    counts = seed_counts(flanked).withColumn("blocks", F.lit(1))
    return Index({"contigs": contigs(sequences), "tiles": tiled, "postings": lists, "seed_count": counts}, seed, step)

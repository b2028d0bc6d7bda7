"""FASTA contigs from byte ranges of files: no task reads a whole contig and no row holds one.

A first pass counts the bases of each byte range, apart for the rest of the line that it begins in, the contig that goes on into it, and each contig
that begins in it. Whether that rest is of a header follows from the ranges before, and sums over the ranges give each contig its length
and each range the coordinate of its first base. In a second pass each range cuts the tiles whose first needed base lies in it; it reads
on into the next range for as long as its last tiles need.

The rules are those of FASTA: a line that begins with ``>`` is a header, its name ends at white space, white space within sequences is dropped,
and what stands before the first header belongs to no contig. A gzip file is one range, which is streamed.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.index import GENOME_BYTES, OVERLAP, STEP, TILE, TILE_COLUMNS, TILES, Index, in_batches, read_index, with_prefix, write_tiled_index
from ..functions.dna import SEED
from .sequences import store

SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Ranges that have a task each; more of them are dealt to as many tasks, or to tasks of ``SPLIT_BYTES`` if these are more.
MOST_TASKS = 256
_BLANK = b" \t\r\n\v\f"


class Text:
    """A file's bytes from ``at`` on, in lines and parts of lines."""

    def __init__(self, path: str, at: int) -> None:
        system, inner = store(path)
        if path.endswith(".gz"):
            self.raw = gzip.open(system.open_input_stream(inner, compression=None))
        else:
            self.raw = system.open_input_file(inner)
            self.raw.seek(at)
        self.at, self.held, self.next, self.ended = at, b"", 0, False  # ``next``: the place in what is held

    def _more(self) -> None:
        if self.next == len(self.held) and not self.ended:
            self.held, self.next = self.raw.read(READ_BYTES), 0
            self.ended = not self.held

    def first(self) -> bytes:
        """The next byte, which stays; empty at the end."""
        self._more()
        return self.held[self.next : self.next + 1]

    def part(self, stop: int | None) -> tuple[bytes, bool]:
        """Bytes of the line that goes on here, none from ``stop`` on, and whether its end (which is taken) is among them."""
        self._more()
        end = self.held.find(b"\n", self.next)
        size = (end + 1 if end >= 0 else len(self.held)) - self.next
        if stop is not None:
            size = min(size, stop - self.at)
        out = self.held[self.next : self.next + size]
        self.next, self.at = self.next + size, self.at + size
        return out, out.endswith(b"\n")

    def line(self) -> bytes:
        """The rest of the line that goes on here."""
        parts = []
        while self.first():
            part, ended = self.part(None)
            parts.append(part)
            if ended:
                break
        return b"".join(parts)

    def close(self) -> None:
        self.raw.close()


def _open(path: str, start: int, stop: int | None) -> tuple[Text, bool]:
    """The file from ``start`` on, and whether a line begins there."""
    text = Text(path, max(0, start - 1))
    return text, not start or text.part(start)[1]


def _head(line: bytes) -> tuple[str, str]:
    words = line[1:].decode().strip().split(None, 1)
    return (words[0] if words else "", words[1] if len(words) > 1 else "")


_SEGMENTS = pa.schema([("file", pa.int32()), ("split", pa.int32()), ("segment", pa.int32()), ("name", pa.string()), ("bases", pa.int64()), ("in_header", pa.bool_())])


def _segments(path: str, start: int, stop: int | None) -> Iterator[tuple[int, str | None, int, bool | None]]:
    """(segment, name, bases, whether the range ends in a header) of a byte range: 0 the rest of a line, 1 what follows it, 2 and on contigs that begin here.

    The last is null where no line ends in the range, as it depends on the ranges before.
    """
    text, fresh = _open(path, start, stop)
    segment, name, bases, in_header, line_start = (1, None, 0, False, True) if fresh else (0, None, 0, None, False)
    while text.first() and (stop is None or text.at < stop):
        if line_start and text.first() == b">":
            yield segment, name, bases, in_header
            begin = text.at
            name, _ = _head(line := text.line())
            segment, bases = max(2, segment + 1), 0
            line_start, in_header = True, stop is not None and begin + len(line) > stop
            continue
        part, line_start = text.part(stop)
        bases += len(part) - sum(part.count(b) for b in _BLANK)
        if line_start and not segment:
            yield 0, None, bases, None
            segment, bases, in_header = 1, 0, False
    text.close()
    yield segment, name, bases, in_header


def _splits(spark: SparkSession, paths: list[str], split_bytes: int) -> tuple[DataFrame, int]:
    """file, split, path, start, stop of each range, dealt to tasks, and how many tasks there are. A gzip file has no stop.

    The tasks, and with them what the driver keeps of them, grow with the bytes and not with the ranges.
    """
    sizes = []
    for path in paths:
        system, inner = store(path)
        sizes.append(0 if path.endswith(".gz") else system.get_file_info(inner).size)
    many = min(sum(max(1, -(-size // split_bytes)) for size in sizes), max(MOST_TASKS, -(-sum(sizes) // SPLIT_BYTES)))
    files = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(zip(paths, sizes))], "file int, path string, size long")
    at = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("split", "start")
    rows = files.select("file", "path", "size", at).select("file", "split", "path", "start", F.when(~F.col("path").endswith(".gz"), F.least(F.col("start") + split_bytes, "size")).alias("stop"))
    return rows.repartition(many, "file", "split"), many


def scanned(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, split, segment, name, bases, in_header: what the first pass counts, a few rows for each range and contig."""
    splits, _ = _splits(spark, paths, split_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(row["file"], row["split"], *x) for x in _segments(row["path"], row["start"], row["stop"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _SEGMENTS)], schema=_SEGMENTS)

    return splits.mapInArrow(scan, "file int, split int, segment int, name string, bases long, in_header boolean")


def placed(segments: DataFrame) -> DataFrame:
    """``scanned`` rows with header (whether the range begins in one), contig (counted in the file, 0 before the first header) and at (the segment's first base in the contig)."""
    in_order = Window.partitionBy("file").orderBy("split", "segment")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # What a range without a line's end ends in is what it begins in.
    rows = segments.withColumn("header", (F.col("segment") == 0) & F.coalesce(F.last("in_header", ignorenulls=True).over(before), F.lit(False)))
    rows = rows.withColumn("own", F.when(F.col("header"), 0).otherwise(F.col("bases")))
    rows = rows.withColumn("contig", F.count("name").over(in_order))
    at = F.sum("own").over(Window.partitionBy("file", "contig").orderBy("split", "segment").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("at", F.coalesce(at, F.lit(0)))


def _numbered(placed: DataFrame) -> DataFrame:
    """file, first: the number of contigs in the files before; a row for each file."""
    counts = placed.groupBy("file").agg(F.max("contig").alias("many"))
    return counts.select("file", F.coalesce(F.sum("many").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))


def contigs_of(placed: DataFrame) -> DataFrame:
    """contig_id (from 0, in order of files and places), name, length, g_start."""
    lengths = placed.where("contig > 0").groupBy("file", "contig").agg(F.first("name", ignorenulls=True).alias("name"), F.sum("own").alias("length"))
    named = lengths.join(F.broadcast(_numbered(placed)), "file").select((F.col("first") + F.col("contig") - 1).alias("contig_id"), "name", "length")
    return with_prefix(named, "contig_id", "length", "g_start")


class Cutter:
    """Tiles of one contig from its bases in order. ``first`` and ``last``: the tiles to cut (last None: all that come)."""

    def __init__(self, contig: int, at: int, tile: int, overlap: int) -> None:
        self.contig, self.tile, self.overlap = contig, tile, overlap
        # The tile whose first needed base (three before its own) is the first at ``at`` or behind.
        self.next, self.last = (at + 3 + tile - 1) // tile if at else 0, None
        self.at, self.held = at, bytearray()

    def close_at(self, at: int) -> None:
        """No tile is wanted whose first needed base lies at ``at`` or behind."""
        self.last = (at + 3 + self.tile - 1) // self.tile - 1 if at else -1

    def wants(self) -> bool:
        return self.last is None or self.next <= self.last

    def give(self, bases: bytes, ended: bool = False) -> Iterator[tuple]:
        self.held += bases
        while self.wants():
            start = self.next * self.tile
            have = self.at + len(self.held)
            if have <= start or not ended and have < start + self.tile + self.overlap:
                break
            a = start - self.at
            text = bytes(self.held[max(0, a - 3) : a + self.tile + self.overlap])
            lead = min(3, a)
            body = text[lead : lead + self.tile]
            yield self.contig, self.next, start, len(body), text[:lead].decode() if start else "", body.decode(), text[lead + self.tile :].decode()
            self.next += 1
        done = min(max(0, self.next * self.tile - 3 - self.at), len(self.held))
        del self.held[:done]
        self.at += done


def _tiles(path: str, start: int, stop: int | None, header: bool, contig: int, at: int, tile: int, overlap: int) -> Iterator[tuple]:
    """The tiles of a byte range that begins ``at`` bases into ``contig`` (below 0: before the first), or in a header."""
    text, line_start = _open(path, start, stop)
    if header:
        text.line()
        line_start = True
    cutter = Cutter(contig, at, tile, overlap) if contig >= 0 else None
    inside, seen = True, at  # ``seen``: bases of the contig so far
    while text.first():
        if inside and stop is not None and text.at >= stop:
            inside = False
            if cutter:
                cutter.close_at(seen)
        if not inside and not (cutter and cutter.wants()):
            break
        if line_start and text.first() == b">":
            if cutter:
                yield from cutter.give(b"", ended=True)
            if not inside:
                cutter = None
                break
            text.line()
            contig, seen = contig + 1, 0
            cutter = Cutter(contig, 0, tile, overlap)
            continue
        part, line_start = text.part(stop if inside else None)
        bases = part.translate(GENOME_BYTES, _BLANK)
        seen += len(bases)
        if cutter:
            yield from cutter.give(bases)
    text.close()
    if cutter:
        if inside:
            cutter.close_at(seen)
        yield from cutter.give(b"", ended=True)


def tiles_of(spark: SparkSession, paths: list[str], found: DataFrame, split_bytes: int = SPLIT_BYTES, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """The tiles of all contigs: contig_id, tile, start, size, before, body, after. ``found``: the ``placed`` rows of the same ranges."""
    splits, many = _splits(spark, paths, split_bytes)
    # A range begins where its first segment does: in the rest of a line, or with what follows a line's end.
    begins = found.where("segment <= 1").groupBy("file", "split").agg(F.min_by(F.struct("header", "contig", "at"), "segment").alias("x"))
    plan = splits.join(begins, ["file", "split"]).join(F.broadcast(_numbered(found)), "file")
    contig = F.when(F.col("x.contig") > 0, F.col("first") + F.col("x.contig") - 1).otherwise(F.col("first") - 1)
    plan = plan.select("path", "start", "stop", F.col("x.header").alias("header"), contig.alias("contig"), (F.col("x.contig") == 0).alias("outside"), F.col("x.at").alias("at")).repartition(many, "path", "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cut_tiles = _outside(row, tile, overlap) if row["outside"] else _tiles(row["path"], row["start"], row["stop"], row["header"], row["contig"], row["at"], tile, overlap)
                yield from in_batches(cut_tiles, TILES)

    return plan.mapInArrow(cut, TILE_COLUMNS)


def _outside(row: dict, tile: int, overlap: int) -> Iterator[tuple]:
    """The tiles of a range that begins before the file's first header: what stands before that is dropped."""
    skipped = row["contig"]  # the number before the file's first contig
    for found in _tiles(row["path"], row["start"], row["stop"], row["header"], skipped, row["at"], tile, overlap):
        if found[0] > skipped:
            yield found


def index_of_files(spark: SparkSession, paths: list[str], path: str, step: int = STEP, seed: int = SEED, split_bytes: int = SPLIT_BYTES, buckets: int | None = None) -> Index:
    """Write the index of FASTA files below ``path`` and read it back; contigs are numbered in order of files and places."""
    scanned(spark, paths, split_bytes).write.parquet(f"{path}/segments")
    rows = placed(spark.read.parquet(f"{path}/segments"))
    write_tiled_index(contigs_of(rows), tiles_of(spark, paths, rows, split_bytes), path, step, seed, buckets)
    return read_index(spark, path, seed)

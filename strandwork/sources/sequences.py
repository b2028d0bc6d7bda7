"""FASTA and FASTQ reads, as a batch and as a stream.

A file is read whole by one task, or in ranges of bytes: a record belongs to the range that its head begins in, and a range finds its first head by
trying the lines in turn until records follow one another from there. Records may be wrapped over lines. Files in block gzip are cut at their blocks, which are
gzip members that state their size; other gzip files are one range.
"""

from __future__ import annotations

import gzip
import itertools
import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "name string, comment string, seq string, qual string, file string"
_ARROW = pa.schema([(n, pa.string()) for n in ("name", "comment", "seq", "qual", "file")])
#: Records of a batch, bytes read at a time, bytes before a range in which its first head is looked for, and records that have to follow one another from there.
BATCH, BLOCK, BACK, IN_TURN = 4096, 1 << 20, 1 << 16, 3


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, comment, seq of each record; splittable, any store that Spark reads. Sequence lines are joined, carriage returns dropped."""
    text = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    parts = text.select(F.split(record, "\n", 2).alias("p")).where(F.length(F.get("p", F.lit(0))) > 0)
    head = F.get("p", F.lit(0))
    return parts.select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("name"),
        F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"),
        F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", "").alias("seq"),
    )


def records(lines: Iterable[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, seq, qual) of FASTA or FASTQ lines; ValueError where sequence and quality differ in length."""
    head, seq = None, []
    lines = iter(lines)
    for line in lines:
        line = line.rstrip("\r\n")
        if line[:1] in (">", "@") or head and line[:1] == "+":
            if line[:1] == "+":
                bases, qual = "".join(seq), ""
                while len(qual) < len(bases):
                    more = next(lines, None)
                    if more is None:
                        break
                    qual += more.rstrip("\r\n")
                if len(qual) != len(bases):
                    raise ValueError(f"{head[0]}: {len(bases)} bases and {len(qual)} qualities")
                yield *head, bases, qual
                head = None
                continue
            if head:
                yield *head, "".join(seq), None
            words = line[1:].split(None, 1)  # the name ends at any white space
            head, seq = (words[0] if words else "", words[1] if len(words) > 1 else ""), []
        elif head:
            seq.append(line.strip())
    if head:
        yield *head, "".join(seq), None


def store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Lines:
    """Lines with the place where each begins, from pieces of text; lines that were looked at may be taken back."""

    def __init__(self, pieces: Iterator[tuple[int, bytes]], fresh: bool, packed: bool = False) -> None:
        """``pieces``: (place, bytes). Unless ``fresh``, what comes before the first line's end is passed over. ``packed``: a line's place is its piece's."""
        self.ahead: list[tuple[int, str]] = []
        self.found = self._cut(pieces, fresh, packed)

    @staticmethod
    def _cut(pieces: Iterator[tuple[int, bytes]], fresh: bool, packed: bool) -> Iterator[tuple[int, str]]:
        began, parts = None, []
        for at, piece in pieces:
            a = 0
            while a < len(piece):
                if began is None:
                    began = at if packed else at + a
                end = piece.find(b"\n", a)
                parts.append(piece[a : end if end >= 0 else len(piece)])
                if end < 0:
                    break
                if fresh:
                    yield began, b"".join(parts).rstrip(b"\r").decode()
                fresh, began, parts, a = True, None, [], end + 1
        if began is not None and fresh:
            yield began, b"".join(parts).rstrip(b"\r").decode()

    def get(self, i: int) -> tuple[int, str] | None:
        """The line ``i`` ahead; None behind the last."""
        while len(self.ahead) <= i:
            line = next(self.found, None)
            if line is None:
                return None
            self.ahead.append(line)
        return self.ahead[i]

    def pass_over(self, many: int) -> None:
        del self.ahead[:many]


def _fastq_at(lines: Lines, i: int) -> tuple[int, tuple[str, str, str, str]] | None:
    """(lines, record) if the line ``i`` ahead begins a FASTQ record."""
    head = lines.get(i)
    if head is None or head[1][:1] != "@":
        return None
    bases, n = [], i + 1
    while (line := lines.get(n)) is not None and line[1][:1] != "+":
        if line[1][:1] in ("@", ">") or not line[1].strip() and lines.get(n + 1) is None:
            return None
        bases.append(line[1].strip())
        n += 1
    if line is None:
        return None
    seq, qual = "".join(bases), ""
    n += 1
    while len(qual) < len(seq) and (line := lines.get(n)) is not None:
        qual += line[1]
        n += 1
    if len(qual) != len(seq):
        return None
    if not seq and (line := lines.get(n)) is not None and not line[1]:
        n += 1  # the empty line of no qualities
    return n - i, (*_words(head[1]), seq, qual)


def _words(head: str) -> tuple[str, str]:
    words = head[1:].split(None, 1)
    return words[0] if words else "", words[1] if len(words) > 1 else ""


def _begins(lines: Lines, i: int) -> bool:
    """Whether records follow one another from the line ``i`` ahead."""
    for _ in range(IN_TURN):
        found = _fastq_at(lines, i)
        if not found:
            return False
        i += found[0]
        while (line := lines.get(i)) is not None and not line[1].strip():
            i += 1
        if line is None:
            return True
    return True


def ranged_records(lines: Lines, start: int, stop: int, fasta: bool, in_step: bool) -> Iterator[tuple[str, str, str, str | None]]:
    """The records that begin from the place ``start`` to before ``stop``; the lines begin further back. ``in_step``: whether the first line is a head."""
    while (line := lines.get(0)) is not None and line[0] < stop:
        if fasta:
            if line[1][:1] != ">" or line[0] < start:
                lines.pass_over(1)
                continue
            lines.pass_over(1)
            bases = []
            while (more := lines.get(0)) is not None and more[1][:1] != ">":
                bases.append(more[1].strip())
                lines.pass_over(1)
            yield *_words(line[1]), "".join(bases), None
        elif not line[1].strip():
            lines.pass_over(1)
        elif in_step or _begins(lines, 0):
            in_step = True
            found = _fastq_at(lines, 0)
            if not found:
                raise ValueError(f"no FASTQ record at byte {line[0]}")
            lines.pass_over(found[0])
            if line[0] >= start:
                yield found[1]
        else:
            lines.pass_over(1)


def _block_size(head: bytes) -> int:
    """The size of the gzip member that begins with ``head`` if it states it, else 0."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


def _blocks(raw, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the members of a block gzip file from the first one at ``start`` or behind; the place is the member's."""
    raw.seek(start)
    near = raw.read(1 << 17)
    at = start
    while start and at < size:  # a member's head is followed by another member or the end
        at = near.find(b"\x1f\x8b\x08\x04", at - start) + start
        if at < start:
            return
        own = _block_size(near[at - start : at - start + 64])
        raw.seek(at + own)
        if own and (at + own == size or _block_size(raw.read(64))):
            break
        at += 1
    while at < size:
        raw.seek(at)
        head = raw.read(1 << 16)
        own = _block_size(head[:64])
        if not own:
            raise ValueError(f"no block at byte {at}")
        yield at, zlib.decompress(head[:own], 31)
        at += own


class _Split(InputPartition):
    """Bytes from ``start`` to ``stop`` of a file (None: all of it)."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None) -> None:
        self.path, self.start, self.stop = path, start, stop


def _in_blocks(path: str) -> bool:
    if not path.endswith((".gz", ".bgz")):
        return False
    system, inner = store(path)
    with system.open_input_stream(inner, compression=None) as raw:
        return _block_size(raw.read(64)) > 0


def splits_of(path: str, split_bytes: int, start: int = 0, size: int | None = None) -> list[_Split]:
    """Ranges of a file from ``start`` to ``size``; all of it at once if it can't be cut or ``split_bytes`` is 0."""
    if not split_bytes or path.endswith((".gz", ".bgz")) and not _in_blocks(path):
        return [_Split(path)]
    if size is None:
        system, inner = store(path)
        size = system.get_file_info(inner).size
    return [_Split(path, a, min(a + split_bytes, size)) for a in range(start, size, split_bytes)]


def _plain(raw, at: int) -> Iterator[tuple[int, bytes]]:
    raw.seek(at)
    while block := raw.read(BLOCK):
        yield at, block
        at += len(block)


def split_records(split: _Split) -> Iterator[tuple[str, str, str, str | None]]:
    system, inner = store(split.path)
    if split.stop is None:
        with system.open_input_stream(inner, compression=None) as raw:
            text = gzip.open(raw, "rt") if split.path.endswith((".gz", ".bgz")) else (line for _, line in Lines(((0, b) for b in iter(lambda: raw.read(BLOCK), b"")), True).found)
            yield from records(text)
        return
    with system.open_input_file(inner) as raw:
        packed, begin = _in_blocks(split.path), max(0, split.start - BACK)
        if packed:
            size = raw.size()
            first = next((t for _, text in _blocks(raw, 0, size) if (t := text.lstrip())), b"")
            pieces = _blocks(raw, begin, size)
        else:
            first = raw.read(1024).lstrip()
            pieces = _plain(raw, begin)
        yield from ranged_records(Lines(pieces, not begin, packed), split.start, split.stop, first[:1] == b">", not begin)


def batches_of(split: _Split) -> Iterator[pa.RecordBatch]:
    found = split_records(split)
    while some := list(itertools.islice(found, BATCH)):
        columns = [*map(list, zip(*some)), [split.path] * len(some)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int) -> None:
        self.paths, self.split_bytes = paths, split_bytes

    def partitions(self) -> list[InputPartition]:
        """One for each file, or for each so many bytes of a file that can be cut (option ``splitBytes``)."""
        return [s for path in self.paths for s in splits_of(path, self.split_bytes)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets say for each file of a folder how many of its bytes have been read. Files may come and grow, by whole records."""

    def __init__(self, folder: str, split_bytes: int) -> None:
        self.folder, self.split_bytes = folder, split_bytes

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, inner = store(self.folder)
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return {"files": json.dumps({f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        done, root = json.loads(start["files"]), self.folder.partition("://")[0] + "://" if "://" in self.folder else ""
        out = []
        for path, size in json.loads(end["files"]).items():
            if size > done.get(path, 0):
                whole = path.endswith((".gz", ".bgz"))  # comes at once
                out += splits_of(root + path, self.split_bytes, 0, size) if whole else [_Split(root + path, s.start, s.stop) for s in splits_of(root + path, self.split_bytes or size, done.get(path, 0), size)]
        return out

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)


class SequenceSource(DataSource):
    """``spark.read.format("sequences").option("paths", "a.fq,b.fq.gz").load()``, and ``spark.readStream`` with the option ``path`` for a folder."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = json.loads(self.options["pathlist"]) if "pathlist" in self.options else [p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p]
        return _Reader(paths, int(self.options.get("splitBytes", "0")))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("splitBytes", "0")))


def read_sequences(spark: SparkSession, paths: list[str], split_bytes: int = 0) -> DataFrame:
    """FASTA or FASTQ files, plain or gzip, with the file of each record.

    ``split_bytes``: plain files and those in block gzip are read in ranges of so many bytes. Whole files tell the two formats apart record by record, ranges
    by the file's first character.
    """
    spark.dataSource.register(SequenceSource)
    return spark.read.format("sequences").option("pathList", json.dumps(paths)).option("splitBytes", str(split_bytes)).load()


def read_sequence_stream(spark: SparkSession, folder: str, split_bytes: int = 0) -> DataFrame:
    """The records of a folder's files as a stream; a query that starts again goes on behind the last bytes that it has committed."""
    spark.dataSource.register(SequenceSource)
    return spark.readStream.format("sequences").option("path", folder).option("splitBytes", str(split_bytes)).load()


def listed(spark: SparkSession, path: str) -> list[str]:
    """The paths that a text file names, one a line."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


def read_list(spark: SparkSession, path: str, split_bytes: int = 0) -> DataFrame:
    """``read_sequences`` of the files that a text file lists, one a line."""
    return read_sequences(spark, listed(spark, path), split_bytes)


def numbered_reads(spark: SparkSession, paths: list[str], split_bytes: int = 0) -> DataFrame:
    """read_id, name, seq, qual, file. The number follows from the range and the place in it, so it is the same whenever the files are read."""
    rows = read_sequences(spark, paths, split_bytes).withColumn("read_id", F.monotonically_increasing_id())
    return rows.select("read_id", "name", "seq", F.coalesce("qual", F.lit("*")).alias("qual"), "file")

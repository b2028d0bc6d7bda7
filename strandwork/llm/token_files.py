"""Token ids in flat binary files.

Layout of a folder, one set of files per non-empty partition of the id-ordered documents:
``ids-<k>.bin`` unsigned little-endian integers (16 bit if the vocabulary allows, else 32), ``ends-<k>.bin``
unsigned 64-bit offsets (documents + 1, from 0), ``docs-<k>.bin`` signed 64-bit document
ids. A file's place in the whole sequence is its base, the prefix sum over the files' token
counts. Each task writes under a name of its own and renames, so a repeated or speculative
task leaves the same files.

Defined results: null text has the end id alone; null ids come first and are read back as null;
rows of one id keep an order by text hash; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import release, small_batches
from .words import encoder_of

NO_ID = -(1 << 63)
MANIFEST = "shard int, documents long, tokens long, width int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class _Store:
    """Files below a folder: plain files for local and file: paths, else Arrow's file systems."""

    def __init__(self, folder: str) -> None:
        self.local = folder.startswith(("/", "file:"))
        if self.local:
            self.root = "/" + folder.removeprefix("file:").lstrip("/")
            os.makedirs(self.root, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def write(self, name: str):
        at = f"{self.root}/{name}"
        return open(at, "wb") if self.local else self.fs.open_output_stream(at)

    def rename(self, old: str, new: str) -> None:
        if self.local:
            os.replace(f"{self.root}/{old}", f"{self.root}/{new}")
        else:
            self.fs.move(f"{self.root}/{old}", f"{self.root}/{new}")

    def mapped(self, name: str, dtype) -> np.ndarray:
        """The file as an array, memory-mapped where the store allows it."""
        at = f"{self.root}/{name}"
        if self.local:
            return np.memmap(at, dtype=dtype, mode="r") if os.path.getsize(at) else np.empty(0, dtype)
        return _Remote(self.fs, at, np.dtype(dtype))


class _Remote:
    """A file of a remote store as an array of which slices are read when asked for."""

    def __init__(self, fs, at: str, dtype: np.dtype) -> None:
        self.fs, self.at, self.dtype = fs, at, dtype
        self.size = fs.get_file_info(at).size // dtype.itemsize

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> np.ndarray:
        a, z, _ = part.indices(self.size)
        with self.fs.open_input_file(self.at) as f:
            f.seek(a * self.dtype.itemsize)
            return np.frombuffer(f.read(max(0, z - a) * self.dtype.itemsize), self.dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int, spaced: bool, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode all texts in ascending id order below ``folder``; the manifest, one entry per file set with its base."""
    small_batches(docs.sparkSession)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, k = encoder_of(tokenizer, spaced), TaskContext.get().partitionId()
        width = 2 if max(encoder.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        files, own = {}, uuid.uuid4().hex
        store, total, count = _Store(folder), 0, 0
        for batch in batches:
            if not files and batch.num_rows:
                files = {x: store.write(f"{x}-{k}.{own}") for x in ("ids", "ends", "docs")}
                files["ends"].write(np.zeros(1, "<u8").tobytes())
            ends = []
            for got in encoder.encode_texts(batch.column(1)):
                ids = np.frombuffer(got + end, "<u4")
                files["ids"].write(ids.astype(f"<u{width}").tobytes())
                total += len(ids)
                ends.append(total)
            if ends:
                files["ends"].write(np.array(ends, "<u8").tobytes())
                files["docs"].write(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                count += len(ends)
        for x, f in files.items():
            f.close()
            store.rename(f"{x}-{k}.{own}", f"{x}-{k}.bin")
        release()
        if files:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "documents": pa.array([count], pa.int64()), "tokens": pa.array([total], pa.int64()), "width": pa.array([width], pa.int32())})

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    found = sorted(ordered.mapInArrow(shard, MANIFEST).collect(), key=lambda r: r["shard"])  # a row per partition
    bases = accumulate((r["tokens"] for r in found), initial=0)
    return [r.asDict() | {"base": base} for r, base in zip(found, bases)]


def read_token_files(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    if not manifest:
        return spark.createDataFrame([], ROWS)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Store(folder)
        for batch in batches:
            for m in batch.to_pylist():
                ids, ends, docs = (store.mapped(f"{x}-{m['shard']}.bin", t) for x, t in (("ids", f"<u{m['width']}"), ("ends", "<u8"), ("docs", "<i8")))
                for a in range(0, len(docs), 1024):
                    z = min(a + 1024, len(docs))
                    at = ends[a : z + 1].astype(np.int64)
                    own = ids[int(at[0]) : int(at[-1])]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs[a:z], pa.int64(), mask=np.asarray(docs[a:z]) == NO_ID),
                            "start": pa.array(at[:-1] + m["base"]),
                            "n_tokens": pa.array(np.diff(at)),
                            "ids_crc32": pa.array([zlib.crc32(own[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1] - at[0], at[1:] - at[0])], pa.int64()),
                        }
                    )

    shards = spark.createDataFrame([tuple(m[c] for c in ("shard", "documents", "tokens", "width", "base")) for m in manifest], MANIFEST + ", base long")
    return shards.repartition(len(manifest)).mapInArrow(documents, ROWS)

"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut every ``capacity`` tokens; whole cuts are sequences already. What remains
is cut every ``grain`` tokens, so that a window holds several pieces, and pieces gather until
they come to ``windows`` windows less ``slack`` tokens each; the last piece is cut to fit. Such a group is split by
differencing: partial partitions start with one piece each, and the two with the largest
imbalance merge again and again, the fullest window of one with the emptiest of the other.
The windows then are nearly equal and become the sequences as they are; where one exceeds the capacity, the number
of windows rises and the group is split anew. At a
task's end, what is left over from whole windows goes to sequences of powers of two, which
need no padding.

Groups form inside a task as documents stream past, so nothing is shuffled and a hot source
or a long document weighs on no single task; memory holds one group.

Defined results: null text is empty (one piece, the end id); null ids and repeated rows pass
through as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, small_batches
from .words import encoder_of

ROWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in so many windows of near-equal sums."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size  # ascending
        heap.append((-size, i, sums, [[] for _ in range(windows - 1)] + [[i]]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        sums = a + b[::-1]
        members = [x + y if x and y else x or y for x, y in zip(own, reversed(other))]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), serial, sums - sums[0], [members[j] for j in order]))
        serial += 1
    return heap[0][3] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The least number of near-equal windows, from the bound up, that differencing can fit."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        got = [w for w in differencing(sizes, count) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in got):
            return got
        count += 1


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 0, capacity: int = 1024, grain: int = 256, windows: int = 24, slack: int = 16, memo: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``memo``: bytes of pre-tokens that a worker remembers."""
    small_batches(docs.sparkSession)
    fill = capacity - slack
    full = windows * fill

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, serial = encoder_of(tokenizer, True, memo=memo), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        done: list[tuple] = []
        waiting: list[tuple] = []  # doc_id, start, ids, doc_tokens
        held = 0

        def place(window: list[tuple]) -> None:
            nonlocal serial
            at = 0
            for doc, start, ids, total in window:
                done.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, serial, at))
                at += len(ids) // 4
            serial += 1

        def take(tokens: int) -> list[tuple]:
            """The first so many tokens that wait; a piece is cut where they end."""
            nonlocal held, waiting
            out, left = [], tokens
            while left:
                doc, start, ids, total = waiting[len(out)]
                size = min(left, len(ids) // 4)
                out.append((doc, start, ids[: 4 * size], total))
                left -= size
            rest = waiting[len(out) :]
            if size < len(ids) // 4:
                rest.insert(0, (doc, start + size, ids[4 * size :], total))
            waiting, held = rest, held - tokens
            return out

        def split(group: list[tuple]) -> None:
            for window in windows_of([len(p[2]) // 4 for p in group], capacity):
                place([group[i] for i in window])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=list(NAMES))
            done.clear()
            return out

        for batch in batches:
            for doc_id, got in zip(batch.column(0), encoder.encode_texts(batch.column(1)), strict=True):
                doc, ids = doc_id.as_py(), got + end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for at in range(0, whole, capacity):
                    place([(doc, at, ids[4 * at : 4 * (at + capacity)], total)])
                for at in range(whole, total, grain):
                    waiting.append((doc, at, ids[4 * at : 4 * min(at + grain, total)], total))
                held += total - whole
                while held >= full:
                    split(take(full))
                if len(done) > 20_000:
                    yield flush()
        if whole := held // fill:
            split(take(whole * fill))
        while held:
            place(take(1 << held.bit_length() - 1))
        if done:
            yield flush()
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, ROWS)

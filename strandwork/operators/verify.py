"""Windows of candidates, bounded semi-global edit distance, and CIGAR text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import hamming
from .index import OVERLAP, TILE

#: Errors whose band of 4 errors + 1 diagonals fits the bits of a number.
MOST_ERRORS = 15


def windows(candidates: DataFrame, strands: DataFrame, tiled: DataFrame, lengths: DataFrame, errors: int, n_policy: str = "as-a", longest: int = OVERLAP) -> DataFrame:
    """Candidates with seq, lo and win: the bases from ``errors`` before the start to ``errors`` behind its end, inside the contig.

    ``lengths (contig_id, length)``. An N of the genome counts as A, or matches nothing with ``n_policy="mismatch"``; what
    isn't a base in a read counts as C. ``longest``: bases of a window at most; up to ``OVERLAP`` it lies in one tile and what follows it, beyond that it
    is put together from as many tiles as it covers.
    """
    rows = candidates.join(strands.select("read_id", "strand", F.regexp_replace("seq", "[^ACGT]", "C").alias("seq")), ["read_id", "strand"]).join(lengths.select("contig_id", "length"), "contig_id")
    rows = rows.withColumn("lo", F.greatest(F.col("start") - errors, F.lit(0).cast("long"))).withColumn("hi", F.least(F.col("start") + F.length("seq") + errors, F.col("length")))
    rows = rows.where(F.col("hi") - F.col("lo") >= F.length("seq") - errors).withColumn("tile", F.floor(F.col("lo") / TILE).cast("int"))
    own = ("read_id", "strand", "contig_id", "start", "seq", "lo")
    shown = lambda cut: (F.translate(cut, "N", "A") if n_policy == "as-a" else cut).alias("win")
    if longest <= OVERLAP:
        cut = F.substr(F.concat("body", "after"), (F.col("lo") % TILE + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
        return rows.join(tiled.select("contig_id", "tile", "body", "after"), ["contig_id", "tile"]).select(*own, shown(cut))
    each = rows.withColumn("first", F.col("tile")).withColumn("tile", F.explode(F.sequence("tile", F.greatest("tile", F.floor((F.col("hi") - 1) / TILE).cast("int")))))
    met = each.join(tiled.select("contig_id", "tile", "body"), ["contig_id", "tile"])
    whole = met.groupBy(*own, "hi").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "body"))), lambda x: x.body), "").alias("text"), F.min("first").alias("first"))
    return whole.select(*own, shown(F.substr("text", (F.col("lo") - F.col("first").cast("long") * TILE + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))))


def verified_sql(rows: DataFrame, errors: int) -> DataFrame:
    """The rule in plain columns, for tests: over all starts up to 2 errors and all ends, the least distance, then the least end."""
    size = F.length("seq")
    ends = lambda a: F.filter(F.sequence(F.lit(-errors), F.lit(errors)), lambda d: (a + size + d >= a) & (a + size + d <= F.length("win")))
    one = lambda a: F.transform(ends(a), lambda d: F.struct(F.levenshtein("seq", F.substr("win", a + 1, size + d)).alias("nm"), (a + size + d).alias("end")))
    best = F.array_min(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2 * errors)), one)))
    found = rows.withColumn("best", best).where(F.col("best.nm") <= errors)
    return found.select("read_id", "strand", "contig_id", "seq", "lo", "win", F.col("best.nm").alias("nm"), F.col("best.end").alias("to"))


_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


def _codes(texts: list[str], size: int, lead: int = 0) -> np.ndarray:
    """A row of base codes for each text, 4 for what is no base and beyond its end; ``lead`` columns before and ``size`` from the start of the text."""
    out = np.full((len(texts), lead + size), 4, np.uint8)
    flat = np.frombuffer("".join(t[:size] for t in texts).encode("ascii", "replace"), np.uint8)
    lengths = np.fromiter((min(len(t), size) for t in texts), np.int64, len(texts))
    where = np.arange(size)[None] < lengths[:, None]
    out[:, lead:][where] = _CODE[flat]
    return out


def distances(reads: list[str], wins: list[str], errors: int) -> tuple[np.ndarray, np.ndarray]:
    """(least distance, least end) of each pair; reads of one length. A pair is a lane of 64-bit numbers.

    Bit b of a lane stands for the diagonal on which the window is b - errors bases ahead of the read, for b up to 4 errors. Two numbers
    say where the distance rises and where it falls from one window position to the next; a step takes the next base of the
    read, and the band moves on by one position with it. The distance at the lowest diagonal is counted along, and the others follow from it at the end.
    Above the band the distance is taken to rise, which no path within ``errors`` can tell.
    """
    e, size, many = errors, len(reads[0]), len(reads)
    if e > MOST_ERRORS:
        return table_distances(reads, wins, errors)
    band, one = 4 * e + 1, np.uint64(1)
    mask, top, last = np.uint64((1 << band) - 1), np.uint64(1 << (band - 1)), np.uint64(band - 1)
    read = np.ascontiguousarray(_codes(reads, size).T)
    win = np.ascontiguousarray(_codes(wins, size + 3 * e + 1, lead=e).T)  # row j is the window's base j - e
    equal = np.zeros((4, many), np.uint64)  # by base: the diagonals whose next window base it is
    for b in range(band - 1):
        for base in range(4):
            equal[base] |= (win[b] == base).astype(np.uint64) << np.uint64(b)
    # Before the first base a start within 2 errors is free; before the window and behind these starts each base counts.
    falls = np.full(many, (1 << (e + 1)) - 2, np.uint64) >> one
    rises = np.full(many, ((1 << band) - 1) & ~((1 << (3 * e + 1)) - 1), np.uint64) >> one | top
    low, lanes = np.full(many, e, np.int64), np.arange(many)
    nothing = np.zeros(many, np.uint64)
    for i in range(size):
        fresh = win[i + band - 1]
        for base in range(4):
            equal[base] |= (fresh == base).astype(np.uint64) << last
        match = np.where(read[i] < 4, equal[np.minimum(read[i], 3), lanes], nothing)
        across = ((match & rises) + rises ^ rises) | match
        low += 1 - ((across | falls) & one).astype(np.int64)
        up = falls | ~(across | rises)
        down = rises & across
        up, down, either = up << one | one, down << one, match | falls
        rises, falls = (down | ~(either | up)) & mask, up & either & mask
        if i + 1 < size:
            rises, falls = rises >> one | top, falls >> one
            equal >>= one
    length = np.fromiter(map(len, wins), np.int64, many)
    best, to, score = np.full(many, 2 * e + 2, np.int64), np.full(many, size - e, np.int64), low
    for b in range(band):
        if b:
            bit = np.uint64(b)
            score = score + (rises >> bit & one).astype(np.int64) - (falls >> bit & one).astype(np.int64)
        end = size + b - e
        better = (score < best) & (end <= length) & (end >= 0)
        best, to = np.where(better, score, best), np.where(better, end, to)
    return best, to


def table_distances(reads: list[str], wins: list[str], errors: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``distances``, by a table of all distances in the band (end - read position from -errors to 3 errors), for any number of errors."""
    e, size, many = errors, len(reads[0]), len(reads)
    far = np.int16(2 * e + 2)
    read, win = _codes(reads, size), _codes(wins, size + 4 * e + 2)
    length = np.array([len(w) for w in wins])
    offsets = np.arange(-e, 3 * e + 1)
    row = np.where((offsets >= 0) & (offsets <= length[:, None]), np.maximum(offsets - 2 * e, 0), far).astype(np.int16)
    for i in range(1, size + 1):
        ends = i + offsets
        fine = (ends >= 0)[None] & (ends[None] <= length[:, None])
        bases = win[:, np.clip(ends - 1, 0, win.shape[1] - 1)]
        now = row + ((bases != read[:, i - 1 : i]) | (bases == 4) | (ends < 1)[None])
        now[:, :-1] = np.minimum(now[:, :-1], row[:, 1:] + 1)  # a base of the read that the window lacks
        now = np.where(fine, now, far)
        for b in range(1, len(offsets)):
            now[:, b] = np.where(fine[:, b], np.minimum(now[:, b], now[:, b - 1] + 1), far)
        row = np.minimum(now, far).astype(np.int16)
    best = row.argmin(axis=1)
    return row[np.arange(many), best].astype(np.int64), size + offsets[best]


_FOUND = pa.schema([("read_id", pa.int64()), ("strand", pa.int32()), ("contig_id", pa.int64()), ("seq", pa.string()), ("lo", pa.int64()), ("win", pa.string()), ("nm", pa.int32()), ("to", pa.int32())])


def verified(rows: DataFrame, errors: int) -> DataFrame:
    """read_id, strand, contig_id, seq, lo, win, nm, to (end in the window): pairs within ``errors``; ``rows`` is read twice.

    A read that stands in its window as it is has distance 0 at its first place there and is settled by the search for a text. Only the
    others go to Python, in Arrow batches, as lanes of pairs of one read length.
    """
    own = ("read_id", "strand", "contig_id", "seq", "lo", "win")
    rows = rows.select("read_id", F.col("strand").cast("int"), *own[2:]).where(F.length("seq") > 0)
    found = rows.withColumn("at", F.expr("instr(win, seq)"))
    exact = found.where("at > 0").select(*own, F.lit(0).alias("nm"), (F.col("at") - 1 + F.length("seq")).alias("to"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch.column(3)).to_numpy()
            for size in np.unique(lengths):
                pairs = batch.take(pa.array(np.flatnonzero(lengths == size)))
                nm, to = distances(pairs.column(3).to_pylist(), pairs.column(5).to_pylist(), errors)
                near = pa.array(np.flatnonzero(nm <= errors))
                columns = [*pairs.take(near).columns, pa.array(nm.astype(np.int32)).take(near), pa.array(to.astype(np.int32)).take(near)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return exact.unionByName(found.where("at = 0").select(*own).mapInArrow(each, "read_id long, strand int, contig_id long, seq string, lo long, win string, nm int, to int"))


def hits(found: DataFrame) -> DataFrame:
    """``verified`` rows with end (in the contig), one for each (read_id, strand, contig_id, end, nm): that of the first window."""
    keys = ("read_id", "strand", "contig_id", "end", "nm")
    rows = found.withColumn("end", F.col("lo") + F.col("to"))
    return rows.groupBy(*keys).agg(F.min(F.struct("lo", "to", "win", "seq")).alias("x")).select(*keys, "x.lo", "x.to", "x.win", "x.seq")


def mismatches(found: DataFrame) -> DataFrame:
    """``found`` with ham: mismatches of the read against as many bases up to the end; null where the window starts later."""
    size = F.length("seq")
    return found.withColumn("ham", F.when(F.col("to") >= size, hamming(F.col("seq"), F.substr("win", F.col("to") - size + 1, size))))


def traced(reads: list[str], wins: list[str], to: np.ndarray, errors: int) -> tuple[list[str], np.ndarray]:
    """(CIGARs, starts in the windows) of alignments of reads of one length that end at ``to``: from the end match or mismatch, then insertion, then deletion.

    All distances of the band (end - read position from -errors to 3 errors) are kept, and all pairs step back together.
    """
    e, size, many = errors, len(reads[0]), len(reads)
    far, width = np.int16(4 * e + 4), 4 * e + 1
    read = np.frombuffer("".join(reads).encode(), np.uint8).reshape(many, size)
    span = size + 4 * e + 2
    win = np.frombuffer("".join(w[:span].ljust(span, "-") for w in wins).encode(), np.uint8).reshape(many, span)
    offsets = np.arange(-e, 3 * e + 1)
    table = np.full((size + 1, many, width + 2), far, np.int16)  # a border on both sides
    table[0, :, 1:-1] = np.where((offsets >= 0) & (offsets[None] <= to[:, None]), np.maximum(offsets - 2 * e, 0), far)
    unequal = np.ones((size + 1, many, width), bool)
    for i in range(1, size + 1):
        ends = i + offsets
        fine = (ends >= 0)[None] & (ends[None] <= to[:, None])
        unequal[i] = (win[:, np.clip(ends - 1, 0, span - 1)] != read[:, i - 1 : i]) | (ends < 1)[None]
        now = np.minimum(table[i - 1, :, 1:-1] + unequal[i], table[i - 1, :, 2:] + 1)
        now = np.where(fine, now, far)
        for b in range(1, width):
            now[:, b] = np.where(fine[:, b], np.minimum(now[:, b], now[:, b - 1] + 1), far)
        table[i, :, 1:-1] = np.minimum(now, far)
    row, i, at = np.arange(many), np.full(many, size), to - size + e  # the place in the band
    ops = np.zeros((many, size + 4 * e + 1), np.uint8)
    for step in range(ops.shape[1]):
        live = (i > 0) | (i + at - e > 2 * e)  # a start behind 2 errors has deletions before it
        if not live.any():
            break
        here, above = table[i, row, at + 1], np.maximum(i - 1, 0)
        diagonal = (i > 0) & (i + at - e > 0) & (table[above, row, at + 1] + unequal[i, row, at] == here)
        insertion = (i > 0) & ~diagonal & (table[above, row, np.minimum(at + 2, width + 1)] + 1 == here)
        ops[:, step] = np.where(live, np.where(diagonal, ord("M"), np.where(insertion, ord("I"), ord("D"))), 0)
        i = np.where(live & (diagonal | insertion), i - 1, i)
        at = np.where(live & insertion, at + 1, np.where(live & ~diagonal & ~insertion, at - 1, at))
    texts = (bytes(x[x > 0][::-1]).decode() for x in ops)
    return ["".join(f"{len(run.group())}{run.group()[0]}" for run in re.finditer(r"M+|I+|D+", t)) for t in texts], at - e


def aligned(found: DataFrame, errors: int) -> DataFrame:
    """Hits with cigar and pos. Hits without a gap stay in the JVM; only the others are traced back in Python."""
    rows = mismatches(found)
    level = F.coalesce((F.col("ham") == F.col("nm")) & (F.col("to") - F.length("seq") <= 2 * errors), F.lit(False))
    plain = rows.where(level).select("read_id", "strand", "contig_id", "end", "nm", F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), (F.col("end") - F.length("seq")).alias("pos"))

    def trace(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for _, own in pdf.groupby(pdf["seq"].str.len()):
                cigars, starts = traced(own["seq"].tolist(), own["win"].tolist(), own["to"].to_numpy(np.int64), errors)
                yield own.assign(cigar=cigars, pos=own["lo"].to_numpy() + starts)[["read_id", "strand", "contig_id", "end", "nm", "cigar", "pos"]]

    gapped = rows.where(~level).mapInPandas(trace, "read_id long, strand int, contig_id long, end long, nm int, cigar string, pos long")
    return plain.unionByName(gapped)

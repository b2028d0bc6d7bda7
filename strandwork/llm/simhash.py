"""SimHash near-dedup by anchor-point covering.

Fingerprints have 64 bits. If two differ in at most three bits, then one of their 32-bit halves
differs in at most one. On 31 bits of a half the Hamming code is a covering code of radius one:
each word lies within one bit of exactly one code word. These code words are the anchors. A
fingerprint is at home at the anchor of each half, and goes to every anchor within the radius plus
the threshold of the half, 1 + 1 bits: at most 16 per half, whatever the data. So any two that
link meet where one of them is at home, and are compared there over all 64 bits.

Dense groups of near copies crowd at an anchor. Where more than ``DENSE`` are at home, its rows are covered anew on the bits
that the anchor leaves open: of the other half's two 16-bit quarters, again, one differs in at most one bit, so the Hamming
code on 15 bits gives the anchors, and if need be that on 7 bits of the remaining quarter's bytes. What even so is crowded is
dealt in blocks of its homes, and all its other rows go to each block. All of this is exact, and rows are compared in the same way throughout.

Equal fingerprints are one row throughout. An anchor is compared as its rows stream past in sorted
order, homes first, and only a spanning forest of the links leaves the task.

Defined results: null and empty texts and those of white space have fingerprint zero, and link
like any other; null ids are kept, and a component of null ids alone has a null component_id;
repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard, release, settle, shuffle_partitions, small_batches

BITS = 3
#: Homes at an anchor beyond which its rows are covered anew on the bits that it leaves open.
DENSE = 4096
#: Bits of the Hamming code of each level: on a half, a quarter of the other half, a byte of the other quarter.
CODES = (31, 15, 7)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: bit by bit the majority of its shingles' XXH64."""
    tokens = (text or "").encode().translate(_LOWER).split()  # bytes.split takes just x20 and x09 to x0D
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, fp long")


def _served(bits: int) -> None:
    if not 0 <= bits <= BITS:
        raise ValueError(f"the anchors cover distances of 0 to {BITS} bits, not {bits}")


def anchors(word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of word, code word, home) for all words of the Hamming code on ``bits`` bits that are within two bits."""
    s = np.zeros(len(word), np.uint64)  # the syndrome; bit i - 1 has the check i
    for i in range(1, bits + 1):
        s ^= (word >> np.uint64(i - 1) & _ONE) * np.uint64(i)
    flip = np.where(s > 0, _ONE << (np.maximum(s, _ONE) - _ONE), np.uint64(0))
    rows, found, home = [np.arange(len(word))], [word ^ flip], [np.ones(len(word), bool)]
    off = np.flatnonzero(s > 0)  # a code word has no other within two bits
    for i in range(1, bits + 1):
        j = s[off] ^ np.uint64(i)  # the bits with checks i and j make up the syndrome
        ok = j > np.uint64(i)
        at = off[ok]
        rows.append(at)
        found.append(word[at] ^ (_ONE << np.uint64(i - 1)) ^ (_ONE << (j[ok] - _ONE)))
        home.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def covered(level: int, anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fp, home) one level further: an anchor of the level before gets a side and a code word of its own as lower bits."""
    bits, out = CODES[level], []
    for side in (0, 1):
        if level == 0:
            shift = np.full(len(fp), 32 * side, np.uint64)
        else:
            half = anchor >> np.uint64(31 + 16 * (level - 1))  # the one that the first level is on
            shift = np.uint64(32) * (_ONE - half) + np.uint64((16, 8)[level - 1] * side)
            if level == 2:
                shift += np.uint64(16) * (_ONE - (anchor >> np.uint64(15) & _ONE))
        word = fp >> shift & np.uint64((1 << bits) - 1)
        row, code, own = anchors(word, bits)
        if homes_only:
            row, code, own = row[own], code[own], own[own]
        out.append((anchor[row] << np.uint64(bits + 1) | np.uint64(side << bits) | code, fp[row], home[row] & own))
    return tuple(map(np.concatenate, zip(*out)))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars around the least member of each part."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        np.minimum.at(least, v, label[u])
        least = least[least]
        if (least == label).all():
            break
        label = least
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _compare(homes: np.ndarray, others: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(others)))
    for i in range(0, len(homes), step):
        part = homes[i : i + step]
        x, y = np.nonzero(np.bitwise_count(part[:, None] ^ others[None, :]) <= bits)
        a, b = part[x], others[y]
        a, b = a[a != b], b[a != b]
        if len(a) > 2 * (len(part) + len(others)):
            a, b = _forest(a.view(np.int64), b.view(np.int64))
            a, b = a.view(np.uint64), b.view(np.uint64)
        left.append(a)
        right.append(b)
    return np.concatenate(left) if left else homes[:0], np.concatenate(right) if right else homes[:0]


def _links(bits: int):
    """Links from rows in order of (anchor, block, homes first): holds a block's homes and one batch."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, homes = None, np.empty(0, np.uint64)
        for pdf in batches:
            anchor, block, fp, home = pdf["anchor"].to_numpy(), pdf["block"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
            if not len(fp):
                continue
            cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(block) != 0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            some = np.concatenate([[0], np.cumsum(home)])
            left, right = [], []
            # only groups of two with a home matter, but for those that a batch's bounds cut
            worth = (ends - starts > 1) & (some[ends] > some[starts])
            worth[[0, -1]] = True
            for s, e in zip(starts[worth], ends[worth], strict=True):
                if (anchor[s], block[s]) != now:
                    now, homes = (anchor[s], block[s]), np.empty(0, np.uint64)
                own, rest = fp[s:e][home[s:e]], fp[s:e][~home[s:e]]
                if len(own):
                    for x, y in ((own, own), (homes, own)):
                        a, b = _compare(x, y, bits)
                        left.append(a)
                        right.append(b)
                    homes = np.concatenate([homes, own])
                if len(homes) and len(rest):
                    a, b = _compare(homes, rest, bits)
                    left.append(a)
                    right.append(b)
            if left and len(a := np.concatenate(left)):
                b = np.concatenate(right)
                if len(a) > len(fp):
                    a, b = _forest(a.view(np.int64), b.view(np.int64))
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        release()

    return each


def _cover(rows: DataFrame, level: int, homes_only: bool = False) -> DataFrame:
    """``rows (anchor, fp, home)`` at the anchors of a level."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                anchor, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.slice(i, 8192).columns)
                anchor, fp, home = covered(level, anchor.view(np.uint64), fp.view(np.uint64), home, homes_only)
                yield pa.RecordBatch.from_pydict({"anchor": anchor.view(np.int64), "fp": fp.view(np.int64), "home": home})

    return rows.select("anchor", "fp", "home").mapInArrow(each, "anchor long, fp long, home boolean")


def _compared(rows: DataFrame, bits: int) -> DataFrame:
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))
    return dealt.mapInPandas(_links(bits), "a long, b long")


def fingerprint_links(fps: DataFrame, bits: int = BITS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``fps (fp)`` that connect just what links at ``bits`` (3 at most) or fewer do."""
    _served(bits)
    rows = fps.select(F.lit(0).cast("long").alias("anchor"), "fp", F.lit(True).alias("home")).distinct()
    links = []
    for level in range(len(CODES)):
        at = _cover(rows, level)
        counts = _cover(rows.where("home"), level, homes_only=True).groupBy("anchor").agg(F.count("*").alias("homes"))
        crowded = settle(counts.where(F.col("homes") > dense), "crowded")
        if crowded.isEmpty():
            links.append(_compared(at.withColumn("block", F.lit(0)), bits))
            break
        links.append(_compared(at.join(crowded, "anchor", "left_anti").withColumn("block", F.lit(0)), bits))
        rows = settle(at.join(crowded.select("anchor"), "anchor", "left_semi"), "crowded-rows")
    else:
        blocks = F.ceil(F.col("homes") / max(1, dense)).cast("int")
        spread = rows.join(crowded, "anchor").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        own = F.pmod(F.xxhash64("fp"), blocks) == F.col("block")
        links.append(_compared(spread.select("anchor", "fp", (F.col("home") & own).alias("home"), "block"), bits))
    return functools.reduce(DataFrame.union, links)


def near_groups(docs: DataFrame, *, words: int = 3, bits: int = BITS, dense: int = DENSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id of the component)."""
    _served(bits)
    fps = settle(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = connected_components(fingerprint_links(classes, bits, dense))
    joined = classes.join(labels, classes.fp == labels.node)
    least = joined.groupBy("label").agg(F.min("least").alias("of_label"))
    linked = joined.join(least, "label").select("fp", "of_label")
    # Written, so that the join deals both sides anew and adaptive execution may split a fingerprint of very many rows.
    ids = settle(classes.join(linked, "fp", "left").select("fp", F.coalesce("of_label", "least").alias("component_id")), "component-ids")
    discard(classes)
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, *, words: int = 3, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; rows without an id stay.

    Of rows that share the smallest id, one stays for each different text.
    """
    groups = near_groups(docs, words=words, bits=bits, id_col=id_col, text_col=text_col)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct().alias("kept_ids")
    stay = docs.alias("all").join(kept, F.col(f"all.`{id_col}`").cast("long") == F.col("kept_ids.kept"), "left_semi").dropDuplicates([id_col, text_col])
    return stay.union(docs.where(F.col(id_col).isNull()))

"""Source divergence audit with mergeable radix tries.

Each task counts the terms of its documents in a byte trie per language, whose leaves hold how many documents have the
term and how often each source has it; the leaf of the empty key holds the documents of each source. Tries leave their
task as leaves in byte order. Sampled splitters deal them by ranges of (language, bytes), an external sort lines equal
prefixes up, and each range merges in a trie of its own that is emptied at a bound, as all smaller keys are complete
by then. What is kept leaves in slices of at most ``SLICE`` neighbouring terms, and each slice meets the totals of its
language's sources: it gives a subtotal of every pair of sources and the first candidates of every source.

A hot language or source weighs on no task, as a task sends each term of a language once and languages are cut by
ranges of terms. Memory: a trie of ``TRIE_BYTES``, or ``SLICE`` terms by the sources of one language.

Defined results: null text, language and source count as empty; repeated rows count each; ids play no part; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import release, settle, shuffle_partitions, small_batches
from .terms import LETTERS, bytes_of, words_of

#: Documents of a language that a kept term is in at least, and the ranks of terms that are shown.
LEAST_DOCS, MOST_TERMS = 30, 50
#: Bytes that a task's tries take by estimate before they are emptied, and terms of a slice.
TRIE_BYTES, SLICE = 192 << 20, 2048
SCALE, SMOOTH = 1_000_000_000, 5

LEAVES = "lang string, term binary, docs long, sources array<string>, counts array<long>"
_LEAVES = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_KEPT = pa.schema([*_LEAVES, ("slice", pa.int64())])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
#: Bits of a source's number beside a leaf's in one key.
_SOURCE_BITS = 20


class Node:
    """An edge's bytes, the nodes below by their first byte, and the number of the key that ends here, or -1."""

    __slots__ = ("edge", "kids", "number")

    def __init__(self, edge: bytes, number: int = -1) -> None:
        self.edge, self.kids, self.number = edge, {}, number


class RadixTrie(dict):
    """A byte trie that numbers its keys as they come; as a dictionary it remembers the numbers of keys that were asked for.

    What is counted at the leaves is kept by their numbers in ``LeafCounts``.
    """

    def __init__(self) -> None:
        super().__init__()
        self.root, self.many, self.bytes = Node(b""), 0, 0

    def __missing__(self, key: bytes) -> int:
        number = self[key] = self.leaf(key)
        return number

    def leaf(self, key: bytes) -> int:
        """The number of ``key``, which is added if it is new."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = node = Node(key[at:])
                break
            edge = kid.edge
            if key.startswith(edge, at):
                node, at = kid, at + len(edge)
            else:
                same = 1
                while same < len(edge) and at + same < len(key) and edge[same] == key[at + same]:
                    same += 1
                fork = node.kids[key[at]] = Node(edge[:same])
                fork.kids[edge[same]] = kid
                kid.edge = edge[same:]
                node, at = fork, at + same
        if node.number < 0:
            node.number = self.many
            self.many += 1
            self.bytes += 2 * len(key) + 400
        return node.number

    def leaves(self) -> Iterator[tuple[bytes, int]]:
        """(key, number) in byte order."""
        stack = [(self.root, b"")]
        while stack:
            node, key = stack.pop()
            if node.number >= 0:
                yield key, node.number
            if len(node.kids) == 1:
                (kid,) = node.kids.values()
                stack.append((kid, key + kid.edge))
            else:
                for first in sorted(node.kids, reverse=True):
                    kid = node.kids[first]
                    stack.append((kid, key + kid.edge))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values[order], starts) if len(keys) else values


class LeafCounts:
    """A trie with the documents of each leaf and its occurrences by source."""

    def __init__(self) -> None:
        self.trie, self.docs = RadixTrie(), np.zeros(1024, np.int64)
        self.sources: dict[str, int] = {}
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def source(self, name: str) -> int:
        return self.sources.setdefault(name, len(self.sources))

    def add(self, leaves: np.ndarray, docs: np.ndarray, keyed: np.ndarray, counts: np.ndarray) -> None:
        """Documents by leaf, and occurrences by leaf and source (``keyed``: the leaf's number above the source's)."""
        if len(leaves):
            if leaves.max() >= len(self.docs):
                self.docs = np.r_[self.docs, np.zeros(max(len(self.docs), int(leaves.max())), np.int64)]
            np.add.at(self.docs, leaves, docs)
        self.fresh.append((keyed, counts))
        self.waiting += len(keyed)
        if self.waiting > max(1 << 18, len(self.keys)):
            self.gather()

    def gather(self) -> None:
        self.keys, self.counts = _summed(*(np.concatenate(x) for x in zip((self.keys, self.counts), *self.fresh)))
        self.fresh, self.waiting = [], 0

    def bytes(self) -> int:
        return self.trie.bytes + 16 * (len(self.keys) + self.waiting)

    def emptied(self, lang: str, rows: int = 4096) -> Iterator[pa.RecordBatch]:
        """The leaves in byte order, as ``LEAVES`` rows."""
        self.gather()
        names = pa.array(list(self.sources), pa.string())
        ends = np.searchsorted(self.keys, np.arange(self.trie.many + 1) << _SOURCE_BITS)
        walk = self.trie.leaves()
        while some := list(itertools.islice(walk, rows)):
            number = np.array([n for _, n in some])
            sizes = ends[number + 1] - ends[number]
            offsets = np.r_[0, np.cumsum(sizes)]
            at = np.repeat(ends[number] - offsets[:-1], sizes) + np.arange(offsets[-1])
            starts = pa.array(offsets, pa.int32())
            sources = names.take(pa.array(self.keys[at] & ((1 << _SOURCE_BITS) - 1)))
            columns = [pa.array([lang] * len(some), pa.string()), pa.array([k for k, _ in some], pa.binary()), pa.array(self.docs[number]), pa.ListArray.from_arrays(starts, sources), pa.ListArray.from_arrays(starts, pa.array(self.counts[at]))]
            yield pa.RecordBatch.from_arrays(columns, schema=_LEAVES)


def counted(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The leaves of each task's tries: lang, term, docs, sources, counts. The empty term holds documents, not occurrences."""
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, LeafCounts] = defaultdict(LeafCounts)

        def emptied() -> Iterator[pa.RecordBatch]:
            while held:
                lang, own = held.popitem()
                yield from own.emptied(lang)

        for batch in batches:
            rows: dict[str, list] = defaultdict(lambda: [[], [], []])
            for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))):
                own, (leaves, sizes, sources) = held[lang], rows[lang]
                trie, before = own.trie, len(leaves)
                leaves.append(trie[b""])
                for words in words_of(body, LETTERS):
                    leaves += [trie[w] for w in words]
                sizes.append(len(leaves) - before)
                sources.append(own.source(source))
            for lang, (leaves, sizes, sources) in rows.items():
                leaf = np.array(leaves, np.int64)
                of_docs = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64) << 32, sizes) | leaf) & 0xFFFFFFFF
                keyed, counts = _summed(leaf << _SOURCE_BITS | np.repeat(np.array(sources, np.int64), sizes), np.ones(len(leaf), np.int64))
                held[lang].add(of_docs, np.ones(len(of_docs), np.int64), keyed, counts)
            if sum(own.bytes() for own in held.values()) > TRIE_BYTES or any(len(own.sources) > 1 << _SOURCE_BITS - 1 for own in held.values()):
                yield from emptied()
        yield from emptied()
        release()

    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).cast("binary").alias("text")).mapInArrow(count, LEAVES)


def _runs(rows: pa.Table) -> np.ndarray:
    """Where a new (lang, term) begins in sorted rows."""
    if rows.num_rows < 2:
        return np.zeros(rows.num_rows, np.int64)
    same = [pc.equal(rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)).to_numpy() for c in ("lang", "term")]
    return np.flatnonzero(np.r_[True, ~(same[0] & same[1])])


def merged(leaves: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``leaves (lang, term, docs, sources, counts)`` of any tries as those of one, without terms of fewer documents; with slice, a number of neighbouring terms.

    Leaves come in byte order, so a term is whole when the next begins; what is too rare never enters the merged trie.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))
        own, now, rest = LeafCounts(), None, _LEAVES.empty_table()

        def emptied() -> Iterator[pa.RecordBatch]:
            for part in own.emptied(now, SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, next(numbers)))], schema=_KEPT)

        def enter(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal own, now
            starts = _runs(rows)
            docs = np.add.reduceat(rows["docs"].to_numpy(), starts)
            root = pc.equal(pc.binary_length(rows["term"]), 0).to_numpy()[starts]
            keep = np.flatnonzero((docs >= least) | root)
            sizes = np.diff(np.r_[starts, rows.num_rows])[keep]
            run = np.repeat(np.arange(len(keep)), sizes)
            rows = rows.take(pa.array(np.repeat(starts[keep] - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(len(run)))).combine_chunks()
            langs, terms = (rows[c].take(pa.array(np.cumsum(np.r_[0, sizes[:-1]]))).to_pylist() if len(keep) else [] for c in ("lang", "term"))
            ends = np.r_[0, np.cumsum(sizes)]
            for first, group in itertools.groupby(range(len(keep)), key=lambda i: langs[i]):
                some = list(group)
                if first != now or own.bytes() > TRIE_BYTES:
                    yield from emptied()
                    own, now = LeafCounts(), first
                part = rows.slice(ends[some[0]], ends[some[-1] + 1] - ends[some[0]]).combine_chunks()
                number = np.array([own.trie[terms[i]] for i in some])
                lists, counts = (part[c].chunk(0) if part[c].num_chunks else pa.array([], part[c].type) for c in ("sources", "counts"))
                coded = lists.flatten().dictionary_encode()
                source = np.array([own.source(n) for n in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
                leaf = np.repeat(number[run[ends[some[0]] : ends[some[-1] + 1]] - some[0]], np.diff(lists.offsets.to_numpy()))
                own.add(number, docs[keep[some]], *_summed(leaf << _SOURCE_BITS | source, counts.flatten().to_numpy()))

        for batch in batches:
            rows = pa.concat_tables([rest, pa.Table.from_batches([batch]).cast(_LEAVES)])
            if not rows.num_rows:
                continue
            last = int(_runs(rows)[-1])
            if last:
                yield from enter(rows.slice(0, last))
            rest = rows.slice(last)
        if rest.num_rows:
            yield from enter(rest)
        yield from emptied()
        release()

    ranged = leaves.repartitionByRange(shuffle_partitions(leaves.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return ranged.mapInArrow(merge, LEAVES + ", slice long")


def parts_of(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH terms)), exact for totals below 9e15: three digits of the quotient at a time."""
    rest, by = count + SMOOTH, total + SMOOTH * terms
    out = np.zeros(np.broadcast_shapes(rest.shape, np.shape(by)), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + digit
    return 1 + out


def compared(groups: pa.Table, kept: pa.Table, ranks: int = MOST_TERMS) -> pa.Table:
    """Subtotals of the pairs and candidates of one slice. ``groups (lang, slice, source, n, total, terms)`` has a row for each source of the language."""
    names = groups["source"].to_pylist()
    if not kept.num_rows or not names:
        return _FOUND.empty_table()
    lang, terms, total = groups["lang"][0].as_py(), groups["terms"][0].as_py(), groups["total"][0].as_py()
    keys = kept["term"].to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys = [keys[i] for i in order]
    kept = kept.take(pa.array(order, pa.int64()))
    place = {name: i for i, name in enumerate(names)}
    sources, counts = kept["sources"].combine_chunks(), kept["counts"].combine_chunks()
    rows = np.repeat(np.arange(len(keys)), np.diff(sources.offsets.to_numpy()))
    here = np.zeros((len(keys), len(names)), np.int64)
    here[rows, [place[s] for s in sources.flatten().to_pylist()]] = counts.flatten().to_numpy()
    own = parts_of(here, groups["n"].to_numpy(), terms)
    whole = parts_of(here.sum(axis=1), np.int64(total), terms)
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def put(source: str, part: str, items: list[bytes], values: np.ndarray) -> None:
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"].append(values)

    for i, name in enumerate(names):
        others = np.delete(np.arange(len(names)), i)
        put(name, "pair", [names[j].encode() for j in others], np.abs(own - own[:, i : i + 1]).sum(axis=0)[others])
        more = own[:, i] - whole
        found = np.flatnonzero((here[:, i] > 0) & (more > 0))
        found = found[np.argsort(-more[found], kind="stable")][:ranks]  # the terms are in byte order
        put(name, "term", [keys[j] for j in found], more[found])
    columns = [pa.array([lang] * len(out["item"]), pa.string()), pa.array(out["source"], pa.string()), pa.array(out["part"], pa.string()), pa.array(out["item"], pa.binary()), pa.array(np.concatenate(out["value"]), pa.int64())]
    return pa.Table.from_arrays(columns, schema=_FOUND)


def source_audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = MOST_TERMS, **columns: str) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank."""
    leaves = settle(counted(docs, **columns), "trie-leaves")
    every = settle(merged(leaves, least), "merged-leaves")
    kept = every.where(F.length("term") > 0)
    groups = every.where(F.length("term") == 0).select("lang", F.explode("sources").alias("source"))
    occurring = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sums = groups.join(occurring, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("total"))
    slices = kept.select("lang", "slice").distinct().join(langs, "lang").join(sums, "lang").select("lang", "slice", "source", "n", "total", "terms")

    def compare(groups: pa.Table, kept: pa.Table) -> pa.Table:
        return compared(groups, kept, ranks)

    found = settle(slices.groupBy("lang", "slice").cogroup(kept.select(F.col("lang").alias("its_lang"), F.col("slice").alias("its_slice"), "term", "sources", "counts").groupBy("its_lang", "its_slice")).applyInArrow(compare, "lang string, source string, part string, item binary, value long"), "slices")
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    subtotals = found.where("part = 'pair'").groupBy("lang", "source", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value"))
    valued = pairs.join(subtotals, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked = lambda rows: rows.withColumn("rank", rank)
    return ranked(valued).unionByName(ranked(terms).where(F.col("rank") <= ranks))

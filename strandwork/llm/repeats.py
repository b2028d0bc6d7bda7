"""Substring dedup by hashing of lines and of passages between them.

Units are normalised (words between white space, ASCII letters in lower case; in scripts without spaces each character is a word),
known by three polynomials of their words' hashes modulo a prime, 93 bits in all, and grouped globally; the occurrence of lowest rank (id, then place) stays. Two kinds of units are hashed:

* each line that has a word; every later occurrence is removed, however short the line (``min_line`` asks for more words);
* for passages that stand within longer lines or go over line breaks, ``GRAM`` words in a row at chosen places: the place of the
  least hash in each ``WINDOW`` of such places. What is chosen depends on nothing but the words of the window, so a passage of
  ``GRAM + WINDOW - 1`` = 23 words has a chosen place in common with its copy for certain, and at most ``WINDOW`` - 1 = 15 words at each of its ends lie
  outside of the chosen ones. A unit also has a digest of the words since the chosen place before it; where that equals the kept occurrence's, these
  are repeated too, so what lies between two common places is told by a digest of 31 bits of its own and isn't taken for granted.

No texts are compared, so equal means equal digests. Moduli of a power of two would let sequences of a few words with regular patterns meet whatever the base; a
prime modulus doesn't.

Repeated passages that touch or overlap form a run; runs of ``min_run`` words or more are removed. A passage of over 50 words
shows at least 51 - 2 x 15 = 21 of its words, hence the default. Offsets are those of the original text, in code points.

Only digests that occur more than once go on to the join, and both the grouping (partial sums) and
the join (skewed partitions are split by adaptive execution) bear a unit that very many documents
share. A document is known by its place in the written table of units, so repeated ids don't mix.

Defined results: null and empty texts have no units and lose nothing; null ids rank last; repeated rows are
copies like any others; what overlaps its kept occurrence stays; an empty table gives an empty result; other columns are ignored, or with
``drop_repeats`` kept, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import discard, release, settle, small_batches

GRAM, WINDOW = 8, 16
#: Words of a run of passages that is removed.
MIN_RUN = 51 - 2 * (WINDOW - 1)
#: Words whose hashes a cutter remembers at most.
REMEMBER = 200_000
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01\uff0c\uff1f\U00020000-\U0003ffff"
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+")
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The modulus, and the bases of the polynomials: three for a unit and one for what lies before it.
_PRIME = (1 << 31) - 1
_BASES = (1_182_637_051, 1_743_219_667, 905_114_243, 1_516_330_009)
_LINE = 1 << 62  # tells lines from passages
#: A unit in few bytes: two numbers of 32 bits in each of place (word, from_word), chars (start, from_start), size (end, words and line) and tail (low digest, gap).
UNITS = "row long, doc_id long, place long, chars long, size long, high long, tail long"


class _Words(dict):
    """The number of each word seen; its two hashes stand at that number."""

    def __init__(self) -> None:
        self.high, self.low = array("Q"), array("Q")

    def __missing__(self, word: str) -> int:
        plain = word.encode("utf-8", "replace").translate(_LOWER)
        self[word] = number = len(self.high)
        self.high.append(xxhash.xxh3_64_intdigest(plain, 1))
        self.low.append(xxhash.xxh3_64_intdigest(plain, 2))
        return number


def _placed(text: str) -> tuple[list[str], np.ndarray]:
    """The words of a text and their offsets."""
    if text.isascii() or not _HAS_UNSPACED.search(text):
        words = text.split()
        if " ".join(words) == text.replace("\n", " "):
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            return words, np.concatenate([[0], ends[:-1]]) if words else ends
        found = list(_WORD.finditer(text))
    else:
        found = list(_TOKEN.finditer(text))
    return [m.group() for m in found], np.fromiter((m.start() for m in found), np.int64, len(found))


def _powers(base: int, many: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < many:
        out = np.concatenate([out, out * pow(base, len(out), _PRIME) % _PRIME])
    return out


class UnitCutter:
    """Cuts texts; remembers the hashes of words and the powers of the bases."""

    def __init__(self) -> None:
        self.known = _Words()
        self.power = self.back = [np.ones(1, np.int64)] * len(_BASES)

    def _sums(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each base the sums of word hash x power over the words before each place."""
        n = len(codes)
        if len(self.power[0]) <= n:
            self.power = [_powers(b, n + 1) for b in _BASES]
            self.back = [_powers(pow(b, -1, _PRIME), n + 1) for b in _BASES]
        high, low = (np.array(h, np.uint64) for h in (self.known.high, self.known.low))
        out = []
        for k, power in enumerate(self.power):
            words = ((high, low)[k // 2] >> np.uint64(32 * (k % 2)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % (_PRIME - 1) + 1
            out.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(words[codes] * power[:n] % _PRIME)]))
        return out

    def cut(self, texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The words of each text, and of each unit: text, word, words, start, end, from_word, from_start, line, high, low, gap."""
        if len(self.known) > REMEMBER:
            self.known = _Words()
        words, starts, lines = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first = np.zeros(len(texts) + 1, np.int64)  # each text's first word
        for i, text in enumerate(texts):
            own, at = _placed(text)
            words += own
            starts.append(at)
            if own:
                breaks = np.cumsum([0, *[len(x) + 1 for x in text.split("\n")]])
                lines.append(np.unique(np.searchsorted(at, breaks)) + first[i])
            first[i + 1] = first[i] + len(own)
        n = len(words)
        owner, start = np.repeat(np.arange(len(texts)), np.diff(first)), np.concatenate(starts)
        end = start + np.fromiter(map(len, words), np.int64, n)
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, n)
        sums = self._sums(codes)

        def digest(which: int, a: np.ndarray, z: np.ndarray) -> np.ndarray:
            return (sums[which][z] - sums[which][a]) % _PRIME * self.back[which][a] % _PRIME

        chosen = self._chosen(first, lambda a: digest(0, a, a + GRAM))
        before = np.append(-1, chosen[:-1]) if len(chosen) else chosen
        since = np.maximum(before, first[owner[chosen]]) if len(chosen) else chosen  # the chosen place before, or the text's start
        bounds = np.concatenate(lines)
        bounds = bounds[np.append(True, np.diff(bounds) > 0)] if len(bounds) else np.zeros(1, np.int64)
        a, z = np.concatenate([chosen, bounds[:-1]]), np.concatenate([chosen + GRAM, bounds[1:]])
        line = np.repeat([False, True], [len(chosen), len(bounds) - 1])
        since = np.concatenate([since, bounds[:-1]])
        of = owner[a] if n else np.zeros(0, np.int64)
        return np.diff(first), {
            "text": of, "word": a - first[of], "words": z - a, "start": start[a], "end": end[z - 1], "from_word": since - first[of], "from_start": start[since],
            "line": line, "high": digest(0, a, z) << 31 | digest(1, a, z) | np.where(line, _LINE, 0), "low": digest(2, a, z), "gap": digest(3, since, a),
        }

    @staticmethod
    def _chosen(first: np.ndarray, digest) -> np.ndarray:
        """First words of the chosen grams of all texts; where a text has fewer grams than a window, its least."""
        grams = np.maximum(np.diff(first) - GRAM + 1, 0)
        if not grams.any():
            return np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(grams)])
        owner = np.repeat(np.arange(len(grams)), grams)
        place = np.arange(base[-1]) - base[owner] + first[owner]
        order = digest(place)
        order = order.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)
        found = [base[i] + int(order[base[i] : base[i + 1]].argmin()) for i in np.flatnonzero((grams > 0) & (grams < WINDOW)).tolist()]
        if len(order) >= WINDOW:
            windows = np.lib.stride_tricks.sliding_window_view(order, WINDOW)
            whole = np.flatnonzero(owner[: len(windows)] == owner[WINDOW - 1 :])
            for i in range(0, len(whole), 1 << 16):
                part = whole[i : i + (1 << 16)]
                found.extend(np.unique(part + windows[part].argmin(axis=1)).tolist())
        return place[np.unique(np.array(found, np.int64))]


def units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per unit, and one per document without a digest, whose ``words`` are all of its words."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in UNITS.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, row = UnitCutter(), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, a = [t or "" for t in batch.column(1).to_pylist()], 0
            while a < len(texts):
                z, size = a, 0
                while z < len(texts) and (z == a or size + len(texts[z]) < 1 << 20):
                    size += len(texts[z])
                    z += 1
                many, found = cutter.cut(texts[a:z])
                ids, of, zero = batch.column(0).slice(a, z - a), found.pop("text"), np.zeros(z - a, np.int32)
                two = lambda high, low: pa.array(high.astype(np.int64) << 32 | low.astype(np.int64))
                none = pa.nulls(z - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(z - a) + row), ids, two(zero, zero), two(zero, zero), two(zero, many << 1), none, none], names=names)
                packed = [two(found["word"], found["from_word"]), two(found["start"], found["from_start"]), two(found["end"], found["words"] << 1 | found["line"]), pa.array(found["high"]), two(found["low"], found["gap"])]
                yield pa.RecordBatch.from_arrays([pa.array(of + row), ids.take(pa.array(of)), *packed], names=names)
                row += z - a
                a = z
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, UNITS)


def _runs(intervals: DataFrame) -> DataFrame:
    """``intervals (row, a, z, start, end, ...)`` that touch or overlap as one: row, a, z, start, end."""
    own = Window.partitionBy("row").orderBy("a", "z")
    reach = F.max("z").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = intervals.withColumn("fresh", F.when(F.col("a") <= reach, 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "run").agg(*[f(c).alias(c) for f, c in ((F.min, "a"), (F.max, "z"), (F.min, "start"), (F.max, "end"))]).drop("run")


def _repeats(docs: DataFrame, min_run: int, min_line: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents by row: row, doc_id, n_words; later lines; removed runs of passages; all removed spans), the last three as (row, a, z, start, end)."""
    high_half, low_half = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    found = settle(units(docs, id_col=id_col, text_col=text_col), "units")
    rows = settle(found.where(F.col("high").isNull()).select("row", "doc_id", (low_half("size") / 2).cast("int").alias("n_words")), "documents")
    some = found.where(F.col("high").isNotNull())
    often = settle(some.groupBy("high").agg(F.count("*").alias("n")).where("n > 1").select("high"), "often")
    # These are written, so that the next join deals both sides anew and adaptive execution may split a unit that is everywhere.
    packed = settle(some.join(often, "high", "left_semi"), "shared-units")
    discard(found, often)
    shared = packed.select(
        "row", "doc_id", "high", high_half("tail").alias("low"), F.col("tail").bitwiseAND(F.lit((1 << 32) - 1)).alias("gap"), high_half("place").alias("word"), low_half("place").alias("from_word"), high_half("chars").alias("start"),
        low_half("chars").alias("from_start"), high_half("size").alias("end"), (low_half("size") / 2).cast("int").alias("words"), (low_half("size") % 2 == 1).alias("line"),
    )
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "word", F.col("gap").alias("gap"))
    kept = settle(shared.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(rank).alias("kept")).where("n > 1").drop("n"), "kept-units")
    apart = (F.col("row") != F.col("kept.row")) | (F.col("word") >= F.col("kept.word") + F.col("words"))
    more = F.col("gap") == F.col("kept.gap")
    later = shared.join(kept, ["high", "low"]).where(apart).select(
        "row", "line", F.when(more, F.col("from_word")).otherwise(F.col("word")).alias("a"), (F.col("word") + F.col("words")).alias("z"),
        F.when(more, F.col("from_start")).otherwise(F.col("start")).alias("start"), "end",
    )
    later = settle(later, "later-units")
    discard(packed, kept)
    lines = later.where(F.col("line") & (F.col("z") - F.col("a") >= min_line)).drop("line")
    passages = _runs(later.where(~F.col("line")).drop("line")).where(F.col("z") - F.col("a") >= min_run)
    columns = ["row", "a", "z", "start", "end"]
    return rows, lines, passages, _runs(lines.select(columns).union(passages.select(columns)))


def repeated_spans(docs: DataFrame, *, min_run: int = MIN_RUN, min_line: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per span to remove: doc_id, start, end, n_words; and ``row``, which tells documents of one id apart."""
    rows, _, _, spans = _repeats(docs, min_run, min_line, id_col, text_col)
    return spans.join(rows, "row").select("doc_id", "start", "end", (F.col("z") - F.col("a")).cast("long").alias("n_words"), "row")


def repeat_digests(docs: DataFrame, *, min_run: int = MIN_RUN, min_line: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_lines and n_passages (later lines, and runs of later passages), removed_words, and all spans to remove as start:end, in order."""
    rows, lines, passages, spans = _repeats(docs, min_run, min_line, id_col, text_col)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    by = lambda df, *aggs: df.groupBy("row").agg(*aggs)
    text = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"))
    joined = rows.join(by(lines, F.count("*").alias("lines")), "row", "left").join(by(passages, F.count("*").alias("passages")), "row", "left")
    joined = joined.join(by(spans, F.sum(F.col("z") - F.col("a")).cast("long").alias("words"), F.array_sort(F.collect_list(F.struct("start", text.alias("x")))).alias("x")), "row", "left")
    return joined.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), zero("lines").alias("n_lines"), zero("passages").alias("n_passages"), zero("words").alias("removed_words"),
        F.coalesce(F.array_join(F.transform("x", lambda x: x["x"]), ","), F.lit("")).alias("spans"),
    )


def drop_repeats(docs: DataFrame, *, min_run: int = MIN_RUN, min_line: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without their repeated spans, with a last column ``removed``: their original offsets, null where there are none.

    Rows are numbered in the order of (id, place) first, so that repeated ids don't mix.
    """
    safe = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own, id_, text = docs.select(*[F.col(c).alias(new) for c, new in safe.items()]), safe[id_col], F.col(safe[text_col])
    ranged = own.repartitionByRange(id_).sortWithinPartitions(F.col(id_).asc_nulls_last())
    numbered = settle(ranged.withColumn("key", F.col(id_).isNull().cast("long") * F.lit(1 << 62) + F.monotonically_increasing_id()), "numbered")
    spans = repeated_spans(numbered, min_run=min_run, min_line=min_line, id_col="key", text_col=safe[text_col])
    each = spans.groupBy(F.col("doc_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    # What stays is what lies between the spans: from each one's end (the text's start before the first) to the next one's start.
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda x: x["end"]))
    stops = F.concat(F.transform("removed", lambda x: x["start"]), F.array(F.length(text)))
    rest = F.array_join(F.zip_with(begins, stops, lambda a, z: F.substr(text, a + 1, z - a)), "")
    joined = numbered.join(each, "key", "left")
    return joined.select(*[(F.when(F.col("removed").isNotNull(), rest).otherwise(text) if c == text_col else F.col(new)).alias(c) for c, new in safe.items()], "removed")

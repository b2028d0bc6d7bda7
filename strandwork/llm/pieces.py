"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The transducer is compiled from a public model file: a normaliser (the dummy prefix; each space
becomes the mark U+2581), a lexicon that reads a piece's characters and writes its id, byte
fallback for a character that no piece holds, and an automaton over neighbouring pieces. Its
weights are tropical: a piece costs one, and a pair of neighbours costs infinity unless the model's
merges, run on the two pieces' text alone, leave just these two. Merges act in one order of
priority, so a sequence whose neighbours all pass is what the merges make of the
whole text, and the shortest path through the composition with an input is its encoding.

The composition is done per segment. No piece holds a character pair that isn't in the model's own table of such
pairs, so a text may be cut there without any change; what a segment gave is remembered.

Defined results: null and empty texts have no pieces; null ids and repeated rows pass
through; an empty table gives an empty result; other columns are ignored. Decoding gives
the normalised text back: a U+2581 of the input comes back as a space, all else as it was.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, small_batches
from .words import different_chunks

MARK = "▁"
#: Bytes that the remembered chunks and segments take at most, each by estimate, beside what one batch adds; and pairs of pieces of some 150 bytes.
REMEMBER, PAIRS = 128 << 20, 400_000
#: Characters of a segment above which it is composed by itself.
LONG = 64
ROWS = "doc_id long, n_tokens long, n_fallback long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_NORMAL, _CONTROL, _BYTE = 1, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


class _Remembered(dict):
    """Ids by text, with an estimate of their bytes."""

    held = 0

    def take(self, found: dict[str, bytes]) -> None:
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + 200 * len(found)
        self.update(found)

    def bound(self) -> None:
        """Empty it beyond ``REMEMBER``."""
        if self.held > REMEMBER:
            self.clear()
            self.held = 0


class PieceTransducer:
    """The compiled transducer of a model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        kinds = []
        self.text: list[str] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.fallback = [0] * 256
        for i, piece in enumerate(dict(_fields(v)) for k, v in parts if k == 1):
            text, kind = piece[1].decode(), piece.get(3, _NORMAL)
            self.text.append(text)
            kinds.append(kind)
            if kind == _BYTE:
                self.fallback[int(text[3:5], 16)] = i
            elif kind == _NORMAL:
                self.ids[text] = i
                self.score[text] = struct.unpack("<f", piece.get(2, bytes(4)))[0]
        normaliser = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1):
            raise ValueError("only identity normalisation with a dummy prefix that keeps white space is compiled")
        self.longest = max(map(len, self.ids))
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.surface = [bytes([int(t[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else t.replace(MARK, " ").encode() for t, k in zip(self.text, kinds, strict=True)]
        self.chunks, self.segments = _Remembered(), _Remembered()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.fresh: dict[int, bool] = {}
        self._compile()

    def _compile(self) -> None:
        """The lexicon as sorted (node, character) keys, and the character pairs within pieces as sorted keys."""
        self.alphabet = np.array(sorted({ord(c) for p in self.ids for c in p}), np.uint32)
        self.width = len(self.alphabet) + 1
        arcs: dict[int, int] = {}
        ends = [-1]
        for piece, number in self.ids.items():
            node = 0
            for code in self._codes(piece):
                key = node * self.width + int(code)
                if key not in arcs:
                    arcs[key] = len(ends)
                    ends.append(-1)
                node = arcs[key]
            ends[node] = number
        self.arc_keys = np.array(sorted(arcs), np.int64)
        self.arc_to = np.array([arcs[k] for k in self.arc_keys.tolist()], np.int64)
        self.node_piece = np.array(ends, np.int64)
        inner = sorted({int(a) * self.width + int(b) for p in self.inner for a, b in [self._codes(p)]})
        self.inner_keys = np.array(inner, np.int64)
        self.pair_keys, self.pair_finite = np.empty(0, np.int64), np.empty(0, bool)

    def _codes(self, text: str) -> np.ndarray:
        """Places in the alphabet; a character outside it has the last code."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)).astype(np.int64)

    @staticmethod
    def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def merged(self, text: str) -> list[str]:
        """What the model's merges make of a short text: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str, right: str) -> bool:
        """Whether the arc from ``left`` to ``right`` has a finite weight; "" stands for the start."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def shortest(self, text: str) -> list[str]:
        """The pieces of a segment on the shortest path; a character without a piece is one of its own."""
        # Merges make one sequence of each prefix, so at most one arc into a place has a finite weight: the
        # first one found is the shortest path to it.
        last, began, ids, pairs, longest = [""], [-1], self.ids, self.pairs, self.longest
        for end in range(1, len(text) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                piece = text[start:end]
                if start == end - 1 or piece in ids:
                    arc = (last[start], piece)
                    finite = pairs.get(arc)
                    if self.follows(*arc) if finite is None else finite:
                        break
            else:
                raise AssertionError("a place that no arc reaches")
            last.append(piece)
            began.append(start)
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at = began[at]
        return out[::-1]

    def _finite(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``follows`` for arrays of piece ids; one past the last id is the start, two past it an unknown character."""
        unknown = len(self.text) + 1
        keys = left * (unknown + 1) + right
        at, known = self._found(self.pair_keys, keys)
        out = known.copy()
        out[known] = self.pair_finite[at[known]]
        free = (left == unknown) | (right == unknown)
        asked = np.flatnonzero(~known & ~free)
        if len(asked):
            different, which = np.unique(keys[asked], return_inverse=True)
            for key in different.tolist():
                if key not in self.fresh:
                    a, b = divmod(key, unknown + 1)
                    self.fresh[key] = self.follows("" if a == unknown - 1 else self.text[a], self.text[b])
            out[asked] = np.fromiter(map(self.fresh.__getitem__, different.tolist()), bool, len(different))[which]
        if free.any():  # merges stop at an unknown character, so what follows it stands as at the start
            out[right == unknown] = True
            after = (left == unknown) & (right != unknown)
            if after.any():
                out[after] = self._finite(np.full(int(after.sum()), unknown - 1), right[after])
        return out

    def _shortest_all(self, segments: list[str]) -> list[bytes]:
        """``shortest`` for many segments at once, as ids; place by place, all segments that reach it together."""
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        sizes = np.array([len(segments[i]) for i in order], np.int64)
        text = "".join(segments[i] for i in order)
        codes, base = self._codes(text), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        start, unknown, outside = len(self.text), len(self.text) + 1, len(self.alphabet)
        last = np.full(len(codes) + len(sizes), -1, np.int64)  # a place more for each segment
        began = np.zeros(len(last), np.int64)
        home = base + np.arange(len(sizes))
        last[home] = start
        for s in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -s, "left"))  # those longer than s come first
            at, place, room, node = base[:live] + s, home[:live] + s, sizes[:live] - s, np.zeros(live, np.int64)
            for size in range(1, self.longest + 1):
                if size == 1:
                    odd = np.flatnonzero(codes[at] == outside)
                    last[place[odd] + 1], began[place[odd] + 1] = unknown, 1
                go, ok = self._found(self.arc_keys, node * self.width + codes[at + size - 1])
                ok &= room >= size
                at, place, room, node = at[ok], place[ok], room[ok], self.arc_to[go[ok]]
                if not len(at):
                    break
                piece = self.node_piece[node]
                some = np.flatnonzero(piece >= 0)
                fine = some[self._finite(last[place[some]], piece[some])]
                last[place[fine] + size], began[place[fine] + size] = piece[fine], size
                more = room > size
                at, place, room, node = at[more], place[more], room[more], node[more]
                if not len(at):
                    break
        if len(self.pair_keys) > 10 * PAIRS:  # 9 bytes each
            self.pair_keys, self.pair_finite = np.empty(0, np.int64), np.empty(0, bool)
        if self.fresh:
            keys = np.concatenate([self.pair_keys, np.fromiter(self.fresh, np.int64, len(self.fresh))])
            finite = np.concatenate([self.pair_finite, np.fromiter(self.fresh.values(), bool, len(self.fresh))])
            by = np.argsort(keys)
            self.pair_keys, self.pair_finite = keys[by], finite[by]
            self.fresh.clear()
        out = [b""] * len(segments)
        last_, began_ = last.tolist(), began.tolist()
        for i, home_, size in zip(order, home.tolist(), sizes.tolist(), strict=True):
            ids, at = [], size
            while at:
                one, step = last_[home_ + at], began_[home_ + at]
                if one == unknown:
                    ids.extend(self.fallback[b] for b in reversed(segments[i][at - 1].encode("utf-8", "surrogatepass")))
                else:
                    ids.append(one)
                at -= step
            out[i] = np.array(ids[::-1], "<u4").tobytes()
        return out

    def _long(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.shortest(text):
            out.extend([self.ids[piece]] if piece in self.ids else [self.fallback[b] for b in piece.encode("utf-8", "surrogatepass")])
        return np.array(out, "<u4").tobytes()

    def _known(self, chunks: list[str]) -> list[bytes]:
        out = list(map(self.chunks.get, chunks))
        missing = list({c: None for c, got in zip(chunks, out, strict=True) if got is None})
        if not missing:
            return out
        text = "".join(missing)
        codes = self._codes(text)
        _, inner = self._found(self.inner_keys, codes[:-1] * self.width + codes[1:])
        ends = np.cumsum([len(c) for c in missing])
        cut = np.concatenate([~inner, [True]])
        cut[ends - 1] = True
        stops = np.flatnonzero(cut) + 1
        parts = [text[a:z] for a, z in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        self.segments.bound()
        fresh = list({p: None for p in parts if p not in self.segments})
        self.segments.take({p: self._long(p) for p in fresh if len(p) > LONG})
        short = [p for p in fresh if len(p) <= LONG]
        for i in range(0, len(short), 100_000):
            self.segments.take(dict(zip(short[i : i + 100_000], self._shortest_all(short[i : i + 100_000]), strict=True)))
        ids = list(map(self.segments.__getitem__, parts))
        owner = np.concatenate([[0], np.searchsorted(stops, ends) + 1]).tolist()
        found = {c: ids[a] if z - a == 1 else b"".join(ids[a:z]) for c, a, z in zip(missing, owner[:-1], owner[1:], strict=True)}
        self.chunks.bound()
        self.chunks.take(found)
        return [found[c] if got is None else got for c, got in zip(chunks, out, strict=True)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self._known(_CUT.split(MARK + text.replace(" ", MARK)))) if text else b""

    def encode_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column; each different chunk between spaces is looked up once."""
        many, codes, ends = different_chunks(texts)
        chunks = many.to_numpy(zero_copy_only=False).tolist()  # far faster than a scalar each
        unsafe = np.fromiter((not c or MARK in c for c in chunks), bool, len(chunks))
        before = np.concatenate([[0], np.cumsum(unsafe[codes])]) if len(codes) else np.zeros(1, np.int64)
        odd = before[ends[1:]] > before[ends[:-1]]
        led = self._known([MARK + c for c in chunks])
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, led), np.int64, len(led)))])
        ids = pa.LargeListArray.from_arrays(pa.array(at // 4), pa.array(np.frombuffer(b"".join(led), "<u4"))).take(pa.array(codes))
        where = ids.offsets.to_numpy()[ends] * 4 if len(codes) else np.zeros(len(texts) + 1, np.int64)
        flat = memoryview(ids.values.to_numpy()).cast("B") if len(codes) else memoryview(b"")
        for i, (a, z) in enumerate(zip(where[:-1], where[1:], strict=True)):
            yield self.encode(texts[i].as_py()) if odd[i] else bytes(flat[a:z])

    def decode_bytes(self, ids: bytes) -> bytes:
        """The normalised text in UTF-8 without the dummy prefix."""
        out = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out[1:] if out.startswith(b" ") else out

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer_of(path: str) -> PieceTransducer:
    """One transducer for all tasks of a Python worker."""
    return PieceTransducer(path)


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(transducer_of(model).encode_texts(batch.column(1)))
            at = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(got), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from the result of ``encode_pieces``; null ids give null."""
    small_batches(encoded.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else transducer_of(model).decode(np.array(ids, "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
        release()

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its count of ids and of fallback ids, their CRC-32, the decoded text's SHA-256, whether it is the normalised text."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fst = transducer_of(model)
            low, high = min(fst.fallback), max(fst.fallback)
            texts = pc.replace_substring(batch.column(1).fill_null(""), MARK, " ").cast(pa.large_binary())
            rows: list[tuple] = []
            for text, ids in zip(texts, fst.encode_texts(batch.column(1)), strict=True):
                seen, back = np.frombuffer(ids, "<u4"), fst.decode_bytes(ids)
                rows.append((len(seen), int(np.count_nonzero((seen >= low) & (seen <= high))), zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == text.as_buffer()))
            n, fallback, crc, sha, same = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                names=[c.split()[0] for c in ROWS.split(", ")],
            )
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, ROWS)

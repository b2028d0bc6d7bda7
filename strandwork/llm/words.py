"""Encoding whole texts with a public tokenizer, with a bounded memory of pre-tokens.

Both public pre-tokenizers break where a single space stands between visible characters,
so the ids of a text are those of its space-led chunks in turn. A chunk is cut into pre-tokens, and only a pre-token
that isn't remembered goes to the tokenizer's model. Chunks with characters beyond ``PLAIN`` go to the tokenizer
whole, as there its normaliser may do more than lower-case letters. The strings of the vocabulary's special tokens are cut out first
and become their ids, as the tokenizer itself does when it is left as it was loaded.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes that a memo holds at most, its keys, values and table together; then it starts anew.
MEMO_BYTES = 192 << 20
#: A place between two chunks that no pre-token can span: one space after and before visible text.
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Characters whose normal form and lower case are a matter of one character.
PLAIN = re.compile(r"[\t-\r -~\xa0-įı-ž]*\Z")
# The pre-token patterns of the two public vocabularies.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that are a pre-token by themselves after letters at a chunk's end.
STOPS = ".,;:!?"
#: White space as Python's str.isspace has it, at an end of a chunk or as all of it.
_EDGE = r"^$|^[\s\v\x1c-\x1f\x85\pZ]|[\s\v\x1c-\x1f\x85\pZ]$"


class Memo(dict):
    """A dictionary of text to bytes that empties itself beyond so many bytes."""

    def __init__(self, most: int | None = None) -> None:
        super().__init__()
        self.most, self.held = MEMO_BYTES if most is None else most, 0

    def put(self, key: str, value: bytes) -> bytes:
        self.held += len(key) + len(value) + 200
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = value
        return value


def byte_letters() -> dict[int, int]:
    """For each byte the visible character that stands for it in byte-level vocabularies."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(visible))}


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    ``spaced``: chunks keep the space that leads them (byte-level); otherwise the tokenizer
    drops white space and lower-cases. ``special_as_text``: the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, spaced: bool, special_as_text: bool = False, memo: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {} if special_as_text else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.tokenizer.encode_special_tokens = True  # what is left after these are cut out holds none
        self.special = {text: array("I", [i]).tobytes() for text, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.pattern = regex.compile(SPACED_PATTERN if spaced else WORD_PATTERN)
        self.letters = byte_letters()
        self.pre = Memo(memo)

    def _pre(self, pre: str) -> bytes:
        if pre.isascii() and pre.isprintable():  # these stand for themselves, but for the space
            seen = pre.replace(" ", chr(self.letters[32]))
        else:
            seen = pre.encode().decode("latin-1").translate(self.letters)
        return self.pre.put(pre, array("I", [t.id for t in self.model.tokenize(seen)]).tobytes())

    def _chunk(self, chunk: str) -> bytes:
        got = self.pre.get(chunk)  # what is remembered is plain, and lower-cased if need be
        if got is not None:
            return got
        plain = chunk.isascii() and (chunk[1:] if self.spaced and chunk[:1] == " " else chunk).isalpha()
        if not plain and not PLAIN.match(chunk):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if not self.spaced:
            chunk = chunk.lower()
            got = self.pre.get(chunk)
            if got is not None:
                return got
        word = chunk[1:] if self.spaced and chunk[:1] == " " else chunk
        if word.isalpha():
            return self._pre(chunk)
        if word[-1:] in STOPS and word[:-1].isalpha():
            head, stop = chunk[:-1], chunk[-1]
            return (self.pre.get(head) or self._pre(head)) + (self.pre.get(stop) or self._pre(stop))
        return b"".join([self.pre.get(pre) or self._pre(pre) for pre in self.pattern.findall(chunk)])

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        get, chunk = self.pre.get, self._chunk
        return [get(c) or chunk(c) for c in chunks]

    def _plain_bytes(self, text: str) -> bytes:
        return b"".join(map(self._chunk, SAFE.split(text) if self.spaced else text.split(" ")))

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return self._plain_bytes(text)
        return b"".join([self.special[part] if i % 2 else self._plain_bytes(part) for i, part in enumerate(self.cut.split(text)) if part])

    def encode_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an Arrow column; null counts as empty.

        Each different chunk of the column is looked up once. A text with a special token, or with white space
        that isn't a single space between visible characters, is cut at the safe places.
        """
        many, codes, ends = different_chunks(texts)
        chunks = many.to_numpy(zero_copy_only=False).tolist()  # far faster than a scalar each
        firsts = np.zeros(len(codes), bool)
        firsts[ends[:-1][np.diff(ends) > 0]] = True
        odd = np.zeros(len(texts), bool)
        for content in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        if self.spaced:
            unsafe = pc.match_substring_regex(many, _EDGE).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(unsafe[codes])])
            odd |= before[ends[1:]] > before[ends[:-1]]
            own, codes_of_firsts = np.unique(codes[firsts], return_inverse=True)
            led = self._chunks([" " + c for c in chunks] + [chunks[i] for i in own])
            codes[firsts] = len(chunks) + codes_of_firsts
        else:
            led = self._chunks(chunks)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, led), np.int64, len(led)))])
        ids = pa.LargeListArray.from_arrays(pa.array(at // 4), pa.array(np.frombuffer(b"".join(led), "<u4"))).take(pa.array(codes))
        where = ids.offsets.to_numpy()[ends] * 4 if len(codes) else np.zeros(len(texts) + 1, np.int64)
        flat = memoryview(ids.values.to_numpy()).cast("B") if len(codes) else memoryview(b"")
        for i, (a, z) in enumerate(zip(where[:-1], where[1:], strict=True)):
            yield self.encode_bytes(texts[i].as_py()) if odd[i] else bytes(flat[a:z])


def different_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different pieces between single spaces of a column, each piece's number among them in order, and each text's bounds there."""
    lists = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
    coded = lists.flatten().dictionary_encode()
    ends = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), ends - ends[0]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, spaced: bool, special_as_text: bool = False, memo: int | None = None) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker. ``memo``: bytes of remembered pre-tokens, ``MEMO_BYTES`` unless told."""
    return ChunkEncoder(path, spaced, special_as_text, memo)

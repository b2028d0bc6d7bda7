"""Words of whole texts as bytes: letters A-Z lower-cased, cut at the ASCII characters that are no part of a word.

All bytes of characters beyond ASCII belong to words, so the bytes can be cut without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are cut into words at a time, so that a text of many megabytes is no list of all its words.
CHUNK = 1 << 20


def table_of(digits: bool) -> bytes:
    """For ``bytes.translate``: what is no letter (or digit, with ``digits``) becomes a space, A-Z becomes a-z."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for low in range(ord("a"), ord("z") + 1):
        out[low] = out[low - 32] = low
    for d in range(ord("0"), ord("9") + 1):
        out[d] = d if digits else 32
    return bytes(out)


#: Words of letters, and words of letters and digits.
LETTERS, LETTERS_AND_DIGITS = table_of(False), table_of(True)


def words_of(text: bytes | None, table: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text in order, some ``chunk`` bytes' worth at a time; none for null."""
    at, size = 0, len(text or b"")
    if size <= chunk:
        yield text.translate(table).split() if text else []
        return
    low = text.translate(table)
    while at < size:
        end = low.find(b" ", min(at + chunk, size))
        end = size if end < 0 else end
        yield low[at:end].split()
        at = end


def bytes_of(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a binary column one by one."""
    for value in column:
        yield value.as_py()

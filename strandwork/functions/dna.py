"""Column functions over DNA text: ``A C G T`` and ``N`` for anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases of a seed unless told otherwise, between two sampled positions, of a long seed beyond a seed, and of a seed at most.
SEED, STEP, FURTHER, MOST_SEED = 12, 4, 3, 31
#: Stands for a base beyond an edge of a contig; equals none.
EDGE = "-"
#: Bases of a text that fit the bits of a number.
PLANE = 62


def genome(seq: Column) -> Column:
    """Upper case; whatever isn't a base is N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """Other characters than bases stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def seed_code(kmer: Column) -> Column:
    """Two bits a base, the first base least; for up to 31 bases without N."""
    return F.conv(F.translate(F.reverse(kmer), "ACGT", "0123"), 4, 10).cast("long")


def planes(text: Column) -> tuple[Column, Column, Column]:
    """Three numbers for up to ``PLANE`` bases, the first base in the least bit: low bit and high bit of the base's code, and whether it is no base.

    What is no base has code 0 for N, 1 for an edge and 2 for R, which stands for anything else.
    """
    turned = F.reverse(F.translate(text, f"ACGTN{EDGE}R", "0123456"))
    low, high, other = (F.conv(F.translate(turned, "0123456", bits), 2, 10).cast("long") for bits in ("0101010", "0011001", "0000111"))
    return low, high, other


def known(text: Column) -> Column:
    """Text that ``planes`` takes: other characters than bases, N and edges are R."""
    return F.regexp_replace(text, f"[^ACGTN{EDGE}]", "R")


def some_bits(word: Column, start: Column | int, many: int) -> Column:
    """``many`` bits of a number from bit ``start`` on."""
    return F.call_function("shiftright", word, F.lit(start) if isinstance(start, int) else start.cast("int")).bitwiseAND(F.lit((1 << many) - 1))


def interleaved(low: Column, high: Column, many: int) -> Column:
    """Bits of ``low`` at even and of ``high`` at odd places; each has ``many`` bits, 31 at most."""

    def spread(x: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            if many > shift:
                x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return spread(low).bitwiseOR(F.shiftleft(spread(high), 1))


def flank_code(six: Column) -> Column:
    """Six bases as 12 bits of codes and 6 bits above that say which is no base."""
    low, high, other = planes(known(six))
    return packed_flank(low, high, other)


def packed_flank(low: Column, high: Column, other: Column) -> Column:
    """``flank_code`` from the three numbers of six bases."""
    return interleaved(low, high, 6).bitwiseOR(F.shiftleft(other, 12)).cast("int")


def flank_part(flank: Column, at: Column) -> Column:
    """Three bases of a flank from base ``at`` on, packed in 6 and 3 bits."""
    at = at.cast("int")
    return F.call_function("shiftright", flank, 2 * at).bitwiseAND(F.lit(63)).bitwiseOR(F.shiftleft(F.call_function("shiftright", flank, at + 12).bitwiseAND(F.lit(7)), 6))


def _shown(code: int, many: int) -> str:
    letters = (*f"ACGTN{EDGE}R", "")
    return "".join(letters[(code >> 2 * k & 3) + 4 * (code >> 2 * many + k & 1)] for k in range(many))


def flank_text(flank: Column, at: int, many: int) -> Column:
    """Some bases of a flank as text, up to three at a time from a table of all texts of so many."""

    def piece(at: int, many: int) -> Column:
        bits = lambda start, many: F.call_function("shiftright", flank, F.lit(start)).bitwiseAND(F.lit((1 << many) - 1))
        return F.get(F.lit([_shown(code, many) for code in range(8**many)]), bits(2 * at, 2 * many).bitwiseOR(F.shiftleft(bits(12 + at, many), 2 * many)))

    pieces = [piece(k, min(3, at + many - k)) for k in range(at, at + many, 3)]
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def residual_code(resid: Column) -> Column:
    """Three bases packed as ``flank_part`` packs them."""
    low, high, other = planes(known(resid))
    return interleaved(low, high, 3).bitwiseOR(F.shiftleft(other, 6)).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Different places of two texts of one length, by the bits in which their planes differ, ``PLANE`` bases at a time; R equals nothing."""
    a, b = known(a), known(b)
    starts = F.sequence(F.lit(0), F.greatest(F.length(a) - 1, F.lit(0)), F.lit(PLANE))

    def apart(at: Column) -> Column:
        x, y = (planes(F.substr(t, at + 1, F.lit(PLANE))) for t in (a, b))
        low, high, other = (p.bitwiseXOR(q) for p, q in zip(x, y))
        return F.coalesce(F.bit_count(low.bitwiseOR(high).bitwiseOR(other).bitwiseOR(x[1].bitwiseAND(x[2]))), F.lit(0))

    return F.aggregate(starts, F.lit(0), lambda acc, at: acc + apart(at))


def letters_as_dna(text: Column) -> Column:
    """A deterministic genome from any text: letters a to y stand for A, C, G, T in turn, z for N."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), letters, "".join("ACGT"[i % 4] for i in range(25)) + "N")


#: ``letters_as_dna`` for ``bytes.translate``: the base of each letter, and the bytes that go.
LETTER_BASES = bytes(ord("N") if chr(b | 32) == "z" else b"ACGT"[((b | 32) - 97) % 4] for b in range(256))
NO_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))

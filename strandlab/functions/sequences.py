"""Column functions on sequences: letters, codes, gaps, complements, k-mers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alphabets in code order.
DNA = "ACGT"
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Bases that an ambiguity code stands for.
AMBIGUOUS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
GAPS = "[-._~]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letters_of(text) -> Column:
    """The ASCII letters of a text, in lower case: the sequence of a document."""
    return F.lower(F.regexp_replace(col(text), "[^A-Za-z]", ""))


def chars(seq) -> Column:
    """The characters as an array; of an empty sequence, none."""
    return F.when(F.length(col(seq)) > 0, F.split(col(seq), "")).otherwise(F.array().cast("array<string>"))


def kmers(seq, k: int) -> Column:
    """All overlapping substrings of length k, in order; linear in the sequence's length."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def encode(seq, alphabet: str) -> Column:
    """Codes 0 .. L-1; -1 for a character outside the alphabet."""
    return F.transform(chars(seq), lambda c: F.position(c, F.lit(alphabet)) - 1)


def decode(codes, alphabet: str) -> Column:
    return F.array_join(F.transform(col(codes), lambda c: F.substring(F.lit(alphabet), c + 1, F.lit(1))), "")


def aligned(seq) -> Column:
    """Whether any gap character occurs."""
    return col(seq).rlike(GAPS)


def unaligned(seq) -> Column:
    return F.regexp_replace(col(seq), GAPS, "")


def complement(seq) -> Column:
    """Reverse complement of a DNA sequence; other characters stay."""
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCAtgca"))


def spaced(seq, n: int, symbol: str) -> Column:
    """n symbols on both sides."""
    return F.concat(F.lit(symbol * n), col(seq), F.lit(symbol * n))


def uniform(*key) -> Column:
    """A number in [0, 1) that is a function of the key alone, whatever the partitioning."""
    return F.pmod(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in key)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def resolved(seq, *key) -> Column:
    """DNA with every ambiguity code replaced by one of its bases, drawn by a hash of key and position."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for code, bases in AMBIGUOUS.items():
            choice = F.floor(uniform(*key, i) * len(bases)).cast("int") + 1
            out = F.when(c == code, F.substring(F.lit(bases), choice, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(chars(seq), one), "")

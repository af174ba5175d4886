"""Nucleotides and k-mers as column expressions. Codes: A 0, C 1, T 2, G 3; first base highest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motifel.functions.bits import bits, shr, unsigned_key

BASES, CODES = "ACTG", "0123"
MAX_K = 32


def clean(seq: Column) -> Column:
    """Bases in upper case, U as T, without line feeds (lines of one record go together); other signs stay."""
    return F.translate(seq, "acgtuU\n", "ACGTTT")


def fragments(seq: Column) -> Column:
    """The maximal runs of valid bases; any other character ends a run and no k-mer spans it."""
    return F.regexp_extract_all(clean(seq), F.lit("[ACGT]+"), 0)


def encode(kmer: Column, k: int) -> Column:
    """Of up to 32 bases the 64 bits, in two halves so that 32 bases fit."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k is {k}; 1 to {MAX_K} fit in 64 bits")
    digits = F.translate(F.upper(kmer), BASES, CODES)
    low = min(k, 16)
    lower = F.conv(F.substring(digits, k - low + 1, low), 4, 10).cast("long")
    if k <= 16:
        return lower
    return F.shiftleft(F.conv(F.substring(digits, 1, k - low), 4, 10).cast("long"), 2 * low).bitwiseOR(lower)


def decode(value: Column, k: int) -> Column:
    """The k bases of the lowest 2k bits."""
    low = min(k, 16)
    digits = lambda x, n: F.lpad(F.conv(x.cast("string"), 10, 4), n, "0")
    out = digits(value.bitwiseAND(bits((1 << (2 * low)) - 1)), low)
    if k > 16:
        out = F.concat(digits(shr(value, 32).bitwiseAND(bits((1 << (2 * (k - 16))) - 1)), k - 16), out)
    return F.translate(out, CODES, BASES)


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACTG", "TGAC")


def canonical(forward: Column, reverse: Column) -> Column:
    """The unsigned minimum of a k-mer's code and that of its reverse complement."""
    return F.when(unsigned_key(forward) <= unsigned_key(reverse), forward).otherwise(reverse)


def pseudo_dna(text: Column) -> Column:
    """Prose as a sequence: its letters a to z in turn as A, C, G, T. For data that holds no sequences."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])

"""Column expressions on base and quality strings (all JVM side)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from readmend import config as C


def upper_bases(seq: Column) -> Column:
    return F.upper(seq)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def substitute_n(seq: Column) -> Column:
    """Uppercase, then every character outside ACGT becomes A."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "A")


def n_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), "[ACGT]+", ""))


def percent_of(length: Column, pct: int) -> Column:
    """floor(length * pct / 100) in integers."""
    return F.floor(length * F.lit(pct) / F.lit(100)).cast("int")


def min_check_length(length: Column) -> Column:
    return percent_of(length, C.CHECK_RANGE_PCT)


def max_trimmed_bases(length: Column) -> Column:
    return F.when(length <= C.MIN_KEPT_BASES, F.lit(0)).otherwise(
        F.least(percent_of(length, C.MAX_TRIM_SHARE_PCT), length - C.MIN_KEPT_BASES)
    ).cast("int")


def correctable(seq: Column, k: int) -> Column:
    """Few enough N and at least one k-mer."""
    length = F.length(seq)
    return (n_count(seq) <= percent_of(length, C.MAX_N_SHARE_PCT)) & (length >= k)


def quality_values(qual: Column, offset: int) -> Column:
    """Quality string to array<int> of scores."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - F.lit(offset))


def unpack_kmer(packed: Column, k: int) -> Column:
    """2-bit packed bigint back to its base string, up to four bases at a look-up."""
    pieces, left = [], k
    while left:
        size = left % 4 or 4
        left -= size
        words = F.array(*(F.lit("".join(w)) for w in product("ACGT", repeat=size)))
        digits = F.shiftrightunsigned(packed, 2 * left).bitwiseAND(F.lit(4**size - 1))
        pieces.append(F.get(words, digits.cast("int")))
    return F.concat(*pieces)


def pack_kmer(kmer: Column) -> Column:
    """Base string (k <= 31) to its 2-bit packed bigint."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")

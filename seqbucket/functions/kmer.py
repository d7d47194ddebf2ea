"""Mers as column expressions: keys, complements, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_LEN = 15


def revcomp_acgt(c: Column) -> Column:
    """Reverse complement of a string that holds only A, C, G, T."""
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def mer_key(mer: Column, k: int = KEY_LEN) -> Column:
    """The smaller of the upper-case mer and its reverse complement; null unless the value is exactly k
    letters A, C, G, T in either case."""
    up = F.upper(mer)
    return F.when(mer.rlike(rf"\A[ACGTacgt]{{{k}}}\z"), F.least(up, revcomp_acgt(up)))


def mer_code(key: Column) -> Column:
    """A key as a number, two bits a letter, in the order of the strings."""
    return F.conv(F.translate(key, "ACGT", "0123"), 4, 10).cast("bigint")


def code_mer(code: Column, k: int = KEY_LEN) -> Column:
    """The key of mer_code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")

"""Scalar sequence functions as column expressions. A null argument gives null, an empty one the empty result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ingest(seq: Column) -> Column:
    """Upper case, without white space; letters other than A, C, G, T stay until normalize."""
    return F.upper(F.regexp_replace(seq, r"\s", ""))


def normalize(seq: Column) -> Column:
    """Anything but A, C, G, T becomes N."""
    return F.regexp_replace(seq, "[^ACGT]", "N")


def revcomp(seq: Column) -> Column:
    """Reverse complement; anything but A, C, G, T becomes N."""
    return F.reverse(F.translate(normalize(seq), "ACGT", "TGCA"))


def revcomp_case(seq: Column) -> Column:
    """Reverse complement that keeps the case and any other character."""
    return F.reverse(F.translate(seq, "acgtACGT", "tgcaTGCA"))


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(seq, revcomp(seq))


def n_to_a(seq: Column) -> Column:
    return F.translate(seq, "N", "A")


def permute(seq: Column, off: Column, k: Column) -> Column:
    """What follows the k characters at off, then what precedes them."""
    return F.concat(F.substr(seq, off + k + 1), F.substr(seq, F.lit(1), off))


def unpermute(body: Column, key: Column, off: Column) -> Column:
    """The sequence of which permute made body."""
    rest = F.length(body) - off
    return F.concat(F.substr(body, rest + 1), key, F.substr(body, F.lit(1), rest))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once a row though f uses it for every element of an array."""
    return F.transform(F.array(value), f)[0]


def two_bit_hex(seq: Column) -> Column:
    """Two bits a base, the first base in the lowest bits of a byte, A and N 0, G 1, C 2, T 3, the last byte
    filled with 0; upper-case hexadecimal."""
    groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(seq) / 4).cast("int") - 1, F.lit(0)))
    digit = lambda s, i: F.lpad(F.conv(F.reverse(F.substr(s, i * 4 + 1, F.lit(4))), 4, 16), 2, "0")
    digits = _let(F.translate(normalize(seq), "ANGCT", "00123"), lambda s: F.transform(groups, lambda i: digit(s, i)))
    return F.when(seq.isNull(), F.lit(None)).when(seq == "", F.lit("")).otherwise(F.array_join(digits, ""))


def two_bit_decode(packed: Column, size: Column) -> Column:
    """The bases of two_bit_hex, N come back as A."""
    groups = F.sequence(F.lit(0), F.greatest(F.ceil(size / 4).cast("int") - 1, F.lit(0)))
    four = lambda s, i: F.translate(F.reverse(F.lpad(F.conv(F.substr(s, i * 2 + 1, F.lit(2)), 16, 4), 4, "0")), "0123", "AGCT")
    bases = _let(packed, lambda s: F.transform(groups, lambda i: four(s, i)))
    return F.when(size.isNull(), F.lit(None)).otherwise(F.substr(F.array_join(bases, ""), F.lit(1), size))


def lcp(a: Column, b: Column, most: Column) -> Column:
    """Length of the longest common prefix, at most `most`."""
    end = F.least(F.length(a), F.length(b), most)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(end, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.least(F.coalesce(F.array_min(differ) - 1, end), end)


def n_positions(seq: Column) -> Column:
    """Places of N, from 0."""
    return F.array_compact(F.transform(F.split(seq, ""), lambda c, i: F.when(c == "N", i)))


def mirrored(positions: Column, size: Column) -> Column:
    """Places after a flip of the sequence."""
    return F.transform(positions, lambda p: size - 1 - p)


def patch_n(seq: Column, positions: Column) -> Column:
    """N at these places."""
    put = lambda at: F.transform(F.split(seq, ""), lambda c, i: F.when(F.array_contains(at, i), F.lit("N")).otherwise(c))
    return F.when((seq == "") | (F.size(positions) == 0), seq).otherwise(F.array_join(_let(positions, put), ""))


def merged(first: Column, second: Column, orientation: Column) -> Column:
    """Mates as one sequence: the second is turned where mates face each other or away from each other."""
    return F.concat(normalize(first), F.when(orientation.isin(1, 2), revcomp(second)).otherwise(normalize(second)))

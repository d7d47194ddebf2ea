"""Formats of read libraries: type (0 single, 1 paired), orientation (0 same, 1 away, 2 toward, 3 none),
strandedness (0 SA, 1 AS, 2 S, 3 A, 4 U), and the number that packs them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the twelve names with type, orientation, strandedness
FORMATS = {
    "IU": (1, 2, 4),
    "ISF": (1, 2, 0),
    "ISR": (1, 2, 1),
    "OU": (1, 1, 4),
    "OSF": (1, 1, 0),
    "OSR": (1, 1, 1),
    "MU": (1, 0, 4),
    "MSF": (1, 0, 2),
    "MSR": (1, 0, 3),
    "U": (0, 3, 4),
    "SF": (0, 3, 2),
    "SR": (0, 3, 3),
}
ORIENTATIONS = ("same", "away", "toward", "none")
STRANDS = ("SA", "AS", "S", "A", "U")
#: The largest number that format_id can give.
MAX_ID = 1 | (len(ORIENTATIONS) - 1) << 1 | (len(STRANDS) - 1) << 3


def parse(name: str) -> tuple[int, int, int]:
    if name.upper() not in FORMATS:
        raise ValueError(f"no library format {name!r}; known: {', '.join(FORMATS)}")
    return FORMATS[name.upper()]


def _of(name: Column, part: int) -> Column:
    pairs = [F.lit(x) for n, v in FORMATS.items() for x in (n, v[part])]
    flat = F.map_from_arrays(F.array(*pairs[::2]), F.array(*pairs[1::2]))
    return F.try_element_at(flat, F.upper(name))


def lib_type(name: Column) -> Column:
    return _of(name, 0)


def orientation(name: Column) -> Column:
    return _of(name, 1)


def strandedness(name: Column) -> Column:
    return _of(name, 2)


def format_id(kind: Column, orient: Column, strand: Column) -> Column:
    return kind.bitwiseOR(F.shiftleft(orient, 1)).bitwiseOR(F.shiftleft(strand, 3))


def unpacked(number: Column) -> tuple[Column, Column, Column]:
    return number.bitwiseAND(F.lit(1)), F.shiftright(number, 1).bitwiseAND(F.lit(3)), F.shiftright(number, 3).bitwiseAND(F.lit(7))


def is_valid(kind: Column, orient: Column, strand: Column) -> Column:
    """Single reads have no orientation and one of S, A, U; mates of the same direction S, A, U; mates that
    face each other or away SA, AS, U."""
    one = strand.isin(2, 3, 4)
    return F.when(kind == 0, (orient == 3) & one).otherwise(F.when(orient == 0, one).otherwise(orient.isin(1, 2) & strand.isin(0, 1, 4)))


def described(kind: Column, orient: Column, strand: Column) -> Column:
    names = lambda of, c: F.element_at(F.array(*map(F.lit, of)), c + 1)
    return F.concat(F.when(kind == 0, "single").otherwise("paired"), F.lit(","), names(ORIENTATIONS, orient), F.lit(","), names(STRANDS, strand))

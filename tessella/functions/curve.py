"""Space-filling order: rank space and Morton codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shifts and masks that spread 31 bits over every other bit.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def spread(c: Column) -> Column:
    c = c.cast("bigint").bitwiseAND(0x7FFFFFFF)
    for shift, mask in SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(mask)
    return c


def morton(rx: Column, ry: Column) -> Column:
    """Interleaved bits of two ranks of 31 bits; x takes the even places."""
    return spread(rx).bitwiseOR(F.shiftleft(spread(ry), 1))

"""Z-order keys of 21 bits an axis, by bit operations on BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 21
LIMIT = 1 << BITS
# Fixed values: (shift, mask) steps that spread 21 bits to every third place.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
# The masks by which the steps are undone.
GATHER = ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF))


def spread(v: Column) -> Column:
    x = v.cast("long").bitwiseAND(F.lit(LIMIT - 1))
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def gather(key: Column) -> Column:
    x = key.bitwiseAND(F.lit(SPREAD[-1][1]))
    for shift, mask in GATHER:
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return x


def encode(x: Column, y: Column, z: Column) -> Column:
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def decode(key: Column) -> Column:
    """STRUCT<x, y, z> of the cells of a key."""
    return F.struct(gather(key).alias("x"), gather(F.shiftrightunsigned(key, 1)).alias("y"), gather(F.shiftrightunsigned(key, 2)).alias("z"))




def keys(pos: Column, origin: tuple, size: tuple) -> tuple[Column, Column]:
    """(key, invalid) of ARRAY<FLOAT> points; invalid cells are not finite, negative or 2**21 and beyond, and have key 0."""
    cells = [((pos[i] - F.lit(origin[i]).cast("float")) / F.lit(size[i]).cast("float")).cast("float") for i in range(3)]
    bad = F.lit(False)
    for c in cells:
        bad = bad | F.isnan(c) | ~((c >= 0) & (c < LIMIT))
    safe = [F.when(bad, F.lit(0.0)).otherwise(c).cast("double") for c in cells]
    return F.when(bad, F.lit(0)).otherwise(encode(*[F.floor(c).cast("long") for c in safe])), bad

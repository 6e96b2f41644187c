"""A space-filling curve as column expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F

#: Bits of each dimension; three of them fit a long.
BITS = 20


def cell(value: Column, low, high, bits: int = BITS) -> Column:
    """Number of the equal part of low..high that a value lies in, from 0; null and NaN as 0, values beyond as the ends."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    part = F.floor((value - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)) * (1 << bits))
    inside = F.greatest(F.lit(0), F.least(part, F.lit((1 << bits) - 1)))
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(inside).cast("long")


def spread(number: Column, dimensions: int, bits: int = BITS) -> Column:
    """The lowest `bits` of a number, moved apart so that `dimensions` numbers interleave.

    Halves move away from each other, then halves of those, so the cost grows with the logarithm of `bits`.
    """
    size = 1 << (bits - 1).bit_length()
    out = number.bitwiseAND(F.lit((1 << bits) - 1))
    while size > 1:
        half = size // 2
        # Where the bits lie after this move: runs of `half` bits, one at every `half * dimensions`.
        kept = sum(1 << (half * dimensions * (i // half) + i % half) for i in range(bits))
        out = out.bitwiseOR(F.shiftleft(out, half * (dimensions - 1))).bitwiseAND(F.lit(kept))
        size = half
    return out


def z_order(*cells: Column, bits: int = BITS) -> Column:
    """Place on the Z-order curve through cells of equally many bits: near places are near in every dimension."""
    if len(cells) * bits > 63:
        raise ValueError("the key does not fit a long")
    parts = [F.shiftleft(spread(c, len(cells), bits), i) for i, c in enumerate(cells)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)

"""Integer transforms of frames, as Spark expressions over arrays of 32-bit samples.

Samples and deltas are INT and wrap modulo 2^32; zigzag values are unsigned and therefore BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO31, TWO32 = 1 << 31, 1 << 32


def wrap32(x: Column) -> Column:
    """x modulo 2^32 as a signed INT; x is BIGINT."""
    return (F.pmod(x + F.lit(TWO31), F.lit(TWO32)) - F.lit(TWO31)).cast("int")


def deltas(samples: Column) -> Column:
    """The first sample, then differences of neighbours, wrapping."""
    return F.transform(samples, lambda x, i: wrap32(x.cast("long") - F.when(i == 0, F.lit(0)).otherwise(F.get(samples, i - 1)).cast("long")))


def sum_abs(d: Column, n: int) -> Column:
    """Sum of the absolute values of the first n deltas."""
    return F.aggregate(F.slice(d, 1, n), F.lit(0).cast("long"), lambda a, x: a + F.abs(x.cast("long")))


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2, 2 ... to 0, 1, 2, 3, 4 ... (BIGINT)."""
    wide = x.cast("long")
    return F.when(wide >= 0, wide * 2).otherwise(wide * -2 - 1)


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z, 1) - 1).cast("int")


def bit_width(zigzags: Column) -> Column:
    """Bits of the largest value; 0 for none or all zero."""
    top = F.coalesce(F.array_max(zigzags), F.lit(0).cast("long"))
    return F.when(top == 0, F.lit(0)).otherwise(F.length(F.bin(top)))


def to_q15(x: Column) -> Column:
    """Clamped to 16 bits."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), x))


def from_q15(x: Column) -> Column:
    """A 16-bit value as INT."""
    return x.cast("int")


def pack_pair(low: Column, high: Column) -> Column:
    """Two 16-bit values in one INT, the first in the low half."""
    return wrap32(F.pmod(low.cast("long"), F.lit(65536)) + F.pmod(high.cast("long"), F.lit(65536)) * 65536)


def unpack_pair(x: Column) -> tuple[Column, Column]:
    wide = F.pmod(x.cast("long"), F.lit(TWO32))
    half = lambda v: F.when(v >= 32768, v - 65536).otherwise(v).cast("int")
    return half(wide % 65536), half(F.floor(wide / 65536))


def deltas_paired(samples: Column) -> Column:
    """deltas() as paired 16-bit lanes give them: within whole pairs, samples are clamped to 16 bits and differences
    wrap at 16 bits; an odd last sample has its full difference."""
    lane = lambda v: F.when(v >= 32768, v - 65536).otherwise(v)
    even = F.size(samples) - F.size(samples) % 2
    last = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(samples, i - 1))
    paired = lambda x, i: lane(F.pmod(to_q15(x).cast("long") - to_q15(last(i)).cast("long"), F.lit(65536))).cast("int")
    return F.transform(samples, lambda x, i: F.when(i < even, paired(x, i)).otherwise(wrap32(x.cast("long") - last(i).cast("long"))))


def sum_abs_saturating(d: Column, n: int) -> Column:
    """sum_abs() with every term of whole groups of four capped at 255, as byte lanes give it; the tail is exact."""
    head = F.slice(d, 1, n)
    whole = F.size(head) - F.size(head) % 4
    return F.aggregate(F.transform(head, lambda x, i: F.when(i < whole, F.least(F.abs(x.cast("long")), F.lit(255))).otherwise(F.abs(x.cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)

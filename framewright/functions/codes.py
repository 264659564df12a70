"""Bit strings, codewords and packet headers, as Spark expressions.

Bits are STRING of 0 and 1, the most significant first; bytes are upper-case hex or BINARY. Variable-length integers
have the low seven bits first, the header's count has the high byte first. What is here is for single values and for
lengths; whole frames are encoded and decoded by kernels.py.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ints import TWO32, bit_width, zigzag
from .format import BLOCK, HEADER_BYTES, MAGIC, MOST_ZEROS, RICE_LIMIT, VERSION


def upto(n: Column) -> Column:
    """0 .. n-1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def hex_byte(v: Column) -> Column:
    return F.lpad(F.hex(v.cast("long")), 2, "0")


def hex_value(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


# Bit strings: what has been written so far, or what is to be read


def write_bits(bits: Column, value: Column, width: Column, capacity: int | None = None) -> Column:
    """STRUCT(bits, status): bits with the lowest `width` bits of value after them. -9 if width is not 1 .. 32, -1 if
    they exceed `capacity` bytes."""
    wrong = (width < 1) | (width > 32)
    full = F.length(bits) + width > 8 * capacity if capacity is not None else F.lit(False)
    status = F.when(bits.isNull() | value.isNull() | width.isNull(), F.lit(None).cast("int")).when(wrong, -9).when(full, -1).otherwise(0)
    low = F.substring(F.lpad(F.bin(F.pmod(value.cast("long"), F.lit(TWO32))), 32, "0"), 33 - width, width)
    return F.struct(F.when(status == 0, F.concat(bits, low)).alias("bits"), status.alias("status"))


def read_bits(bits: Column, at: Column, width: Column) -> Column:
    """STRUCT(value, next, status): the number in `width` bits from position `at`. -9 if width is not 1 .. 32, -6 if
    there are too few."""
    status = F.when(bits.isNull() | at.isNull() | width.isNull(), F.lit(None).cast("int")).when((width < 1) | (width > 32), -9).when(F.length(bits) < at + width, -6).otherwise(0)
    value = F.conv(F.substring(bits, at + 1, width), 2, 10).cast("long")
    return F.struct(F.when(status == 0, value).alias("value"), F.when(status == 0, at + width).cast("int").alias("next"), status.alias("status"))


def align(bits: Column) -> Column:
    """bits, filled with zeros to whole bytes."""
    return F.rpad(bits, F.ceil(F.length(bits) / 8).cast("int") * 8, F.lit("0"))


def bytes_written(bits: Column) -> Column:
    return F.ceil(F.length(bits) / 8).cast("int")


def remaining_bits(bits: Column, capacity: int) -> Column:
    """Bits that a buffer of `capacity` bytes has left."""
    return F.greatest(F.lit(0), F.lit(8 * capacity) - F.length(bits))


# Variable-length integers


def varint_bytes(u: Column) -> Column:
    """Bytes that u (0 .. 2^32 - 1) takes."""
    return F.when(u < 1 << 7, 1).when(u < 1 << 14, 2).when(u < 1 << 21, 3).when(u < 1 << 28, 4).otherwise(5)


def varint_hex(u: Column) -> Column:
    parts = [F.when(F.shiftright(u, 7 * k) > 0, hex_byte(F.shiftright(u, 7 * k) % 128 + F.when(F.shiftright(u, 7 * (k + 1)) > 0, 128).otherwise(0))).otherwise("") for k in range(1, 5)]
    return F.concat(hex_byte(u % 128 + F.when(u >= 128, 128).otherwise(0)), *parts)


def varint_zigzag_hex(x: Column) -> Column:
    """varint_hex() of a signed value's zigzag."""
    return varint_hex(zigzag(x))


def varint_payload(d: Column, use_zigzag: bool = False) -> Column:
    """Deltas as unsigned integers. Without zigzag, as packets have them, a negative one takes five bytes."""
    return F.array_join(F.transform(d, lambda x: varint_zigzag_hex(x) if use_zigzag else varint_hex(F.pmod(x.cast("long"), F.lit(TWO32)))), "")


# Rice codes


def rice_k(abs_sum: Column) -> Column:
    return F.when(abs_sum > RICE_LIMIT, 3).otherwise(1)


def rice_code(v: Column, k: Column) -> Column:
    """STRUCT(bits, status) of a value: v >> k zeros, a one, k low bits. -8 if k is not 0 .. 3, -10 if there would be
    over MOST_ZEROS zeros."""
    rest = lambda n: F.lpad(F.bin(v % (1 << n)), n, "0")
    low = F.when(k == 1, rest(1)).when(k == 2, rest(2)).when(k == 3, rest(3)).otherwise("")
    zeros = F.when(k == 0, v).when(k == 1, F.shiftright(v, 1)).when(k == 2, F.shiftright(v, 2)).otherwise(F.shiftright(v, 3))
    status = F.when(v.isNull() | k.isNull(), F.lit(None).cast("int")).when((k < 0) | (k > 3), -8).when(zeros > MOST_ZEROS, -10).otherwise(0)
    return F.struct(F.when(status == 0, F.concat(F.repeat(F.lit("0"), zeros.cast("int")), F.lit("1"), low)).alias("bits"), status.alias("status"))


def rice_overflows(z: Column, k: Column) -> Column:
    return F.coalesce(F.array_max(z), F.lit(0)) >= F.when(k == 3, (MOST_ZEROS + 1) << 3).otherwise((MOST_ZEROS + 1) << 1)


# Four-bit codes


def nibble(d: Column) -> Column:
    """d / 256, rounded down, in -8 .. 7, as 0 .. 15."""
    return F.pmod(F.greatest(F.lit(-8), F.least(F.lit(7), F.shiftright(d, 8))), F.lit(16))


# Fixed-width blocks


def _blocks(z: Column) -> Column:
    return F.transform(upto(F.ceil(F.size(z) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK)))


def block_widths(z: Column) -> Column:
    """Bit width of each block of 32."""
    return F.transform(_blocks(z), bit_width)


# Header


def header_hex(count: Column, strategy: Column | int, k: Column | int) -> Column:
    strategy, k = (x if isinstance(x, Column) else F.lit(x) for x in (strategy, k))
    return F.concat(F.lit(MAGIC + "01"), F.lpad(F.hex(count.cast("long")), 4, "0"), hex_byte(strategy * 4 + k % 4))


def header(packet: Column) -> Column:
    """STRUCT(version, channel_count, strategy_id, rice_k) of a BINARY packet; null if shorter than a header."""
    h = F.hex(packet)
    part = lambda at, n: hex_value(F.substring(h, at, n)).cast("int")
    return F.when(F.length(packet) >= HEADER_BYTES, F.struct(part(9, 2).alias("version"), part(11, 4).alias("channel_count"), F.floor(part(15, 2) / 4).cast("int").alias("strategy_id"), (part(15, 2) % 4).cast("int").alias("rice_k")))


def header_status(packet: Column) -> Column:
    """0, or the first failure in this order: length, magic, version, strategy. Null for a null packet."""
    h = header(packet)
    return (
        F.when(packet.isNull(), F.lit(None).cast("int"))
        .when(F.length(packet) < HEADER_BYTES, -6)
        .when(F.substring(F.hex(packet), 1, 8) != MAGIC, -3)
        .when(h["version"] != VERSION, -4)
        .when(h["strategy_id"] > 3, -5)
        .otherwise(0)
    )

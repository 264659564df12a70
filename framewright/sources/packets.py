"""Durable packets and cursors over their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_packets(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Packets as Parquet. They are compressed already, so the files are not."""
    w = df.write.option("compression", "none")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def take_bytes(packet: Column, at: int, n: int) -> tuple[Column, Column]:
    """(bytes, status): n bytes from offset `at`, or null and -6 past the end."""
    ok = F.length(packet) >= at + n
    return F.when(ok, F.substring(packet, at + 1, n)), F.when(packet.isNull(), F.lit(None).cast("int")).when(ok, 0).otherwise(-6)


def byte_at(packet: Column, at: int) -> Column:
    """Value of a byte, null past the end."""
    return F.when(F.length(packet) > at, F.conv(F.hex(F.substring(packet, at + 1, 1)), 16, 10).cast("int"))


def remaining(packet: Column, at: int) -> Column:
    """Bytes from offset `at` to the end; empty past it."""
    return F.substring(packet, at + 1, 1 << 30)


def within_budget(packet: Column, max_bytes: int) -> Column:
    """Status of a byte budget: 0, or -1 for a packet beyond it."""
    return F.when(packet.isNull(), F.lit(None).cast("int")).when(F.length(packet) > max_bytes, -1).otherwise(0)


def append_bytes(packet: Column, more: Column, capacity: int) -> Column:
    """STRUCT(packet, status): a buffer's bytes with more after them, or null and -1 beyond its capacity. An empty BINARY
    is a new or reset buffer."""
    full = F.length(packet) + F.length(more) > capacity
    status = F.when(packet.isNull() | more.isNull(), F.lit(None).cast("int")).when(full, -1).otherwise(0)
    return F.struct(F.when(status == 0, F.concat(packet, more)).alias("packet"), status.alias("status"))


def room(packet: Column, capacity: int) -> Column:
    """Bytes that a buffer has left."""
    return F.greatest(F.lit(0), F.lit(capacity) - F.length(packet))


def split_at(packet: Column, at: int) -> Column:
    """STRUCT(head, tail, status): the bytes before and from an offset, or nulls and -6 past the end."""
    status = F.when(packet.isNull(), F.lit(None).cast("int")).when(F.length(packet) < at, -6).otherwise(0)
    ok = status == 0
    return F.struct(F.when(ok, F.substring(packet, 1, at)).alias("head"), F.when(ok, F.substring(packet, at + 1, 1 << 30)).alias("tail"), status.alias("status"))

"""Frames from long tables, and spike counts from sampled voltages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ints import wrap32


def frames(df: DataFrame, key: str | Column, order: list[str], value: Column) -> DataFrame:
    """frame_id, samples: a frame for each key, its samples in ascending order. One shuffle, by key; a frame has
    65535 samples at most to be encoded, which bounds its row."""
    key = F.col(key) if isinstance(key, str) else key
    rows = df.select(key.alias("frame_id"), F.struct(*order, value.cast("int").alias("_v")).alias("_r"))
    return rows.groupBy("frame_id").agg(F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["_v"]).alias("samples"))


def to_long(df: DataFrame, column: str = "samples", value: str = "sample") -> DataFrame:
    """frame_id, idx, value of each element of an array column."""
    return df.select("frame_id", F.posexplode(column).alias("idx", value))


def delta_long(df: DataFrame) -> DataFrame:
    """(frame_id, idx, sample) with delta: the first sample, then differences, wrapping."""
    before = F.lag("sample", 1, 0).over(Window.partitionBy("frame_id").orderBy("idx"))
    return df.withColumn("delta", wrap32(F.col("sample").cast("long") - before.cast("long")))


def undelta_long(df: DataFrame) -> DataFrame:
    """(frame_id, idx, delta) with sample, the running sum, wrapping."""
    return df.withColumn("sample", wrap32(F.sum(F.col("delta").cast("long")).over(Window.partitionBy("frame_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))))


def spikes(df: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Rows above the threshold."""
    return df.filter(F.col(value) > threshold)


def bin_counts(df: DataFrame, bin_: str, ts: str = "ts", channel: str = "channel") -> DataFrame:
    """bin_start, channel, n: rows in each tumbling bin and channel; bins and channels without any have no row."""
    return df.groupBy(F.window(ts, bin_).alias("_w"), channel).agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.col("_w.start").alias("bin_start"), F.col(channel).alias("channel"), "n")


def dense_frames(counts: DataFrame, bins: DataFrame, channels: DataFrame) -> DataFrame:
    """bin_start, samples: a frame for every row of bins (bin_start), with a count for every row of channels (channel)
    in ascending order, 0 where counts has none. Counts are folded into a map for each bin, so what is shuffled is
    counts, not bins times channels; the list of channels goes along with each bin. There may be any number of channels;
    a packet holds 65535 of them."""
    listed = channels.agg(F.sort_array(F.collect_set("channel")).alias("_all"))
    folded = counts.groupBy("bin_start").agg(F.sort_array(F.collect_list(F.struct("channel", "n"))).alias("_seen"))
    joined = bins.select("bin_start").distinct().join(folded, "bin_start", "left").join(F.broadcast(listed))  # listed is one row
    dense = F.map_from_entries(F.coalesce("_seen", F.array().cast("array<struct<channel:bigint,n:int>>")))
    zero = F.map_from_entries(F.transform("_all", lambda c: F.struct(c.alias("channel"), F.lit(0).alias("n"))))
    merged = F.map_zip_with(zero, dense, lambda _, a, b: F.coalesce(b, a))
    return joined.select("bin_start", F.transform(F.sort_array(F.map_entries(merged)), lambda e: e["value"]).alias("samples"))


def detect_and_bin(df: DataFrame, threshold: float, bin_: str, calendar: DataFrame, channels: DataFrame) -> DataFrame:
    """Threshold, count by channel and bin, fill silent bins and channels: frames ready to encode."""
    return dense_frames(bin_counts(spikes(df, threshold), bin_), calendar, channels)

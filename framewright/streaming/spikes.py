"""The detect, bin and encode pipeline as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.codecs import encode


def stream_packets(readings: DataFrame, threshold: float, bin_: str, n_channels: int, lateness: str = "0 seconds", strategy: str = "delta_varint") -> DataFrame:
    """bin_start, samples, packet, status from a stream of (ts TIMESTAMP, channel, v).

    A frame has the channels 0 .. n_channels - 1. A bin is emitted, in append mode, once the watermark has passed its
    end. Every reading opens its bin, so a bin of readings without spikes is a frame of zeros; a bin without any
    reading is not emitted. Readings later than `lateness` are dropped by the watermark, as Spark defines it.
    State is one counter for each open bin and channel with readings: the first aggregation sums by bin and channel
    and combines before its shuffle, the second gathers at most n_channels counts of a bin.
    """
    hit = F.when(F.col("v") > threshold, 1).otherwise(0)
    counts = readings.withWatermark("ts", lateness).groupBy(F.window("ts", bin_), "channel").agg(F.sum(hit).cast("int").alias("n"))
    by_bin = counts.groupBy(F.window(F.window_time("window"), bin_)).agg(F.collect_list(F.struct("channel", "n")).alias("_seen"))
    # Every channel's count, from a map of zeros over which the counts go: one step a channel.
    zeros = F.map_from_arrays(F.sequence(F.lit(0).cast("long"), F.lit(n_channels - 1).cast("long")), F.array_repeat(F.lit(0), n_channels))
    seen = F.map_from_entries(F.transform("_seen", lambda s: F.struct(s["channel"].cast("long"), s["n"])))
    merged = F.map_filter(F.map_zip_with(zeros, seen, lambda _, a, b: F.when(a.isNotNull(), F.coalesce(b, a))), lambda _, n: n.isNotNull())
    dense = by_bin.select(F.col("window.start").alias("bin_start"), F.transform(F.array_sort(F.map_entries(merged)), lambda e: e["value"]).alias("samples"))
    return encode(dense, strategy)


def write_stream(packets: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts the stream's sink: packets as Parquet files, each bin once, exactly. every: a trigger's interval; without
    one, what is there is worked off and the query ends."""
    w = packets.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("compression", "none")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start(path)

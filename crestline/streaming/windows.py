"""Event-time windows over streams: an extension beyond the batch windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hop_counts(stream: DataFrame, event_time: str, key: str, window: str, hop: str, late: str | None = None) -> DataFrame:
    """Messages and summed weight of each key and hopping window; late rows end at the watermark."""
    source = stream.withWatermark(event_time, late) if late else stream
    w = F.window(event_time, window, hop)
    out = source.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "weight")


def sessions(stream: DataFrame, event_time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each key: stretches without a gap."""
    source = stream.withWatermark(event_time, late) if late else stream
    out = source.groupBy(F.session_window(event_time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

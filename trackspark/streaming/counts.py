"""Chunk counts of strong events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_chunk_counts(events: DataFrame, keys: list[str], time: str = "ts", chunk: str = "4 seconds", late: str = "1 minute") -> DataFrame:
    """Events per key and chunk of event time; chunks close once the watermark, `late` behind, has passed them."""
    windows = events.withWatermark(time, late).groupBy(*keys, F.window(time, chunk).alias("w")).agg(F.count("*").alias("count"))
    return windows.select(*keys, F.col("w.start").alias("start"), "count")

"""Popularity over a stream of events: an extension, counted by event time in windows, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", item: str = "item_id", time: str = "ts") -> DataFrame:
    """(start, item_id, n) for batch or streaming events; in a stream, windows close when the watermark has passed them."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), item).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), item, "n")

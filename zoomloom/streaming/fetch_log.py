"""An extension: the fetch log and event streams in tumbling windows, late rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(start, keys..., events, total): works on batches and, with a watermark, on streams."""
    s = stream.withWatermark(time, late) if late and stream.isStreaming else stream
    out = s.groupBy(F.window(time, width).alias("win"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("win.start").alias("start"), *keys, "events", "total")


def first_of_id(stream: DataFrame, ident: str, time: str, late: str = "2 hours") -> DataFrame:
    """Records sent again under one id come once, as long as they are within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([ident]) if stream.isStreaming else stream.dropDuplicates([ident])

"""Windows over event tables; the same expressions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, late: str | None = None, at: str = "ts") -> DataFrame:
    """(start, event_type, n, total) of fixed windows; ``late`` sets a watermark on a stream."""
    source = events.withWatermark(at, late) if late else events
    out = source.groupBy(F.window(at, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None, at: str = "ts") -> DataFrame:
    """(start, event_type, n) of overlapping windows."""
    source = events.withWatermark(at, late) if late else events
    return source.groupBy(F.window(at, size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None, at: str = "ts") -> DataFrame:
    """(user_id, start, end, n) of runs of events no further apart than ``gap``."""
    source = events.withWatermark(at, late) if late else events
    out = source.groupBy("user_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

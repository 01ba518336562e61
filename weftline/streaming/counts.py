"""Reference counts over a stream of rows, in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, key: str, time: str, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows per key and window; rows later than ``late`` behind the newest are left out, and so state is bounded.

    On a batch frame the watermark has no effect and all rows count.
    """
    t = F.col(time).cast("timestamp")
    rows = stream.where(F.col(key).isNotNull()).select(key, t.alias("__t")).withWatermark("__t", late)
    w = F.window("__t", length, slide) if slide else F.window("__t", length)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rows per key and session; a session ends after ``gap`` without rows."""
    rows = stream.where(F.col(key).isNotNull()).select(key, F.col(time).cast("timestamp").alias("__t")).withWatermark("__t", late)
    return rows.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")

"""Event-time windows; the same functions serve batch tables and streams with a watermark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp: watermarks and session windows don't take the zoneless type."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str, by: Sequence[str], aggregates: Mapping[str, Column], *, column: str = "ts", late: str | None = None) -> DataFrame:
    """Aggregates per key and window of ``width``; ``late`` sets a watermark on a stream."""
    source = events.withWatermark(column, late) if late else events
    grouped = source.groupBy(F.window(column, width).alias("_w"), *by).agg(*[c.alias(k) for k, c in aggregates.items()])
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *aggregates)


def sessions(events: DataFrame, gap: str, by: Sequence[str], aggregates: Mapping[str, Column], *, column: str = "ts", late: str | None = None) -> DataFrame:
    """Aggregates per key and session: rows less than ``gap`` apart."""
    source = events.withWatermark(column, late) if late else events
    grouped = source.groupBy(F.session_window(column, gap).alias("_w"), *by).agg(*[c.alias(k) for k, c in aggregates.items()])
    return grouped.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *by, *aggregates)

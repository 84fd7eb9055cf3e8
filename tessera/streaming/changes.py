"""Change feeds in batches, and event-time windows (the latter are additions of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def published(changes: DataFrame, tables: list[str] | None = None, ops: tuple[str, ...] = ("insert", "update", "delete")) -> DataFrame:
    """changes(lsn, committed, table, op, ...): committed ones of a publication; no list of tables means all."""
    out = changes.where("committed").where(F.col("op").isin(*ops))
    return out if tables is None else out.where(F.col("table").isin(*tables))


def peek(changes: DataFrame, acknowledged: int, most: int = 4096) -> DataFrame:
    """What a slot has not acknowledged, in order, up to its bound."""
    return changes.where(F.col("lsn") > acknowledged).orderBy("lsn").limit(most)


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type; on a stream, later rows than the watermark are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = w.withWatermark("ts", late) if w.isStreaming else w
    return w.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = w.withWatermark("ts", gap) if w.isStreaming else w
    return w.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("until"), "n")

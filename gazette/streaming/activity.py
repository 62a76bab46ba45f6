"""Structured Streaming forms over an event stream (ts TIMESTAMP): each is a plain transform, so it
runs alike on a stream and on a table. Watermarks bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limited(events: DataFrame, client: str, width: str = "1 hour", most: int = 3, late: str = "1 hour") -> DataFrame:
    """Windows in which a client goes over the limit."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), client)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > most)
        .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), client, "n")
    )


def sessions(events: DataFrame, client: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a client: runs of events with no gap as long as this."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), client)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(client, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
    )


def first_of_visitor(events: DataFrame, keys: list[str], late: str = "5 minutes") -> DataFrame:
    """Each visitor key once within the watermark (repeats within it are dropped)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available now, through a query with a checkpoint, as an in-memory table (tests)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

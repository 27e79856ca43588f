"""Sessions that expire and are used once, and item statistics over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAPTURE_TTL, EVALUATION_TTL = "15 minutes", "30 minutes"


def active(sessions: DataFrame, now: Column, ttl: str = CAPTURE_TTL) -> DataFrame:
    """Sessions (created_at) that have not expired at ``now``."""
    return sessions.filter(F.col("created_at") + F.expr(f"INTERVAL {ttl}") > now)


def first_use(events: DataFrame, token: str, at: str) -> DataFrame:
    """A token works once: its first use."""
    n = F.row_number().over(Window.partitionBy(token).orderBy(at))
    return events.withColumn("n", n).filter("n = 1").drop("n")


def stream_once(events: DataFrame, token: str, at: str, ttl: str = EVALUATION_TTL) -> DataFrame:
    """The same over a stream: state for a token is held for the time it lives."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark([token])


def windowed(scored: DataFrame, at: str, by: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of each window and group, on a stream or a table."""
    source = scored.withWatermark(at, late) if scored.isStreaming else scored
    t = source.groupBy(F.window(at, length), by).agg(F.count("*").alias("answers"), F.sum(value).alias("total"))
    return t.select(F.col("window.start").alias("start"), by, "answers", F.round(F.col("total") + F.lit(1e-9), 4).alias("total"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what a stream has now into Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

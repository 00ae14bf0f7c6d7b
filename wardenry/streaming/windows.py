"""Windowed metrics and error rates over streams; the same functions work on batch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(df: DataFrame, watermark: str | None) -> DataFrame:
    # Watermarks need TIMESTAMP; sources may carry TIMESTAMP_NTZ.
    timed = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", watermark) if watermark and df.isStreaming else timed


def windowed_metrics(metrics: DataFrame, window: str = "1 hour", watermark: str | None = "10 minutes") -> DataFrame:
    """Per tumbling window and name: count, sum, min and max."""
    return (
        _timed(metrics, watermark)
        .groupBy(F.window("ts", window), "name")
        .agg(
            F.count("*").alias("count"), F.sum(F.col("value").cast("double")).alias("sum"),
            F.min("value").alias("min"), F.max("value").alias("max"),
        )
        .select(F.col("window.start").alias("window_start"), "name", "count", "sum", "min", "max")
    )


def windowed_error_rate(audit: DataFrame, window: str = "1 hour", watermark: str | None = "10 minutes") -> DataFrame:
    """Per tumbling window the failures as a percentage of audit events."""
    return (
        _timed(audit, watermark)
        .groupBy(F.window("ts", window))
        .agg(
            F.count("*").alias("event_count"),
            F.round(F.count_if(F.col("status") == "FAILURE") / F.count("*") * 100, 2).alias("error_rate"),
        )
        .select(F.col("window.start").alias("window_start"), "event_count", "error_rate")
    )


def start_windows(rows: DataFrame, aggregate: Callable[..., DataFrame], out: str, checkpoint: str, *, window: str = "1 hour",
                  watermark: str = "10 minutes", available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Append each window to ``out`` once, when the watermark has passed its end.

    ``aggregate`` is one of the functions above. The state holds open windows alone; rows of a window that is closed are late and
    left out, and ``accounts`` tells how many.
    """
    if not watermark:
        raise ValueError("without a watermark no window ever closes")
    writer = aggregate(rows, window, watermark).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start(out)


def accounts(spark: SparkSession, out: str, checkpoint: str, received: int, count: str = "count") -> DataFrame:
    """One row: events ``received``, in ``closed`` windows, in windows still ``open``, and ``late``, the others.

    Open windows are read from the state store of the stopped query. The engine's own figure for late rows is no count of events: it counts
    rows that were already combined within a task.
    """
    closed = spark.read.parquet(out).agg(F.coalesce(F.sum(count), F.lit(0)).alias("closed"))
    state = spark.read.format("statestore").load(checkpoint)
    waiting = state.agg(F.coalesce(F.sum(f"value.{count}"), F.lit(0)).alias("open"))
    both = closed.withColumn("_one", F.lit(1)).join(waiting.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.select(F.lit(received).cast("long").alias("received"), "closed", "open", (F.lit(received) - F.col("closed") - F.col("open")).alias("late"))

"""Quality gate: error lists, batch summary, score and circuit breaker (QLT-1..6)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenry.functions.checks import column_errors, parse_record, record_errors, required_fields

DEFAULT_THRESHOLD = 0.95


def _checked_threshold(threshold: float) -> float:
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be a number between 0 and 1")
    return float(threshold)


def with_errors(df: DataFrame, rules: Mapping[str, object], record: str | None = None) -> DataFrame:
    """Add the ``errors`` array. With ``record`` the raw JSON column is checked, otherwise the table's own columns."""
    fields = required_fields(rules)
    if record is None:
        return df.withColumn("errors", column_errors(df.columns, fields))
    parsed = df.withColumn("_parsed", parse_record(F.col(record)))
    return parsed.withColumn("errors", record_errors(F.col("_parsed"), F.col(record), fields)).drop("_parsed")


def error_table(checked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per error."""
    return checked.select(*keys, F.explode("errors").alias("_error")).select(
        *keys, "_error.field", "_error.error_type", "_error.message"
    )


def passed(errors: str = "errors") -> Column:
    return F.size(errors) == 0


def score(passed_records: Column, failed_records: Column) -> Column:
    """Share of passed records, 0.0 for an empty batch."""
    total = (passed_records + failed_records).cast("double")
    return F.coalesce(F.try_divide(passed_records.cast("double"), total), F.lit(0.0))


def with_gate(counts: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    limit = _checked_threshold(threshold)
    scored = counts.withColumn("quality_score", score(F.col("passed_records"), F.col("failed_records")))
    return scored.withColumn("circuit_breaker_triggered", F.col("quality_score") < F.lit(limit))


def summarise(checked: DataFrame, threshold: float = DEFAULT_THRESHOLD, by: list[str] | None = None) -> DataFrame:
    """Passed and failed counts with score and breaker, for the batch or per group. One partial aggregate."""
    counts = [
        F.count_if(passed()).alias("passed_records"),
        F.count_if(~passed()).alias("failed_records"),
    ]
    grouped = checked.groupBy(*by).agg(*counts) if by else checked.agg(*counts)
    return with_gate(grouped, threshold)


def rolling(checked: DataFrame, ts: str, window: str, slide: str, threshold: float = DEFAULT_THRESHOLD, by: list[str] | None = None,
            watermark: str | None = "10 minutes") -> DataFrame:
    """The gate over sliding windows of event time: each window's counts, score and breaker, over batches and streams alike.

    A stream gives a window once its watermark has passed the end; the counts of open windows are in its state, so records of many
    batches close the gate together. Each record is counted in every window that covers it.
    """
    timed = checked.withColumn("_at", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        if not watermark:
            raise ValueError("without a watermark no window ever closes")
        timed = timed.withWatermark("_at", watermark)
    counts = timed.groupBy(F.window("_at", window, slide), *(by or [])).agg(
        F.count_if(passed()).alias("passed_records"), F.count_if(~passed()).alias("failed_records")
    )
    return with_gate(counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "passed_records", "failed_records"), threshold)


def closed_spans(windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """When the gate is closed: from the end of a window that fell below the threshold to the end of the next one that did not.

    ``(by..., closed_at, reopened_at)``, ``reopened_at`` null while it is still closed. Only windows meet in a group, never records.
    """
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("window_end")
    changed = windows.withColumn("_before", F.lag("circuit_breaker_triggered", 1, False).over(order)).where("circuit_breaker_triggered <> _before")
    next_change = changed.withColumn("reopened_at", F.lead("window_end").over(order))
    return next_change.where("circuit_breaker_triggered").select(*(by or []), F.col("window_end").alias("closed_at"), "reopened_at")

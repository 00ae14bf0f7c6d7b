"""Audit trail as an append-only table (AUD-1..8)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.operators.conformance import AUDIT_STATUSES
from wardenry.schemas import moment, typed_literal


def events(rows: DataFrame, action: str | Column, *, status: str | Column = "SUCCESS", user: str | Column = "batch_job",
           tenant_id: str | Column = "tenant_id", record_id: Column | None = None, details: dict[str, Column] | None = None,
           error_message: Column | None = None, ts: object | None = None) -> DataFrame:
    """Audit rows derived from ``rows``, one each. Ids and, unless given, times are assigned here."""
    def text(value: str | Column) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    if isinstance(status, str) and status not in AUDIT_STATUSES:
        raise ValueError(f"status must be one of {AUDIT_STATUSES}")
    at = F.current_timestamp() if ts is None else moment(ts).cast("timestamp")
    pairs = [part for key, value in (details or {}).items() for part in (F.lit(key), value.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    null = F.lit(None).cast("string")
    return rows.select(
        F.uuid().alias("event_id"), at.alias("ts"), text(action).alias("action"), text(user).alias("user"),
        (F.col(tenant_id) if isinstance(tenant_id, str) else tenant_id).alias("tenant_id"),
        (null if record_id is None else record_id.cast("string")).alias("record_id"),
        (F.create_map(*pairs) if pairs else empty).alias("details"), text(status).alias("status"),
        (null if error_message is None else error_message.cast("string")).alias("error_message"),
        F.to_date(at).alias("dt"),
    )


def chronological(audit: DataFrame) -> DataFrame:
    return audit.orderBy("ts", "event_id")


def by_action(audit: DataFrame, action: str) -> DataFrame:
    return audit.where(F.col("action") == action)


def by_tenant(audit: DataFrame, tenant_id: str) -> DataFrame:
    return audit.where(F.col("tenant_id") == tenant_id)


def by_time_range(audit: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Events from ``start`` to ``end``, both included. A ``dt`` partition column prunes whole days."""
    if start > end:
        raise ValueError("start must not be after end")
    kept = audit.where(F.col("ts").between(typed_literal(audit, "ts", start), typed_literal(audit, "ts", end)))
    if "dt" in audit.columns:
        kept = kept.where(F.col("dt").between(F.lit(start.date()), F.lit(end.date())))
    return kept


def count(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("event_count"))


def retained(audit: DataFrame, as_of: object, retention_days: int | None) -> DataFrame:
    """Events young enough to keep; no period keeps everything, and an event without a time is kept."""
    if retention_days is None:
        return audit
    if retention_days < 0:
        raise ValueError("retention_days must not be negative")
    cutoff = typed_literal(audit, "ts", as_of) - F.make_dt_interval(days=F.lit(retention_days))
    return audit.where((F.col("ts") >= cutoff) | F.col("ts").isNull())


def expired(audit: DataFrame, as_of: object, retention_days: int) -> DataFrame:
    """Events past the retention period, the complement of ``retained``."""
    if retention_days < 0:
        raise ValueError("retention_days must not be negative")
    cutoff = typed_literal(audit, "ts", as_of) - F.make_dt_interval(days=F.lit(retention_days))
    return audit.where(F.col("ts") < cutoff)

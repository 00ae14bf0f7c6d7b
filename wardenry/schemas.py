"""Table schemas of the governance entities."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
_TS = T.TimestampType()
_MAP = T.MapType(_S, _S)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS = _table(
    schema_id=_S, name=_S, version=_S, description=_S, field=_S, ord=T.IntegerType(), type=_S,
    required=T.BooleanType(), sensitive=T.BooleanType(), masking_strategy=_S,
    extra=_MAP, registered_at=_TS,
)
QUALITY_RUNS = _table(
    batch_id=_S, tenant_id=_S, passed_records=T.LongType(), failed_records=T.LongType(),
    quality_score=T.DoubleType(), circuit_breaker_triggered=T.BooleanType(),
)
QUALITY_ERRORS = _table(batch_id=_S, record_key=_S, field=_S, error_type=_S, message=_S)
AUDIT = _table(
    event_id=_S, ts=_TS, action=_S, user=_S, tenant_id=_S, record_id=_S, details=_MAP,
    status=_S, error_message=_S, dt=T.DateType(),
)
LINEAGE = _table(
    event_id=_S, ts=_TS, source_dataset=_S, destination_dataset=_S, transformation=_S,
    user=_S, tenant_id=_S, metadata=_MAP,
)
ERASURE_REQUESTS = _table(
    request_id=_S, user_id=_S, tenant_id=_S, reason=_S, fields_to_delete=T.ArrayType(_S),
    created_at=_TS, status=_S, executed_at=_TS, error_message=_S,
)
ERASURE_STATES = _table(request_id=_S, status=_S, ts=_TS, error_message=_S)
VAULT = _table(
    token_id=_S, value=_S, created_at=_TS, expires_at=_TS, tenant_id=_S, user_id=_S, field=_S,
)
METRICS = _table(metric_id=_S, name=_S, value=T.DoubleType(), ts=_TS, labels=_MAP)
TENANTS = _table(
    tenant_id=_S, name=_S, enabled=T.BooleanType(), allowed_resources=T.ArrayType(_S),
    allowed_connector_types=T.ArrayType(_S),
)
JOB_RUNS = _table(
    job_type=_S, tenant_id=_S, status=_S, start_time=_TS, end_time=_TS, elapsed_seconds=T.DoubleType(),
    records_processed=T.LongType(), records_failed=T.LongType(), error_message=_S,
    warnings=T.ArrayType(_S), details=_MAP,
)
MESSAGES = _table(
    offset=T.LongType(), value=T.BinaryType(), partition=T.IntegerType(), timestamp=_TS,
)


def moment(value: object) -> Column:
    """A point in time as an expression. A naive ``datetime`` is UTC, whatever the time zone of the driver's machine."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def typed_literal(df: DataFrame, column: str, value: object) -> Column:
    """``value`` in the type of ``column``, so the comparison folds and reaches the parquet scan.

    Comparing a TIMESTAMP_NTZ column with a TIMESTAMP literal would cast the column and lose the pushdown.
    """
    literal = moment(value) if isinstance(value, (Column, datetime)) else F.lit(value)
    return literal.cast(df.schema[column].dataType)

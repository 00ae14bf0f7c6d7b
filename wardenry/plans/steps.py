"""Ordered read and write steps published together, and audited single operations (JOB-5, JOB-6)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenry.functions.patterns import tenant_id_denial
from wardenry.operators import audit, tenancy
from wardenry.operators.conformance import CONNECTOR_TYPES
from wardenry.plans.jobs import log_audit
from wardenry.sources.versioned import TableStore

# Fixed value.
EXECUTE_RESOURCE = "pipeline:execute"
STEP_RESULTS = "step int, connector_type string, operation string, destination string, status string, records long"


class AccessDenied(PermissionError):
    """The tenant may not use the resource."""


class StepsFailed(RuntimeError):
    """A step failed, so no step was published."""


@dataclass(frozen=True)
class Step:
    """A read names a table in ``query``; a write takes a DataFrame, or a function of the steps read so far."""

    connector_type: str
    operation: str
    query: str | None = None
    destination: str | None = None
    data: DataFrame | Callable[[dict[int, DataFrame]], DataFrame] | None = None


def require_access(store: TableStore, tenants: DataFrame, tenant_id: str, resource: str) -> None:
    """Raise, after auditing the denial, unless the policy allows the tenant to use the resource."""
    asked = store.spark.createDataFrame([(tenant_id, resource)], "tenant_id string, resource string")
    policies = tenants.where(F.col("tenant_id") == tenant_id)
    verdict = tenancy.decide(asked, policies)
    row = verdict.first()
    if row.decision == "deny":
        with store.transaction() as change:
            log_audit(change, tenancy.denial_events(verdict))
        raise AccessDenied(f"{tenant_id} may not use {resource}: {row.reason}")


def _check_step(number: int, step: Step) -> None:
    if not step.connector_type or not step.operation:
        raise ValueError(f"step {number} lacks a connector type or an operation")
    if step.operation not in ("read", "write"):
        raise ValueError(f"unknown operation: {step.operation}")
    if step.connector_type not in CONNECTOR_TYPES:
        raise ValueError(f"unsupported connector type: {step.connector_type}")


def run_steps(store: TableStore, tenants: DataFrame, tenant_id: str, steps: list[Step]) -> DataFrame:
    """Run the steps in order and publish all writes in one commit; any failure publishes none of them.

    Returns one result row per step. Reads stay lazy DataFrames: they run inside the writes that use them.
    """
    spark = store.spark
    if not steps:
        return spark.createDataFrame([], STEP_RESULTS)
    require_access(store, tenants, tenant_id, EXECUTE_RESOURCE)
    one = spark.createDataFrame([(tenant_id,)], "tenant_id string")
    results = []
    try:
        with store.transaction() as change:
            reads: dict[int, DataFrame] = {}
            for number, step in enumerate(steps):
                try:
                    _check_step(number, step)
                    if step.operation == "read":
                        table = store.read(step.query, change.base)
                        reads[number] = table.where(F.col("tenant_id") == tenant_id) if "tenant_id" in table.columns else table
                        results.append((number, step.connector_type, "read", None, "success", None))
                    else:
                        rows = step.data(reads) if callable(step.data) else step.data
                        folder = change.new_folder(step.destination)
                        owned = rows.withColumn("tenant_id", F.lit(tenant_id))
                        owned.write.parquet(folder)
                        written = spark.read.schema(owned.schema).parquet(folder).count()
                        change.adopt(step.destination, folder, owned.schema)
                        results.append((number, step.connector_type, "write", step.destination, "success", written))
                except Exception as error:
                    raise StepsFailed(f"failed at step {number}: {error}") from error
            details = {"steps": F.lit(len(steps)), "connector_types": F.lit(",".join(sorted({s.connector_type for s in steps})))}
            log_audit(change, audit.events(one, "PIPELINE_SUCCESS", user="system", details=details))
    except StepsFailed as error:
        with store.transaction() as change:
            log_audit(change, audit.events(
                one, "PIPELINE_FAILED", user="system", status="FAILURE", error_message=F.lit(str(error)),
                details={"error": F.lit(str(error)), "steps_done": F.lit(len(results))},
            ))
        raise
    return spark.createDataFrame(results, STEP_RESULTS)


def _log_operation(store: TableStore, tenant_id: str, action: str, resource: str, error: Exception | None) -> None:
    one = store.spark.createDataFrame([(tenant_id,)], "tenant_id string")
    with store.transaction() as change:
        log_audit(change, audit.events(
            one, action, user="system", details={"resource": F.lit(resource)},
            status="SUCCESS" if error is None else "FAILURE",
            error_message=None if error is None else F.lit(str(error)),
        ))


def tenant_read(store: TableStore, tenants: DataFrame, tenant_id: str, table: str, kind: str = "postgresql") -> DataFrame:
    """Access check, tenant-scoped read, one ``READ_OPERATION`` audit row."""
    resource = f"{kind}:{table}"
    require_access(store, tenants, tenant_id, resource)
    failure: Exception | None = None
    try:
        return store.read(table).where(F.col("tenant_id") == tenant_id)
    except Exception as error:
        failure = error
        raise
    finally:
        _log_operation(store, tenant_id, "READ_OPERATION", resource, failure)


def tenant_write(store: TableStore, tenants: DataFrame, tenant_id: str, table: str, rows: DataFrame, kind: str = "postgresql") -> None:
    """Access check, append under the tenant's id, one ``WRITE_OPERATION`` audit row."""
    resource = f"{kind}:{table}"
    require_access(store, tenants, tenant_id, resource)
    failure: Exception | None = None
    try:
        with store.transaction() as change:
            change.append(table, rows.withColumn("tenant_id", F.lit(tenant_id)))
    except Exception as error:
        failure = error
        raise
    finally:
        _log_operation(store, tenant_id, "WRITE_OPERATION", resource, failure)


def valid_tenant(df: DataFrame) -> DataFrame:
    """Rows whose tenant id may be used at all."""
    return df.where(tenant_id_denial(F.col("tenant_id")).isNull())

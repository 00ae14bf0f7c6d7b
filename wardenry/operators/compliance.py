"""Compliance checks per tenant and their roll-up (JOB-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
CHECKS = ("pii_masking", "lineage", "audit_logs", "retention")
CHECK_TYPES = {
    "full": CHECKS,
    "pii": ("pii_masking",),
    "lineage": ("lineage",),
    "audit": ("audit_logs",),
    "retention": ("retention",),
}
FOUND = {
    "pii_masking": "PII masking events",
    "lineage": "lineage tracking events",
    "audit_logs": "audit log entries",
    "retention": "retention/erasure records",
}
NOT_FOUND = {
    "pii_masking": "No PII masking events found for tenant",
    "lineage": "No lineage events found for tenant",
    "audit_logs": "No audit log entries found for tenant",
    "retention": "No retention policy enforcement records found",
}


def checks_for(check_type: str) -> tuple[str, ...]:
    """Names of the checks of a type; an unknown type runs all of them."""
    return CHECK_TYPES.get(check_type, CHECKS)


def check_tenants(tenants: DataFrame, audit: DataFrame, edges: DataFrame, requests: DataFrame,
                  check_type: str = "full", masking_action: str = "MASK_RECORD") -> DataFrame:
    """``(tenant_id, check_name, status, event_count, message)``: a check passes with one matching event.

    Every log is counted per tenant before the join, so the join sees one row per tenant and log.
    """
    wanted = checks_for(check_type)
    counts: dict[str, DataFrame] = {}
    if {"pii_masking", "audit_logs"} & set(wanted):
        per_tenant = audit.groupBy("tenant_id").agg(
            F.count_if(F.col("action") == masking_action).alias("pii_masking"), F.count("*").alias("audit_logs")
        )
        counts["audit"] = per_tenant
    if "lineage" in wanted:
        counts["lineage"] = edges.groupBy("tenant_id").agg(F.count("*").alias("lineage"))
    if "retention" in wanted:
        counts["retention"] = requests.groupBy("tenant_id").agg(F.count("*").alias("retention"))
    joined = tenants.select("tenant_id").distinct()
    for counted in counts.values():
        joined = joined.join(counted, "tenant_id", "left")
    rows = [
        F.struct(
            F.lit(name).alias("check_name"), F.coalesce(F.col(name), F.lit(0)).cast("long").alias("event_count"),
            F.lit(FOUND[name]).alias("found"), F.lit(NOT_FOUND[name]).alias("not_found"),
        )
        for name in wanted
    ]
    has_any = F.col("event_count") > 0
    return joined.select("tenant_id", F.explode(F.array(*rows)).alias("_c")).select("tenant_id", "_c.*").select(
        "tenant_id", "check_name",
        F.when(has_any, "pass").otherwise("warning").alias("status"), "event_count",
        F.when(has_any, F.concat(F.lit("Found "), F.col("event_count").cast("string"), F.lit(" "), F.col("found")))
        .otherwise(F.col("not_found")).alias("message"),
    )


def roll_up(checks: DataFrame) -> DataFrame:
    """Overall status per tenant: no failed check is success, fewer than half is a warning, otherwise failure."""
    passed, failed = F.col("checks_passed"), F.col("checks_failed")
    return (
        checks.groupBy("tenant_id")
        .agg(
            F.count_if(F.col("status") == "pass").alias("checks_passed"),
            F.count_if(F.col("status") != "pass").alias("checks_failed"),
        )
        .withColumn(
            "overall_status",
            F.when(failed == 0, "success").when(failed * 2 < passed + failed, "warning").otherwise("failure"),
        )
        .withColumn(
            "error_message",
            F.when(
                F.col("overall_status") == "failure",
                F.concat(F.lit("Compliance check failed: "), failed.cast("string"), F.lit(" issues found")),
            ),
        )
    )

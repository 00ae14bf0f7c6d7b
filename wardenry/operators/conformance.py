"""One conformance job for all entities: named violation conditions, one output row per breach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenry.functions.masking import STRATEGIES

# Fixed values.
AUDIT_STATUSES = ("SUCCESS", "FAILURE")
ERASURE_STATUSES = ("PENDING", "IN_PROGRESS", "COMPLETE", "FAILED")
CONNECTOR_TYPES = ("s3", "gcs", "adls", "kafka", "pubsub", "postgresql", "mongodb", "snowflake")


def blank(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def outside(name: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(name).isin(*allowed), F.lit(False))


def violations(df: DataFrame, rules: list[tuple[str, Column]], keys: list[str]) -> DataFrame:
    """Rows ``(keys..., rule)`` for every rule whose breach condition holds. One narrow pass."""
    broken = F.array_compact(F.array(*[F.when(breach, F.lit(rule)) for rule, breach in rules]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def audit_rules() -> list[tuple[str, Column]]:
    rules = [(f"{c}_empty", blank(c)) for c in ("event_id", "action", "user", "tenant_id")]
    rules.append(("ts_missing", F.col("ts").isNull()))
    rules.append(("status_invalid", outside("status", AUDIT_STATUSES)))
    rules.append(("failure_without_message", (F.col("status") == "FAILURE") & blank("error_message")))
    return rules


def audit_violations(audit: DataFrame) -> DataFrame:
    return violations(audit, audit_rules(), ["event_id"])


def lineage_violations(edges: DataFrame) -> DataFrame:
    names = ("event_id", "source_dataset", "destination_dataset", "transformation", "user", "tenant_id")
    return violations(edges, [(f"{c}_empty", blank(c)) for c in names], ["event_id"])


def request_rules() -> list[tuple[str, Column]]:
    rules = [(f"{c}_empty", blank(c)) for c in ("request_id", "user_id", "tenant_id", "reason")]
    fields = F.col("fields_to_delete")
    rules.append(("fields_empty", F.coalesce(F.size(fields) <= 0, F.lit(True))))
    rules.append(("field_name_empty", F.coalesce(F.exists(fields, lambda f: f.isNull() | (f == "")), F.lit(False))))
    rules.append(("created_at_missing", F.col("created_at").isNull()))
    rules.append(("status_invalid", outside("status", ERASURE_STATUSES)))
    rules.append(("failed_without_message", (F.col("status") == "FAILED") & blank("error_message")))
    return rules


def request_violations(requests: DataFrame) -> DataFrame:
    return violations(requests, request_rules(), ["request_id"])


def metric_violations(metrics: DataFrame) -> DataFrame:
    rules = [(f"{c}_empty", blank(c)) for c in ("metric_id", "name")]
    rules += [(f"{c}_missing", F.col(c).isNull()) for c in ("value", "ts", "labels")]
    return violations(metrics, rules, ["metric_id"])


def quality_run_violations(runs: DataFrame) -> DataFrame:
    score = F.col("quality_score")
    rules = [
        ("batch_id_empty", blank("batch_id")),
        ("passed_records_negative", F.coalesce(F.col("passed_records") < 0, F.lit(True))),
        ("failed_records_negative", F.coalesce(F.col("failed_records") < 0, F.lit(True))),
        ("quality_score_out_of_range", F.coalesce(F.isnan(score) | (score < 0) | (score > 1), F.lit(True))),
    ]
    return violations(runs, rules, ["batch_id"])


def tenant_violations(tenants: DataFrame) -> DataFrame:
    known = F.array(*[F.lit(t) for t in CONNECTOR_TYPES])
    unknown = F.size(F.array_except(F.col("allowed_connector_types"), known)) > 0
    is_list = isinstance(tenants.schema["allowed_resources"].dataType, T.ArrayType)
    rules = [
        ("tenant_id_empty", blank("tenant_id")),
        ("name_missing", F.col("name").isNull()),
        ("allowed_resources_not_a_list", F.lit(not is_list) & F.col("allowed_resources").isNotNull()),
        ("connector_type_unknown", F.coalesce(unknown, F.lit(False))),
    ]
    return violations(tenants, rules, ["tenant_id"])


def strategy_violations(schemas: DataFrame) -> DataFrame:
    """Sensitive fields that declare a strategy the engine does not know."""
    declared = F.col("masking_strategy")
    unknown = F.col("sensitive") & declared.isNotNull() & ~F.lower(declared).isin(*STRATEGIES)
    return violations(schemas, [("masking_strategy_unknown", unknown)], ["schema_id", "field"])

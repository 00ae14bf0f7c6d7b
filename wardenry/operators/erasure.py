"""Erasure requests: intake, state machine, token, field and record erasure (ERA-1..9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.functions.masking import is_blank
from wardenry.operators import audit
from wardenry.operators.conformance import request_rules
from wardenry.operators.joins import lookup_join
from wardenry.schemas import moment

# Fixed values.
NEXT_STATES = {"PENDING": ("IN_PROGRESS",), "IN_PROGRESS": ("COMPLETE", "FAILED")}


def intake(submitted: DataFrame, ts: object | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted requests with id, time and PENDING status, and the rejected ones with the rules they break."""
    at = F.current_timestamp() if ts is None else moment(ts).cast("timestamp")
    request_id = F.col("request_id") if "request_id" in submitted.columns else F.uuid()
    rows = submitted.select(
        request_id.alias("request_id"), "user_id", "tenant_id", "reason", "fields_to_delete",
        at.alias("created_at"), F.lit("PENDING").alias("status"),
        F.lit(None).cast("timestamp").alias("executed_at"), F.lit(None).cast("string").alias("error_message"),
    )
    broken = F.array_compact(F.array(*[F.when(breach, F.lit(name)) for name, breach in request_rules()]))
    judged = rows.withColumn("broken_rules", broken)
    return judged.where(F.size("broken_rules") == 0).drop("broken_rules"), judged.where(F.size("broken_rules") > 0)


def submission_events(accepted: DataFrame) -> DataFrame:
    return audit.events(
        accepted, "ERASURE_REQUEST_SUBMITTED", user=F.col("user_id"), record_id=F.col("request_id"), ts=F.col("created_at"),
        details={"reason": F.col("reason"), "fields": F.to_json("fields_to_delete")},
    )


def current_states(states: DataFrame) -> DataFrame:
    """Latest state of every request. At equal times the state further along wins."""
    rank = (
        F.when(F.col("status") == "PENDING", 0).when(F.col("status") == "IN_PROGRESS", 1).otherwise(2)
    )
    latest = F.max(F.struct("ts", rank.alias("rank"), "status")).alias("_latest")
    return states.groupBy("request_id").agg(latest).select(
        "request_id", F.col("_latest.status").alias("status"), F.col("_latest.ts").alias("ts")
    )


def judge_transitions(states: DataFrame, proposed: DataFrame) -> DataFrame:
    """Adds ``from_status`` and ``problem`` (NULL when allowed) to rows ``(request_id, status)``."""
    now = current_states(states).select("request_id", F.col("status").alias("from_status"))
    allowed = F.lit(False)
    for start, ends in NEXT_STATES.items():
        allowed = allowed | ((F.col("from_status") == start) & F.col("status").isin(*ends))
    return lookup_join(proposed, now, ["request_id"]).withColumn(
        "problem",
        F.when(F.col("from_status").isNull(), "unknown_request").when(~allowed, "transition_not_allowed"),
    )


def executable(states: DataFrame, asked: DataFrame) -> DataFrame:
    """Whether each asked request may be executed: only a PENDING one may."""
    proposed = asked.select("request_id").distinct().withColumn("status", F.lit("IN_PROGRESS"))
    return judge_transitions(states, proposed)


def outcome(executed: DataFrame, failed_tokens: Column) -> DataFrame:
    """Final status of executed requests from the number of tokens that could not be deleted."""
    return executed.withColumn("status", F.when(failed_tokens > 0, "FAILED").otherwise("COMPLETE")).withColumn(
        "error_message",
        F.when(failed_tokens > 0, F.concat(F.lit("Failed to delete "), failed_tokens.cast("string"), F.lit(" tokens"))),
    )


def execution_events(executed: DataFrame, ts: object | None = None) -> DataFrame:
    """The start and the end audit row of every executed request."""
    started = audit.events(
        executed, "ERASURE_EXECUTION_STARTED", user=F.col("user_id"), record_id=F.col("request_id"), ts=ts
    )
    failed = F.col("status") == "FAILED"
    ended = audit.events(
        executed,
        F.when(failed, "ERASURE_EXECUTION_FAILED").otherwise("ERASURE_EXECUTION_COMPLETED"),
        user=F.col("user_id"), record_id=F.col("request_id"), ts=ts,
        status=F.when(failed, "FAILURE").otherwise("SUCCESS"), error_message=F.col("error_message"),
        details={"fields_erased": F.to_json("fields_to_delete")},
    )
    return started.unionByName(ended)


def by_status(requests: DataFrame, status: str) -> DataFrame:
    return requests.where(F.col("status") == status)


def by_tenant(requests: DataFrame, tenant_id: str) -> DataFrame:
    return requests.where(F.col("tenant_id") == tenant_id)


def by_id(requests: DataFrame, request_id: str) -> DataFrame:
    return requests.where(F.col("request_id") == request_id)


def count(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("request_count"))


def doomed_tokens(vault: DataFrame, requests: DataFrame, scope: str = "owner") -> DataFrame:
    """Vault rows the requests erase: those of the requesting user's fields, or every row with scope ``all``."""
    if scope not in ("owner", "all"):
        raise ValueError("scope must be owner or all")
    if scope == "all":
        # Any request at all erases the whole vault; the existence test is one scalar, not a join.
        return vault.where(requests.agg((F.count("*") > 0).alias("any_request")).scalar())
    owned = requests.select("tenant_id", "user_id", F.explode("fields_to_delete").alias("field")).distinct()
    return lookup_join(vault, owned, ["tenant_id", "user_id", "field"], "left_semi")


def erase_tokens(vault: DataFrame, requests: DataFrame, scope: str = "owner") -> DataFrame:
    """The vault after the requests."""
    if scope == "all":
        return vault.where(requests.agg((F.count("*") == 0).alias("no_request")).scalar())
    if scope != "owner":
        raise ValueError("scope must be owner or all")
    owned = requests.select("tenant_id", "user_id", F.explode("fields_to_delete").alias("field")).distinct()
    return lookup_join(vault, owned, ["tenant_id", "user_id", "field"], "left_anti")


def erase_fields(df: DataFrame, requests: DataFrame, fields: list[str], keys: tuple[str, ...] = ("tenant_id", "user_id")) -> DataFrame:
    """Null the requested fields of the requesting users' rows.

    All requests of a user become one row of flags first, so the data side is never multiplied; a user with very many
    rows is split by the skew join.
    """
    flags = requests.groupBy(*keys).agg(
        *[F.bool_or(F.array_contains("fields_to_delete", f)).alias(f"_erase_{f}") for f in fields]
    )
    joined = lookup_join(df, flags, list(keys))
    kept = [
        F.when(F.col(f"_erase_{c}"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in df.columns
    ]
    return joined.select(*kept)


def erase_records(df: DataFrame, record_ids: DataFrame, key: str) -> DataFrame:
    """The table without the listed records."""
    return lookup_join(df, record_ids.select(key).distinct(), [key], "left_anti")


def record_outcomes(df: DataFrame, record_ids: DataFrame, key: str) -> DataFrame:
    """Per listed id how many rows it erases; zero means the id was not found."""
    asked = record_ids.select(key).distinct()
    held = lookup_join(df, asked, [key], "left_semi").groupBy(key).agg(F.count("*").alias("erased_rows"))
    return asked.join(held, key, "left").select(key, F.coalesce("erased_rows", F.lit(0).cast("long")).alias("erased_rows"))


def unmasked_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """How many values of each field are still present, to verify an erasure."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.agg(*[F.count_if(~is_blank(F.col(f), kinds[f])).alias(f) for f in fields])

"""Tenant ids, resource policies and access decisions (TEN-1..8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenry.functions import patterns as pt
from wardenry.operators import audit
from wardenry.operators.joins import lookup_join
from wardenry.session import broadcast_if_small


def id_denial(df: DataFrame, tenant_id: str = "tenant_id") -> Column:
    """Denial reason of the id column; a column that is not text is of an invalid type throughout."""
    if not isinstance(df.schema[tenant_id].dataType, T.StringType):
        return F.when(F.col(tenant_id).isNull(), "empty_tenant_id").otherwise("invalid_type")
    return pt.tenant_id_denial(F.col(tenant_id))


def check_ids(df: DataFrame, tenant_id: str = "tenant_id") -> DataFrame:
    return df.withColumn("denial_reason", id_denial(df, tenant_id))


def latest_registrations(tenants: DataFrame) -> DataFrame:
    """One row per tenant: the newest by ``registered_at``, where the table has it.

    Of registrations that are equally new a disabled one stays, then the one whose JSON text is greatest, so that a
    request has one decision and reruns agree.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in tenants.columns])
    newest = [F.col("registered_at")] if "registered_at" in tenants.columns else []
    order = F.struct(*newest, (~F.coalesce("enabled", F.lit(True))).alias("disabled"), F.to_json(row).alias("text"))
    last = tenants.groupBy("tenant_id").agg(F.max_by(row, order).alias("_row"))
    return last.select(*[F.col("_row")[c].alias(c) for c in tenants.columns])


# Entries of a list that travels with its tenant's requests; the entries of a longer one are rows that requests are joined with.
LISTED = 1_000
# Steps of a binary search, for lists of up to twice as many entries.
_STEPS = [1 << n for n in range(23, -1, -1)]


def _in_sorted(value: Column, entries: Column) -> Column:
    """Whether a sorted array holds the value: a binary search, so a list of thousands costs a dozen comparisons."""
    steps = F.filter(F.array(*map(F.lit, _STEPS)), lambda step: step <= F.size(entries))
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(entries, at + step - 1) <= value, step).otherwise(0))
    return F.coalesce(F.get(entries, below - 1) == value, F.lit(False))


def _is_regex(pattern: Column) -> Column:
    return pattern.startswith(pt.REGEX_PREFIX)


def _is_prefix(pattern: Column) -> Column:
    return pattern.rlike(r"\A[^*?\[]*\*\z") & ~_is_regex(pattern)


def _is_glob(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]") & ~_is_prefix(pattern)


def compile_policies(tenants: DataFrame) -> DataFrame:
    """Sort every allow-list into exact names, plain prefixes and regular expressions, once per tenant.

    Names and prefixes are sorted, and prefixes are filed with the lengths they have: a resource is looked up once, and its start once a
    length. Only real globs and expressions run the regex engine.
    """
    listed = F.coalesce("allowed_resources", F.array().cast("array<string>"))
    anchored = F.transform(
        F.filter(listed, _is_regex),
        lambda p: F.concat(F.lit(r"\A(?:"), F.substr(p, F.lit(len(pt.REGEX_PREFIX) + 1)), F.lit(")")),
    )
    prefixes = F.array_sort(F.array_distinct(F.transform(F.filter(listed, _is_prefix), lambda p: F.regexp_replace(p, r"\*\z", ""))))
    return tenants.select(
        "tenant_id", "enabled", "allowed_connector_types",
        (F.size(listed) > 0).alias("_restricted"),
        F.array_sort(F.array_distinct(F.array_compact(listed))).alias("_exact"),
        prefixes.alias("_prefixes"), F.array_distinct(F.transform(prefixes, F.length)).alias("_lengths"),
        F.concat(F.transform(F.filter(listed, _is_glob), pt.glob_regex), anchored).alias("_regexes"),
    )


def allowed(resource: Column) -> Column:
    """Whether any pattern of the compiled policy on the same row matches."""
    return (
        _in_sorted(resource, F.col("_exact"))
        | F.exists("_lengths", lambda n: (F.length(resource) >= n) & _in_sorted(F.left(resource, n), F.col("_prefixes")))
        | F.exists("_regexes", lambda p: F.call_function("rlike", resource, p))
    )


def matching_patterns(requests: DataFrame, tenants: DataFrame, resource: str = "resource") -> DataFrame:
    """Each request with the patterns of its own tenant that match it. Equi-join on the tenant, no pattern pairs."""
    lists = latest_registrations(tenants).select("tenant_id", "allowed_resources")
    joined = requests.join(broadcast_if_small(lists), "tenant_id")
    return joined.withColumn(
        "matched", F.filter("allowed_resources", lambda p: pt.matches(F.col(resource), p))
    ).drop("allowed_resources")


def _as_rows(requests: DataFrame, tenants: DataFrame, entries: DataFrame, resource: str) -> tuple[DataFrame, DataFrame]:
    """Long allow-lists, their ``entries`` (tenant_id, pattern) being rows, in two parts.

    First ``tenants``, whose lists are left with their globs and expressions, and with a name no request can match where nothing else is left
    that tells a restricted tenant; then the distinct ``(tenant_id, resource)`` of requests whose name, or whose start of a length that the
    tenant's prefixes have, is an entry.
    """
    pattern = F.col("pattern")
    regular = entries.where(_is_glob(pattern) | _is_regex(pattern)).select("tenant_id", pattern.alias("_regular"))
    lists = entries.select("tenant_id").distinct().join(regular.groupBy("tenant_id").agg(F.collect_set("_regular").alias("_regular")), "tenant_id", "left")
    unmatched = F.array(F.lit(None).cast("string"))
    kept = F.when(F.col("_long"), F.coalesce("_regular", unmatched)).otherwise(F.col("allowed_resources"))
    short = tenants.join(broadcast_if_small(lists.withColumn("_long", F.lit(True))), "tenant_id", "left").withColumn("allowed_resources", kept).select(*tenants.columns)
    # A name has the length -1, so that it meets whole resources alone.
    prefix = F.when(_is_prefix(pattern), F.regexp_replace(pattern, r"\*\z", ""))
    filed = entries.where(pattern.isNotNull()).select("tenant_id", F.coalesce(F.length(prefix), F.lit(-1)).alias("_length"), F.coalesce(prefix, pattern).alias("_start")).distinct()
    lengths = filed.groupBy("tenant_id").agg(F.collect_set("_length").alias("_lengths"))
    asked = requests.select("tenant_id", F.col(resource)).join(broadcast_if_small(lengths), "tenant_id").where(F.col(resource).isNotNull())
    starts = asked.select("tenant_id", resource, F.explode(F.filter("_lengths", lambda n: n <= F.length(resource))).alias("_length")).withColumn(
        "_start", F.when(F.col("_length") < 0, F.col(resource)).otherwise(F.left(resource, F.col("_length"))))
    return short, lookup_join(starts, filed, ["tenant_id", "_length", "_start"], "left_semi").select("tenant_id", resource).distinct()


def decide(requests: DataFrame, tenants: DataFrame, resource: str = "resource", connector_type: str | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """Adds ``decision`` and ``reason``.

    The last registration of a tenant counts. An invalid id is denied, an unregistered tenant is allowed, a disabled one denied, an empty list allows all,
    otherwise some pattern must match. With ``connector_type`` the tenant's connector allow-list must hold too. Rows ``(tenant_id, pattern)`` of
    ``patterns`` are added to the list of their tenant, for lists too long for a row.
    """
    latest = latest_registrations(tenants)
    one = F.explode("allowed_resources").alias("pattern")
    if patterns is not None:
        entries = latest.select("tenant_id", one).unionByName(patterns.select("tenant_id", "pattern"))
    else:
        entries = latest.where(F.size("allowed_resources") > LISTED).select("tenant_id", one)
        entries = None if entries.isEmpty() else entries
    if entries is not None:
        latest, found = _as_rows(requests, latest, entries, resource)
    policies = broadcast_if_small(compile_policies(latest).withColumn("_registered", F.lit(True)))
    judged = check_ids(requests).join(policies, "tenant_id", "left")
    fits = allowed(F.col(resource))
    if entries is not None:
        judged = lookup_join(judged, found.withColumn("_found", F.lit(True)), ["tenant_id", resource])
        fits = F.coalesce("_found", F.lit(False)) | fits
    refusal = (
        F.when(F.col("denial_reason").isNotNull(), F.col("denial_reason"))
        .when(F.col("_registered").isNull(), F.lit(None).cast("string"))
        .when(~F.coalesce("enabled", F.lit(True)), "tenant_disabled")
    )
    if connector_type is not None:
        types = F.col("allowed_connector_types")
        limited = F.coalesce(F.size(types) > 0, F.lit(False))
        refusal = refusal.when(limited & ~F.array_contains(types, F.col(connector_type)), "connector_type_not_allowed")
    refusal = refusal.when(F.col("_restricted") & ~fits, "resource_not_allowed")
    return judged.withColumn("_refusal", refusal).select(
        *requests.columns,
        F.when(F.col("_refusal").isNull(), "allow").otherwise("deny").alias("decision"),
        F.coalesce(
            "_refusal",
            F.when(F.col("_registered").isNull(), "unregistered").when(F.col("_restricted"), "matched").otherwise("unrestricted"),
        ).alias("reason"),
    )


def denial_events(decisions: DataFrame, ts: object | None = None, resource: str = "resource") -> DataFrame:
    """One audit row per denied request."""
    denied = decisions.where(F.col("decision") == "deny")
    return audit.events(
        denied, "TENANT_ACCESS_DENIED", user="system", status="FAILURE", error_message=F.col("reason"), ts=ts,
        tenant_id=F.when(F.col("tenant_id").isNull() | (F.col("tenant_id") == ""), "UNKNOWN").otherwise(F.col("tenant_id")),
        details={"resource": F.col(resource), "reason": F.col("reason")},
    )


def check_paths(df: DataFrame, path: str = "path", listing: bool = False) -> DataFrame:
    return df.withColumn("denial_reason", pt.path_denial(F.col(path), listing))


def object_key(tenant_id: Column, path: Column) -> Column:
    return F.concat_ws("/", tenant_id, path)


def topic_name(tenant_id: Column, topic: Column) -> Column:
    return F.concat_ws("_", tenant_id, topic)

"""Queries over the provided tables, each with the SQL it is compared with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenry.functions import masking as mk
from wardenry.operators import (
    audit, compliance, conformance, dml, erasure, lineage, masking, metrics, quality, reconcile, registry, tenancy, vault,
)
from wardenry.plans.bindings import table, view, with_views
from wardenry.schemas import moment
from wardenry.session import configure, scratch_path
from wardenry.sources import tables as query_scans
from wardenry.sources import topics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KYC_RULES = {
    "customer_id": {"type": "string", "required": True},
    "full_name": {"type": "string", "required": True},
    "email": {"type": "string", "required": True, "sensitive": True, "masking_strategy": "hash"},
    "ssn": {"type": "string", "sensitive": True, "masking_strategy": "redact"},
}
TABLE_RULES = {
    "email": {"sensitive": True, "masking_strategy": "HASH"},
    "ssn": {"sensitive": True, "masking_strategy": "redact"},
    "card": {"sensitive": True, "masking_strategy": "tokenize"},
    "note": {"sensitive": True, "masking_strategy": "rot13"},
    "segment": {"sensitive": False, "masking_strategy": "hash"},
}
AS_OF_RANGE = (datetime(2024, 1, 8), datetime(2024, 1, 20, 12))
VAULT_TIME = datetime(2024, 1, 1)


def query(name: str, views: list[str] | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL over the given derived views."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views or [], sql)
        return build

    return register


def micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


# --- masking ---------------------------------------------------------------------------------------------------------

@query("msk1_hash", ["kyc"], """
SELECT customer_id, sha256('email:' || email) AS email_hash, sha256('balance:' || CAST(balance AS STRING)) AS balance_hash,
       sha256('premium:' || CASE WHEN premium THEN 'True' ELSE 'False' END) AS premium_hash,
       sha256('key:' || customer_id) AS key_hash
FROM kyc""")
def msk1_hash(spark, sf):
    kyc = view(spark, sf, "kyc")
    kinds = {f.name: f.dataType for f in kyc.schema.fields}

    def hashed(column, field):
        return mk.mask_value(F.col(column), kinds[column], "hash", field)

    return kyc.select(
        "customer_id", hashed("email", "email").alias("email_hash"), hashed("balance", "balance").alias("balance_hash"),
        hashed("premium", "premium").alias("premium_hash"), hashed("customer_id", "key").alias("key_hash"),
    )


@query("msk1_hash_text", [], """
SELECT doc_id, sha256('text:' || text) AS text_hash, sha256('lang:' || lang) AS lang_hash FROM documents""")
def msk1_hash_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rule = {"sensitive": True, "masking_strategy": "hash"}
    masked = masking.mask_table(docs, {"text": rule, "lang": rule})
    return masked.select("doc_id", F.col("text").alias("text_hash"), F.col("lang").alias("lang_hash"))


@query("msk2_tokenize", ["kyc"], """
SELECT customer_id, 'token_' || substr(sha256(card), 1, 16) AS card_token,
       'token_' || substr(sha256(ssn), 1, 16) AS ssn_token FROM kyc""")
def msk2_tokenize(spark, sf):
    return view(spark, sf, "kyc").select(
        "customer_id", mk.token_text(F.col("card")).alias("card_token"), mk.token_text(F.col("ssn")).alias("ssn_token")
    )


@query("msk3_redact", ["kyc"], """
SELECT customer_id, CASE WHEN email IS NULL THEN NULL ELSE '***REDACTED***' END AS email, '***REDACTED***' AS ssn FROM kyc""")
def msk3_redact(spark, sf):
    rule = {"sensitive": True, "masking_strategy": "redact"}
    return masking.mask_table(view(spark, sf, "kyc").select("customer_id", "email", "ssn"), {"email": rule, "ssn": rule})


@query("msk4_guard", ["kyc"], """
SELECT customer_id, CASE WHEN note IS NULL OR note = '' OR lower(note) = 'null' THEN note ELSE sha256('note:' || note) END AS note,
       CASE WHEN note IS NULL OR note = '' OR lower(note) = 'null' THEN note ELSE '***REDACTED***' END AS note_redacted,
       CASE WHEN note IS NULL OR note = '' OR lower(note) = 'null' THEN note
            ELSE 'token_' || substr(sha256(note), 1, 16) END AS note_token
FROM kyc""")
def msk4_guard(spark, sf):
    kyc = view(spark, sf, "kyc").select("customer_id", "note")
    kind, note = kyc.schema["note"].dataType, F.col("note")
    return kyc.select(
        "customer_id", mk.mask_value(note, kind, "hash", "note").alias("note"),
        mk.mask_value(note, kind, "redact").alias("note_redacted"), mk.mask_value(note, kind, "tokenize").alias("note_token"),
    )


@query("msk5_mask", ["kyc"], """
SELECT customer_id, tenant_id, full_name, sha256('email:' || email) AS email, '***REDACTED***' AS ssn,
       'token_' || substr(sha256(card), 1, 16) AS card, segment,
       CASE WHEN note IS NULL OR note = '' OR lower(note) = 'null' THEN note ELSE '***REDACTED***' END AS note, balance
FROM kyc""")
def msk5_mask(spark, sf):
    columns = ["customer_id", "tenant_id", "full_name", "email", "ssn", "card", "segment", "note", "balance"]
    return masking.mask_table(view(spark, sf, "kyc").select(*columns), TABLE_RULES)


@query("msk5_complex", [], None)
def msk5_complex(spark, sf):
    rule = {"embedding": {"sensitive": True, "masking_strategy": "hash"}}
    return masking.mask_table(table(spark, sf, "embeddings"), rule)


@query("msk5_struct", [], """
SELECT c_custkey, sha256('owner:{"key":' || CAST(c_custkey AS STRING) || ',"nation":' || CAST(c_nationkey AS STRING) || ',"note":null}') AS owner,
  sha256('path:[' || CAST(c_nationkey AS STRING) || ',' || CAST(c_custkey AS STRING) || ']') AS path FROM customer""")
def msk5_struct(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.struct(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("note")).alias("owner"),
        F.array("c_nationkey", "c_custkey").alias("path"),
    )
    rule = {"sensitive": True, "masking_strategy": "hash"}
    return masking.mask_table(rows, {"owner": rule, "path": rule})


@query("msk6_strategies", ["kyc"], """
SELECT segment AS schema_id, count(*) AS fields, count(*) FILTER (WHERE strategy = 'hash') AS hashed,
       count(*) FILTER (WHERE strategy = 'redact') AS redacted, count(*) FILTER (WHERE fell_back) AS fell_back
FROM (SELECT segment,
        CASE WHEN lower(note) = 'null' THEN 'redact' WHEN note IS NULL THEN 'redact' WHEN note = '' THEN 'redact' ELSE 'hash' END AS strategy,
        note IS NOT NULL AND (note = '' OR lower(note) = 'null') AS fell_back
      FROM kyc) s GROUP BY segment""")
def msk6_strategies(spark, sf):
    kyc = view(spark, sf, "kyc")
    declared = F.when(F.col("note") == F.col("full_name"), F.lit("Hash")).otherwise(F.col("note"))
    rows = kyc.select(
        F.col("segment").alias("schema_id"), F.col("customer_id").alias("field"), F.lit(True).alias("sensitive"),
        declared.alias("masking_strategy"),
    )
    return masking.resolve_strategies(rows).groupBy("schema_id").agg(
        F.count("*").alias("fields"), F.count_if(F.col("strategy") == "hash").alias("hashed"),
        F.count_if(F.col("strategy") == "redact").alias("redacted"), F.count_if("fell_back").alias("fell_back"),
    )


@query("msk7_noseed", ["kyc"], "SELECT customer_id, sha256(ssn) AS ssn FROM kyc")
def msk7_noseed(spark, sf):
    rules = {"ssn": {"sensitive": True, "masking_strategy": "hash", "include_in_hash": False}}
    return masking.mask_table(view(spark, sf, "kyc").select("customer_id", "ssn"), rules)


@query("msk8_tokens", ["kyc"], """
SELECT count(DISTINCT v) AS token_count FROM (
  SELECT email AS v FROM kyc UNION ALL SELECT card FROM kyc UNION ALL SELECT segment FROM kyc UNION ALL SELECT note FROM kyc
) t WHERE v IS NOT NULL AND v <> '' AND lower(v) <> 'null'""")
def msk8_tokens(spark, sf):
    return masking.token_count(view(spark, sf, "kyc"), ["email", "card", "segment", "note"])


@query("msk8_sketch", ["kyc"], """
SELECT column_name, CAST(2 AS BIGINT) AS batches, true AS within_error FROM (VALUES ('email'), ('card'), ('segment'), ('note')) t(column_name)
UNION ALL SELECT 'all', 2, true""")
def msk8_sketch(spark, sf):
    """Sketches of two batches, united per column and over all, against the exact counts of the same rows."""
    columns = ["email", "card", "segment", "note"]
    kyc = view(spark, sf, "kyc")
    path = scratch_path(spark, "sketches")
    for part in (0, 1):  # the second batch brings half of the first again
        rows = kyc.where(F.col("customer_id").cast("long") % 4 <= 1 if part == 0 else F.col("customer_id").cast("long") % 4 >= 1)
        masking.token_sketches(rows, columns, F.lit(part)).write.mode("append").parquet(path)
    held = spark.read.parquet(path)
    each = masking.sketched_token_count(held, ["column_name"]).join(held.groupBy("column_name").agg(F.countDistinct("batch").alias("batches")), "column_name")
    whole = masking.sketched_token_count(held).select(F.lit("all").alias("column_name"), "token_count", F.lit(2).cast("long").alias("batches"))
    exact = None
    for name, over in [*((c, [c]) for c in columns), ("all", columns)]:
        one = masking.token_count(kyc, over).select(F.lit(name).alias("column_name"), F.col("token_count").alias("exact"))
        exact = one if exact is None else exact.unionByName(one)
    off = F.abs(F.col("token_count") - F.col("exact")) <= F.col("exact") * masking.SKETCH_ERROR
    return each.select("column_name", "token_count", "batches").unionByName(whole).join(exact, "column_name").select("column_name", "batches", off.alias("within_error"))


def kyc_vault(spark, sf):
    """A vault of e-mail and card tokens; owners of the automobile segment have tokens that expire."""
    kyc = view(spark, sf, "kyc")
    fields = F.explode(F.array(
        F.struct(F.lit("email").alias("field"), F.col("email").alias("value")),
        F.struct(F.lit("card").alias("field"), F.col("card").alias("value")),
        F.struct(F.lit("ssn").alias("field"), F.col("ssn").alias("value")),
    ))
    owned = kyc.select("tenant_id", "user_id", "balance", fields.alias("_f")).select("tenant_id", "user_id", "balance", "_f.*")
    ttl = F.when(F.col("balance") > 8000, 1800).when(F.col("balance") > 6000, 3600).when(F.col("balance") > 4000, 7200)
    created = moment(VAULT_TIME).cast("timestamp")
    return owned.where("value IS NOT NULL").select(
        mk.token_text(F.col("value")).alias("token_id"), "value", created.alias("created_at"),
        (created + F.make_dt_interval(secs=ttl)).alias("expires_at"), "tenant_id", "user_id", "field",
    )


_VAULT_SQL = """
vault_rows AS (SELECT *, 'token_' || substr(sha256(value), 1, 16) AS token_id,
    CASE WHEN balance > 8000 THEN 1800 WHEN balance > 6000 THEN 3600 WHEN balance > 4000 THEN 7200 END AS ttl FROM (
  SELECT tenant_id, user_id, balance, 'email' AS field, email AS value FROM kyc UNION ALL
  SELECT tenant_id, user_id, balance, 'card', card FROM kyc UNION ALL
  SELECT tenant_id, user_id, balance, 'ssn', ssn FROM kyc) f WHERE value IS NOT NULL)
"""


@query("msk9_rotation", ["kyc"], f"""
WITH {_VAULT_SQL} SELECT token_id AS old_token, 'token_' || substr(sha256('2024:' || value), 1, 16) AS new_token, value FROM vault_rows""")
def msk9_rotation(spark, sf):
    return masking.rotate_tokens(kyc_vault(spark, sf), "2024")


# --- vault -----------------------------------------------------------------------------------------------------------

@query("vlt1_store", ["kyc"], f"""
WITH {_VAULT_SQL} SELECT DISTINCT 'token_' || substr(sha256(v), 1, 16) AS token_id, v AS value,
  epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS created_us, epoch_us(TIMESTAMP '2024-01-01 01:00:00') AS expires_us
FROM (SELECT segment AS v FROM kyc UNION ALL SELECT full_name FROM kyc UNION ALL SELECT email FROM kyc UNION ALL SELECT note FROM kyc) a
WHERE v IS NOT NULL AND v <> '' AND 'token_' || substr(sha256(v), 1, 16) NOT IN (SELECT token_id FROM vault_rows)""")
def vlt1_store(spark, sf):
    kyc = view(spark, sf, "kyc")
    values = kyc.select(F.explode(F.array("segment", "full_name", "email", "note")).alias("value"))
    fresh = vault.new_tokens(values, kyc_vault(spark, sf), VAULT_TIME, ttl_seconds=3600)
    return fresh.select("token_id", "value", micros("created_at").alias("created_us"), micros("expires_at").alias("expires_us"))


def token_references(spark, sf):
    """Tokens that events refer to: a user's card, the shared token of the event type, and one nobody stored."""
    events = table(spark, sf, "events")
    key = F.lpad(F.col("user_id").cast("string"), 9, "0")
    card = F.concat(F.lit("4000-0000-"), F.substring(key, 2, 4), F.lit("-"), F.substring(key, 6, 4))
    text = F.when(F.col("event_type") == "error", F.lit("user.000000000@example.com")).otherwise(card)
    return events.select("event_id", mk.token_text(text).alias("token_id"))


@query("vlt2_detok", ["kyc"], f"""
WITH {_VAULT_SQL}, refs AS (SELECT event_id, 'token_' || substr(sha256(CASE WHEN event_type = 'error' THEN 'user.000000000@example.com'
    ELSE '4000-0000-' || substr(lpad(CAST(user_id AS STRING), 9, '0'), 2, 4) || '-' || substr(lpad(CAST(user_id AS STRING), 9, '0'), 6, 4) END), 1, 16) AS token_id FROM events)
SELECT r.event_id, r.token_id, CASE WHEN v.ttl IS NULL OR v.ttl >= 3600 THEN v.value END AS value,
  CASE WHEN v.token_id IS NULL THEN 'unknown' WHEN v.ttl < 3600 THEN 'expired' END AS vault_error
FROM refs r LEFT JOIN vault_rows v ON r.token_id = v.token_id""")
def vlt2_detok(spark, sf):
    return vault.detokenise(token_references(spark, sf), kyc_vault(spark, sf), datetime(2024, 1, 1, 1))


@query("vlt3_delete", ["kyc"], f"""
WITH {_VAULT_SQL} SELECT token_id, user_id, field FROM vault_rows
WHERE token_id NOT IN (SELECT token_id FROM vault_rows WHERE user_id IN (SELECT 'user_' || CAST(user_id AS STRING) FROM events WHERE event_type = 'error'))""")
def vlt3_delete(spark, sf):
    held = kyc_vault(spark, sf)
    failing = table(spark, sf, "events").where("event_type = 'error'").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id")
    ).distinct()
    doomed = held.join(failing, "user_id", "left_semi")
    return vault.delete_tokens(held, doomed).select("token_id", "user_id", "field")


@query("vlt3_flags", ["kyc"], f"""
WITH {_VAULT_SQL}, refs AS (SELECT DISTINCT 'token_' || substr(sha256(CASE WHEN event_type = 'error' THEN 'user.000000000@example.com'
    ELSE '4000-0000-' || substr(lpad(CAST(user_id AS STRING), 9, '0'), 2, 4) || '-' || substr(lpad(CAST(user_id AS STRING), 9, '0'), 6, 4) END), 1, 16) AS token_id FROM events)
SELECT token_id, token_id IN (SELECT token_id FROM vault_rows) AS deleted FROM refs""")
def vlt3_flags(spark, sf):
    return vault.deletion_flags(kyc_vault(spark, sf), token_references(spark, sf))


@query("vlt4_list", ["kyc"], f"WITH {_VAULT_SQL} SELECT token_id FROM vault_rows")
def vlt4_list(spark, sf):
    return vault.list_tokens(kyc_vault(spark, sf))


@query("vlt4_count", ["kyc"], f"WITH {_VAULT_SQL} SELECT count(*) AS token_count FROM vault_rows")
def vlt4_count(spark, sf):
    return vault.count_tokens(kyc_vault(spark, sf))


@query("vlt5_metadata", ["kyc"], f"""
WITH {_VAULT_SQL} SELECT token_id, epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS created_us,
  epoch_us(TIMESTAMP '2024-01-01 00:00:00') + CAST(ttl AS BIGINT) * 1000000 AS expires_us FROM vault_rows""")
def vlt5_metadata(spark, sf):
    meta = vault.token_metadata(kyc_vault(spark, sf))
    return meta.select("token_id", micros("created_at").alias("created_us"), micros("expires_at").alias("expires_us"))


@query("vlt6_purge", ["kyc"], f"WITH {_VAULT_SQL} SELECT token_id, field FROM vault_rows WHERE ttl IS NULL OR ttl >= 3600")
def vlt6_purge(spark, sf):
    return vault.purge_expired(kyc_vault(spark, sf), datetime(2024, 1, 1, 1)).select("token_id", "field")


@query("vlt_collisions", [], """
SELECT token_id, min(value) AS first_value, max(value) AS last_value FROM (
  SELECT 'token_' || substr(sha256(CAST(o_custkey AS STRING)), 1, 4) AS token_id, CAST(o_custkey AS STRING) AS value FROM orders) t
GROUP BY token_id HAVING count(DISTINCT value) > 1""")
def vlt_collisions(spark, sf):
    # Tokens cut to four hex digits, so that values do collide.
    text = F.col("o_custkey").cast("string")
    short = table(spark, sf, "orders").select(F.substring(mk.token_text(text), 1, 10).alias("token_id"), text.alias("value"))
    return vault.collisions(short)


# --- schema checks and quality gate ----------------------------------------------------------------------------------

_MISSING_SQL = """
SELECT customer_key, tenant_id, record, json_type(record) = 'OBJECT' AS is_object,
  json_type(record) = 'OBJECT' AND NOT list_contains(json_keys(record), 'email') AS no_email,
  json_type(record) = 'OBJECT' AND NOT list_contains(json_keys(record), 'ssn') AS no_ssn,
  json_type(record) = 'OBJECT' AND list_contains(json_keys(record), 'email') AND json_type(record, '$.email') = 'NULL' AS null_email
FROM kyc_json
"""


@query("sch1_missing", ["kyc_json"], f"""
SELECT customer_key, is_object AND NOT no_email AND NOT no_ssn AS valid,
  CASE WHEN NOT is_object THEN NULL WHEN no_email AND no_ssn THEN 'email,ssn' WHEN no_email THEN 'email' WHEN no_ssn THEN 'ssn' ELSE '' END AS missing
FROM ({_MISSING_SQL}) m""")
def sch1_missing(spark, sf):
    checked = registry.check_presence(view(spark, sf, "kyc_json"), list(KYC_RULES))
    return checked.select("customer_key", "valid", F.array_join(F.array_sort("missing_fields"), ",").alias("missing"))


@query("sch2_split", ["kyc_json"], f"""
SELECT tenant_id, count(*) FILTER (WHERE is_object AND NOT no_email AND NOT no_ssn) AS valid_records,
  count(*) FILTER (WHERE NOT (is_object AND NOT no_email AND NOT no_ssn)) AS rejected_records
FROM ({_MISSING_SQL}) m GROUP BY tenant_id""")
def sch2_split(spark, sf):
    checked = registry.check_presence(view(spark, sf, "kyc_json"), list(KYC_RULES))
    return checked.groupBy("tenant_id").agg(
        F.count_if("valid").alias("valid_records"), F.count_if(~F.col("valid")).alias("rejected_records")
    )


def entity_schemas(spark):
    first, second = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = registry.schema_rows("customer_v1", "customer", "1.0", {"customer_id": {}, "name": {}}, first)
    rows += registry.schema_rows("customer_v1", "customer", "1.1", {"customer_id": {}, "name": {}, "email": {}}, second)
    rows += registry.schema_rows("part_v1", "part", "1.0", {"part_id": {}, "brand": {"required": False}}, first)
    rows += registry.schema_rows("supplier_v1", "supplier", "1.0", {"supplier_id": {"type": "int", "min": 0}}, first)
    return registry.schema_table(spark, rows)


@query("sch3_multi", ["entities"], """
SELECT schema_id, entity_id, CASE WHEN schema_id = 'part_v9' THEN 'Schema not found: part_v9'
  WHEN json_type(record) <> 'OBJECT' THEN 'Expected dict'
  WHEN schema_id = 'customer_v1' AND NOT list_contains(json_keys(record), 'email') THEN 'Missing required fields: email'
  WHEN schema_id = 'part_v1' AND NOT list_contains(json_keys(record), 'brand') THEN 'Missing required fields: brand' END AS problem
FROM entities""")
def sch3_multi(spark, sf):
    checked = registry.check_presence_by_schema(view(spark, sf, "entities"), entity_schemas(spark))
    return checked.select("schema_id", "entity_id", "problem")


@query("sch4_definitions", [], """
SELECT schema_id, name, version, rule FROM (
  SELECT p_brand || ':' || p_type AS schema_id, CASE p_type WHEN 'PROMO' THEN '' ELSE p_type END AS name, 'v1' AS version,
         max(CASE WHEN p_size > 49 THEN 1 ELSE 0 END) AS has_field FROM part GROUP BY p_brand, p_type) d,
  (VALUES ('name_empty'), ('fields_empty')) r(rule)
WHERE (rule = 'name_empty' AND name = '') OR (rule = 'fields_empty' AND has_field = 0)""")
def sch4_definitions(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select(
        F.concat_ws(":", "p_brand", "p_type").alias("schema_id"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type")).alias("name"), F.lit("v1").alias("version"),
        F.when(F.col("p_size") > 49, F.col("p_name")).otherwise("").alias("field"),
    )
    return registry.definition_violations(rows)


@query("qlt1_errors", ["kyc_json"], f"""
SELECT customer_key, CASE WHEN NOT is_object THEN NULL ELSE 'email' END AS field,
  CASE WHEN NOT is_object THEN 'structural' WHEN no_email THEN 'missing_field' ELSE 'null_value' END AS error_type,
  CASE WHEN NOT is_object THEN 'Record must be dict, got list' WHEN no_email THEN 'Required field missing: email'
       ELSE 'Required field is null: email' END AS message
FROM ({_MISSING_SQL}) m WHERE NOT is_object OR no_email OR null_email""")
def qlt1_errors(spark, sf):
    checked = quality.with_errors(view(spark, sf, "kyc_json"), KYC_RULES, record="record")
    return quality.error_table(checked, ["customer_key"])


@query("qlt1_columns", ["kyc"], """
SELECT customer_id, field, CASE field WHEN 'phone' THEN 'missing_field' ELSE 'null_value' END AS error_type,
  CASE field WHEN 'phone' THEN 'Required field missing: phone' ELSE 'Required field is null: ' || field END AS message
FROM kyc, (VALUES ('email'), ('note'), ('phone')) f(field)
WHERE field = 'phone' OR (field = 'email' AND email IS NULL) OR (field = 'note' AND note IS NULL)""")
def qlt1_columns(spark, sf):
    rules = {"email": {"required": True}, "note": {"required": True}, "phone": {"required": True}, "ssn": "string"}
    return quality.error_table(quality.with_errors(view(spark, sf, "kyc"), rules), ["customer_id"])


_GATE_SQL = """
count(*) FILTER (WHERE is_object AND NOT no_email AND NOT null_email) AS passed_records,
count(*) FILTER (WHERE NOT is_object OR no_email OR null_email) AS failed_records,
CAST(count(*) FILTER (WHERE is_object AND NOT no_email AND NOT null_email) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS quality_score
"""


@query("qlt2_gate", ["kyc_json"], f"""
SELECT *, quality_score < 0.95 AS circuit_breaker_triggered FROM (SELECT {_GATE_SQL} FROM ({_MISSING_SQL}) m) s""")
def qlt2_gate(spark, sf):
    return quality.summarise(quality.with_errors(view(spark, sf, "kyc_json"), KYC_RULES, record="record"))


@query("qlt3_score", [], """
SELECT l_suppkey AS supplier, count(*) FILTER (WHERE l_discount < 0.09) AS passed_records,
  count(*) FILTER (WHERE NOT l_discount < 0.09) AS failed_records,
  CAST(count(*) FILTER (WHERE l_discount < 0.09) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS quality_score
FROM lineitem GROUP BY l_suppkey""")
def qlt3_score(spark, sf):
    counted = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count_if(F.col("l_discount") < 0.09).alias("passed_records"),
        F.count_if(~(F.col("l_discount") < 0.09)).alias("failed_records"),
    )
    return counted.withColumn("quality_score", quality.score(F.col("passed_records"), F.col("failed_records")))


@query("qlt4_breaker", ["kyc_json"], f"""
SELECT segment, threshold, quality_score, quality_score < threshold AS tripped FROM (
  SELECT c_mktsegment AS segment, CAST(count(*) FILTER (WHERE c_acctbal >= 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS quality_score
  FROM customer GROUP BY c_mktsegment) s, (VALUES (0.0::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) t(threshold)""")
def qlt4_breaker(spark, sf):
    kyc = view(spark, sf, "kyc")
    checked = quality.with_errors(kyc, {"email": {"required": True}})
    gates = [
        quality.summarise(checked, limit, ["segment"]).select(
            "segment", F.lit(limit).alias("threshold"), "quality_score", F.col("circuit_breaker_triggered").alias("tripped")
        )
        for limit in (0.0, 0.9, 1.0)
    ]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


_ROLLING_SQL = """
w AS (
  SELECT tenant_id, status, ts, to_timestamp(epoch(time_bucket(INTERVAL 6 HOUR, ts)) - 21600 * k) AS window_start FROM audit, (VALUES (0), (1), (2), (3)) s(k)),
g AS (
  SELECT tenant_id, window_start, count(*) FILTER (WHERE status = 'SUCCESS') AS passed_records, count(*) FILTER (WHERE status <> 'SUCCESS') AS failed_records
  FROM w GROUP BY tenant_id, window_start),
b AS (
  SELECT *, CAST(passed_records AS DOUBLE) / CAST(passed_records + failed_records AS DOUBLE) AS quality_score,
         CAST(passed_records AS DOUBLE) / CAST(passed_records + failed_records AS DOUBLE) < 0.9 AS tripped,
         CAST(epoch_us(window_start) AS BIGINT) + 86400000000 AS end_us FROM g)
"""


def rolling_gate(spark, sf):
    """A day's window every six hours over audit events, in which only successes are whole records."""
    log = view(spark, sf, "audit").withColumn("done", F.when(F.col("status") == "SUCCESS", "x"))
    return quality.rolling(quality.with_errors(log.select("ts", "tenant_id", "done"), {"done": {"required": True}}), "ts", "24 hours", "6 hours", 0.9, ["tenant_id"])


@query("qlt4_rolling", ["audit"], f"WITH {_ROLLING_SQL} SELECT tenant_id, end_us, passed_records, failed_records, quality_score, tripped FROM b")
def qlt4_rolling(spark, sf):
    return rolling_gate(spark, sf).select(
        "tenant_id", micros("window_end").alias("end_us"), "passed_records", "failed_records", "quality_score", F.col("circuit_breaker_triggered").alias("tripped"))


@query("qlt4_closed", ["audit"], f"""
WITH {_ROLLING_SQL},
c AS (SELECT tenant_id, end_us, tripped FROM (SELECT *, lag(tripped, 1, false) OVER (PARTITION BY tenant_id ORDER BY end_us) AS was FROM b) x WHERE tripped <> was)
SELECT tenant_id, closed_us, reopened_us FROM (
  SELECT tenant_id, end_us AS closed_us, lead(end_us) OVER (PARTITION BY tenant_id ORDER BY end_us) AS reopened_us, tripped FROM c) y WHERE tripped""")
def qlt4_closed(spark, sf):
    spans = quality.closed_spans(rolling_gate(spark, sf), ["tenant_id"])
    return spans.select("tenant_id", micros("closed_at").alias("closed_us"), micros("reopened_at").alias("reopened_us"))


@query("qlt5_by_tenant", ["kyc_json"], f"""
SELECT *, quality_score < 0.9 AS circuit_breaker_triggered FROM (SELECT tenant_id, {_GATE_SQL} FROM ({_MISSING_SQL}) m GROUP BY tenant_id) s""")
def qlt5_by_tenant(spark, sf):
    checked = quality.with_errors(view(spark, sf, "kyc_json"), KYC_RULES, record="record")
    return quality.summarise(checked, 0.9, ["tenant_id"])


@query("qlt6_conformance", [], """
SELECT batch_id, rule FROM (
  SELECT 'order-' || CAST(o_orderkey AS STRING) AS batch_id, o_totalprice / 400000 AS score,
         CASE o_orderstatus WHEN 'F' THEN -1 ELSE 1 END AS failed FROM orders) r,
  (VALUES ('failed_records_negative'), ('quality_score_out_of_range')) k(rule)
WHERE (rule = 'failed_records_negative' AND failed < 0) OR (rule = 'quality_score_out_of_range' AND (score < 0 OR score > 1))""")
def qlt6_conformance(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("batch_id"), F.lit(1).alias("passed_records"),
        F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("failed_records"),
        (F.col("o_totalprice") / 400000).alias("quality_score"),
    )
    return conformance.quality_run_violations(runs)


# --- audit -----------------------------------------------------------------------------------------------------------

@query("aud1_append", ["audit"], """
SELECT action, tenant_id, status, count(*) AS events, count(error_message) AS messages, epoch_us(min(ts)) AS first_us FROM audit GROUP BY action, tenant_id, status""")
def aud1_append(spark, sf):
    raw = view(spark, sf, "audit")
    logged = audit.events(
        raw, F.col("action"), status=F.col("status"), user=F.col("user"), record_id=F.col("record_id"),
        error_message=F.col("error_message"), ts=F.col("ts"), details={"source": F.col("event_id")},
    )
    return logged.groupBy("action", "tenant_id", "status").agg(
        F.count("*").alias("events"), F.count("error_message").alias("messages"), F.min("ts").alias("first")
    ).withColumn("first_us", micros("first")).drop("first")


@query("aud2_chronological", ["audit"], "SELECT event_id, action, tenant_id, epoch_us(ts) AS ts_us FROM audit ORDER BY ts, event_id")
def aud2_chronological(spark, sf):
    return audit.chronological(view(spark, sf, "audit")).select("event_id", "action", "tenant_id", micros("ts").alias("ts_us"))


@query("aud3_action", ["audit"], "SELECT event_id, tenant_id, status, epoch_us(ts) AS ts_us FROM audit WHERE action = 'purchase'")
def aud3_action(spark, sf):
    return audit.by_action(view(spark, sf, "audit"), "purchase").select("event_id", "tenant_id", "status", micros("ts").alias("ts_us"))


@query("aud4_tenant", ["audit"], "SELECT event_id, action, status FROM audit WHERE tenant_id = 'tenant_3'")
def aud4_tenant(spark, sf):
    return audit.by_tenant(view(spark, sf, "audit"), "tenant_3").select("event_id", "action", "status")


@query("aud5_range", ["audit"], """
SELECT event_id, action, status, epoch_us(ts) AS ts_us FROM audit WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def aud5_range(spark, sf):
    return audit.by_time_range(view(spark, sf, "audit"), *AS_OF_RANGE).select("event_id", "action", "status", micros("ts").alias("ts_us"))


@query("aud6_count", ["audit"], "SELECT count(*) AS event_count FROM audit")
def aud6_count(spark, sf):
    return audit.count(view(spark, sf, "audit"))


@query("aud7_violations", ["audit_raw"], """
SELECT event_id, rule FROM audit_raw, (VALUES ('action_empty'), ('user_empty'), ('tenant_id_empty'), ('status_invalid'), ('failure_without_message')) r(rule)
WHERE (rule = 'action_empty' AND action = '') OR (rule = 'user_empty' AND actor IS NULL) OR (rule = 'tenant_id_empty' AND tenant_id = '')
  OR (rule = 'status_invalid' AND status = 'UNKNOWN') OR (rule = 'failure_without_message' AND status = 'FAILURE' AND error_message IS NULL)""")
def aud7_violations(spark, sf):
    return conformance.audit_violations(view(spark, sf, "audit_raw"))


@query("aud8_retention", ["audit"], """
SELECT event_id, tenant_id FROM audit WHERE ts >= (SELECT max(ts) FROM audit) - INTERVAL 10 DAY""")
def aud8_retention(spark, sf):
    log = view(spark, sf, "audit")
    return audit.retained(log, latest_event(spark, sf), 10).select("event_id", "tenant_id")


# --- lineage ---------------------------------------------------------------------------------------------------------

@query("lin1_track", ["edges"], """
SELECT source_dataset, destination_dataset, transformation, count(*) AS tracked FROM edges GROUP BY source_dataset, destination_dataset, transformation""")
def lin1_track(spark, sf):
    edges = view(spark, sf, "edges")
    tracked = lineage.track(
        edges, F.col("source_dataset"), F.col("destination_dataset"), F.col("transformation"),
        user=F.col("user"), ts=datetime(2024, 1, 1), metadata={"event": F.col("event_id")},
    )
    logged = lineage.tracking_events(tracked)
    return logged.groupBy(
        F.col("details")["source_dataset"].alias("source_dataset"),
        F.col("details")["destination_dataset"].alias("destination_dataset"),
        F.col("details")["transformation"].alias("transformation"),
    ).agg(F.count("*").alias("tracked"))


@query("lin2_event", ["edges"], "SELECT event_id, source_dataset, destination_dataset, transformation FROM edges WHERE event_id = 'o7'")
def lin2_event(spark, sf):
    return lineage.by_event(view(spark, sf, "edges"), "o7").select("event_id", "source_dataset", "destination_dataset", "transformation")


@query("lin3_touch", ["edges"], """
SELECT event_id, source_dataset, destination_dataset FROM edges WHERE source_dataset = 'supplier:5' OR destination_dataset = 'supplier:5'""")
def lin3_touch(spark, sf):
    return lineage.touching(view(spark, sf, "edges"), "supplier:5").select("event_id", "source_dataset", "destination_dataset")


@query("lin3_touch_many", ["edges"], """
WITH d AS (SELECT 'supplier:' || CAST(s_suppkey AS STRING) AS dataset FROM supplier WHERE s_acctbal < 0)
SELECT d.dataset, e.event_id FROM d JOIN edges e ON e.source_dataset = d.dataset OR e.destination_dataset = d.dataset""")
def lin3_touch_many(spark, sf):
    wanted = table(spark, sf, "supplier").where("s_acctbal < 0").select(
        F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("dataset")
    )
    return lineage.touching_many(view(spark, sf, "edges"), wanted).select("dataset", "event_id")


@query("lin4_up", ["edges"], "SELECT event_id, source_dataset, transformation FROM edges WHERE destination_dataset = 'nation:7'")
def lin4_up(spark, sf):
    return lineage.upstream(view(spark, sf, "edges"), "nation:7").select("event_id", "source_dataset", "transformation")


@query("lin5_down", ["edges"], "SELECT event_id, destination_dataset, transformation FROM edges WHERE source_dataset = 'nation:7'")
def lin5_down(spark, sf):
    return lineage.downstream(view(spark, sf, "edges"), "nation:7").select("event_id", "destination_dataset", "transformation")


@query("lin6_graph", ["edges"], """
SELECT DISTINCT destination_dataset AS root, 'upstream' AS direction, source_dataset AS neighbour FROM edges
UNION ALL SELECT DISTINCT source_dataset, 'downstream', destination_dataset FROM edges WHERE source_dataset <> destination_dataset""")
def lin6_graph(spark, sf):
    return lineage.neighbours(view(spark, sf, "edges"))


@query("lin6_adjacency", ["edges"], "SELECT DISTINCT source_dataset, destination_dataset FROM edges")
def lin6_adjacency(spark, sf):
    return lineage.adjacency(view(spark, sf, "edges"))


@query("lin6_degrees", ["edges"], """
SELECT root, count(*) FILTER (WHERE direction = 'u') AS upstream_count, count(*) FILTER (WHERE direction = 'd') AS downstream_count FROM (
  SELECT DISTINCT destination_dataset AS root, 'u' AS direction, source_dataset AS neighbour FROM edges
  UNION ALL SELECT DISTINCT source_dataset, 'd', destination_dataset FROM edges WHERE source_dataset <> destination_dataset) n GROUP BY root""")
def lin6_degrees(spark, sf):
    return lineage.degrees(view(spark, sf, "edges"))


@query("lin7_type", ["edges"], "SELECT event_id, source_dataset, destination_dataset FROM edges WHERE transformation = 'TOKENIZE'")
def lin7_type(spark, sf):
    return lineage.by_transformation(view(spark, sf, "edges"), "TOKENIZE").select("event_id", "source_dataset", "destination_dataset")


@query("lin7_types", ["edges"], "SELECT transformation, count(*) AS event_count FROM edges GROUP BY transformation")
def lin7_types(spark, sf):
    return lineage.transformation_counts(view(spark, sf, "edges"))


@query("lin8_tenant", ["edges"], "SELECT event_id, transformation FROM edges WHERE tenant_id = 'tenant_4'")
def lin8_tenant(spark, sf):
    return lineage.by_tenant(view(spark, sf, "edges"), "tenant_4").select("event_id", "transformation")


@query("lin9_datasets", ["edges"], "SELECT source_dataset AS dataset FROM edges UNION SELECT destination_dataset FROM edges")
def lin9_datasets(spark, sf):
    return lineage.datasets(view(spark, sf, "edges"))


@query("lin9_count", ["edges"], """
SELECT count(*) AS dataset_count FROM (SELECT source_dataset AS dataset FROM edges UNION SELECT destination_dataset FROM edges) d""")
def lin9_count(spark, sf):
    return lineage.dataset_count(view(spark, sf, "edges"))


@query("lin10_count", ["edges"], "SELECT count(*) AS event_count FROM edges")
def lin10_count(spark, sf):
    return lineage.event_count(view(spark, sf, "edges"))


@query("lin11_closure", ["edges"], """
WITH RECURSIVE reach(root, dataset, hops) AS (
  SELECT 'region:' || CAST(r_regionkey AS STRING), destination_dataset, 1 FROM region, edges WHERE source_dataset = 'region:' || CAST(r_regionkey AS STRING)
  UNION SELECT r.root, e.destination_dataset, r.hops + 1 FROM reach r JOIN edges e ON e.source_dataset = r.dataset WHERE r.hops < 30)
SELECT root, dataset, CAST(min(hops) AS INTEGER) AS hops FROM reach GROUP BY root, dataset""")
def lin11_closure(spark, sf):
    roots = table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("dataset"))
    return lineage.provenance(view(spark, sf, "edges"), roots)


@query("lin12_violations", ["edges"], "SELECT event_id, 'user_empty' AS rule FROM edges WHERE actor = ''")
def lin12_violations(spark, sf):
    return conformance.lineage_violations(view(spark, sf, "edges"))


# --- erasure ---------------------------------------------------------------------------------------------------------

def erasure_requests(spark, sf):
    return view(spark, sf, "requests").withColumn("fields_to_delete", F.split("fields", ",")).drop("fields")


@query("era1_intake", ["requests"], """
SELECT request_id, user_id, CASE WHEN status = 'FAILED' THEN '' ELSE reason END AS reason, 'PENDING' AS status,
  CASE WHEN status = 'FAILED' THEN 'reason_empty' ELSE '' END AS broken_rules FROM requests""")
def era1_intake(spark, sf):
    submitted = erasure_requests(spark, sf).withColumn(
        "reason", F.when(F.col("status") == "FAILED", "").otherwise(F.col("reason"))
    )
    accepted, rejected = erasure.intake(submitted, datetime(2024, 1, 1))
    columns = ["request_id", "user_id", "reason", "status"]
    return accepted.select(*columns, F.lit("").alias("broken_rules")).unionByName(
        rejected.select(*columns, F.array_join("broken_rules", ",").alias("broken_rules"))
    )


@query("era2_scoped", ["kyc", "requests"], f"""
WITH {_VAULT_SQL} SELECT token_id, user_id, field FROM vault_rows v WHERE NOT EXISTS (
  SELECT 1 FROM requests r WHERE r.user_id = v.user_id AND r.tenant_id = v.tenant_id AND list_contains(string_split(r.fields, ','), v.field))""")
def era2_scoped(spark, sf):
    return erasure.erase_tokens(kyc_vault(spark, sf), erasure_requests(spark, sf)).select("token_id", "user_id", "field")


@query("era2_doomed", ["kyc", "requests"], f"""
WITH {_VAULT_SQL} SELECT token_id, user_id, field FROM vault_rows v WHERE EXISTS (
  SELECT 1 FROM requests r WHERE r.user_id = v.user_id AND r.tenant_id = v.tenant_id AND list_contains(string_split(r.fields, ','), v.field))""")
def era2_doomed(spark, sf):
    return erasure.doomed_tokens(kyc_vault(spark, sf), erasure_requests(spark, sf)).select("token_id", "user_id", "field")


@query("era2_all", ["kyc"], f"""
WITH {_VAULT_SQL} SELECT field, count(*) AS erased FROM vault_rows GROUP BY field""")
def era2_all(spark, sf):
    doomed = erasure.doomed_tokens(kyc_vault(spark, sf), erasure_requests(spark, sf), scope="all")
    return doomed.groupBy("field").agg(F.count("*").alias("erased"))


def request_states(spark, sf):
    """A state log from the events: every sign-up opens a request for its user, later events move it on."""
    status = (
        F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "click", "IN_PROGRESS")
        .when(F.col("event_type") == "purchase", "COMPLETE").when(F.col("event_type") == "error", "FAILED")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("request_id"), status.alias("status"), "ts", "value"
    ).where("status IS NOT NULL")


_STATES_SQL = """
states AS (SELECT CAST(user_id AS STRING) AS request_id, ts, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'IN_PROGRESS'
   WHEN 'purchase' THEN 'COMPLETE' ELSE 'FAILED' END AS status FROM events WHERE event_type <> 'view'),
current_state AS (SELECT request_id, status, ts FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts DESC) AS rn FROM states) s WHERE rn = 1)
"""


@query("era3_states", [], f"WITH {_STATES_SQL} SELECT request_id, status, epoch_us(ts) AS ts_us FROM current_state")
def era3_states(spark, sf):
    return erasure.current_states(request_states(spark, sf)).select("request_id", "status", micros("ts").alias("ts_us"))


@query("era3_transitions", [], f"""
WITH {_STATES_SQL}, proposed AS (SELECT o_orderkey, CAST(o_custkey AS STRING) AS request_id,
    CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'COMPLETE' END AS status FROM orders)
SELECT o_orderkey, p.request_id, p.status, c.status AS from_status, CASE WHEN c.status IS NULL THEN 'unknown_request'
  WHEN (c.status = 'PENDING' AND p.status = 'IN_PROGRESS') OR (c.status = 'IN_PROGRESS' AND p.status IN ('COMPLETE', 'FAILED')) THEN NULL
  ELSE 'transition_not_allowed' END AS problem
FROM proposed p LEFT JOIN current_state c ON c.request_id = p.request_id""")
def era3_transitions(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("COMPLETE")
    proposed = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("request_id"), status.alias("status"))
    return erasure.judge_transitions(request_states(spark, sf), proposed).select(
        "o_orderkey", "request_id", "status", "from_status", "problem"
    )


@query("era3_execution", ["requests"], """
SELECT action, status, count(*) AS events FROM (
  SELECT 'ERASURE_EXECUTION_STARTED' AS action, 'SUCCESS' AS status FROM requests UNION ALL
  SELECT CASE WHEN fields LIKE '%,%' THEN 'ERASURE_EXECUTION_FAILED' ELSE 'ERASURE_EXECUTION_COMPLETED' END,
         CASE WHEN fields LIKE '%,%' THEN 'FAILURE' ELSE 'SUCCESS' END FROM requests) e GROUP BY action, status""")
def era3_execution(spark, sf):
    executed = erasure.outcome(erasure_requests(spark, sf), F.size("fields_to_delete") - 1)
    return erasure.execution_events(executed, datetime(2024, 1, 1)).groupBy("action", "status").agg(F.count("*").alias("events"))


@query("era4_status", ["requests"], "SELECT request_id, tenant_id, reason FROM requests WHERE status = 'PENDING'")
def era4_status(spark, sf):
    return erasure.by_status(erasure_requests(spark, sf), "PENDING").select("request_id", "tenant_id", "reason")


@query("era5_tenant", ["requests"], "SELECT request_id, status, reason FROM requests WHERE tenant_id = 'tenant_3'")
def era5_tenant(spark, sf):
    return erasure.by_tenant(erasure_requests(spark, sf), "tenant_3").select("request_id", "status", "reason")


@query("era6_count", ["requests"], "SELECT count(*) AS request_count FROM requests")
def era6_count(spark, sf):
    return erasure.count(erasure_requests(spark, sf))


@query("era7_fields", ["kyc", "requests"], """
SELECT k.customer_id, k.tenant_id, k.full_name, CASE WHEN list_contains(string_split(r.fields, ','), 'email') THEN NULL ELSE k.email END AS email,
  CASE WHEN list_contains(string_split(r.fields, ','), 'ssn') THEN NULL ELSE k.ssn END AS ssn,
  CASE WHEN list_contains(string_split(r.fields, ','), 'card') THEN NULL ELSE k.card END AS card
FROM kyc k LEFT JOIN requests r ON r.user_id = k.user_id AND r.tenant_id = k.tenant_id""")
def era7_fields(spark, sf):
    erased = erasure.erase_fields(view(spark, sf, "kyc"), erasure_requests(spark, sf), ["email", "ssn", "card"])
    return erased.select("customer_id", "tenant_id", "full_name", "email", "ssn", "card")


@query("era8_records", [], """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def era8_records(spark, sf):
    ids = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return erasure.erase_records(table(spark, sf, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


@query("era8_outcomes", [], """
SELECT c_custkey AS o_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS erased_rows
FROM customer c WHERE c_acctbal < 0""")
def era8_outcomes(spark, sf):
    ids = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return erasure.record_outcomes(table(spark, sf, "orders").where("o_orderstatus = 'F'"), ids, "o_custkey")


@query("era9_violations", ["requests"], """
SELECT request_id, rule FROM requests, (VALUES ('failed_without_message'), ('field_name_empty')) r(rule)
WHERE (rule = 'failed_without_message' AND status = 'FAILED') OR (rule = 'field_name_empty' AND fields = 'card')""")
def era9_violations(spark, sf):
    requests = erasure_requests(spark, sf).withColumn("created_at", moment(VAULT_TIME)).withColumn(
        "error_message", F.lit(None).cast("string")
    ).withColumn("fields_to_delete", F.transform("fields_to_delete", lambda f: F.when(f == "card", "").otherwise(f)))
    return conformance.request_violations(requests)


# --- metrics ---------------------------------------------------------------------------------------------------------

def event_metrics(spark, sf):
    rows = view(spark, sf, "metrics")
    labels = F.when(
        F.col("speed_label") == "fast", F.create_map(F.lit("tenant"), "tenant_label")
    ).otherwise(F.create_map(F.lit("tenant"), F.col("tenant_label"), F.lit("speed"), F.col("speed_label")))
    return rows.select("metric_id", "name", "value", "ts", labels.alias("labels"))


def latest_event(spark, sf):
    """Time of the newest event, as a value: filters on it reach the scan, as they would with a scheduled ``as_of``."""
    return table(spark, sf, "events").agg(F.max("ts")).first()[0]


@query("met1_record", [], """
SELECT l_returnflag || '_price' AS name, count(*) AS metrics, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag""")
def met1_record(spark, sf):
    recorded = metrics.record(
        table(spark, sf, "lineitem"), F.concat("l_returnflag", F.lit("_price")), F.col("l_extendedprice"),
        {"supplier": F.col("l_suppkey")}, ts=F.col("l_shipdate"),
    )
    return recorded.groupBy("name").agg(F.count("*").alias("metrics"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("met2_all", ["metrics"], "SELECT metric_id, name, value, epoch_us(ts) AS ts_us FROM metrics ORDER BY ts")
def met2_all(spark, sf):
    return metrics.chronological(event_metrics(spark, sf)).select("metric_id", "name", "value", micros("ts").alias("ts_us"))


@query("met3_name", ["metrics"], "SELECT metric_id, value, epoch_us(ts) AS ts_us FROM metrics WHERE name = 'click_ms' ORDER BY ts")
def met3_name(spark, sf):
    return metrics.by_name(event_metrics(spark, sf), "click_ms").select("metric_id", "value", micros("ts").alias("ts_us"))


@query("met4_label", ["metrics"], "SELECT metric_id, name, value FROM metrics WHERE speed_label = 'slow' ORDER BY ts")
def met4_label(spark, sf):
    return metrics.by_label(event_metrics(spark, sf), "speed", "slow").select("metric_id", "name", "value")


@query("met5_window", ["metrics"], """
SELECT metric_id, value FROM metrics WHERE name = 'view_ms' AND ts >= (SELECT max(ts) FROM metrics) - INTERVAL 100 HOUR""")
def met5_window(spark, sf):
    return metrics.trailing(event_metrics(spark, sf), "view_ms", latest_event(spark, sf), 100).select("metric_id", "value")


def _rank_sql(source: str, keys: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}"""


def _at(fraction: float) -> str:
    return f"max(CASE WHEN i = least(CAST(floor(CAST(n AS DOUBLE) * CAST({fraction} AS DOUBLE)) AS BIGINT), n - 1) THEN value END)"


@query("met6_summary", ["metrics"], f"""
SELECT name, count(*) AS "count", round(avg(value), 2) AS mean, min(value) AS "min", max(value) AS "max", round(stddev_samp(value), 2) AS stdev,
  {_at(0.5)} AS p50, {_at(0.99)} AS p99 FROM ({_rank_sql("metrics", "name")}) r GROUP BY name""")
def met6_summary(spark, sf):
    return metrics.summary(event_metrics(spark, sf))


@query("met6_summary_lineitem", [], f"""
SELECT name, count(*) AS "count", round(avg(value), 2) AS mean, min(value) AS "min", max(value) AS "max", round(stddev_samp(value), 2) AS stdev,
  {_at(0.5)} AS p50, {_at(0.99)} AS p99 FROM ({_rank_sql("(SELECT l_returnflag AS name, l_extendedprice AS value FROM lineitem) m", "name")}) r GROUP BY name""")
def met6_summary_lineitem(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_extendedprice").alias("value"))
    return metrics.summary(rows)


@query("met7_throughput", ["metrics"], """
SELECT name, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 864000, 2) AS throughput FROM metrics
WHERE ts >= (SELECT max(ts) FROM metrics) - INTERVAL 240 HOUR GROUP BY name""")
def met7_throughput(spark, sf):
    return metrics.throughput(event_metrics(spark, sf), latest_event(spark, sf), 240)


@query("met8_error_rate", ["audit"], """
SELECT round(100.0 * count(*) FILTER (WHERE status = 'FAILURE') / count(*), 2)::DOUBLE AS error_rate, count(*) AS event_count FROM audit
WHERE ts BETWEEN (SELECT max(ts) FROM audit) - INTERVAL 200 HOUR AND (SELECT max(ts) FROM audit)""")
def met8_error_rate(spark, sf):
    end = latest_event(spark, sf)
    return metrics.error_rate(view(spark, sf, "audit"), end - timedelta(hours=200), end)


@query("met8_by_tenant", ["audit"], """
SELECT tenant_id, round(100.0 * count(*) FILTER (WHERE status = 'FAILURE') / count(*), 2)::DOUBLE AS error_rate, count(*) AS event_count FROM audit
WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY tenant_id""")
def met8_by_tenant(spark, sf):
    return metrics.error_rate(view(spark, sf, "audit"), *AS_OF_RANGE, by=["tenant_id"])


_PERCENTILES = [0, 25, 50, 90, 95, 99.9, 100]


@query("met9_pct", ["metrics"], " UNION ALL ".join(
    f"SELECT name, CAST({p} AS DOUBLE) AS percentile, round({_at(p / 100)}, 2) AS latency FROM ({_rank_sql('(SELECT * FROM metrics WHERE ts >= (SELECT max(ts) FROM metrics) - INTERVAL 300 HOUR) w', 'name')}) r GROUP BY name"
    for p in _PERCENTILES))
def met9_pct(spark, sf):
    return metrics.latency_percentiles(event_metrics(spark, sf), _PERCENTILES, latest_event(spark, sf), 300)


@query("met10_count", ["metrics"], "SELECT count(*) AS metric_count FROM metrics")
def met10_count(spark, sf):
    return metrics.count(event_metrics(spark, sf))


@query("met11_violations", ["metrics"], """
SELECT metric_id, rule FROM metrics, (VALUES ('name_empty'), ('value_missing')) r(rule)
WHERE (rule = 'name_empty' AND name = 'error_ms') OR (rule = 'value_missing' AND value < 3)""")
def met11_violations(spark, sf):
    broken = event_metrics(spark, sf).withColumn(
        "name", F.when(F.col("name") == "error_ms", "").otherwise(F.col("name"))
    ).withColumn("value", F.when(F.col("value") >= 3, F.col("value")))
    return conformance.metric_violations(broken)


# --- tenancy ---------------------------------------------------------------------------------------------------------

TENANT_POLICIES = [
    ("tenant_0", "Exact and prefix", True, ["s3://src1/*", "s3://src16/en/6.txt", "https://therin.example.net/*"], ["s3", "kafka"]),
    ("tenant_1", "Globs", True, ["s3://src[0-4]/*/?*1*.txt", "http://*.example.com/*"], []),
    ("tenant_2", "Expressions", True, ["regex:https?://[a-z.]+\\.example\\.(org|net)/en/[0-9]+", "regex:s3://src1[0-9]/"], []),
    ("tenant_3", "Disabled", False, ["*"], []),
    ("tenant_4", "Unrestricted", True, [], ["kafka"]),
    ("tenant_5", "Classes", True, ["s3://src[!1]/en/*", "https://*.html"], ["s3"]),
]
_ALLOWED_SQL = r"""
CASE tenant_id
 WHEN 'tenant_0' THEN resource LIKE 's3://src1/%' OR resource = 's3://src16/en/6.txt' OR resource LIKE 'https://therin.example.net/%'
 WHEN 'tenant_1' THEN regexp_full_match(resource, 's3://src[0-4]/.*/..*1.*\.txt', 's') OR regexp_full_match(resource, 'http://.*\.example\.com/.*', 's')
   OR regexp_full_match(resource, 's3://src[0-4]/.*/.1.*\.txt', 's')
 WHEN 'tenant_2' THEN regexp_matches(resource, '^https?://[a-z.]+\.example\.(org|net)/en/[0-9]+') OR regexp_matches(resource, '^s3://src1[0-9]/')
 WHEN 'tenant_5' THEN regexp_full_match(resource, 's3://src[^1]/en/.*', 's') OR regexp_full_match(resource, 'https://.*\.html', 's')
END
"""
_ID_SQL = """
CASE WHEN tenant_id = '' THEN 'empty_tenant_id' WHEN length(tenant_id) > 255 THEN 'tenant_id_too_long'
     WHEN contains(tenant_id, '/') THEN 'invalid_characters' END
"""


def tenant_policies(spark):
    from wardenry.schemas import TENANTS

    return spark.createDataFrame(TENANT_POLICIES, TENANTS)


@query("ten1_ids", ["access"], f"SELECT tenant_id, resource, {_ID_SQL} AS denial_reason FROM access")
def ten1_ids(spark, sf):
    return tenancy.check_ids(view(spark, sf, "access")).select("tenant_id", "resource", "denial_reason")


@query("ten2_match", ["access"], r"""
SELECT resource, (resource LIKE 's3://src1/%')::INT + (resource = 's3://src16/en/6.txt')::INT + (resource LIKE 'https://therin.example.net/%')::INT AS matches
FROM access WHERE tenant_id = 'tenant_0'
UNION ALL SELECT resource, regexp_full_match(resource, 's3://src[0-4]/.*/..*1.*\.txt|s3://src[0-4]/.*/.1.*\.txt', 's')::INT + regexp_full_match(resource, 'http://.*\.example\.com/.*', 's')::INT
FROM access WHERE tenant_id = 'tenant_1'
UNION ALL SELECT resource, regexp_matches(resource, '^https?://[a-z.]+\.example\.(org|net)/en/[0-9]+')::INT + regexp_matches(resource, '^s3://src1[0-9]/')::INT
FROM access WHERE tenant_id = 'tenant_2'
UNION ALL SELECT resource, 1 FROM access WHERE tenant_id = 'tenant_3'
UNION ALL SELECT resource, 0 FROM access WHERE tenant_id = 'tenant_4'
UNION ALL SELECT resource, regexp_full_match(resource, 's3://src[^1]/en/.*', 's')::INT + regexp_full_match(resource, 'https://.*\.html', 's')::INT
FROM access WHERE tenant_id = 'tenant_5'""")
def ten2_match(spark, sf):
    matched = tenancy.matching_patterns(view(spark, sf, "access"), tenant_policies(spark))
    return matched.select("resource", F.size("matched").alias("matches"))


_DECISION_SQL = f"""
SELECT *, CASE WHEN denial IS NOT NULL THEN denial WHEN tenant_id = 'tenant_ghost' THEN 'unregistered' WHEN tenant_id = 'tenant_3' THEN 'tenant_disabled'
   WHEN tenant_id = 'tenant_4' THEN 'unrestricted' WHEN matched THEN 'matched' ELSE 'resource_not_allowed' END AS reason
FROM (SELECT *, {_ID_SQL} AS denial, {_ALLOWED_SQL} AS matched FROM access) a
"""


@query("ten3_decide", ["access"], f"""
SELECT tenant_id, resource, CASE WHEN reason IN ('unregistered', 'unrestricted', 'matched') THEN 'allow' ELSE 'deny' END AS decision, reason FROM ({_DECISION_SQL}) d""")
def ten3_decide(spark, sf):
    decided = tenancy.decide(view(spark, sf, "access"), tenant_policies(spark))
    return decided.select("tenant_id", "resource", "decision", "reason")


@query("ten3_many_patterns", [], """
WITH ids AS (SELECT o_orderkey AS k, CAST(o_orderkey AS STRING) AS t, 'tenant_' || CAST(o_custkey % 2 AS STRING) AS tenant_id FROM orders),
prefixes AS (SELECT DISTINCT tenant_id, substr(t, 1, greatest(length(t) - 1, 2)) AS p FROM ids WHERE k % 3 = 0)
SELECT tenant_id, 's3://orders/' || t AS resource,
  CASE WHEN k % 7 = 0 OR (tenant_id, substr(t, 1, 1)) IN (SELECT tenant_id, p FROM prefixes) OR (tenant_id, substr(t, 1, 2)) IN (SELECT tenant_id, p FROM prefixes) OR (tenant_id, substr(t, 1, 3)) IN (SELECT tenant_id, p FROM prefixes)
    OR (tenant_id, substr(t, 1, 4)) IN (SELECT tenant_id, p FROM prefixes) OR (tenant_id, substr(t, 1, 5)) IN (SELECT tenant_id, p FROM prefixes)
    OR (tenant_id, substr(t, 1, 6)) IN (SELECT tenant_id, p FROM prefixes) THEN 'allow' ELSE 'deny' END AS decision FROM ids""")
def ten3_many_patterns(spark, sf):
    """Tenants whose lists have a prefix or a name for thousands of orders."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("t"), F.concat(F.lit("tenant_"), (F.col("o_custkey") % 2).cast("string")).alias("tenant_id"))
    uri = F.concat(F.lit("s3://orders/"), F.col("t"))
    start = F.concat(F.lit("s3://orders/"), F.left("t", F.greatest(F.length("t") - 1, F.lit(2))), F.lit("*"))
    patterns = F.explode(F.array_compact(F.array(F.when(F.col("k") % 3 == 0, start), F.when(F.col("k") % 7 == 0, uri))))
    lists = orders.select("tenant_id", patterns.alias("pattern")).distinct()
    none = F.array().cast("array<string>")
    tenants = lists.select("tenant_id").distinct().select(
        "tenant_id", F.lit("x").alias("name"), F.lit(True).alias("enabled"), none.alias("allowed_resources"), none.alias("allowed_connector_types"))
    return tenancy.decide(orders.select("tenant_id", uri.alias("resource")), tenants, patterns=lists).select("tenant_id", "resource", "decision")


@query("ten4_keys", ["access"], """
SELECT tenant_id || '/' || resource AS object_key, tenant_id || '_' || connector_type AS topic FROM access""")
def ten4_keys(spark, sf):
    return view(spark, sf, "access").select(
        tenancy.object_key(F.col("tenant_id"), F.col("resource")).alias("object_key"),
        tenancy.topic_name(F.col("tenant_id"), F.col("connector_type")).alias("topic"),
    )


@query("ten5_denials", ["access"], f"""
SELECT CASE WHEN tenant_id = '' THEN 'UNKNOWN' ELSE tenant_id END AS tenant_id, reason AS error_message, 'TENANT_ACCESS_DENIED' AS action, count(*) AS denials
FROM ({_DECISION_SQL}) d WHERE reason NOT IN ('unregistered', 'unrestricted', 'matched') GROUP BY ALL""")
def ten5_denials(spark, sf):
    decided = tenancy.decide(view(spark, sf, "access"), tenant_policies(spark))
    return tenancy.denial_events(decided, datetime(2024, 1, 1)).groupBy("tenant_id", "error_message", "action").agg(
        F.count("*").alias("denials")
    )


@query("ten6_paths", ["paths"], """
SELECT path, CASE WHEN path = '' THEN 'empty_path' WHEN contains(path, '..') THEN 'parent_reference' WHEN path LIKE '/%' THEN 'absolute_path' END AS denial_reason FROM paths""")
def ten6_paths(spark, sf):
    return tenancy.check_paths(view(spark, sf, "paths"))


@query("ten7_registrations", [], """
SELECT tenant_id, rule FROM (SELECT 'supplier_' || CAST(s_suppkey AS STRING) AS tenant_id, s_acctbal, s_nationkey FROM supplier) s,
  (VALUES ('name_missing'), ('connector_type_unknown')) r(rule)
WHERE (rule = 'name_missing' AND s_acctbal < 0) OR (rule = 'connector_type_unknown' AND s_nationkey > 12)""")
def ten7_registrations(spark, sf):
    tenants = table(spark, sf, "supplier").select(
        F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("tenant_id"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("name"), F.lit(True).alias("enabled"),
        F.array(F.lit("s3://*")).alias("allowed_resources"),
        F.array(F.lit("s3"), F.when(F.col("s_nationkey") > 12, "ftp").otherwise("kafka")).alias("allowed_connector_types"),
    )
    return conformance.tenant_violations(tenants)


@query("ten8_types", ["access"], f"""
SELECT tenant_id, resource, CASE WHEN reason IN ('unregistered', 'unrestricted', 'matched') THEN 'allow' ELSE 'deny' END AS decision, reason FROM (
  SELECT tenant_id, resource, CASE WHEN (tenant_id = 'tenant_4' AND connector_type = 's3') OR (tenant_id = 'tenant_5' AND connector_type = 'kafka')
     THEN 'connector_type_not_allowed' ELSE reason END AS reason FROM ({_DECISION_SQL}) d) e""")
def ten8_types(spark, sf):
    decided = tenancy.decide(view(spark, sf, "access"), tenant_policies(spark), connector_type="connector_type")
    return decided.select("tenant_id", "resource", "decision", "reason")


# --- sources, changes, reconciliation --------------------------------------------------------------------------------

@query("src7_sql", ["kyc"], "SELECT customer_id, full_name, balance FROM kyc WHERE segment = 'BUILDING' AND balance >= 2500 AND tenant_id <> 'tenant_3'")
def src7_sql(spark, sf):
    return query_scans.query(
        spark,
        "SELECT customer_id, full_name, balance FROM {kyc} WHERE segment = :segment AND balance >= :least AND tenant_id <> :tenant",
        {"segment": "BUILDING", "least": 2500.0, "tenant": "tenant_3"}, kyc=view(spark, sf, "kyc"),
    )


@query("src8_find", ["kyc"], """
SELECT customer_id AS _id, tenant_id, segment, balance FROM kyc
WHERE segment = 'MACHINERY' AND tenant_id <> 'tenant_1' AND (balance > 5000 OR email IS NULL)""")
def src8_find(spark, sf):
    docs = view(spark, sf, "kyc").select(F.col("customer_id").cast("long").alias("_id"), "tenant_id", "segment", "balance", "email")
    wanted = '{"segment": "MACHINERY", "tenant_id": {"$ne": "tenant_1"}, "$or": [{"balance": {"$gt": 5000}}, {"email": null}]}'
    return query_scans.find(docs, wanted).drop("email")


@query("src10_replay", ["messages"], "SELECT offset, partition, value FROM messages WHERE partition = 2 AND offset >= 500".replace("offset", '"offset"').replace("partition", '"partition"'))
def src10_replay(spark, sf):
    return topics.replay_landed(view(spark, sf, "messages"), 500, 2).select("offset", "partition", "value")


@query("src11_once", ["messages"], "SELECT DISTINCT message_id, value FROM messages")
def src11_once(spark, sf):
    delivered = view(spark, sf, "messages")
    again = delivered.where("tenant_id = 'tenant_2'")
    return topics.once(delivered.unionByName(again)).select("message_id", "value")


@query("snk6_messages", ["messages"], """
SELECT tenant_id || '_events' AS topic, '{"message_id":"' || message_id || '","note":' || CASE WHEN value LIKE '%9}' THEN 'null' ELSE '"ok"' END || '}' AS value FROM messages""")
def snk6_messages(spark, sf):
    rows = view(spark, sf, "messages").withColumn("note", F.when(~F.col("value").like("%9}"), F.lit("ok")))
    return topics.messages(rows, "events", columns=["message_id", "note"])


@query("snk4_upsert", [], """
SELECT c.c_custkey, CASE WHEN o.status IS NULL THEN c.c_mktsegment ELSE o.status END AS segment
FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
UNION ALL SELECT 1000000000 + l_suppkey, 'NEW' FROM (SELECT DISTINCT l_suppkey FROM lineitem) n""")
def snk4_upsert(spark, sf):
    target = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    orders = table(spark, sf, "orders").where("o_totalprice > 400000").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("segment"), F.col("o_orderkey").alias("version")
    )
    added = table(spark, sf, "lineitem").select(
        (F.lit(1_000_000_000) + F.col("l_suppkey")).alias("c_custkey"), F.lit("NEW").alias("segment"), F.lit(0).cast("long").alias("version")
    )
    return dml.upsert(target, orders.unionByName(added), ["c_custkey"], order="version")


@query("snk4_update", [], """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT o_totalprice < 20000""")
def snk4_update(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    changed = dml.update_where(orders, F.col("o_orderpriority") == "1-URGENT", {"o_orderstatus": F.lit("X")})
    return dml.delete_where(changed, F.col("o_totalprice") < 20000).select("o_orderkey", "o_orderstatus")


@query("snk4_one", [], """
SELECT s_suppkey, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 7) THEN 'changed' ELSE s_name END AS s_name FROM supplier
WHERE s_suppkey <> (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal < 0)""")
def snk4_one(spark, sf):
    suppliers = table(spark, sf, "supplier")
    changed = dml.update_one(suppliers, F.col("s_nationkey") == 7, {"s_name": F.lit("changed")}, "s_suppkey")
    return dml.delete_one(changed, F.col("s_acctbal") < 0, "s_suppkey").select("s_suppkey", "s_name")


@query("snk2_delete", [], "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def snk2_delete(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return dml.delete_keys(docs, table(spark, sf, "labels").where("toxic = 1"), ["doc_id"])


@query("job2_reconcile", ["migrated_orders"], """
SELECT o_orderstatus, records_processed, records_written, CASE WHEN records_processed = records_written THEN 'passed' ELSE 'failed_mismatch' END AS verification_status,
  CASE WHEN records_processed <> records_written THEN 'Record count mismatch: ' || CAST(records_processed - records_written AS STRING) || ' records not written' END AS warning
FROM (SELECT o_orderstatus, count(*) AS records_processed FROM orders GROUP BY o_orderstatus) s
JOIN (SELECT o_orderstatus, count(*) AS records_written FROM migrated_orders GROUP BY o_orderstatus) t USING (o_orderstatus)""")
def job2_reconcile(spark, sf):
    return reconcile.count_check(table(spark, sf, "orders"), view(spark, sf, "migrated_orders"), ["o_orderstatus"])


@query("job2_differences", [], """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN 'missing_in_target' ELSE 'values_differ' END AS difference FROM orders
WHERE (o_orderstatus = 'P' AND o_totalprice > 450000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 50000)""")
def job2_differences(spark, sf):
    columns = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return reconcile.compare_rows(table(spark, sf, "orders"), view(spark, sf, "migrated_orders"), ["o_orderkey"], columns)


@query("job2_differences_tree", [], """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN 'missing_in_target' ELSE 'values_differ' END AS difference FROM orders
WHERE (o_orderstatus = 'P' AND o_totalprice > 450000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 50000)""")
def job2_differences_tree(spark, sf):
    columns = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return reconcile.compare_by_ranges(table(spark, sf, "orders"), view(spark, sf, "migrated_orders"), ["o_orderkey"], columns)


def compliance_logs(spark, sf):
    """Tenants, and logs in which some tenants lack some kind of event."""
    tenants = table(spark, sf, "nation").select(F.concat(F.lit("tenant_"), F.col("n_nationkey").cast("string")).alias("tenant_id"))
    return tenants, view(spark, sf, "audit"), view(spark, sf, "edges"), erasure_requests(spark, sf)


_COMPLIANCE_SQL = """
tenants AS (SELECT 'tenant_' || CAST(n_nationkey AS STRING) AS tenant_id FROM nation),
checks AS (
  SELECT tenant_id, 'pii_masking' AS check_name, (SELECT count(*) FROM audit a WHERE a.tenant_id = t.tenant_id AND action = 'signup') AS event_count FROM tenants t UNION ALL
  SELECT tenant_id, 'lineage', (SELECT count(*) FROM edges e WHERE e.tenant_id = t.tenant_id) FROM tenants t UNION ALL
  SELECT tenant_id, 'audit_logs', (SELECT count(*) FROM audit a WHERE a.tenant_id = t.tenant_id) FROM tenants t UNION ALL
  SELECT tenant_id, 'retention', (SELECT count(*) FROM requests r WHERE r.tenant_id = t.tenant_id) FROM tenants t)
"""


@query("job3_checks", ["audit", "edges", "requests"], f"""
WITH {_COMPLIANCE_SQL} SELECT tenant_id, check_name, event_count, CASE WHEN event_count > 0 THEN 'pass' ELSE 'warning' END AS status,
  CASE WHEN event_count > 0 THEN 'Found ' || CAST(event_count AS STRING) || CASE check_name WHEN 'pii_masking' THEN ' PII masking events'
      WHEN 'lineage' THEN ' lineage tracking events' WHEN 'audit_logs' THEN ' audit log entries' ELSE ' retention/erasure records' END
    ELSE CASE check_name WHEN 'pii_masking' THEN 'No PII masking events found for tenant' WHEN 'lineage' THEN 'No lineage events found for tenant'
      WHEN 'audit_logs' THEN 'No audit log entries found for tenant' ELSE 'No retention policy enforcement records found' END END AS message
FROM checks""")
def job3_checks(spark, sf):
    return compliance.check_tenants(*compliance_logs(spark, sf), masking_action="signup")


@query("job3_compliance", ["audit", "edges", "requests"], f"""
WITH {_COMPLIANCE_SQL} SELECT *, CASE WHEN checks_failed = 0 THEN 'success' WHEN checks_failed < (checks_passed + checks_failed) / 2.0 THEN 'warning' ELSE 'failure' END AS overall_status,
  CASE WHEN checks_failed <> 0 AND NOT checks_failed < (checks_passed + checks_failed) / 2.0 THEN 'Compliance check failed: ' || CAST(checks_failed AS STRING) || ' issues found' END AS error_message
FROM (SELECT tenant_id, count(*) FILTER (WHERE event_count > 0) AS checks_passed, count(*) FILTER (WHERE event_count = 0) AS checks_failed FROM checks GROUP BY tenant_id) r""")
def job3_compliance(spark, sf):
    return compliance.roll_up(compliance.check_tenants(*compliance_logs(spark, sf), masking_action="signup"))

"""Queries that write files or versioned tables derived from the provided tables and read them back.

Each run works below a fresh path in the shared folder.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenry import schemas as S
from wardenry.operators import erasure, masking, registry, tenancy
from wardenry.plans import jobs, runs, steps
from wardenry.plans.bindings import table, view
from wardenry.plans.catalog import (
    KYC_RULES, _MISSING_SQL, erasure_requests, event_metrics, kyc_vault, query, tenant_policies,
)
from wardenry.session import scratch_path
from wardenry.sources import files, sinks, topics
from wardenry.sources.versioned import TableStore
from wardenry.streaming import ingest, windows

_CSV_COLUMNS = ["customer_id", "full_name", "email", "ssn", "note"]
RECORDS_PER_DOCUMENT = 1000


def _store(spark) -> TableStore:
    return TableStore(spark, scratch_path(spark, "store"))


def _write_documents(df: DataFrame, number: str, record: str, path: str) -> None:
    """JSON array files of a fixed number of records each, so that files multiply with the data and never grow."""
    document = F.floor(F.col(number).cast("long") / RECORDS_PER_DOCUMENT)
    (
        df.groupBy(document.alias("document"))
        .agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n "), F.lit("]")).alias("value"))
        .repartition("document").write.partitionBy("document").text(path)
    )


_MASKED_SQL = f"""
SELECT json_extract_string(record, '$.customer_id') AS customer_id, json_extract_string(record, '$.full_name') AS full_name,
  sha256('email:' || json_extract_string(record, '$.email')) AS email, '***REDACTED***' AS ssn, tenant_id
FROM ({_MISSING_SQL}) m WHERE is_object AND NOT no_email AND NOT no_ssn"""


@query("job1_projection", ["kyc_json"], _MASKED_SQL)
def job1_projection(spark, sf):
    checked = registry.check_presence(view(spark, sf, "kyc_json"), list(KYC_RULES))
    valid, _ = registry.split_valid(checked)
    columns = [F.try_element_at("parsed", F.lit(f)).alias(f) for f in KYC_RULES]
    return masking.mask_table(valid.select(*columns, "tenant_id"), KYC_RULES)


# --- scans -----------------------------------------------------------------------------------------------------------

@query("src1_json", ["kyc_json"], "SELECT record, false AS malformed FROM kyc_json")
def src1_json(spark, sf):
    path = scratch_path(spark, "json")
    _write_documents(view(spark, sf, "kyc_json"), "customer_key", "record", path)
    return files.json_documents(spark, path).select("record", "malformed")


@query("src1_json_lines", ["kyc_json"], "SELECT record, json_type(record) <> 'OBJECT' AS malformed FROM kyc_json")
def src1_json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    view(spark, sf, "kyc_json").select("record").write.text(path)
    return files.json_lines(spark, path).select("record", "malformed")


@query("src2_csv", ["kyc"], "SELECT customer_id, full_name, coalesce(email, '') AS email, ssn, coalesce(note, '') AS note FROM kyc")
def src2_csv(spark, sf):
    path = scratch_path(spark, "csv")
    view(spark, sf, "kyc").select(*_CSV_COLUMNS).write.option("header", "true").csv(path)
    return files.csv_table(spark, path, _CSV_COLUMNS).select(*_CSV_COLUMNS)


@query("src2_csv_multiline", [], "SELECT CAST(doc_id AS STRING) AS doc_id, text FROM documents")
def src2_csv_multiline(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "text").write.option("header", "true").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return files.csv_table(spark, path, ["doc_id", "text"], multi_line=True).select("doc_id", "text")


@query("src3_parquet", [], "SELECT p_partkey, p_name, p_retailprice FROM part")
def src3_parquet(spark, sf):
    return files.read_object(spark, sf.rsplit("/", 1)[0], sf.rsplit("/", 1)[1], "part.parquet", "parquet").select(
        "p_partkey", "p_name", "p_retailprice"
    )


@query("src4_landing", [], """
SELECT 'json' AS suffix, count(*) AS records, 0 AS malformed FROM customer UNION ALL
SELECT 'csv', count(*), 0 FROM supplier UNION ALL SELECT 'parquet', count(*), 0 FROM part""")
def src4_landing(spark, sf):
    path = scratch_path(spark, "landing")
    _write_documents(
        view(spark, sf, "kyc").select("customer_id", F.to_json(F.struct("customer_id", "email"), {"ignoreNullFields": "false"}).alias("record")),
        "customer_id", "record", f"{path}/in",
    )
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("header", "true").csv(f"{path}/csv")
    table(spark, sf, "part").select("p_partkey", "p_name").write.parquet(f"{path}/parquet")
    # Spark names text output .txt, so documents are scanned as their own folder here.
    landed = files.landing_zone(spark, path, ["s_suppkey", "s_name"]).unionByName(files.json_documents(spark, f"{path}/in"))
    suffix = F.when(F.col("path").endswith(".txt"), "json").otherwise(F.regexp_extract("path", r"\.([a-z]+)$", 1))
    return landed.groupBy(suffix.alias("suffix")).agg(
        F.count("*").alias("records"), F.count_if("malformed").cast("int").alias("malformed")
    )


@query("src5_object", ["kyc"], "SELECT customer_id, email, tenant_id FROM kyc WHERE tenant_id = 'tenant_3'")
def src5_object(spark, sf):
    path = scratch_path(spark, "objects")
    for_all = view(spark, sf, "kyc").select("customer_id", "email", "tenant_id")
    for_all.withColumn("owner", F.col("tenant_id")).write.partitionBy("owner").parquet(f"{path}/kyc")
    return files.read_object(spark, f"{path}/kyc", "owner=tenant_3", "*.parquet", "parquet")


@query("src6_list", ["kyc"], "SELECT tenant_id, true AS has_objects FROM (SELECT DISTINCT tenant_id FROM kyc) t")
def src6_list(spark, sf):
    path = scratch_path(spark, "objects")
    view(spark, sf, "kyc").select("customer_id", "tenant_id").write.partitionBy("tenant_id").parquet(f"{path}/acme/kyc")
    listed = files.list_objects(spark, path, "acme", "kyc/tenant_id=")
    return listed.groupBy(F.regexp_extract("key", r"tenant_id=([^/]+)/", 1).alias("tenant_id")).agg(
        (F.sum("length") > 0).alias("has_objects")
    )


@query("src12_table", [], "SELECT * FROM supplier")
def src12_table(spark, sf):
    store = _store(spark)
    with store.transaction() as change:
        change.append("supplier", table(spark, sf, "supplier"))
    return store.read("supplier")


@query("src13_read_write", ["messages"], """
SELECT '{"message_id":"' || message_id || '"}' AS value, 'tenant_9_landed' AS topic FROM messages""")
def src13_read_write(spark, sf):
    root = scratch_path(spark, "topics")
    rows = view(spark, sf, "messages").select("message_id")
    sinks.write_any("kafka", "landed", rows, tenant_id="tenant_9", root=root)
    return sinks.read_any(spark, "kafka", "landed", tenant_id="tenant_9", root=root).select("value", "topic")


# --- sinks -----------------------------------------------------------------------------------------------------------

@query("snk1_overwrite", ["kyc"], """
SELECT customer_id, CASE WHEN tenant_id = 'tenant_3' THEN 'second' ELSE 'first' END AS write_no, tenant_id FROM kyc""")
def snk1_overwrite(spark, sf):
    path = scratch_path(spark, "by-tenant")
    rows = view(spark, sf, "kyc").select("customer_id", F.lit("first").alias("write_no"), "tenant_id")
    sinks.write_by_tenant(rows, path)
    sinks.write_by_tenant(rows.where("tenant_id = 'tenant_3'").withColumn("write_no", F.lit("second")), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("snk3_append", ["kyc"], """
SELECT customer_id, email, CAST(NULL AS STRING) AS phone FROM kyc UNION ALL SELECT customer_id, NULL, 'unknown' FROM kyc""")
def snk3_append(spark, sf):
    store, target = _store(spark), "customer_id string, email string, phone string"
    declared = spark.createDataFrame([], target).schema
    kyc = view(spark, sf, "kyc")
    sinks.append(store, "contacts", kyc.select("customer_id", "email", "segment"), declared)
    sinks.append(store, "contacts", kyc.select(F.lit("unknown").alias("phone"), "customer_id"), declared)
    return store.read("contacts")


@query("snk5_transaction", [], """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def snk5_transaction(spark, sf):
    store = _store(spark)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    with store.transaction() as change:
        change.append("orders", orders)
    # Replaces the table it reads.
    with store.transaction() as change:
        change.replace("orders", store.read("orders").where("o_orderstatus <> 'F'"))
    try:
        with store.transaction() as change:
            change.replace("orders", store.read("orders").where("o_orderstatus = 'P'"))
            raise InterruptedError
    except InterruptedError:
        pass
    return store.read("orders")


# --- jobs ------------------------------------------------------------------------------------------------------------

@query("job1_kyc", ["kyc_json"], _MASKED_SQL)
def job1_kyc(spark, sf):
    store = _store(spark)
    jobs.ingest_records(store, view(spark, sf, "kyc_json"), KYC_RULES, "customers", source_path="s3://landing/kyc")
    return store.read("customers").drop("extra")


LINE_RULES = {
    "order": {"required": True}, "supplier": {"required": True, "sensitive": True, "masking_strategy": "tokenize"},
    "price": {"sensitive": True, "masking_strategy": "hash"}, "flag": {},
}


@query("job1_volume", [], """
SELECT CAST(l_orderkey AS STRING) AS "order", 'token_' || substr(sha256(CAST(l_suppkey AS STRING)), 1, 16) AS supplier,
  sha256('price:' || CAST(l_extendedprice AS STRING)) AS price, l_returnflag AS flag, 'tenant_' || l_linestatus AS tenant_id
FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity < 10)""")
def job1_volume(spark, sf):
    """The largest table as raw records of two tenants; returned records of small orders lack their supplier."""
    supplier = F.when(~((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10)), F.col("l_suppkey"))
    record = F.to_json(F.struct(
        F.col("l_orderkey").alias("order"), supplier.alias("supplier"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"),
    ))
    records = table(spark, sf, "lineitem").select(
        record.alias("record"), F.concat(F.lit("tenant_"), "l_linestatus").alias("tenant_id")
    )
    store = _store(spark)
    jobs.ingest_records(store, records, LINE_RULES, "lines", source_path="s3://landing/lines")
    return store.read("lines").drop("extra")


def _typed_records(spark, sf):
    """Customers as records with a boolean, the same as a string, and a repeated key."""
    rich = F.coalesce(F.col("c_acctbal") > 0, F.lit(False))
    text = F.to_json(F.struct(F.col("c_custkey").alias("id"), rich.alias("rich"), rich.cast("string").alias("told")))
    again = F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"id":"again-'), F.col("c_custkey").cast("string"), F.lit('"}'))
    return table(spark, sf, "customer").select(again.alias("record"), F.lit("tenant_0").alias("tenant_id"))


_RICH_SQL = "CASE WHEN c_acctbal > 0 THEN {} ELSE {} END"


@query("job1_types", [], f"""
SELECT 'again-' || c_custkey AS id, sha256('rich:' || {_RICH_SQL.format("'True'", "'False'")}) AS rich,
  sha256('told:' || {_RICH_SQL.format("'true'", "'false'")}) AS told FROM customer""")
def job1_types(spark, sf):
    """Booleans and their strings are hashed as different texts, and of a repeated key the last value counts."""
    store, masked = _store(spark), {"sensitive": True, "masking_strategy": "hash"}
    jobs.ingest_records(store, _typed_records(spark, sf), {"id": {"required": True}, "rich": masked, "told": masked}, "rich", source_path="s3://landing/rich")
    return store.read("rich").select("id", "rich", "told")


@query("job1_extra", [], f"""
SELECT 'again-' || c_custkey AS id, {_RICH_SQL.format("'true'", "'false'")} AS rich, {_RICH_SQL.format("'true'", "'false'")} AS told, 2 AS others FROM customer""")
def job1_extra(spark, sf):
    """Keys that the schema does not declare are kept."""
    store = _store(spark)
    jobs.ingest_records(store, _typed_records(spark, sf), {"id": {"required": True}}, "rich", source_path="s3://landing/rich")
    extra = F.col("extra")
    return store.read("rich").select("id", extra["rich"].alias("rich"), extra["told"].alias("told"), F.size(extra).alias("others"))


@query("job2_volume", [], "SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, l_extendedprice AS amount FROM lineitem")
def job2_volume(spark, sf):
    store = _store(spark)
    jobs.migrate_table(
        store, table(spark, sf, "lineitem"), "lines", rules={"l_orderkey": {"required": True}, "l_suppkey": {"required": True}},
        tenant_id="tenant_0", source_system="postgresql", target_system="snowflake",
        mapping={"order_id": "l_orderkey", "supplier_id": "l_suppkey", "amount": "l_extendedprice"},
    )
    return store.read("lines")


@query("job4_volume", ["requests"], """
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM requests r WHERE r.user_id = 'user_' || CAST(o_custkey AS STRING) AND list_contains(string_split(r.fields, ','), 'card'))
  THEN NULL ELSE o_totalprice END AS card FROM orders""")
def job4_volume(spark, sf):
    """Orders of the customers who asked for erasure, the amount standing for the card field; nation tenants as partitions."""
    owners = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("tenant_"), F.col("c_nationkey").cast("string")).alias("tenant_id")
    )
    orders = table(spark, sf, "orders").join(owners, "o_custkey").select(
        "o_orderkey", F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("o_totalprice").alias("card"), "tenant_id",
    )
    store = _store(spark)
    with store.transaction() as change:
        change.append("orders", orders, ["tenant_id"])
    jobs.submit_requests(store, erasure_requests(spark, sf))
    jobs.execute_requests(store, {"orders": ["card"]})
    return store.read("orders").select("o_orderkey", "card")


@query("job1_rejected", ["kyc_json"], f"""
SELECT record, tenant_id, CASE WHEN NOT is_object THEN NULL WHEN no_email AND no_ssn THEN 'email,ssn' WHEN no_email THEN 'email' ELSE 'ssn' END AS missing
FROM ({_MISSING_SQL}) m WHERE NOT is_object OR no_email OR no_ssn""")
def job1_rejected(spark, sf):
    store = _store(spark)
    jobs.ingest_records(store, view(spark, sf, "kyc_json"), KYC_RULES, "customers", source_path="s3://landing/kyc")
    return store.read("customers_rejected").select(
        "record", "tenant_id", F.array_join(F.array_sort("missing_fields"), ",").alias("missing")
    )


@query("job1_audit", ["kyc_json"], f"""
SELECT tenant_id, action, record_id, status, n AS masked FROM (
  SELECT tenant_id, CAST(count(*) FILTER (WHERE is_object AND NOT no_email AND NOT no_ssn) AS STRING) AS n FROM ({_MISSING_SQL}) m GROUP BY tenant_id) t,
  (VALUES ('KYC_INGESTION', 'customers', 'SUCCESS'), ('MASK_RECORD', 'customers', 'SUCCESS')) a(action, record_id, status)""")
def job1_audit(spark, sf):
    store = _store(spark)
    jobs.ingest_records(store, view(spark, sf, "kyc_json"), KYC_RULES, "customers", source_path="s3://landing/kyc")
    logged = store.read("audit").where("action <> 'LINEAGE_TRANSFORMATION_TRACKED'")
    masked = F.coalesce(F.col("details")["records_masked"], F.col("details")["records_inserted"])
    return logged.select("tenant_id", "action", "record_id", "status", masked.alias("masked"))


@query("job2_migration", [], """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders""")
def job2_migration(spark, sf):
    store = _store(spark)
    rules = {"o_orderkey": {"required": True}, "o_totalprice": {"required": True}}
    jobs.migrate_table(
        store, table(spark, sf, "orders"), "orders", rules=rules, tenant_id="tenant_0", source_system="postgresql",
        target_system="snowflake", mapping={"order_id": "o_orderkey", "customer_id": "o_custkey", "amount": "o_totalprice"},
    )
    return store.read("orders")


@query("job3_job", ["kyc_json"], f"""
SELECT tenant_id, check_name, CASE check_name WHEN 'retention' THEN 'warning' ELSE 'pass' END AS status
FROM (SELECT DISTINCT tenant_id FROM ({_MISSING_SQL}) m) t, (VALUES ('pii_masking'), ('lineage'), ('audit_logs'), ('retention')) c(check_name)""")
def job3_job(spark, sf):
    store = _store(spark)
    records = view(spark, sf, "kyc_json")
    jobs.ingest_records(store, records, KYC_RULES, "customers", source_path="s3://landing/kyc")
    jobs.check_compliance(store, records)
    return store.read("compliance_checks").select("tenant_id", "check_name", "status")


@query("job4_erasure", ["kyc", "requests"], """
SELECT k.customer_id, k.tenant_id, CASE WHEN list_contains(string_split(r.fields, ','), 'email') THEN NULL ELSE k.email END AS email,
  CASE WHEN list_contains(string_split(r.fields, ','), 'ssn') THEN NULL ELSE k.ssn END AS ssn
FROM kyc k LEFT JOIN requests r ON r.user_id = k.user_id AND r.tenant_id = k.tenant_id""")
def job4_erasure(spark, sf):
    store = _store(spark)
    with store.transaction() as change:
        change.append("customers", view(spark, sf, "kyc").select("customer_id", "tenant_id", "user_id", "email", "ssn"), ["tenant_id"])
        change.append("vault", kyc_vault(spark, sf), ["tenant_id"])
    jobs.submit_requests(store, erasure_requests(spark, sf))
    jobs.execute_requests(store, {"customers": ["email", "ssn"]})
    return store.read("customers").select("customer_id", "tenant_id", "email", "ssn")


@query("job4_vacuum", ["kyc", "requests"], """
SELECT k.customer_id, CASE WHEN list_contains(string_split(r.fields, ','), 'email') THEN NULL ELSE k.email END AS email,
  CASE WHEN list_contains(string_split(r.fields, ','), 'ssn') THEN NULL ELSE k.ssn END AS ssn
FROM kyc k LEFT JOIN requests r ON r.user_id = k.user_id AND r.tenant_id = k.tenant_id""")
def job4_vacuum(spark, sf):
    """Whatever files lie below the table after the erasure, read without the store."""
    store = _store(spark)
    with store.transaction() as change:
        change.append("customers", view(spark, sf, "kyc").select("customer_id", "tenant_id", "user_id", "email", "ssn"), ["tenant_id"])
    jobs.submit_requests(store, erasure_requests(spark, sf))
    jobs.execute_requests(store, {"customers": ["email", "ssn"]})
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"{store.root}/data/customers")
    return files.select("customer_id", "email", "ssn")


@query("job4_states", ["requests"], "SELECT request_id, 'COMPLETE' AS status FROM requests")
def job4_states(spark, sf):
    store = _store(spark)
    with store.transaction() as change:
        change.append("vault", kyc_vault(spark, sf))
    jobs.submit_requests(store, erasure_requests(spark, sf))
    jobs.execute_requests(store, {})
    return erasure.current_states(store.read("erasure_states")).select("request_id", "status")


@query("job4_records", [], """
SELECT c_custkey, tenant_id FROM (SELECT c_custkey, 'tenant_' || CAST(c_nationkey AS STRING) AS tenant_id, c_nationkey FROM customer) c
WHERE NOT (c_nationkey = 7 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))""")
def job4_records(spark, sf):
    store = _store(spark)
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("tenant_"), F.col("c_nationkey").cast("string")).alias("tenant_id")
    )
    with store.transaction() as change:
        change.append("customers", customers, ["tenant_id"])
    ids = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    jobs.erase_records(store, "customers", ids, "c_custkey", tenant_id="tenant_7")
    return store.read("customers")


@query("job5_atomic", [], """
SELECT step, connector_type, operation, status, CASE step WHEN 0 THEN NULL WHEN 1 THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
  ELSE (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') END AS records
FROM (VALUES (0, 'postgresql', 'read', 'success'), (1, 's3', 'write', 'success'), (2, 'snowflake', 'write', 'success')) v(step, connector_type, operation, status)""")
def job5_atomic(spark, sf):
    store = _store(spark)
    with store.transaction() as change:
        change.append("orders", table(spark, sf, "orders"))
    outcome = steps.run_steps(store, tenant_policies(spark), "tenant_4", [
        steps.Step("postgresql", "read", query="orders"),
        steps.Step("s3", "write", destination="finished", data=lambda read: read[0].where("o_orderstatus = 'F'")),
        steps.Step("snowflake", "write", destination="buyers", data=lambda read: read[0].where("o_orderstatus = 'F'").select("o_custkey").distinct()),
    ])
    return outcome.drop("destination")


@query("job5_rolled_back", [], "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders")
def job5_rolled_back(spark, sf):
    store = _store(spark)
    with store.transaction() as change:
        change.append("orders", table(spark, sf, "orders"))
    try:
        steps.run_steps(store, tenant_policies(spark), "tenant_4", [
            steps.Step("postgresql", "read", query="orders"),
            steps.Step("s3", "write", destination="orders", data=lambda read: read[0]),
            steps.Step("s3", "read", query="no_such_table"),
        ])
    except steps.StepsFailed:
        pass
    return store.read("orders").agg(F.count("*").alias("row_count")).select(F.lit("orders").alias("table_name"), "row_count")


@query("job6_audited", ["kyc"], "SELECT customer_id, email FROM kyc WHERE tenant_id = 'tenant_4'")
def job6_audited(spark, sf):
    store = _store(spark)
    policies = tenant_policies(spark)
    kyc = view(spark, sf, "kyc").select("customer_id", "email", "tenant_id")
    with store.transaction() as change:
        change.append("customers", kyc)
    mine = steps.tenant_read(store, policies, "tenant_4", "customers")
    steps.tenant_write(store, policies, "tenant_4", "copies", mine.drop("tenant_id"))
    return store.read("copies").select("customer_id", "email")


@query("job7_dry_run", ["kyc_json"], f"""
SELECT 'kyc_ingestion' AS job_type, 'success' AS status, count(*) FILTER (WHERE is_object AND NOT no_email AND NOT no_ssn) AS records_processed,
  count(*) FILTER (WHERE NOT (is_object AND NOT no_email AND NOT no_ssn)) AS records_failed FROM ({_MISSING_SQL}) m""")
def job7_dry_run(spark, sf):
    store = _store(spark)
    outcome = jobs.ingest_records(
        store, view(spark, sf, "kyc_json"), KYC_RULES, "customers", source_path="s3://landing/kyc", dry_run=True
    )
    return outcome.row(spark).select("job_type", "status", "records_processed", "records_failed")


@query("job8_history", [], """
SELECT event_type AS job_type, 'tenant_' || CAST(user_id % 5 AS STRING) AS tenant_id, CASE WHEN value < 5 THEN 'failure' ELSE 'success' END AS status,
  count(*) AS runs, sum(user_id)::BIGINT AS records_processed, round(avg(value), 6) AS avg_elapsed_seconds FROM events GROUP BY ALL""")
def job8_history(spark, sf):
    events = table(spark, sf, "events")
    job_runs = events.select(
        F.col("event_type").alias("job_type"),
        F.concat(F.lit("tenant_"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        F.when(F.col("value") < 5, "failure").otherwise("success").alias("status"),
        F.col("value").alias("elapsed_seconds"), F.col("user_id").alias("records_processed"), F.lit(0).cast("long").alias("records_failed"),
    )
    return runs.history(job_runs).select(
        "job_type", "tenant_id", "status", "runs", "records_processed", F.round("avg_elapsed_seconds", 6).alias("avg_elapsed_seconds")
    )


@query("job9_stream", ["kyc_json"], _MASKED_SQL)
def job9_stream(spark, sf):
    path = scratch_path(spark, "topic")
    landed = view(spark, sf, "kyc_json").select(F.encode("record", "utf-8").alias("value"), "tenant_id")
    landed.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", "4").parquet(f"{path}/in")
    store = TableStore(spark, f"{path}/store")
    ingest.start_ingestion(
        ingest.message_records(stream), store, KYC_RULES, "customers", name=f"kyc-{path[-8:]}",
        checkpoint=f"{path}/checkpoint", source_path="kafka://kyc",
    ).awaitTermination()
    return store.read("customers").drop("extra")


@query("job9_redelivered", [], """
SELECT 'order-' || o_orderkey AS id, o_orderstatus AS status, 'tenant_0' AS tenant_id FROM orders""")
def job9_redelivered(spark, sf):
    """Every message is delivered in two batches, and stored once."""
    path = scratch_path(spark, "redelivered")
    key = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    record = F.to_json(F.struct(key.alias("id"), F.col("o_orderstatus").alias("status")))
    sent = table(spark, sf, "orders").select(record.alias("value"), key.alias("message_id"), F.lit("tenant_0").alias("tenant_id"))
    for _ in range(2):
        sent.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", "1").parquet(f"{path}/in")
    store = TableStore(spark, f"{path}/store")
    ingest.start_ingestion(
        ingest.message_records(stream), store, {"id": {"required": True}, "status": {}}, "orders", name=f"orders-{path[-8:]}",
        checkpoint=f"{path}/checkpoint", source_path="kafka://orders", message_id="message_id",
    ).awaitTermination()
    return store.read("orders").select("id", "status", "tenant_id")


def _two_tenants(spark, sf):
    """Orders as messages of two tenants, who both number theirs from the same keys; some come twice in the first batch, all of one kind again in the second."""
    path = scratch_path(spark, "two_tenants")
    key = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    record = F.to_json(F.struct(key.alias("id"), F.col("o_orderstatus").alias("status")))
    sent = table(spark, sf, "orders").withColumn("tenant_id", F.explode(F.array(F.lit("tenant_0"), F.lit("tenant_1")))).select(
        record.alias("value"), key.alias("message_id"), "tenant_id", "o_orderstatus", "o_orderpriority")
    first = sent.where("o_orderstatus <> 'P' OR tenant_id = 'tenant_0'")
    again = sent.where("o_orderstatus = 'F'").unionByName(sent.where("o_orderstatus = 'P' AND tenant_id = 'tenant_1'"))
    for batch in (first.unionByName(first.where("o_orderpriority = '1-URGENT'")), again):
        batch.select("value", "message_id", "tenant_id").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("value string, message_id string, tenant_id string").option("maxFilesPerTrigger", "1").parquet(f"{path}/in")
    store, name = TableStore(spark, f"{path}/store"), f"tenants-{path[-8:]}"
    running = ingest.start_ingestion(
        ingest.message_records(stream), store, {"id": {"required": True}, "status": {}}, "orders", name=name,
        checkpoint=f"{path}/checkpoint", source_path="kafka://orders", message_id="message_id",
    )
    running.awaitTermination()
    ingest.log_redelivered(store, running, name)
    return store


@query("job9_two_tenants", [], """
SELECT 'order-' || o_orderkey AS id, o_orderstatus AS status, tenant_id FROM orders, (VALUES ('tenant_0'), ('tenant_1')) t(tenant_id)""")
def job9_two_tenants(spark, sf):
    return _two_tenants(spark, sf).read("orders").select("id", "status", "tenant_id")


@query("job9_left_out", [], """
SELECT 'redelivery' AS job_type, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P') * 2
  + count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') + count(*) FILTER (WHERE o_orderstatus = 'F') * 2 AS BIGINT) AS redelivered
FROM orders""")
def job9_left_out(spark, sf):
    told = _two_tenants(spark, sf).read("job_runs").where("job_type = 'redelivery'")
    return told.groupBy("job_type").agg(F.sum(F.col("details")["redelivered"].cast("long")).alias("redelivered"))


@query("job1_redelivered", [], """
SELECT tenant_id, CAST(count(*) FILTER (WHERE part = 'new') AS BIGINT) AS stored, CAST(count(*) FILTER (WHERE part = 'again') AS STRING) AS redelivered
FROM (SELECT 'tenant_' || (o_custkey % 3) AS tenant_id, unnest(CASE WHEN o_orderstatus = 'F' THEN ['new', 'again'] ELSE ['new'] END) AS part FROM orders) m
GROUP BY tenant_id""")
def job1_redelivered(spark, sf):
    """A second batch of files brings one kind of message again: told in the details of the job, tenant by tenant in its audit rows."""
    store = _store(spark)
    key = F.col("o_orderkey").cast("string")
    tenant = F.concat(F.lit("tenant_"), (F.col("o_custkey") % 3).cast("string"))
    record = F.to_json(F.struct(F.col("o_orderstatus").alias("status")))
    sent = table(spark, sf, "orders").select(record.alias("record"), key.alias("mid"), tenant.alias("tenant_id"), "o_orderstatus")
    for batch in (sent.where("o_orderstatus <> 'O'"), sent.where("o_orderstatus <> 'P'")):
        jobs.ingest_records(store, batch.select("record", "mid", "tenant_id"), {"status": {}}, "orders", source_path="x", message_id="mid")
    stored = store.read("orders").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("stored"))
    told = store.read("audit").where("action = 'KYC_INGESTION'").groupBy("tenant_id").agg(F.sum(F.col("details")["redelivered"].cast("long")).cast("string").alias("redelivered"))
    return stored.join(told, "tenant_id").select("tenant_id", "stored", "redelivered")


@query("src9_consume", ["messages"], """
SELECT message_id, value, tenant_id FROM messages""")
def src9_consume(spark, sf):
    path = scratch_path(spark, "consume")
    landed = view(spark, sf, "messages").select("message_id", "value", "tenant_id", F.col("timestamp").cast("timestamp").alias("timestamp"))
    landed.unionByName(landed.where("tenant_id = 'tenant_2'")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(landed.schema).parquet(f"{path}/in").withWatermark("timestamp", "60 days")
    topics.once(stream).writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(
        f"{path}/out", format="parquet"
    ).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("message_id", "value", "tenant_id")


@query("met_windows", ["metrics"], """
SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_us, name, count(*) AS "count", round(sum(value), 2) AS "sum", min(value) AS "min", max(value) AS "max"
FROM metrics GROUP BY 1, 2""")
def met_windows(spark, sf):
    path = scratch_path(spark, "windows")
    measured = event_metrics(spark, sf)
    measured.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(measured.schema).parquet(f"{path}/in")
    name = "windows_" + path[-16:]
    running = windows.windowed_metrics(stream, "1 day", watermark=None).writeStream.outputMode("complete").foreachBatch(
        lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out")
    ).queryName(name).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out").select(
        F.unix_micros("window_start").alias("window_us"), "name", "count", F.round("sum", 2).alias("sum"), "min", "max"
    )


def _late_metrics(spark, sf):
    """Metrics in order of time in two batches; then those of one name from before the first batch's last three days, which come too late."""
    path = scratch_path(spark, "late")
    measured = event_metrics(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    late = (F.col("name") == "signup_ms") & (F.col("ts") < F.lit("2024-01-12").cast("timestamp"))
    first = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    for batch in (measured.where(~late & first), measured.where(~late & ~first), measured.where(late)):
        batch.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(measured.schema).option("maxFilesPerTrigger", "1").parquet(f"{path}/in")
    windows.start_windows(stream, windows.windowed_metrics, f"{path}/out", f"{path}/checkpoint", window="1 day", watermark="1 day").awaitTermination()
    return path, measured


_ON_TIME = "NOT (name = 'signup_ms' AND ts < TIMESTAMP '2024-01-12 00:00:00')"
_CLOSED = "time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM metrics) - INTERVAL 1 DAY"


@query("met_windows_late", ["metrics"], f"""
SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_us, name, count(*) AS "count", round(sum(value), 2) AS "sum", min(value) AS "min", max(value) AS "max"
FROM metrics WHERE {_ON_TIME} AND {_CLOSED} GROUP BY 1, 2""")
def met_windows_late(spark, sf):
    path, _ = _late_metrics(spark, sf)
    return spark.read.parquet(f"{path}/out").select(
        F.unix_micros("window_start").alias("window_us"), "name", "count", F.round("sum", 2).alias("sum"), "min", "max"
    )


@query("met_windows_left_out", ["metrics"], f"""
SELECT count(*) AS received, count(*) FILTER (WHERE {_ON_TIME} AND {_CLOSED}) AS closed,
  count(*) FILTER (WHERE {_ON_TIME} AND NOT ({_CLOSED})) AS "open", count(*) FILTER (WHERE NOT ({_ON_TIME})) AS late FROM metrics""")
def met_windows_left_out(spark, sf):
    path, measured = _late_metrics(spark, sf)
    return windows.accounts(spark, f"{path}/out", f"{path}/checkpoint", measured.count())


@query("met8_windows", ["audit"], """
SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_us, count(*) AS event_count, round(100.0 * count(*) FILTER (WHERE status = 'FAILURE') / count(*), 2)::DOUBLE AS error_rate
FROM audit GROUP BY 1""")
def met8_windows(spark, sf):
    rated = windows.windowed_error_rate(view(spark, sf, "audit"), "1 day")
    return rated.select(F.unix_micros("window_start").alias("window_us"), "event_count", "error_rate")


@query("vlt_job", ["kyc"], """
SELECT DISTINCT 'token_' || substr(sha256(email), 1, 16) AS token_id, email AS value, tenant_id, user_id FROM kyc WHERE email IS NOT NULL""")
def vlt_job(spark, sf):
    store = _store(spark)
    kyc = view(spark, sf, "kyc").select(F.col("email").alias("value"), "tenant_id", "user_id", F.lit("email").alias("field"))
    owner = ("tenant_id", "user_id", "field")
    jobs.store_tokens(store, kyc, datetime(2024, 1, 1), owner=owner)
    jobs.store_tokens(store, kyc, datetime(2024, 1, 2), owner=owner)
    return store.read("vault").select("token_id", "value", "tenant_id", "user_id")


def _gated(spark, sf):
    """Two batches of checked records; the second holds the customers of one kind again."""
    store = _store(spark)
    kyc = view(spark, sf, "kyc").select("customer_id", "tenant_id", "email", "segment", "full_name")
    rules = {"email": {"required": True}, "full_name": {"required": True}}
    ids = [jobs.gate_batch(store, batch, rules, "customer_id", threshold=0.9) for batch in (kyc, kyc.where("segment = 'BUILDING'"))]
    return store, F.when(F.col("batch_id") == ids[0], 1).when(F.col("batch_id") == ids[1], 2).alias("batch")


_BATCHES_SQL = "b AS (SELECT 1 AS batch, * FROM kyc UNION ALL SELECT 2, * FROM kyc WHERE segment = 'BUILDING')"


@query("qlt2_runs", ["kyc"], f"""
WITH {_BATCHES_SQL} SELECT *, quality_score < 0.9 AS circuit_breaker_triggered FROM (
  SELECT batch, tenant_id, count(*) FILTER (WHERE email IS NOT NULL) AS passed_records, count(*) FILTER (WHERE email IS NULL) AS failed_records,
    CAST(count(*) FILTER (WHERE email IS NOT NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS quality_score FROM b GROUP BY batch, tenant_id) s""")
def qlt2_runs(spark, sf):
    store, batch = _gated(spark, sf)
    return store.read("quality_runs").select(batch, "tenant_id", "passed_records", "failed_records", "quality_score", "circuit_breaker_triggered")


@query("qlt2_errors", ["kyc"], f"""
WITH {_BATCHES_SQL} SELECT batch, customer_id AS record_key, 'email' AS field, 'null_value' AS error_type FROM b WHERE email IS NULL""")
def qlt2_errors(spark, sf):
    store, batch = _gated(spark, sf)
    return store.read("quality_errors").select(batch, "record_key", "field", "error_type")


@query("met1_append", [], """
SELECT name, status_label, count(*) AS "count", round(sum(value), 2) AS "sum" FROM (
  SELECT 'order_price' AS name, o_orderstatus AS status_label, o_totalprice AS value FROM orders UNION ALL
  SELECT 'balance', CASE WHEN c_acctbal < 0 THEN 'short' ELSE 'fine' END, c_acctbal FROM customer) m GROUP BY 1, 2""")
def met1_append(spark, sf):
    store = _store(spark)
    jobs.record_metrics(store, table(spark, sf, "orders"), "order_price", F.col("o_totalprice"), {"status": F.col("o_orderstatus")})
    short = F.when(F.col("c_acctbal") < 0, "short").otherwise("fine")
    jobs.record_metrics(store, table(spark, sf, "customer"), "balance", F.col("c_acctbal"), {"status": short})
    label = F.col("labels")["status"].alias("status_label")
    return store.read("metrics").groupBy("name", label).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("value"), 2).alias("sum"))


@query("aud8_purge", ["audit"], """
SELECT tenant_id, CAST(count(*) AS STRING) AS purged FROM audit WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY GROUP BY tenant_id""")
def aud8_purge(spark, sf):
    store = _store(spark)
    log = view(spark, sf, "audit").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "action", "user", "record_id",
        F.create_map().cast("map<string,string>").alias("details"), "status", "error_message", "tenant_id",
        F.to_date("ts").alias("dt"),
    ).select(*S.AUDIT.fieldNames())
    with store.transaction() as change:
        change.append("audit", log, ["tenant_id", "dt"])
    jobs.expire_audit(store, datetime(2024, 1, 20), 10)
    purges = store.read("audit").where("action = 'AUDIT_RETENTION_PURGE'")
    return purges.select("tenant_id", F.col("details")["purged_events"].alias("purged"))


@query("ten6_safe", ["paths"], """
SELECT 'acme/' || path AS object_key FROM paths WHERE path <> '' AND NOT contains(path, '..') AND NOT path LIKE '/%'""")
def ten6_safe(spark, sf):
    safe, _ = files.safe_paths(view(spark, sf, "paths"))
    return safe.select(tenancy.object_key(F.lit("acme"), F.col("path")).alias("object_key"))

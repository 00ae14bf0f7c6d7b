from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardenry import schemas as S
from wardenry.operators import compliance, conformance, erasure, vault
from wardenry.plans import jobs, runs, steps
from wardenry.streaming import ingest, windows

RULES = {
    "id": {"type": "string", "required": True}, "email": {"type": "string", "required": True, "sensitive": True, "masking_strategy": "hash"},
    "ssn": {"type": "string", "sensitive": True},
}
GOOD = '{"id":"1","email":"a@b.c","ssn":"9"}'


def records(spark, *rows):
    return spark.createDataFrame(list(rows), "tenant_id string, record string")


def actions(store):
    return sorted(r.action for r in store.read("audit").collect())


def test_ingestion(spark, store):
    rows = records(spark, ("t1", GOOD), ("t1", '{"id":"2"}'), ("t2", '{"id":"3","email":null,"ssn":""}'), ("t2", "[1]"))
    done = jobs.ingest_records(store, rows, RULES, "kyc", source_path="s3://b/k.json")
    assert (done.status, done.records_processed, done.records_failed, done.error_message) == ("success", 2, 2, None)
    got = {tuple(r) for r in store.read("kyc").select("tenant_id", "id", "email", "ssn").collect()}
    assert got == {("t1", "1", hashlib.sha256(b"email:a@b.c").hexdigest(), "***REDACTED***"), ("t2", "3", None, "")}
    rejected = {r.record: r.missing_fields for r in store.read("kyc_rejected").collect()}
    assert rejected == {'{"id":"2"}': ["email", "ssn"], "[1]": None}
    assert actions(store) == ["KYC_INGESTION"] * 2 + ["LINEAGE_TRANSFORMATION_TRACKED"] * 2 + ["MASK_RECORD"] * 2
    edge = store.read("lineage").first()
    assert (edge.source_dataset, edge.destination_dataset, edge.transformation) == ("s3:s3://b/k.json", "postgresql:kyc", "kyc_ingestion")
    tracked = {r.record_id for r in store.read("audit").where("action LIKE 'LINEAGE%'").collect()}
    assert tracked == {r.event_id for r in store.read("lineage").collect()}
    assert conformance.audit_violations(store.read("audit")).count() == 0
    again = jobs.ingest_records(store, rows, RULES, "kyc", source_path="local.json")
    assert again.status == "success" and store.read("kyc").count() == 4
    assert runs.history(store.read("job_runs")).first().runs == 2


def test_ingestion_fails_closed_without_a_schema(spark, store):
    done = jobs.ingest_records(store, records(spark, ("t1", GOOD)), {}, "kyc", source_path="x")
    assert done.status == "failure" and store.tables() == ["audit", "job_runs"]
    assert actions(store) == ["KYC_INGESTION_FAILED"]
    assert store.read("audit").first().error_message == done.error_message


def test_booleans_hash_as_in_typed_columns(spark, store):
    rules = {"id": {}, "b": {"sensitive": True, "masking_strategy": "hash"}}
    rows = records(spark, ("t", '{"id":"1","b":true}'), ("t", '{"id":"2","b":"true"}'), ("t", '{"id":"3","b":"x","b":false}'), ("t", '{"id":"4","b":"TRUE"}'))
    jobs.ingest_records(store, rows, rules, "kyc", source_path="x")
    got = {r.id: r.b for r in store.read("kyc").collect()}
    assert got == {k: hashlib.sha256(f"b:{v}".encode()).hexdigest() for k, v in {"1": "True", "2": "true", "3": "False", "4": "TRUE"}.items()}


def test_undeclared_keys_are_kept(spark, store):
    rows = records(spark, ("t", '{"id":"1","x":1,"x":{"y":null},"tenant_id":"u"}'), ("t", '{"id":"2"}'), ("t", '{"id":"3","z":null}'))
    jobs.ingest_records(store, rows, {"id": {}}, "kyc", source_path="x")
    assert {r.id: r.extra for r in store.read("kyc").collect()} == {"1": {"x": '{"y":null}'}, "2": None, "3": {"z": None}}
    done = jobs.ingest_records(store, rows, {"id": {}, "extra": {}}, "other", source_path="x")
    assert done.status == "failure" and "other" not in store.tables()
    assert jobs.ingest_records(store, rows.limit(0), {"id": {}, "extra": {}}, "other", source_path="x", extra="rest").status == "success"


def test_a_message_is_ingested_once(spark, store):
    def batch(*ids):
        return spark.createDataFrame([("t", f'{{"id":"{i}"}}', i) for i in ids], "tenant_id string, record string, mid string")

    for ids in (("a", "a", None), ("a", "b", None)):
        jobs.ingest_records(store, batch(*ids), {"id": {}}, "kyc", source_path="x", message_id="mid")
    assert sorted(r.id for r in store.read("kyc").collect()) == ["None", "None", "a", "b"]
    assert jobs.ingest_records(store, batch("c"), {"id": {}}, "kyc", source_path="x", message_id="mid", dry_run=True).records_processed == 1
    assert sorted(r.message_id for r in store.read("kyc_messages").collect()) == ["a", "b"]


def test_tenants_number_their_messages_alone(spark, store):
    def batch(*rows):
        return spark.createDataFrame([(t, f'{{"id":"{t}{i}"}}', i) for t, i in rows], "tenant_id string, record string, mid string")

    first = jobs.ingest_records(store, batch(("t1", "m1"), ("t2", "m1"), ("t2", "m1"), (None, "m1")), {"id": {}}, "kyc", source_path="x", message_id="mid")
    again = jobs.ingest_records(store, batch(("t1", "m1"), ("t3", "m1"), ("t3", None), ("t3", None)), {"id": {}}, "kyc", source_path="x", message_id="mid")
    assert (first.records_processed, first.details["redelivered"], again.records_processed, again.details["redelivered"]) == (3, 1, 3, 1)
    assert sorted(r.id for r in store.read("kyc").collect()) == ["Nonem1", "t1m1", "t2m1", "t3None", "t3None", "t3m1"]
    told = {(r.tenant_id, r.details["redelivered"]) for r in store.read("audit").where("action = 'KYC_INGESTION'").collect()}
    assert told == {("t1", "0"), ("t2", "1"), (None, "0"), ("t1", "1"), ("t3", "0")}
    only_known = jobs.ingest_records(store, batch(("t1", "m1")), {"id": {}}, "kyc", source_path="x", message_id="mid")
    assert (only_known.status, only_known.records_processed, only_known.details["redelivered"]) == ("success", 0, 1)


def test_a_stream_knows_messages_of_earlier_runs(spark, store, tmp_path):
    schema = "tenant_id string, value string, message_id string"

    def deliver(*rows):
        spark.createDataFrame([(t, f'{{"id":"{t}{i}"}}', i) for t, i in rows], schema).coalesce(1).write.mode("append").parquet(f"file:{tmp_path}/in")
        query = ingest.start_ingestion(
            ingest.message_records(spark.readStream.schema(schema).parquet(f"file:{tmp_path}/in")), store, {"id": {}}, "kyc", name="known", checkpoint=f"file:{tmp_path}/ck",
            source_path="kafka://x", message_id="message_id")
        query.awaitTermination()
        ingest.log_redelivered(store, query, "known")
        return ingest.log_redelivered(store, query, "known")  # told once

    assert deliver(("a", "1"), ("b", "1"), ("b", "1")) == 0
    assert deliver(("a", "1"), ("a", "2"), ("a", None), ("a", None)) == 0
    assert sorted(r.id for r in store.read("kyc").collect()) == ["a1", "a2", "aNone", "aNone", "b1"]
    told = [r.details for r in store.read("job_runs").where("job_type = 'redelivery'").collect()]
    assert [d["redelivered"] for d in told] == ["1", "1"]


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [[0, 1, 2], [300], [301], [5, 299], [310]]
    for minutes in batches:
        rows = [(start + timedelta(minutes=m), "x", 1.0) for m in minutes]
        spark.createDataFrame(rows, "ts timestamp, name string, value double").coalesce(1).write.mode("append").parquet(f"file:{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, name string, value double").option("maxFilesPerTrigger", 1).parquet(f"file:{tmp_path}/in")
    out, checkpoint = f"file:{tmp_path}/out", f"file:{tmp_path}/ck"
    windows.start_windows(stream, windows.windowed_metrics, out, checkpoint, window="10 minutes", watermark="5 minutes").awaitTermination()
    account = windows.accounts(spark, out, checkpoint, 8).first()
    # 310 closes the window of 299 (which 300 alone does not, five minutes being allowed); minute 5 came when its window was closed.
    assert (account.received, account.closed, account.open, account.late) == (8, 4, 3, 1)
    with pytest.raises(ValueError):
        windows.start_windows(stream, windows.windowed_metrics, out, checkpoint, watermark="")


def test_breaker_stops_before_the_sink(spark, store):
    rows = records(spark, ("t1", GOOD), ("t1", "{}"))
    assert jobs.ingest_records(store, rows, RULES, "kyc", source_path="x", threshold=0.6).status == "failure"
    assert "kyc" not in store.tables()
    assert jobs.ingest_records(store, rows, RULES, "kyc", source_path="x", threshold=0.5).status == "success"


def test_ingestion_of_nothing_and_dry_run(spark, store):
    empty = spark.createDataFrame([], "tenant_id string, record string")
    assert jobs.ingest_records(store, empty, RULES, "kyc", source_path="x").status == "success"
    version = store.version()
    dry = jobs.ingest_records(store, records(spark, ("t1", GOOD)), RULES, "kyc", source_path="x", dry_run=True)
    assert (dry.status, dry.records_processed, store.version()) == ("success", 1, version)


@pytest.mark.parametrize("path, name", [("s3://b/k", "s3:s3://b/k"), ("kafka://t", "kafka:kafka://t"), ("/data/x", "local:/data/x")])
def test_source_names(path, name):
    assert jobs.source_name(path) == name


def test_migration(spark, store):
    source = spark.createDataFrame([(1, "a"), (2, None)] + [(i, "x") for i in range(38)], "id int, v string")
    args = dict(rules={"v": {"required": True}}, tenant_id="t1", source_system="pg", target_system="sf")
    done = jobs.migrate_table(store, source, "items", mapping={"key": "id", "v": "v"}, **args)
    assert (done.status, done.records_processed, done.details["verification_status"]) == ("success", 40, "passed")
    assert done.warnings == ["Quality issues: 1 records"] and store.read("items").columns == ["key", "v"]
    assert store.read("lineage").first().destination_dataset == "sf:items"
    closed = jobs.migrate_table(store, source.limit(2), "other", **args)
    assert closed.status == "failure" and "other" not in store.tables() and "DATA_MIGRATION_FAILED" in actions(store)
    assert jobs.migrate_table(store, source, "third", dry_run=True, **args).status == "success"
    assert "third" not in store.tables()


def test_compliance(spark, store):
    jobs.ingest_records(store, records(spark, ("t1", GOOD)), RULES, "kyc", source_path="x")
    tenants = spark.createDataFrame([("t1",), ("t9",)], "tenant_id string")
    done = jobs.check_compliance(store, tenants)
    assert (done.status, done.records_processed, done.records_failed) == ("failure", 3, 5)
    statuses = {r.tenant_id: r.overall_status for r in compliance.roll_up(store.read("compliance_checks")).collect()}
    assert statuses == {"t1": "warning", "t9": "failure"}
    assert jobs.check_compliance(store, tenants.where("tenant_id = 't1'"), "lineage").status == "success"
    assert compliance.checks_for("anything") == compliance.CHECKS and compliance.checks_for("pii") == ("pii_masking",)


@pytest.mark.parametrize("failed, status", [(0, "success"), (1, "warning"), (2, "failure"), (4, "failure")])
def test_compliance_roll_up(spark, failed, status):
    checks = spark.createDataFrame([("t", "pass" if i >= failed else "warning") for i in range(4)], "tenant_id string, status string")
    assert compliance.roll_up(checks).first().overall_status == status


def test_erasure_by_request(spark, store):
    data = spark.createDataFrame([("t1", "u1", "e", "s"), ("t1", "u2", "e", "s"), ("t2", "u1", "e", "s")], "tenant_id string, user_id string, email string, ssn string")
    tokens = [("k1", "v1", None, None, "t1", "u1", "email"), ("k2", "v2", None, None, "t2", "u1", "email")]
    with store.transaction() as change:
        change.append("people", data)
        change.append("vault", spark.createDataFrame(tokens, S.VAULT))
    submitted = spark.createDataFrame([("u1", "t1", "GDPR", ["email"]), ("u1", "t1", "GDPR", [])], "user_id string, tenant_id string, reason string, fields_to_delete array<string>")
    assert jobs.submit_requests(store, submitted).count() == 1
    done = jobs.execute_requests(store, {"people": ["email", "ssn"]})
    assert (done.status, done.records_processed) == ("success", 1)
    assert {tuple(r) for r in store.read("people").collect()} == {("t1", "u1", None, "s"), ("t1", "u2", "e", "s"), ("t2", "u1", "e", "s")}
    assert [r.token_id for r in store.read("vault").collect()] == ["k2"]
    assert [r.status for r in erasure.current_states(store.read("erasure_states")).collect()] == ["COMPLETE"]
    assert actions(store) == ["ERASURE_EXECUTION_COMPLETED", "ERASURE_EXECUTION_STARTED", "ERASURE_REQUEST_SUBMITTED"]
    assert jobs.execute_requests(store, {"people": ["email"]}).records_processed == 0


def test_failed_erasure_changes_nothing(spark, store):
    with store.transaction() as change:
        change.append("people", spark.createDataFrame([("t1", "u1", "e")], "tenant_id string, user_id string, email string"))
    jobs.submit_requests(store, spark.createDataFrame([("u1", "t1", "GDPR", ["email"])], "user_id string, tenant_id string, reason string, fields_to_delete array<string>"))
    done = jobs.execute_requests(store, {"people": ["email"], "no_such_table": ["email"]})
    assert done.status == "failure" and store.read("people").first().email == "e"
    assert [r.status for r in erasure.current_states(store.read("erasure_states")).collect()] == ["PENDING"]


def test_erasure_by_record_id(spark, store):
    with store.transaction() as change:
        change.append("people", spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 1)], "tenant_id string, id int"), ["tenant_id"])
    asked = spark.createDataFrame([(1,), (9,)], "id int")
    dry = jobs.erase_records(store, "people", asked, "id", tenant_id="t1", dry_run=True)
    assert (dry.records_processed, dry.records_failed, store.read("people").count()) == (1, 1, 3)
    done = jobs.erase_records(store, "people", asked, "id", tenant_id="t1")
    assert done.status == "warning" and {(r.tenant_id, r.id) for r in store.read("people").collect()} == {("t1", 2), ("t2", 1)}


def test_steps(spark, store):
    policies = spark.createDataFrame([("t1", "T", True, ["pipeline:*", "postgresql:items"], None), ("t2", "T", True, ["s3://*"], None)], S.TENANTS)
    with store.transaction() as change:
        change.append("items", spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, id int"))
    read = steps.Step("postgresql", "read", query="items")
    write = steps.Step("s3", "write", destination="copy", data=lambda got: got[0])
    assert [r.records for r in steps.run_steps(store, policies, "t1", [read, write]).collect()] == [None, 1]
    assert steps.run_steps(store, policies, "t1", []).count() == 0
    for bad in (steps.Step("s3", "delete"), steps.Step("ftp", "read", query="items"), steps.Step("", "read"), steps.Step("s3", "read", query="gone")):
        with pytest.raises(steps.StepsFailed):
            steps.run_steps(store, policies, "t1", [read, write, bad])
    assert store.read("copy").count() == 1
    with pytest.raises(steps.AccessDenied):
        steps.run_steps(store, policies, "t2", [read])
    assert steps.run_steps(store, policies, "unregistered", [read]).count() == 1
    assert actions(store) == ["PIPELINE_FAILED"] * 4 + ["PIPELINE_SUCCESS"] * 2 + ["TENANT_ACCESS_DENIED"]


def test_audited_operations(spark, store):
    policies = spark.createDataFrame([("t1", "T", True, ["postgresql:*"], None), ("t2", "T", False, None, None)], S.TENANTS)
    steps.tenant_write(store, policies, "t1", "items", spark.range(3))
    assert steps.tenant_read(store, policies, "t1", "items").count() == 3
    with pytest.raises(KeyError):
        steps.tenant_read(store, policies, "t1", "gone")
    with pytest.raises(steps.AccessDenied):
        steps.tenant_read(store, policies, "t2", "items")
    logged = sorted((r.action, r.status) for r in store.read("audit").collect())
    assert logged == [("READ_OPERATION", "FAILURE"), ("READ_OPERATION", "SUCCESS"), ("TENANT_ACCESS_DENIED", "FAILURE"), ("WRITE_OPERATION", "SUCCESS")]
    assert steps.valid_tenant(spark.createDataFrame([("a",), ("a/b",)], "tenant_id string")).count() == 1


def test_tokens_are_stored_once(spark, store):
    values = spark.createDataFrame([("a",), ("b",), ("a",)], "value string")
    assert jobs.store_tokens(store, values, datetime(2024, 1, 1)) == 2
    assert jobs.store_tokens(store, values, datetime(2024, 1, 2)) == 0
    assert store.read("vault").count() == 2


def test_audit_retention_is_logged(spark, store):
    rows = [("e1", datetime(2024, 1, 1), "A", "u", "t", None, {}, "SUCCESS", None, datetime(2024, 1, 1).date()),
            ("e2", datetime(2024, 3, 1), "A", "u", "t", None, {}, "SUCCESS", None, datetime(2024, 3, 1).date())]
    with store.transaction() as change:
        change.append("audit", spark.createDataFrame(rows, S.AUDIT), ["tenant_id", "dt"])
    jobs.expire_audit(store, datetime(2024, 3, 2), None)
    assert store.version() == 1
    jobs.expire_audit(store, datetime(2024, 3, 2), 30)
    assert actions(store) == ["A", "AUDIT_RETENTION_PURGE"]


def test_purged_events_leave_the_disk(spark, store):
    """Events without a time or a day stay; what is purged is in no file, and a purge that died before deleting is finished by the next."""
    day = lambda *d: datetime(*d)
    rows = [(f"e{i}", ts, "A", "u", "t", None, {}, "SUCCESS", None, ts.date() if ts and i != 4 else None)
            for i, ts in enumerate([day(2024, 1, 1), day(2024, 2, 1, 1), day(2024, 2, 1, 23), None, day(2024, 1, 2), day(2024, 3, 1)])]
    with store.transaction() as change:
        change.append("audit", spark.createDataFrame(rows, S.AUDIT), ["tenant_id", "dt"])
    files = lambda: {r.event_id for r in spark.read.option("recursiveFileLookup", "true").schema(S.AUDIT).parquet(f"{store.root}/data/audit").where("action = 'A'").collect()}
    vacuum, store.vacuum = store.vacuum, lambda: None  # dies before it deletes
    version = store.version()
    jobs.expire_audit(store, datetime(2024, 3, 2, 12), 30)
    assert store.version() == version + 1 and len(files()) == 6
    store.vacuum = vacuum
    jobs.expire_audit(store, datetime(2024, 3, 2, 12), 30)
    kept = {"e2", "e3", "e5"}
    assert files() == kept == {r.event_id for r in store.read("audit").where("action = 'A'").collect()}
    purges = store.read("audit").where("action = 'AUDIT_RETENTION_PURGE'").collect()
    assert [r.details["purged_events"] for r in purges] == ["3"]


def test_stream_equals_batch_and_skips_repeated_batches(spark, store, tmp_path):
    rows = [("t1", GOOD.replace("1", str(i))) for i in range(20)] + [("t2", "{}")]
    df = records(spark, *rows).select("tenant_id", F.encode("record", "utf-8").alias("value"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    schema = df.schema

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "2").parquet(f"{tmp_path}/in")
        ingest.start_ingestion(
            ingest.message_records(stream), store, RULES, "kyc", name="kyc", checkpoint=f"{tmp_path}/{checkpoint}", source_path="kafka://kyc",
        ).awaitTermination()

    run("c1")
    assert store.read("kyc").count() == 20 and store.read("kyc_rejected").count() == 1
    done = store.progress("kyc")
    run("c1")
    # A lost checkpoint delivers the same batch numbers again; they were committed with their rows.
    run("c2")
    assert store.progress("kyc") == done and store.read("kyc").count() == 20


def test_stream_stops_below_the_threshold(spark, store, tmp_path):
    records(spark, ("t1", "{}")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("tenant_id string, record string").parquet(f"{tmp_path}/in")
    query = ingest.start_ingestion(stream, store, RULES, "kyc", name="gated", checkpoint=f"{tmp_path}/c", source_path="x", threshold=0.5)
    with pytest.raises(Exception):
        query.awaitTermination()
    assert "kyc" not in store.tables() and store.progress("gated") is None


def test_windows_in_batch_and_stream(spark, tmp_path):
    rows = [("m", "lat", float(i), datetime(2024, 1, 1, i), {}) for i in range(10)]
    df = spark.createDataFrame(rows, S.METRICS)
    batch = sorted(map(tuple, windows.windowed_metrics(df, "2 hours").collect()))
    assert len(batch) == 5 and batch[0][2:] == (2, 1.0, 0.0, 1.0)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = windows.windowed_metrics(stream, "2 hours", "1 minute").writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    # The window still open at the watermark is held back.
    assert sorted(map(tuple, spark.table("win").collect())) == batch[:-1]


def test_erased_values_leave_the_disk(spark, store):
    people = spark.createDataFrame([("t1", "u1", "gone"), ("t1", "u2", "kept"), ("t2", "u1", "other")], "tenant_id string, user_id string, email string")
    with store.transaction() as change:
        change.append("people", people, ["tenant_id"])
    jobs.submit_requests(store, spark.createDataFrame([("u1", "t1", "GDPR", ["email"])], "user_id string, tenant_id string, reason string, fields_to_delete array<string>"))
    assert jobs.execute_requests(store, {"people": ["email"]}).details["deleted_folders"] == 1
    raw = spark.read.option("recursiveFileLookup", "true").parquet(f"{store.root}/data/people")
    assert sorted(str(r.email) for r in raw.collect()) == ["None", "kept", "other"]
    assert store.read("people").count() == 3


def test_vacuum_spares_running_writers_and_kept_versions(spark, store):
    rows = spark.range(3)
    with store.transaction() as change:
        change.append("numbers", rows)
    with store.transaction() as change:
        change.replace("numbers", rows.limit(1))
    running = f"{store.root}/data/numbers/part_of=running"
    rows.write.parquet(running)
    assert store.vacuum(keep_versions=2) == 0 and store.read("numbers", 1).count() == 3
    assert store.vacuum() == 1 and spark.read.parquet(running).count() == 3 and store.read("numbers").count() == 1
    assert store.vacuum(older_than=timedelta(seconds=-60)) == 1 and store.read("numbers").count() == 1


def test_failed_transaction_leaves_no_folder(spark, store):
    with pytest.raises(RuntimeError), store.transaction() as change:
        change.append("numbers", spark.range(3))
        raise RuntimeError
    assert store._list("data/numbers") == []


def test_colliding_and_ownerless_tokens(spark, store, monkeypatch):
    people = spark.createDataFrame([("a", "t1", None), ("a", None, None)], "value string, tenant_id string, user_id string")
    owner = ("tenant_id", "user_id")
    assert jobs.store_tokens(store, people, datetime(2024, 1, 1), owner=owner) == 2
    assert jobs.store_tokens(store, people, datetime(2024, 1, 2), owner=owner) == 0
    monkeypatch.setattr(vault, "token_text", lambda value: F.lit(store.read("vault").first().token_id))
    with pytest.raises(vault.TokenCollision):
        jobs.store_tokens(store, people.withColumn("value", F.lit("b")), datetime(2024, 1, 3), owner=owner)


def test_last_of_repeated_keys_counts(spark, store):
    records = spark.createDataFrame([('{"id": "1", "id": "2"}',)], "record string")
    jobs.ingest_records(store, records, {"id": {"required": True}}, "people", source_path="s3://x", tenant_id="t")
    assert store.read("people").first().id == "2"

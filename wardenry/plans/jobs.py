"""The batch jobs: ingestion, migration, compliance, erasure (JOB-1..4, JOB-7).

Every job stages its tables, its audit and lineage rows and its run record, and publishes them in one commit. A job that
raises publishes nothing but its failure event.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenry import schemas as S
from wardenry.functions.checks import field_value, other_values, typed_text
from wardenry.functions.masking import mask_value
from wardenry.operators import audit, compliance, erasure, lineage, metrics, quality, vault
from wardenry.operators.joins import lookup_join
from wardenry.operators.masking import field_strategy
from wardenry.operators.registry import check_presence
from wardenry.plans.runs import JobResult
from wardenry.session import observed
from wardenry.sources.versioned import TableStore, Transaction, write_partitioned

AUDIT_TABLE, LINEAGE_TABLE, RUNS_TABLE = "audit", "lineage", "job_runs"
REQUESTS_TABLE, STATES_TABLE, VAULT_TABLE = "erasure_requests", "erasure_states", "vault"
QUALITY_RUNS_TABLE, QUALITY_ERRORS_TABLE, METRICS_TABLE = "quality_runs", "quality_errors", "metrics"
AUDIT_PARTITIONS = ["tenant_id", "dt"]
_TEXT = T.StringType()


class QualityGateClosed(RuntimeError):
    """The batch scored below its threshold, so nothing was published."""


def log_audit(change: Transaction, rows: DataFrame) -> None:
    """Stage audit rows by tenant and day."""
    folder = change.new_folder(AUDIT_TABLE)
    write_partitioned(rows, folder, AUDIT_PARTITIONS)
    change.adopt(AUDIT_TABLE, folder, S.AUDIT, partition_by=AUDIT_PARTITIONS)


def log_work(change: Transaction, rows: DataFrame, edges: DataFrame) -> None:
    """Stage edges, then in one write the audit rows and those that accompany the edges.

    The latter are read from the staged edges, so that both carry the same ids.
    """
    folder = change.new_folder(LINEAGE_TABLE)
    edges.write.parquet(folder)
    change.adopt(LINEAGE_TABLE, folder, S.LINEAGE)
    written = edges.sparkSession.read.schema(S.LINEAGE).parquet(folder)
    log_audit(change, rows.unionByName(lineage.tracking_events(written)))


def _run(store: TableStore, result: JobResult, action: str, body: Callable[[Transaction], str], dry_run: bool) -> JobResult:
    """Run a job body in one transaction; on any error publish only the failure event and the run record."""
    spark = store.spark
    try:
        with store.transaction() as change:
            status = body(change)
            result.finish(status)
            if dry_run:
                change.staged.clear()
                change.marks.clear()
            else:
                change.append(RUNS_TABLE, result.row(spark))
    except Exception as error:
        result.error_message = str(error)
        result.finish("failure")
        with store.transaction() as change:
            one = result.row(spark).select("tenant_id", "error_message")
            message = F.col("error_message")
            failed = audit.events(one, f"{action}_FAILED", status="FAILURE", error_message=message,
                                  details={"error_details": message})
            log_audit(change, failed)
            change.append(RUNS_TABLE, result.row(spark))
    return result


def source_name(path: str) -> str:
    if path.startswith("kafka://"):
        return f"kafka:{path}"
    return f"s3:{path}" if "s3://" in path else f"local:{path}"


def ingest_records(store: TableStore, records: DataFrame, rules: Mapping[str, object], target: str, *, source_path: str,
                   tenant_id: str | None = None, threshold: float | None = None, dry_run: bool = False,
                   mark: tuple[str, int] | None = None, extra: str = "extra", message_id: str | None = None,
                   redelivery_days: int = 7) -> JobResult:
    """Check, mask and append raw JSON records (JOB-1).

    The source is read once: accepted rows and rejected records go to two partitions of one write. Records of many
    tenants may come together in a ``tenant_id`` column; audit and lineage rows are then written per tenant.

    Keys that the schema does not declare are kept, unmasked, in the map column ``extra``. With ``message_id`` (a column)
    a tenant's message is ingested once: its id is published with its rows in ``{target}_messages``, by day, and left out when
    that tenant sends it again within ``redelivery_days``; how many were left out is in the job's details. Records without an id
    are always taken. All counts are those of the files written, so a task that runs again counts once.
    """
    result = JobResult("kyc_ingestion", tenant_id or "*")

    def body(change: Transaction) -> str:
        if not rules:
            raise ValueError("no schema is registered: records are not ingested unmasked")
        if tenant_id is None and "tenant_id" not in records.columns:
            raise ValueError("tenant_id is required when the records do not carry one")
        if extra in rules:
            raise ValueError(f"undeclared keys need a column of their own, {extra} is declared")
        owned = records if tenant_id is None else records.withColumn("tenant_id", F.lit(tenant_id))
        messages = f"{target}_messages"
        if message_id is not None:
            owned = _each_once(change, owned, messages, message_id, redelivery_days)
        checked = check_presence(owned, list(rules))
        valid = F.col("valid")
        if message_id is not None:
            # Neither accepted nor rejected: only its number of deliveries is written.
            checked = checked.withColumn("valid", F.when(~F.col("_known"), valid))
        fields = []
        for name, rule in rules.items():
            if name == "tenant_id":
                continue
            raw = field_value(F.col("parsed"), name)
            strategy = field_strategy(rule)
            if strategy:
                text = typed_text(F.col("record"), F.col("parsed"), name)
                raw = mask_value(text, _TEXT, strategy, name, rule.get("include_in_hash", True))
            fields.append(F.when(valid, raw).alias(name))
        fields.append(F.when(valid, other_values(F.col("parsed"), [*rules, "tenant_id"])).alias(extra))
        rows = checked.select(
            *fields,
            F.when(~valid, F.col("record")).alias("record"), F.when(~valid, F.col("missing_fields")).alias("missing_fields"),
            valid.alias("accepted"), "tenant_id", *((F.col(message_id).cast("string").alias("_message"), "_again") if message_id is not None else ()),
        )
        tally = [
            F.count_if("accepted").alias("passed"), F.count_if(~F.col("accepted")).alias("failed"),
            F.coalesce(F.sum("_again"), F.lit(0)).alias("redelivered"),
        ]
        if message_id is None:
            rows = rows.withColumn("_again", F.lit(0).cast("long"))
        folder = change.new_folder(target)
        if dry_run:
            totals = rows.agg(*tally).first()
        else:
            write_partitioned(rows if message_id is not None else rows.drop("_again"), folder, ["accepted", "tenant_id"])
            # Only partition columns and the small counts of deliveries are read back.
            written = store.spark.read.schema("_again long, accepted boolean, tenant_id string").parquet(folder)
            per_tenant = written.groupBy("tenant_id").agg(*tally)
            totals = per_tenant.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("passed", "failed", "redelivered")]).first()
        passed, failed = totals.passed, totals.failed
        result.records_processed, result.records_failed = passed, failed
        result.details = {"records_processed": passed, "records_inserted": passed, "validation_errors": failed}
        if message_id is not None:
            result.details["redelivered"] = totals.redelivered
        score = passed / (passed + failed) if passed + failed else 0.0
        if threshold is not None and score < threshold:
            raise QualityGateClosed(f"quality score {score:.4f} is below {threshold}")
        if dry_run:
            return "success"
        columns = [name for name in rules if name != "tenant_id"]
        accepted_schema = T.StructType([
            *(T.StructField(c, _TEXT) for c in columns), T.StructField(extra, T.MapType(_TEXT, _TEXT)), T.StructField("tenant_id", _TEXT),
        ])
        rejected_schema = T.StructType([
            T.StructField("record", _TEXT), T.StructField("missing_fields", T.ArrayType(_TEXT)), T.StructField("tenant_id", _TEXT),
        ])
        if passed:
            change.adopt(target, f"{folder}/accepted=true", accepted_schema, partition_by=["tenant_id"])
        if failed:
            change.adopt(f"{target}_rejected", f"{folder}/accepted=false", rejected_schema, partition_by=["tenant_id"])
        if message_id is not None and passed + failed:
            ids = store.spark.read.schema("_message string, accepted boolean, tenant_id string").parquet(folder)
            taken = ids.where(F.col("accepted").isNotNull() & F.col("_message").isNotNull())
            day = F.lit(datetime.now().date()).alias("dt")
            change.append(messages, taken.select("tenant_id", F.col("_message").alias("message_id"), day), ["dt"])
        if passed or failed:
            _log_ingestion(change, per_tenant, source_path, target, any(map(field_strategy, rules.values())), message_id is not None)
        if mark:
            change.mark(*mark)
        return "success"

    return _run(store, result, "KYC_INGESTION", body, dry_run)


def _each_once(change: Transaction, records: DataFrame, table: str, message_id: str, days: int) -> DataFrame:
    """Each tenant's messages once, with the deliveries to leave out (``_again``) and whether an earlier batch has it (``_known``).

    Deliveries of a message combine before they are shuffled, so a message that comes very often is a few rows.
    """
    store, today = change.store, datetime.now().date()
    others = [c for c in records.columns if c not in ("tenant_id", message_id)]
    with_id = records.where(F.col(message_id).isNotNull())
    once = with_id.groupBy("tenant_id", message_id).agg(F.first(F.struct(*others)).alias("_rest"), F.count(F.lit(1)).alias("_deliveries"))
    once = once.withColumn("_id", F.col(message_id).cast("string"))
    if table in store.tables():
        recent = store.read(table).where(F.col("dt") >= F.lit(today - timedelta(days=days)))
        known = recent.select("tenant_id", F.col("message_id").alias("_id"), F.lit(True).alias("_seen")).distinct()
        once = lookup_join(once, known, ["tenant_id", "_id"])
    else:
        once = once.withColumn("_seen", F.lit(None).cast("boolean"))
    known = F.coalesce("_seen", F.lit(False))
    told = once.select(
        "tenant_id", message_id, "_rest.*", (F.col("_deliveries") - F.when(known, 0).otherwise(1)).alias("_again"), known.alias("_known")
    )
    free = records.where(F.col(message_id).isNull()).withColumns({"_again": F.lit(0).cast("long"), "_known": F.lit(False)})
    return told.unionByName(free)


def _log_ingestion(change: Transaction, per_tenant: DataFrame, source_path: str, target: str, masks: bool, redelivery: bool) -> None:
    details = {
        "source_path": F.lit(source_path), "records_processed": F.col("passed"),
        "records_inserted": F.col("passed"), "validation_errors": F.col("failed"),
    }
    if redelivery:
        details["redelivered"] = F.col("redelivered")
    rows = audit.events(per_tenant, "KYC_INGESTION", record_id=F.lit(target), details=details)
    if masks:
        rows = rows.unionByName(
            audit.events(per_tenant.where("passed > 0"), "MASK_RECORD", record_id=F.lit(target),
                         details={"records_masked": F.col("passed")})
        )
    log_work(change, rows, lineage.track(
        per_tenant, F.lit(source_name(source_path)), F.lit(f"postgresql:{target}"), F.lit("kyc_ingestion")
    ))


def migrate_table(store: TableStore, source: DataFrame, target: str, *, rules: Mapping[str, object], tenant_id: str,
                  source_system: str, target_system: str, mapping: Mapping[str, str] | None = None,
                  threshold: float = quality.DEFAULT_THRESHOLD, dry_run: bool = False) -> JobResult:
    """Quality-gate a table, write it, and compare the rows written with the rows read (JOB-2).

    ``mapping`` names target columns and the source columns they come from. Reading, checking and writing are one pass;
    the gate decides afterwards whether the staged copy is published.
    """
    result = JobResult("data_migration", tenant_id)

    def body(change: Transaction) -> str:
        checked = quality.with_errors(source, rules)
        seen = Observation()
        counted = checked.observe(
            seen, F.count_if(quality.passed()).alias("passed"), F.count_if(~quality.passed()).alias("failed")
        )
        wanted = mapping or {c: c for c in source.columns}
        rows = counted.select(*[F.col(old).alias(new) for new, old in wanted.items()])
        written_schema = rows.schema
        folder = change.new_folder(target)
        if dry_run:
            rows.write.format("noop").mode("overwrite").save()
        else:
            rows.write.parquet(folder)
        passed, failed = observed(seen, "passed"), observed(seen, "failed")
        read = passed + failed
        result.records_processed, result.records_failed = read, failed
        if failed:
            result.warnings.append(f"Quality issues: {failed} records")
        score = passed / read if read else 0.0
        if read and score < threshold:
            raise QualityGateClosed(f"quality score {score:.4f} is below {threshold}")
        written = read if dry_run else store.spark.read.schema(written_schema).parquet(folder).count()
        result.details = {"verification_status": "passed", "records_processed": read, "records_written": written}
        if written != read:
            result.warnings.append(f"Record count mismatch: {read - written} records not written")
            result.records_failed = read - written
            result.details["verification_status"] = "failed_mismatch"
        if dry_run:
            return "success"
        change.adopt(target, folder, written_schema)
        one = store.spark.createDataFrame([(tenant_id,)], "tenant_id string")
        rows = audit.events(one, "DATA_MIGRATION", record_id=F.lit(target), details={
            "source_system": F.lit(source_system), "target_system": F.lit(target_system),
            "records_processed": F.lit(read), "records_written": F.lit(written),
        })
        log_work(change, rows, lineage.track(
            one, F.lit(f"{source_system}:{target}"), F.lit(f"{target_system}:{target}"), F.lit("data_migration")
        ))
        return "success"

    return _run(store, result, "DATA_MIGRATION", body, dry_run)


def _table_or_empty(store: TableStore, table: str, schema: T.StructType) -> DataFrame:
    try:
        return store.read(table)
    except KeyError:
        return store.spark.createDataFrame([], schema)


def check_compliance(store: TableStore, tenants: DataFrame, check_type: str = "full", *, dry_run: bool = False) -> JobResult:
    """Check all tenants at once and publish the checks, the roll-up and one audit row per tenant (JOB-3)."""
    result = JobResult("compliance_check", "*")

    def body(change: Transaction) -> str:
        logs = (
            _table_or_empty(store, AUDIT_TABLE, S.AUDIT), _table_or_empty(store, LINEAGE_TABLE, S.LINEAGE),
            _table_or_empty(store, REQUESTS_TABLE, S.ERASURE_REQUESTS),
        )
        checks = compliance.check_tenants(tenants, *logs, check_type=check_type)
        folder = change.new_folder("compliance_checks")
        checks.write.parquet(folder)
        staged = store.spark.read.schema(checks.schema).parquet(folder)
        totals = staged.agg(
            F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") != "pass").alias("failed")
        ).first()
        result.records_processed, result.records_failed = totals.passed, totals.failed
        result.details = {"check_type": check_type, "checks_passed": totals.passed, "checks_failed": totals.failed}
        change.adopt("compliance_checks", folder, checks.schema, replaces=True)
        rolled = compliance.roll_up(staged)
        log_audit(change, audit.events(rolled, "COMPLIANCE_CHECK", record_id=F.col("tenant_id"), details={
            "check_type": F.lit(check_type), "checks_passed": F.col("checks_passed"),
            "checks_failed": F.col("checks_failed"), "overall_status": F.col("overall_status"),
        }))
        if totals.failed == 0:
            return "success"
        if totals.failed * 2 < totals.passed + totals.failed:
            return "warning"
        result.error_message = f"Compliance check failed: {totals.failed} issues found"
        return "failure"

    return _run(store, result, "COMPLIANCE_CHECK", body, dry_run)


def erase_records(store: TableStore, table: str, record_ids: DataFrame, key: str, *, tenant_id: str,
                  reason: str = "user_request", dry_run: bool = False) -> JobResult:
    """Erase the listed records of one tenant from a table (JOB-4 by record id). Ids that match nothing count as failed."""
    result = JobResult("data_erasure", tenant_id)

    def body(change: Transaction) -> str:
        data = store.read(table, change.base)
        mine = data.where(F.col("tenant_id") == tenant_id)
        found = erasure.record_outcomes(mine, record_ids, key).agg(
            F.count_if(F.col("erased_rows") > 0).alias("found"), F.count_if(F.col("erased_rows") == 0).alias("absent")
        ).first()
        result.records_processed, result.records_failed = found.found, found.absent
        result.details = {"reason": reason, "record_count": found.found + found.absent,
                          "erased_count": found.found, "failed_count": found.absent}
        if found.absent:
            result.warnings.append(f"{found.absent} records not found")
        if dry_run:
            return "success"
        if "tenant_id" in store.partition_columns(table, change.base):
            # Only the tenant's own partitions are read and written again.
            change.replace_partitions(
                table, erasure.erase_records(mine, record_ids, key), lambda values: values.get("tenant_id") == tenant_id
            )
        else:
            doomed = record_ids.select(key).withColumn("tenant_id", F.lit(tenant_id)).distinct()
            change.replace(table, lookup_join(data, doomed, [key, "tenant_id"], "left_anti"))
        one = store.spark.createDataFrame([(tenant_id,)], "tenant_id string")
        log_audit(change, audit.events(one, "DATA_ERASURE", record_id=F.lit(table), details={
            k: F.lit(str(v)) for k, v in result.details.items()
        }))
        return "warning" if found.absent else "success"

    return _cleaned(store, _run(store, result, "DATA_ERASURE", body, dry_run), dry_run)


def _cleaned(store: TableStore, result: JobResult, dry_run: bool) -> JobResult:
    """After an erasure that was published, delete the replaced files, so that erased values are gone from disk."""
    if not dry_run and result.status != "failure" and result.records_processed:
        result.details = {**result.details, "deleted_folders": store.vacuum()}
    return result


def submit_requests(store: TableStore, submitted: DataFrame) -> DataFrame:
    """Take in a batch of erasure requests; returns the rejected ones with the rules they break (JOB-4)."""
    with store.transaction() as change:
        accepted, rejected = erasure.intake(submitted)
        folder = change.new_folder(REQUESTS_TABLE)
        accepted.write.parquet(folder)
        change.adopt(REQUESTS_TABLE, folder, S.ERASURE_REQUESTS)
        written = store.spark.read.schema(S.ERASURE_REQUESTS).parquet(folder)
        change.append(STATES_TABLE, written.select(
            "request_id", "status", F.col("created_at").alias("ts"), "error_message"
        ))
        log_audit(change, erasure.submission_events(written))
    return rejected


def _replace_for_tenants(store: TableStore, change: Transaction, table: str, tenants: DataFrame | None,
                         rewrite: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrite only the partitions of the given tenants, where a table has them; all of it for ``None``.

    What comes to the driver are values of the table's own partitions, which the commit names anyway.
    """
    data = store.read(table, change.base)
    by_tenant = "tenant_id" in store.partition_columns(table, change.base)
    if not by_tenant or tenants is None:
        change.replace(table, rewrite(data))
        return
    held = data.select("tenant_id").distinct().join(tenants, "tenant_id", "left_semi")
    affected = {r.tenant_id for r in held.collect()}
    mine = data.join(tenants, "tenant_id", "left_semi").select(*data.columns)
    change.replace_partitions(table, rewrite(mine), lambda values: values.get("tenant_id") in affected)


def execute_requests(store: TableStore, tables: Mapping[str, list[str]], *, scope: str = "owner",
                     dry_run: bool = False) -> JobResult:
    """Execute every PENDING request: null its fields in ``tables`` and delete its tokens, all or nothing (JOB-4).

    ``tables`` maps each table, which carries ``tenant_id`` and ``user_id``, to the columns that may be erased.
    """
    result = JobResult("data_erasure", "*")
    spark = store.spark

    def body(change: Transaction) -> str:
        states = store.read(STATES_TABLE, change.base)
        pending_ids = erasure.current_states(states).where("status = 'PENDING'").select("request_id")
        pending = store.read(REQUESTS_TABLE, change.base).join(pending_ids, "request_id", "left_semi")
        folder = change.new_folder("executed_requests")
        pending.write.parquet(folder)
        pending = spark.read.schema(S.ERASURE_REQUESTS).parquet(folder)
        result.records_processed = pending.count()
        if dry_run or result.records_processed == 0:
            return "success"
        tenants = pending.select("tenant_id").distinct()
        for table, fields in tables.items():
            _replace_for_tenants(store, change, table, tenants, lambda rows: erasure.erase_fields(rows, pending, fields))
        if VAULT_TABLE in store.tables():
            _replace_for_tenants(
                store, change, VAULT_TABLE, tenants if scope == "owner" else None,
                lambda rows: erasure.erase_tokens(rows, pending, scope),
            )
        executed = erasure.outcome(pending, F.lit(0))
        now = F.current_timestamp()
        started = pending.select("request_id", F.lit("IN_PROGRESS").alias("status"), now.alias("ts"),
                                 F.lit(None).cast("string").alias("error_message"))
        ended = executed.select("request_id", "status", now.alias("ts"), "error_message")
        change.append(STATES_TABLE, started.unionByName(ended))
        log_audit(change, erasure.execution_events(executed))
        return "success"

    return _cleaned(store, _run(store, result, "DATA_ERASURE", body, dry_run), dry_run)


def store_tokens(store: TableStore, values: DataFrame, created_at: object, ttl_seconds: int | None = None,
                 owner: tuple[str, ...] = ()) -> int:
    """Add tokens for new values to the vault table and return how many; a collision publishes nothing."""
    with store.transaction() as change:
        held = _table_or_empty(store, VAULT_TABLE, S.VAULT)
        fresh = vault.new_tokens(values, held, created_at, ttl_seconds, owner=owner)
        columns = [F.col(f.name) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.VAULT]
        folder = change.new_folder(VAULT_TABLE)
        by = store.partition_columns(VAULT_TABLE, change.base) if VAULT_TABLE in store.tables() else ["tenant_id"]
        write_partitioned(fresh.select(*columns), folder, by)
        staged = store.spark.read.schema(S.VAULT).parquet(folder)
        added = staged.count()
        if added:
            vault.require_no_collisions(staged, held)
            change.adopt(VAULT_TABLE, folder, S.VAULT, partition_by=by)
    return added


def gate_batch(store: TableStore, rows: DataFrame, rules: Mapping[str, object], key: str, *, threshold: float = quality.DEFAULT_THRESHOLD,
               record: str | None = None, tenant: str = "tenant_id") -> str:
    """Check a batch and store its run and its errors under a new batch id, which is returned (QLT-2).

    Runs have one row a tenant, errors one row each with the record's ``key``; both tables and an audit row per tenant are one commit.
    """
    batch_id = uuid.uuid4().hex
    checked = quality.with_errors(rows, rules, record)
    with store.transaction() as change:
        folder = change.new_folder(QUALITY_RUNS_TABLE)
        runs = quality.summarise(checked, threshold, [tenant]).select(F.lit(batch_id).alias("batch_id"), F.col(tenant).alias("tenant_id"), *S.QUALITY_RUNS.fieldNames()[2:])
        runs.write.parquet(folder)
        change.adopt(QUALITY_RUNS_TABLE, folder, S.QUALITY_RUNS)
        errors = quality.error_table(checked, [key]).select(
            F.lit(batch_id).alias("batch_id"), F.col(key).cast("string").alias("record_key"), *S.QUALITY_ERRORS.fieldNames()[2:])
        change.append(QUALITY_ERRORS_TABLE, errors)
        told = store.spark.read.schema(S.QUALITY_RUNS).parquet(folder)
        log_audit(change, audit.events(told, "QUALITY_CHECK", record_id=F.col("batch_id"), details={
            c: F.col(c) for c in ("passed_records", "failed_records", "quality_score", "circuit_breaker_triggered")}))
    return batch_id


def record_metrics(store: TableStore, rows: DataFrame, name: str, value: Column, labels: dict[str, Column] | None = None, ts: object | None = None) -> None:
    """Append one metric for each row to the metrics table (MET-1); rows without a value are no metrics."""
    with store.transaction() as change:
        change.append(METRICS_TABLE, metrics.record(rows, name, value, labels, ts).where(F.col("value").isNotNull()).select(*S.METRICS.fieldNames()))


def expire_audit(store: TableStore, as_of: datetime, retention_days: int | None) -> None:
    """Rewrite the audit table without events past the retention period and log the purge per tenant (AUD-8).

    The rewritten days and the purge's own events are one commit. Then the files of what was purged are deleted; a run that dies before
    leaves them to the next one, which deletes what no commit names even if nothing has expired since.
    """
    if retention_days is None:
        return
    with store.transaction() as change:
        current = store.read(AUDIT_TABLE, change.base)
        purges = change.new_folder("purges")
        audit.expired(current, as_of, retention_days).groupBy("tenant_id").agg(F.count("*").alias("n")).write.parquet(purges)
        counted = store.spark.read.schema("tenant_id string, n long").parquet(purges)
        # Days before the cutoff lose their folders, days after it keep their files; only the cutoff's day and events without one are written again.
        last_day = (as_of - timedelta(days=retention_days)).date()
        boundary = audit.retained(current.where((F.col("dt") == F.lit(last_day)) | F.col("dt").isNull()), as_of, retention_days)
        change.replace_partitions(AUDIT_TABLE, boundary, lambda values: values["dt"] is None or values["dt"] <= last_day.isoformat())
        log_audit(change, audit.events(counted, "AUDIT_RETENTION_PURGE", details={"purged_events": F.col("n")}))
    store.vacuum()

"""Streaming ingestion (JOB-9): the batch job on every micro-batch, published once per batch id."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardenry.plans.jobs import RUNS_TABLE, ingest_records
from wardenry.plans.runs import JobResult
from wardenry.sources import topics
from wardenry.sources.versioned import TableStore


def message_records(messages: DataFrame) -> DataFrame:
    """Topic messages as raw records, with the offset columns that identify them when the source has them."""
    identity = [c for c in ("tenant_id", "message_id", "partition", "offset", "timestamp") if c in messages.columns]
    return messages.select(F.col("value").cast("string").alias("record"), *identity)


def unseen(stream: DataFrame, message_id: str, redelivery_days: int = 7) -> DataFrame:
    """Messages that their tenant did not send within ``redelivery_days``, decided by the state store of the stream.

    Time is that of arrival, so no message is late. A message without an id is a message of its own.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", f"{redelivery_days} days")
    own = arrived.withColumn("_message", F.coalesce(F.col(message_id).cast("string"), F.uuid()))
    return topics.once(own, "_message").drop("_arrived", "_message")


def redelivered(query: StreamingQuery) -> dict[int, int]:
    """How many messages each of the query's recent batches left out, as the state store counted them."""
    out = {}
    for progress in query.recentProgress:
        told = json.loads(progress.json) if hasattr(progress, "json") else progress
        out[told["batchId"]] = sum(int(op.get("customMetrics", {}).get("numDroppedDuplicateRows", 0)) for op in told.get("stateOperators", []))
    return out


def log_redelivered(store: TableStore, query: StreamingQuery, name: str, tenant_id: str | None = None) -> int:
    """Append a run record with the messages left out since the last such record, and return their number.

    The last batch told is published with the record, so no batch is told twice. Batches run it before their own work; call it once more when the query has ended.
    """
    mark = f"{name}:redelivered"
    done = store.progress(mark)
    fresh = {batch: n for batch, n in redelivered(query).items() if done is None or batch > done}
    left_out = sum(fresh.values())
    if left_out:
        result = JobResult("redelivery", tenant_id or "*", details={"redelivered": left_out, "stream": name, "batches": json.dumps(sorted(b for b, n in fresh.items() if n))})
        with store.transaction() as change:
            change.append(RUNS_TABLE, result.finish("success").row(store.spark))
            change.mark(mark, max(fresh))
    return left_out


def start_ingestion(stream: DataFrame, store: TableStore, rules: Mapping[str, object], target: str, *, name: str,
                    checkpoint: str, source_path: str, tenant_id: str | None = None, threshold: float | None = None,
                    available_now: bool = True, interval: str = "1 minute", message_id: str | None = None,
                    redelivery_days: int = 7) -> StreamingQuery:
    """Ingest ``(record[, tenant_id])`` rows as they arrive.

    The number of each batch is committed together with its rows, so a batch that is delivered again after a crash is
    skipped: at-least-once delivery, exactly-once tables. With ``message_id`` a message that the source itself delivers again,
    in the same or a later batch within ``redelivery_days``, is stored once a tenant; run records of job type ``redelivery`` tell how many
    were left out. A batch below ``threshold`` stops the query unpublished.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        done = store.progress(name)
        if done is not None and batch_id <= done:
            return
        if message_id is not None:
            for running in store.spark.streams.active:
                if running.name == name:
                    log_redelivered(store, running, name, tenant_id)
        outcome = ingest_records(
            store, batch, rules, target, source_path=source_path, tenant_id=tenant_id, threshold=threshold, mark=(name, batch_id),
        )
        if outcome.status == "failure":
            raise RuntimeError(outcome.error_message)

    if message_id is not None:
        owned = stream if tenant_id is None else stream.withColumn("tenant_id", F.lit(tenant_id))
        stream = unseen(owned, message_id, redelivery_days)
    writer = stream.writeStream.queryName(name).foreachBatch(ingest).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()

"""Topic scans and message production (SRC-9..11, SNK-6)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenry.schemas import typed_literal
from wardenry.sources.files import tenant_path


def scoped(tenant_id: str, name: str) -> str:
    """``{tenant}_{name}``, for topics and consumer groups."""
    tenant_path("", tenant_id)
    if not isinstance(name, str) or not name.strip():
        raise ValueError("topic must be a non-empty string")
    return f"{tenant_id}_{name}"


def kafka_options(servers: str, topic: str, tenant_id: str, group: str | None = None, starting: str = "earliest",
                  max_per_trigger: int | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers, "subscribe": scoped(tenant_id, topic), "startingOffsets": starting,
    }
    if group:
        options["kafka.group.id"] = scoped(tenant_id, group)
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def offsets_from(topic: str, offset: int, tenant_id: str, partition: int = 0) -> str:
    """``startingOffsets`` text that replays one partition from an offset."""
    if isinstance(offset, bool) or not isinstance(offset, int):
        raise TypeError("offset must be int")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return json.dumps({scoped(tenant_id, topic): {str(partition): offset}})


def consume(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Streaming rows ``(offset, value, partition, timestamp)`` of a Kafka topic."""
    return spark.readStream.format("kafka").options(**options).load().select("offset", "value", "partition", "timestamp")


def replay(spark: SparkSession, options: dict[str, str], ending: str = "latest") -> DataFrame:
    """The same rows as a bounded batch."""
    bounded = {**options, "endingOffsets": ending}
    return spark.read.format("kafka").options(**bounded).load().select("offset", "value", "partition", "timestamp")


def replay_landed(messages: DataFrame, offset: int, partition: int = 0) -> DataFrame:
    """Replay from a landed topic table; both predicates reach the scan."""
    offsets_from("t", offset, "t", partition)
    return messages.where(
        (F.col("partition") == typed_literal(messages, "partition", partition))
        & (F.col("offset") >= typed_literal(messages, "offset", offset))
    )


def once(messages: DataFrame, message_id: str = "message_id", tenant_id: str = "tenant_id") -> DataFrame:
    """Redelivered messages once; tenants, where the messages name them, number theirs on their own.

    For a stream, give it a watermark first so that the state stays bounded: a message is known for as long as the watermark's delay.
    """
    keys = [c for c in (tenant_id, message_id) if c in messages.columns]
    if messages.isStreaming:
        return messages.dropDuplicatesWithinWatermark(keys)
    return messages.dropDuplicates(keys)


def messages(df: DataFrame, topic: str, tenant_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``(topic, value)`` rows to produce: one JSON object per row with nulls kept.

    Without ``tenant_id`` the table's own tenant column names the topic, so one job serves all tenants.
    """
    if not isinstance(topic, str) or not topic.strip():
        raise ValueError("topic must be a non-empty string")
    body = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    owner = F.lit(tenant_id) if tenant_id is not None else F.col("tenant_id")
    return df.select(F.concat_ws("_", owner, F.lit(topic)).alias("topic"), body.alias("value"))


def produce(rows: DataFrame, servers: str) -> None:
    """Write ``(topic, value)`` rows to Kafka."""
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()

"""Plain sinks (SNK-1, SNK-3) and the uniform read and write by kind (SRC-13)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenry.session import observed
from wardenry.sources import files, tables, topics
from wardenry.sources.versioned import TableStore

OBJECT_KINDS = ("s3", "gcs", "adls")
TABLE_KINDS = ("postgresql", "snowflake", "mongodb")
TOPIC_KINDS = ("kafka", "pubsub")


def write_by_tenant(df: DataFrame, path: str) -> None:
    """Overwrite only the tenants present in ``df``; the folders of other tenants are left alone."""
    df.hint("rebalance", "tenant_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "tenant_id"
    ).parquet(path)


def align(df: DataFrame, target: T.StructType) -> tuple[DataFrame, list[str]]:
    """``df`` in the target's columns and types, absent ones NULL; and the surplus columns that were left out."""
    fields = [
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields
    ]
    return df.select(*fields), [c for c in df.columns if c not in target.fieldNames()]


def append(store: TableStore, table: str, df: DataFrame, target: T.StructType, partition_by: list[str] | None = None) -> int:
    """Append rows in the declared schema and return how many the write itself counted. No rows, no new version.

    Columns that the schema lacks are left out and named in a warning.
    """
    aligned, surplus = align(df, target)
    if surplus:
        warnings.warn(f"columns that {table} does not have were left out: {', '.join(surplus)}", stacklevel=2)
    counted = Observation()
    with store.transaction() as change:
        change.append(table, aligned.observe(counted, F.count(F.lit(1)).alias("n")), partition_by)
        if observed(counted, "n") == 0:
            change.staged.clear()
    return observed(counted, "n")


def append_database(df: DataFrame, url: str, table: str, batch_size: int = 10_000, connections: int = 16) -> None:
    """Append through JDBC with a bounded number of connections."""
    df.write.format("jdbc").mode("append").options(
        url=url, dbtable=table, batchsize=str(batch_size), numPartitions=str(connections)
    ).save()


def read_any(spark: SparkSession, kind: str, query: str, *, tenant_id: str, root: str | None = None,
             params: dict | None = None, options: dict[str, str] | None = None, collection: DataFrame | None = None,
             fmt: str = "binaryFile") -> DataFrame:
    """Read by connector kind: an object path, SQL, a document filter or a topic.

    Without ``options`` naming a broker, a topic is read from its landed table under ``root``.
    """
    if not isinstance(query, str) or not query.strip():
        raise ValueError("query must be a non-empty string")
    if kind in OBJECT_KINDS:
        return files.read_object(spark, root, tenant_id, query, fmt)
    if kind == "mongodb":
        return tables.for_tenant(tables.find(collection, query), tenant_id)
    if kind in TABLE_KINDS:
        return tables.for_tenant(tables.query(spark, query, params), tenant_id)
    if kind in TOPIC_KINDS:
        if options:
            return topics.consume(spark, topics.kafka_options(topic=query, tenant_id=tenant_id, **options))
        return spark.read.parquet(f"{root.rstrip('/')}/{topics.scoped(tenant_id, query)}")
    raise ValueError(f"unsupported connector type: {kind}")


def write_any(kind: str, destination: str, df: DataFrame, *, tenant_id: str, root: str | None = None,
              store: TableStore | None = None, servers: str | None = None) -> int:
    """Write by connector kind and return the rows written; a kind that cannot write raises."""
    if not isinstance(destination, str) or not destination.strip():
        raise ValueError("destination must be a non-empty string")
    counted = Observation()
    rows = df.observe(counted, F.count(F.lit(1)).alias("n"))
    if kind in OBJECT_KINDS and root:
        rows.write.mode("overwrite").parquet(files.tenant_path(root, tenant_id, destination))
    elif kind in TABLE_KINDS and store:
        with store.transaction() as change:
            change.append(destination, rows.withColumn("tenant_id", F.lit(tenant_id)), ["tenant_id"])
    elif kind in TOPIC_KINDS and servers:
        topics.produce(topics.messages(rows, destination, tenant_id), servers)
    elif kind in TOPIC_KINDS and root:
        topics.messages(rows, destination, tenant_id).write.mode("append").parquet(
            f"{root.rstrip('/')}/{topics.scoped(tenant_id, destination)}"
        )
    else:
        raise ValueError(f"cannot write to {kind} with what was given")
    return observed(counted, "n")

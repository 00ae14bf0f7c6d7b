"""Schema registry tables and presence checks (SCH-1..4)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenry import schemas as S
from wardenry.functions.checks import missing_keys, parse_record
from wardenry.operators.conformance import violations
from wardenry.operators.joins import lookup_join
from wardenry.session import broadcast_if_small

_READ_KEYS = ("type", "required", "sensitive", "masking_strategy")


def schema_rows(schema_id: str, name: str, version: str, fields: Mapping[str, object],
                registered_at: datetime, description: str = "") -> list[tuple]:
    """One row per field. Rule keys nobody reads stay in ``extra``."""
    rows = []
    for position, (field, rule) in enumerate(fields.items()):
        known = rule if isinstance(rule, Mapping) else {"type": str(rule)}
        extra = {k: str(v) for k, v in known.items() if k not in _READ_KEYS}
        rows.append((
            schema_id, name, version, description, field, position, known.get("type"),
            bool(known.get("required", False)), bool(known.get("sensitive", False)),
            known.get("masking_strategy"), extra, registered_at,
        ))
    return rows


def schema_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, S.SCHEMAS)


def latest_schemas(schemas: DataFrame) -> DataFrame:
    """Rows of the last registration of every schema id."""
    newest = schemas.groupBy("schema_id").agg(F.max("registered_at").alias("registered_at"))
    return schemas.join(newest, ["schema_id", "registered_at"])


def field_sets(schemas: DataFrame) -> DataFrame:
    """Per schema its field names in declared order; bounded by the width of a schema."""
    return (
        latest_schemas(schemas)
        .groupBy("schema_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "field"))).alias("_ordered"))
        .select("schema_id", F.col("_ordered.field").alias("fields"))
    )


def check_presence(records: DataFrame, fields: list[str], record: str = "record") -> DataFrame:
    """Every field must be a key, null or not.

    Adds ``parsed`` (the record as a map), ``missing_fields`` (NULL: not an object) and ``valid``.
    """
    parsed = records.withColumn("parsed", parse_record(F.col(record)))
    missing = missing_keys(F.col("parsed"), F.array(*[F.lit(f) for f in fields]))
    return parsed.withColumn("missing_fields", missing).withColumn(
        "valid", F.coalesce(F.size("missing_fields") == 0, F.lit(False))
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows of a checked table."""
    return checked.where("valid"), checked.where(~F.col("valid"))


def check_presence_by_schema(records: DataFrame, schemas: DataFrame, record: str = "record") -> DataFrame:
    """Presence check where each record names its own ``schema_id``."""
    joined = lookup_join(records, broadcast_if_small(field_sets(schemas)), ["schema_id"])
    parsed = joined.withColumn("parsed", parse_record(F.col(record)))
    missing = missing_keys(F.col("parsed"), F.col("fields"))
    return parsed.withColumn("missing_fields", missing).withColumn(
        "problem",
        F.when(F.col("fields").isNull(), F.concat(F.lit("Schema not found: "), "schema_id"))
        .when(F.col("parsed").isNull(), "Expected dict")
        .when(
            F.size("missing_fields") > 0,
            F.concat(F.lit("Missing required fields: "), F.array_join(F.array_sort("missing_fields"), ", ")),
        ),
    ).drop("fields", "parsed")


def definition_violations(schemas: DataFrame) -> DataFrame:
    """Schema definitions with an empty id, name, version or field set."""
    heads = schemas.groupBy("schema_id", "name", "version").agg(
        F.count(F.when(F.col("field") != "", 1)).alias("field_count")
    )
    rules = [(f"{c}_empty", F.coalesce(F.col(c) == "", F.lit(True))) for c in ("schema_id", "name", "version")]
    rules.append(("fields_empty", F.col("field_count") == 0))
    return violations(heads, rules, ["schema_id", "name", "version"])

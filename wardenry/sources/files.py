"""File scans (SRC-1..6): every format becomes ``(path, record)`` with one JSON object text per row, or typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from wardenry.functions.patterns import path_denial


def _reader(spark: SparkSession, glob: str | None):
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob) if glob else reader


def json_documents(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(path, record, malformed)`` from files that each hold one JSON array of records.

    Keys that are absent stay absent and nulls stay null. A file that does not parse gives one malformed row with its
    whole text. One file is one task: producers should write many files, or JSON lines (see ``json_lines``).
    """
    whole = _reader(spark, glob).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    records = F.from_json("value", "array<string>")
    is_array = F.json_array_length("value").isNotNull()
    is_object = F.json_object_keys("value").isNotNull()
    parsed = F.when(is_array, records).when(is_object, F.array("value"))
    return (
        whole.select("path", F.coalesce(parsed, F.array("value")).alias("_records"), parsed.isNull().alias("malformed"))
        .select("path", F.explode("_records").alias("record"), "malformed")
    )


def json_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(path, record, malformed)`` from files with one JSON object per line; the files are split."""
    return _reader(spark, glob).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("record"),
        F.json_object_keys("value").isNull().alias("malformed"),
    )


def json_columns(spark: SparkSession, path: str | list[str], schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """Typed JSON scan for when key presence does not matter."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def csv_table(spark: SparkSession, path: str | list[str], columns: list[str], glob: str | None = None,
              multi_line: bool = False) -> DataFrame:
    """CSV with a header; every value is text. ``multi_line`` keeps quoted newlines but reads a file in one task.

    The declared columns spare the pass over the data that finding them would take. An empty field is the empty text.
    Rows with too few or too many fields come back with ``malformed`` set and their text in ``raw``; there a NULL may
    be an absent or an empty field.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "raw"]])
    rows = (
        _reader(spark, glob).schema(schema)
        .option("header", "true").option("multiLine", str(multi_line).lower()).option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw").option("enforceSchema", "false")
        .csv(path)
    )
    # Spark refuses a scan that needs nothing but the raw column, so the flag looks at a data column too.
    malformed = F.col("raw").isNotNull() & (F.length(F.coalesce(F.col(columns[0]), F.lit(""))) >= 0)
    return rows.select(
        *[F.when(F.col("raw").isNull(), F.coalesce(F.col(c), F.lit(""))).otherwise(F.col(c)).alias(c) for c in columns],
        "raw", malformed.alias("malformed"), F.col("_metadata.file_path").alias("path"),
    )


def as_records(df: DataFrame, path: Column, columns: list[str] | None = None) -> DataFrame:
    """Typed rows as ``(path, record)``; a NULL stays a key with a null value."""
    body = F.struct(*(columns or df.columns))
    return df.select(path.alias("path"), F.to_json(body, {"ignoreNullFields": "false"}).alias("record"))


def landing_zone(spark: SparkSession, root: str, csv_columns: list[str], json_is_lines: bool = False) -> DataFrame:
    """One scan of a folder that mixes ``.json``, ``.csv`` and ``.parquet`` files, by suffix, as ``(path, record, malformed)``.

    Any scheme a Hadoop file system answers to may be used. A suffix without files contributes nothing.
    """
    read_json = json_lines if json_is_lines else json_documents
    parts = [read_json(spark, root, "*.json")]
    csv = csv_table(spark, root, csv_columns, "*.csv")
    parts.append(
        csv.select(
            "path",
            F.when(F.col("malformed"), F.col("raw"))
            .otherwise(F.to_json(F.struct(*csv_columns), {"ignoreNullFields": "false"})).alias("record"),
            "malformed",
        )
    )
    try:
        parquet = _reader(spark, "*.parquet").option("mergeSchema", "true").parquet(root)
        parts.append(
            as_records(parquet, F.col("_metadata.file_path")).withColumn("malformed", F.lit(False))
        )
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # there are parquet files
            raise
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def tenant_path(root: str, tenant_id: str, path: str = "") -> str:
    """``root/tenant/path``, refusing ids and paths that would leave the tenant's folder."""
    if not isinstance(tenant_id, str) or not tenant_id or len(tenant_id) > 255 or any(
        part in tenant_id for part in ("/", "\\", "..", "\0")
    ):
        raise ValueError(f"invalid tenant id: {tenant_id!r}")
    if not isinstance(path, str) or ".." in path or path.startswith("/"):
        raise ValueError(f"invalid path: {path!r}")
    return "/".join(part for part in (root.rstrip("/"), tenant_id, path) if part)


def read_object(spark: SparkSession, root: str, tenant_id: str, path: str, fmt: str = "binaryFile", **options: str) -> DataFrame:
    """A tenant's object: raw bytes through ``binaryFile``, or any tabular format."""
    if not path:
        raise ValueError("path must not be empty")
    return spark.read.format(fmt).options(**options).load(tenant_path(root, tenant_id, path))


def list_objects(spark: SparkSession, root: str, tenant_id: str, prefix: str = "") -> DataFrame:
    """``(key, length, modified)`` of a tenant's objects under a prefix. File contents are not read."""
    base = tenant_path(root, tenant_id)
    if ".." in prefix or prefix.startswith("/"):
        raise ValueError(f"invalid prefix: {prefix!r}")
    marker = f"/{tenant_id}/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    below = F.substring_index(F.col("path"), f"{root.rstrip('/').split(':')[-1]}{marker}", -1)
    return listed.select(
        F.concat(F.lit(f"{tenant_id}/"), below).alias("key"), "length", F.col("modificationTime").alias("modified")
    ).where(F.col("key").startswith(f"{tenant_id}/{prefix}"))


def safe_paths(df: DataFrame, path: str = "path", listing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a table of object paths."""
    judged = df.withColumn("denial_reason", path_denial(F.col(path), listing))
    return judged.where("denial_reason IS NULL").drop("denial_reason"), judged.where("denial_reason IS NOT NULL")

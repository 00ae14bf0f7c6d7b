"""Query scans: parameterised SQL, database tables, document filters (SRC-7, SRC-8, SRC-12)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def query(spark: SparkSession, sql: str, params: dict | list | None = None, **tables: DataFrame) -> DataFrame:
    """Parameterised SQL over Spark tables. Values are bound, never put into the text."""
    if not isinstance(sql, str) or not sql.strip():
        raise ValueError("sql must be a non-empty string")
    if params is not None and not isinstance(params, (dict, list)):
        raise TypeError("params must be a dict of names or a list of positions")
    return spark.sql(sql, args=params, **tables)


def for_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """The tenant predicate; on a table partitioned by tenant it prunes to one partition."""
    return df.where(F.col("tenant_id") == tenant_id)


def jdbc_options(url: str, table: str | None = None, sql: str | None = None, partition_column: str | None = None,
                 lower: object = None, upper: object = None, partitions: int = 1, fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a JDBC scan. A partition column splits the read over executors; filters and columns are pushed down."""
    if (table is None) == (sql is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size), "pushDownPredicate": "true", "pushDownAggregate": "true"}
    if partition_column is None:
        options["query" if sql else "dbtable"] = sql or table
        return options
    # Spark refuses ``query`` together with a partition column; a derived table says the same.
    options["dbtable"] = table or f"({sql}) AS source"
    options |= {
        "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
        "numPartitions": str(partitions),
    }
    return options


def read_database(spark: SparkSession, **options: object) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """A whole catalog table, for migration."""
    return spark.table(table)


def _operator(value: Column, name: str, operand: object) -> Column:
    if name == "$eq":
        return value.isNull() if operand is None else value.eqNullSafe(F.lit(operand))
    if name == "$ne":
        return value.isNotNull() if operand is None else ~value.eqNullSafe(F.lit(operand))
    if name == "$in":
        present = [o for o in operand if o is not None]
        held = F.coalesce(value.isin(*present), F.lit(False))
        return held | value.isNull() if None in operand else held
    if name == "$nin":
        return ~_operator(value, "$in", operand)
    comparisons = {"$gt": value > operand, "$gte": value >= operand, "$lt": value < operand, "$lte": value <= operand}
    if name not in comparisons:
        raise ValueError(f"unsupported filter operator: {name}")
    return F.coalesce(comparisons[name], F.lit(False))


def document_filter(condition: dict) -> Column:
    """A document filter as one predicate: fields are ANDed; a value means equality, an object means operators."""
    predicate = F.lit(True)
    for field, wanted in condition.items():
        if field in ("$or", "$and"):
            parts = [document_filter(part) for part in wanted]
            joined = parts[0]
            for part in parts[1:]:
                joined = joined | part if field == "$or" else joined & part
        elif isinstance(wanted, dict):
            joined = F.lit(True)
            for name, operand in wanted.items():
                joined = joined & _operator(F.col(field), name, operand)
        else:
            joined = _operator(F.col(field), "$eq", wanted)
        predicate = predicate & joined
    return predicate


def find(df: DataFrame, json_filter: str) -> DataFrame:
    """Documents that satisfy a JSON filter; ``_id`` comes back as text."""
    condition = json.loads(json_filter) if json_filter.strip() else {}
    if not isinstance(condition, dict):
        raise ValueError("the filter must be a JSON object")
    found = df.where(document_filter(condition))
    if "_id" in df.columns and not isinstance(df.schema["_id"].dataType, T.StringType):
        found = found.withColumn("_id", F.col("_id").cast("string"))
    return found

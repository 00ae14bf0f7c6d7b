"""Set-based changes of a table: every form returns the new table, to be published as a version (SNK-2, SNK-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.operators.joins import lookup_join


def latest_per_key(changes: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One change per key, the last by ``order``. An aggregate, so a key with many changes is combined early."""
    if order is None:
        return changes.dropDuplicates(keys)
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of ``target`` with the same keys, and new keys are added."""
    last = latest_per_key(changes, keys, order).select(*target.columns)
    return target.join(last.select(*keys), keys, "left_anti").select(*target.columns).unionByName(last)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Keep rows for which the condition is false or unknown."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return lookup_join(target, doomed.select(*keys).distinct(), keys, "left_anti")


def update_where(target: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return target.select(
        *[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns]
    )


def _first_match(target: DataFrame, condition: Column, key: str) -> Column:
    return F.col(key).eqNullSafe(target.where(condition).agg(F.min(key)).scalar())


def update_one(target: DataFrame, condition: Column, changes: dict[str, Column], key: str) -> DataFrame:
    """Change the matching row with the least ``key``, which must be unique."""
    return update_where(target, condition & _first_match(target, condition, key), changes)


def delete_one(target: DataFrame, condition: Column, key: str) -> DataFrame:
    return delete_where(target, condition & _first_match(target, condition, key))


def affected(target: DataFrame, condition: Column) -> DataFrame:
    return target.agg(F.count_if(condition).alias("affected_rows"))

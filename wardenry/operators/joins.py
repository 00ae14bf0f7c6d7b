"""The join of a large table with a side that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` so that a key with a very large share of the facts is split over many tasks.

    The lookup side comes from an aggregate on the same keys and would be joined in place, without a shuffle of its own;
    then adaptive execution leaves hot keys whole. A hash of the keys as one more join key makes both sides shuffle, and
    hot partitions of the facts are split. A small lookup is still broadcast by its measured size.
    """
    left = facts.withColumn("_key_hash", F.xxhash64(*keys))
    right = lookup.withColumn("_key_hash", F.xxhash64(*keys))
    return left.join(right, [*keys, "_key_hash"], how).drop("_key_hash").select(
        *facts.columns, *([] if how in ("left_semi", "left_anti") else [c for c in lookup.columns if c not in keys])
    )

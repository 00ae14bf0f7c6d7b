"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import number_within


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose weighted score is highest for ``key``: ``-weight / ln(u)`` with u uniform in (0, 1) from (key, shard).

    A shard's score depends on nothing but key, shard and its own weight. So a new shard takes rows only into itself, and a shard
    that goes gives up only its own rows. Equal scores go to the larger shard. A weight of 0 takes no rows.
    """
    table = F.array(*(F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w > 0))
    text = F.coalesce(key.cast("string"), F.lit("\0null"))

    def score(entry: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(text, entry["shard"]), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-entry["weight"] / F.log(uniform)).alias("score"), entry["shard"].alias("shard"))

    return F.array_max(F.transform(table, score))["shard"]


def shard_rows(docs: DataFrame, shards: int | Sequence[float] = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard by its key, and number the rows of each shard without gaps.

    ``shards`` is a count or the weights of the shards. Returns ``id_col``, ``size`` (UTF-8 bytes of the text plus 1; a null text
    has none), ``text_crc32`` (unsigned; null counts as empty), ``law`` (``key``), ``shard``, ``slot`` (from 0) and ``grown_shard``,
    the shard were there one more of mean weight. Rows with a null key share one shard; repeated rows share theirs and
    get slots of their own. No row is moved to be assigned: the only shuffle is the one that numbers slots, in ranges of hashes.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(map(float, shards))
    grown = [*weights, sum(weights) / len(weights)]
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.col(id_col)
    placed = docs.select(
        key, (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"),
    ).withColumn("__spread", F.xxhash64(F.col(id_col), F.col("size"), F.col("text_crc32")))
    order = [F.col(id_col), F.col("size"), F.col("text_crc32")]
    return number_within(placed, ["shard"], "__spread", order, docs.count(), "slot").drop("__spread")

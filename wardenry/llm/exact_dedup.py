"""Exact deduplication by content sort, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A text that holds this share of the rows or more is hot: at most that many texts are, which bounds what is broadcast.
HOT_SHARES = 1024
# Characters of a text that order it between the splitters; the digest behind them parts texts that begin alike.
PREFIX_CHARS = 48


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), hot_shares: int = HOT_SHARES) -> DataFrame:
    """Mark, among rows of equal text, the one with the largest id as kept.

    Texts are equal when identical after no change; null counts as the empty text. Returns every row with ``id_col``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256`` and the ``carry`` columns (a carried column named like an output gives way to it).
    Among rows of equal text and id exactly one is kept. A null id is smaller than any other and stays only if all ids of its
    group are null. An empty table gives no rows.

    Rows are range-partitioned on (start of the text, digest, salt) by splitters that Spark samples, sorted by whole texts with an
    external sort, and runs of equal neighbours are found by comparing whole texts. The digest is no test of equality there; it
    only spreads texts that begin alike. A hot text is dealt over salts in proportion to its rows; its size and largest id come
    from an aggregate that combines before it shuffles, and at most ``hot_shares`` such rows are broadcast.
    """
    outputs = {id_col, "keep_id", "group_size", "kept", "text_sha256"}
    carried = [c for c in carry if c not in outputs and c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("__id"), text.alias("__text"), F.col(text_col).isNull().alias("__null"),
        F.struct(*carried).alias("__row") if carried else F.lit(None).cast("struct<x:int>").alias("__row"), F.sha2(text, 256).alias("__sha"),
    )
    total = docs.count()
    sizes = docs.select(F.col(id_col).alias("__id"), F.sha2(text, 256).alias("__hot_sha")).groupBy("__hot_sha").agg(F.count(F.lit(1)).alias("__hot_rows"), F.max("__id").alias("__hot_keep"))
    hot = sizes.where((F.col("__hot_rows") > 1) & (F.col("__hot_rows") * hot_shares >= total))
    salts = F.ceil(F.col("__hot_rows") * hot_shares / F.lit(max(total, 1))).cast("long")
    salted = base.join(F.broadcast(hot), F.col("__sha") == F.col("__hot_sha"), "left").withColumn("__salt", F.when(F.col("__hot_rows").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("__id"), salts)).cast("long"))
    ranged = salted.withColumn("__head", F.substring("__text", 1, PREFIX_CHARS)).repartitionByRange("__head", "__sha", "__salt")
    equal = Window.partitionBy("__head", "__sha", "__salt", "__text")
    ordered = equal.orderBy(F.desc_nulls_last("__id"), F.xxhash64("__row"))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_hot = F.col("__hot_rows").isNotNull()
    marked = ranged.select("*", F.row_number().over(ordered).alias("__n"), F.first("__id").over(whole).alias("__first"), F.count(F.lit(1)).over(whole).alias("__rows"))
    return marked.select(
        F.col("__id").alias(id_col),
        F.when(is_hot, F.col("__hot_keep")).otherwise(F.col("__first")).alias("keep_id"),
        F.when(is_hot, F.col("__hot_rows")).otherwise(F.col("__rows")).alias("group_size"),
        ((F.col("__n") == 1) & (~is_hot | F.col("__id").eqNullSafe(F.col("__hot_keep")))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
        *([F.when(~F.col("__null"), F.col("__text")).alias(text_col)] if text_col in carry else []),
        *(F.col("__row")[c].alias(c) for c in carried),
    )

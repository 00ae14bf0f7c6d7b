"""A training corpus from ``documents``: graded, without exact and near copies, mixed by source, and packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenry.llm import exact_dedup, mixing, packing, quality, simhash_dedup
from wardenry.llm.common import frozen, read
from wardenry.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than bad, by a model learned from the labels of documents that are not held out."""
    model = quality.train(docs, quality.ratings_of(read(spark, sf_dir, "labels")))
    return quality.keep_documents(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that of the largest id."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("__others")) if others else docs.withColumn("__others", F.lit(None))
    kept = exact_dedup.exact_dedup(packed, carry=("text", "__others")).where("kept")
    return kept.select(*(F.col("__others")[c].alias(c) if c in others else F.col(c) for c in docs.columns))


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    groups = simhash_dedup.simhash_groups(docs)
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__drop_id"), F.col("text_hash").alias("__drop_hash"))
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("__drop_id")) & (F.xxhash64("text") == F.col("__drop_hash")), "left_anti")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("simhash_dedup", unlike_documents),
    ("mixing", mixed_documents),
    ("packing", packed_documents),
]

# Models, fingerprints and seeded draws are beyond SQL: the stages are tested one by one against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

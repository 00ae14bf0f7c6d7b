"""Helpers shared by the corpus operators: frozen tables, gapless ranks, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wardenry.session import scratch_path

# Rows that one task numbers or one group holds, wherever a job cuts its rows into groups of bounded size.
GROUP_ROWS = 4096
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rounds of contraction. Each keeps about half of the nodes, so this many cover any graph Spark can hold.
MAX_ROUNDS = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frozen(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that are written inside come to Python in batches of at most ``rows``, or fewer if the session says so."""
    before = spark.conf.get(ARROW_ROWS, None)
    spark.conf.set(ARROW_ROWS, str(rows if before is None or int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_ROWS)
        else:
            spark.conf.set(ARROW_ROWS, before)


def nullable(schema: StructType) -> StructType:
    """The schema of rows that Python returns: any column may be null there."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema])


def held_out(key: Column) -> Column:
    """True for one fifth of the keys: the unsigned CRC-32 of the key as text, modulo 5, is 0. A null key is learned from."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def groups_of(rows: int, size: int = GROUP_ROWS) -> int:
    return max(1, math.ceil(rows / size))


def bucket_of(keys: Sequence[Column], buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets) if isinstance(buckets, int) else buckets)


def number_within(df: DataFrame, keys: Sequence[str], position: str, order: Sequence[Column], rows: int, out: str) -> DataFrame:
    """Add ``out``: a gapless number from 0 in each group of ``keys``, ordered by ``position`` (a signed 64-bit hash) and ``order``.

    A group of any size is numbered by many tasks: ``position`` is cut into equal ranges, each range is numbered on its own and
    shifted by the rows in the ranges before it. Only one small row a range meets in the second step.
    """
    ranges = 1 << max(0, groups_of(rows) - 1).bit_length()
    shift = 64 - (ranges.bit_length() - 1)
    cut = df.withColumn("__range", F.shiftright(position, shift) if shift < 64 else F.lit(0).cast("long"))
    sizes = cut.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__range").alias("__at"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    within = Window.partitionBy(*keys, "__range").orderBy(position, *order)
    numbered = cut.withColumn("__n", F.row_number().over(within) - 1)
    condition = F.col("__range") == F.col("__at")
    for test in same:
        condition = condition & test
    return numbered.join(starts, condition).withColumn(out, (F.col("__start") + F.col("__n")).cast("long")).drop("__range", "__at", "__start", "__n", *(f"__k_{k}" for k in keys))


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the rank from 0 of distinct values of ``column``, ascending, null last, without sorting in one task."""
    last = F.col(column).isNull()
    cut = frozen(df.repartitionByRange(last, F.col(column)).withColumn("__part", F.spark_partition_id()), "ranks")
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy(last, F.col(column))
    return cut.withColumn("__n", F.row_number().over(within) - 1).join(starts, "__part").withColumn(out, (F.col("__start") + F.col("__n")).cast("long")).drop("__part", "__start", "__n")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges``: one row (node, component) per node with a link, component = smallest node reachable.

    Randomised contraction: in each round a node joins the neighbour of the lowest random priority, itself included, edges move to
    the joined nodes, and loops and repeats fall away. Aggregates combine before the shuffle and joins split hot nodes, so a star
    with a third of all links is no single task. Every round is a table in the shared folder. Links of null are left out.
    """
    spark = edges.sparkSession
    links = frozen(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    kind = links.schema["a"].dataType
    steps: list[DataFrame] = []
    for round_no in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(round_no)).alias("p"), c.alias("node"))
        joined = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("best"))
        step = frozen(joined.select(F.col("a").alias("node"), F.least(F.col("best"), rank(F.col("a")))["node"].alias("into")), "joined")
        steps.append(step)
        left = links.join(step.select(F.col("node").alias("a"), F.col("into").alias("x")), "a").select("b", "x")
        moved = left.join(step.select(F.col("node").alias("b"), F.col("into").alias("y")), "b").where("x <> y")
        links = frozen(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return spark.createDataFrame([], "node long, component long").select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
    # A later step names only nodes that are still linked; the others stay where they are.
    found = steps[-1]
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("into"), F.col("into").alias("end"))
        found = step.join(later, "into", "left").select("node", F.coalesce("end", "into").alias("into"))
    found = frozen(found, "joined")
    least = found.groupBy("into").agg(F.min("node").alias("component"))
    return found.join(least, "into").select("node", "component")

"""Comparison of a migrated table with its source (JOB-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.session import broadcast_if_small, scratch_path

# Key ranges of each level of a checksum tree, the levels, and the rows of a range from which on it is halved no further.
FAN_OUT, LEVELS, LEAF_ROWS = 4096, 3, 4096


def count_check(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Rows read and written per group, with the verification status and the warning."""
    counted = (
        source.select(*by, F.lit(1).alias("_read"), F.lit(0).alias("_written"))
        .unionByName(target.select(*by, F.lit(0).alias("_read"), F.lit(1).alias("_written")))
        .groupBy(*by)
        .agg(F.sum("_read").alias("records_processed"), F.sum("_written").alias("records_written"))
    )
    short = F.col("records_processed") - F.col("records_written")
    return counted.withColumn(
        "verification_status", F.when(short == 0, "passed").otherwise("failed_mismatch")
    ).withColumn(
        "warning",
        F.when(short != 0, F.concat(F.lit("Record count mismatch: "), short.cast("string"), F.lit(" records not written"))),
    )


def row_fingerprint(columns: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(columns)])


def _per_key(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    # Copies of a key collapse to one row before the join; the decimal sum does not depend on their order.
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(row_fingerprint(columns).cast("decimal(20,0)")).alias("print")
    )


def compare_rows(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys..., difference)`` for keys that are missing, extra, changed or repeated a different number of times."""
    return _told(_per_key(source, keys, columns), _per_key(target, keys, columns), keys)


def _told(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    s, t = left.alias("s"), right.alias("t")
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"s.{key}").eqNullSafe(F.col(f"t.{key}"))
    joined = s.join(t, condition, "full_outer")
    difference = (
        F.when(F.col("t.rows").isNull(), "missing_in_target")
        .when(F.col("s.rows").isNull(), "extra_in_target")
        .when(F.col("s.rows") != F.col("t.rows"), "row_count_differs")
        .when(F.col("s.print") != F.col("t.print"), "values_differ")
    )
    return joined.select(
        *[F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in keys], difference.alias("difference")
    ).where(F.col("difference").isNotNull())


def _leveled(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every row's place in the tree (a hash of its key, so that ranges are even) and its own checksum."""
    place = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), F.lit(FAN_OUT**LEVELS))
    return df.select(*keys, place.alias("_place"), row_fingerprint([*keys, *columns]).alias("_print"), row_fingerprint(columns).alias("_values"))


def _checksums(rows: DataFrame, width: int, suspects: DataFrame | None) -> DataFrame:
    """Rows and an order-free checksum of each range of ``width`` places, only below the ranges that differed before.

    Ranges combine where the rows are read, so what is shuffled is one row a range and task.
    """
    if suspects is not None:
        rows = _below(rows, suspects)
    total = F.sum(F.col("_print").cast("decimal(20,0)"))
    return rows.groupBy(F.floor(F.col("_place") / width).alias("_range")).agg(F.count(F.lit(1)).alias("_rows"), total.alias("_sum"), F.bit_xor("_print").alias("_xor"))


def _below(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    # A suspect table of bounded size is broadcast, so no row moves; beyond it rows and suspects meet by their range.
    width = suspects.select("_width").first()
    if width is None:
        return rows.where(F.lit(False))
    at = rows.withColumn("_suspect", F.floor(F.col("_place") / width[0]))
    return at.join(broadcast_if_small(suspects.select(F.col("_range").alias("_suspect"))), "_suspect", "left_semi").drop("_suspect")


def differing_ranges(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame | None:
    """``(_range, _width)`` of the smallest key ranges whose multisets of rows differ; None when the tables are equal.

    A tree of checksums, level by level: ranges with equal counts, sums and exclusive ors of row checksums are equal, ranges that differ are
    cut into FAN_OUT parts. Ranges stop being cut when the differing ones hold at most ``leaf_rows`` rows each, or at once when most differ.
    """
    spark = source.sparkSession
    left, right = _leveled(source, keys, columns), _leveled(target, keys, columns)
    suspects: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        width = FAN_OUT ** (LEVELS - level)
        sums = _checksums(left, width, suspects), _checksums(right, width, suspects)
        # One more aggregate in place of a full join: a range of one side alone has no partner.
        both = sums[0].withColumn("_side", F.lit(1)).unionByName(sums[1].withColumn("_side", F.lit(-1))).groupBy("_range").agg(
            F.sum(F.col("_side") * F.col("_rows")).alias("_more"), F.sum(F.col("_side") * F.col("_sum")).alias("_off"), F.bit_xor("_xor").alias("_xor"), F.max("_rows").alias("_rows"))
        differ = both.where("_more <> 0 OR _off <> 0 OR _xor <> 0").select("_range", F.lit(width).cast("long").alias("_width"), "_rows")
        path = scratch_path(spark, "ranges")
        differ.write.parquet(path)
        suspects = spark.read.schema(differ.schema).parquet(path)
        found, largest = suspects.agg(F.count(F.lit(1)), F.max("_rows")).first()
        if not found:
            return None
        if largest <= leaf_rows or (level == 1 and found > FAN_OUT // 2):
            break
    return suspects


def compare_by_ranges(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """What ``compare_rows`` finds, from a join of differing key ranges alone.

    Where tables hardly differ, as after a migration, both are scanned once a level and next to nothing is shuffled. Where most ranges
    differ the tree ends at its first level and the join is that of ``compare_rows``.
    """
    suspects = differing_ranges(source, target, keys, columns, leaf_rows)
    left, right = _leveled(source, keys, columns), _leveled(target, keys, columns)
    if suspects is None:
        suspects = source.sparkSession.createDataFrame([], "_range long, _width long")
    per_key = lambda rows: _below(rows, suspects).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("_values").cast("decimal(20,0)")).alias("print"))
    return _told(per_key(left), per_key(right), keys)

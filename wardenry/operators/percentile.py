"""Exact percentiles by rank: value ranges are narrowed by sketches and counts until a task can sort them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenry.session import broadcast_if_small, scratch_path

# Rows of a value range from which on it is narrowed further instead of sorted.
TASK_ROWS = 200_000
# Size of the quantile sketches, the share of a range's rows that their ranks are surely off by, and the shares they are asked for.
SKETCH_SIZE, SKETCH_ERROR, GRID = 2048, 0.004, 256
# Each round leaves about a hundredth of a range. A range that a round does not narrow holds few distinct values.
MAX_ROUNDS = 12


def _kept(df: DataFrame) -> DataFrame:
    """A small table of ranges, written to the shared folder: every round builds on it, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"v.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], F.lit(True))


def _inside(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the ranges (keys, least, most), both ends included. Few ranges are broadcast after a count of them, so no row moves.

    Else the rows are shuffled by key. The hash makes the ranges, an aggregate on the keys, shuffle on their own, so that a hot group is split.
    """
    value = F.col("v._value")
    condition = _same_keys(keys) & (F.xxhash64(*[F.col(f"v.{k}") for k in keys]) == F.col("r._hash")) & (value >= F.col("r._least")) & (value <= F.col("r._most"))
    side = broadcast_if_small(ranges).withColumn("_hash", F.xxhash64(*keys))
    others = [F.col(f"r.{c}") for c in ranges.columns if c not in keys]
    return rows.alias("v").join(side.alias("r"), condition).select(*[F.col(f"v.{k}") for k in keys], "v._value", *others)


def _narrowed(rows: DataFrame, wanted: DataFrame, sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Every wanted rank again, within the piece of its range that holds it.

    The sketch of a range is cut a little below and above each wanted rank. The pieces are counted exactly, so the choice is
    right whatever the sketch says; only the size of the piece depends on it.
    """
    place = keys + ["_least", "_most"]
    share = F.col("_offset") / F.col("_rows")
    low = F.greatest(F.floor((share - SKETCH_ERROR) * GRID), F.lit(0)).cast("int")
    high = F.least(F.ceil((share + SKETCH_ERROR) * GRID), F.lit(GRID)).cast("int")
    known = sketched.where(F.kll_sketch_get_n_double("_sketch") > 0)
    # Sketches are asked for constant shares alone: a grid of them, from which each wanted rank takes its neighbours.
    grid = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    met = _matched(wanted, known.select(*place, grid.alias("_grid")), place)
    ends = met.select(*place, F.explode(F.array(F.get("_grid", low), F.get("_grid", high))).alias("_cut"))
    cuts = ends.groupBy(*place).agg(F.sort_array(F.collect_set("_cut")).alias("_cuts"))
    # A range of NaN alone has nothing in its sketch and no cuts: it is one piece.
    ranges = _matched(wanted.select(*place).distinct(), cuts, place, how="left")
    ranges = _kept(ranges.select(*place, F.coalesce("_cuts", F.array().cast("array<double>")).alias("_cuts")))
    piece = F.aggregate("_cuts", F.lit(0), lambda n, cut: n + F.when(cut <= F.col("_value").cast("double"), 1).otherwise(0))
    counted = _inside(rows, ranges, keys).groupBy(*place, piece.alias("_piece")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high")
    )
    before = Window.partitionBy(*place).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    held = (F.col("_before") <= F.col("_offset")) & (F.col("_offset") < F.col("_before") + F.col("_n"))
    return _matched(wanted, counted, place, held).select(
        *keys, "fraction", (F.col("_offset") - F.col("_before")).alias("_offset"),
        F.col("_n").alias("_rows"), F.col("_low").alias("_least"), F.col("_high").alias("_most"),
    )


def _matched(left: DataFrame, right: DataFrame, columns: list[str], also: Column | None = None, how: str = "inner") -> DataFrame:
    """Null-safe join on ``columns``; the other columns of both sides have different names."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in columns], *[c for c in right.columns if c not in columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns])
    return left.join(other, condition if also is None else condition & also, how).drop(*[f"_r_{c}" for c in columns])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], task_rows: int = TASK_ROWS) -> DataFrame:
    """``(keys..., fraction, percentile)``: the value at sorted position ``min(int(n * fraction), n - 1)``.

    Mergeable sketches and exact counts, both combined before they are shuffled, narrow each group to a value range that holds
    the wanted position and at most ``task_rows`` rows. Only rows of those ranges are shuffled, equal values as one. A position in a run
    of equal values needs no sort at all. Sketches only balance the work: any cut gives the same answer. NaN is larger than any number.
    """
    if any(not 0.0 <= f <= 1.0 for f in fractions):
        raise ValueError("fractions must be between 0 and 1")
    if task_rows < 1:
        raise ValueError("task_rows must be positive")
    if not keys:
        # One constant group: the joins below stay equi-joins.
        return exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, fractions, task_rows).drop("_all")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    sketch = F.kll_sketch_agg_double(F.col("_value").cast("double"), SKETCH_SIZE).alias("_sketch")
    whole = _kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_least"), F.max("_value").alias("_most"), sketch))
    position = F.least(F.floor(F.col("_rows").cast("double") * F.col("fraction")), F.col("_rows") - 1).cast("long")
    wanted = whole.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).select(
        *keys, "fraction", position.alias("_offset"), "_rows", "_least", "_most"
    )
    sketched = whole.select(*keys, "_least", "_most", "_sketch")
    large = (F.col("_rows") > task_rows) & (F.col("_least") != F.col("_most"))
    before = None
    for step in range(MAX_ROUNDS):
        left = wanted.where(large).agg(F.sum("_rows")).first()[0]
        if left is None or left == before:  # nothing is left, or what is left does not get smaller
            break
        before = left
        if step:
            ranges = wanted.where(large).select(*keys, "_least", "_most").distinct()
            sketched = _kept(_inside(rows, ranges, keys).groupBy(*keys, "_least", "_most").agg(sketch))
        wanted = _kept(wanted.where(~large).unionByName(_narrowed(rows, wanted.where(large), sketched, keys)))
    settled = wanted.where(F.col("_least") == F.col("_most")).select(*keys, "fraction", F.col("_least").alias("percentile"))
    return settled.unionByName(_sorted(rows, wanted.where(F.col("_least") != F.col("_most")), keys))


def _sorted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    place = keys + ["_least", "_most"]
    weighted = _inside(rows, wanted.select(*place).distinct(), keys).groupBy(*place, "_value").agg(F.count(F.lit(1)).alias("_weight"))
    upto = F.sum("_weight").over(Window.partitionBy(*place).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = weighted.withColumn("_upto", upto)
    held = (F.col("_offset") < F.col("_upto")) & (F.col("_offset") >= F.col("_upto") - F.col("_weight"))
    return _matched(ranked, broadcast_if_small(wanted), place, held).select(*keys, "fraction", F.col("_value").alias("percentile"))

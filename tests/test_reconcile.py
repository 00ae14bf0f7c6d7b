from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wardenry.operators import reconcile

SCHEMA = "k long, g string, v double"


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(spark, seed, changes):
    rng = random.Random(seed)
    rows = [(None if i % 97 == 0 else i // 2 if i % 5 == 0 else i, rng.choice("ab"), rng.choice([None, 1.5, float(i)])) for i in range(2000)]
    moved = list(rows)
    for _ in range(changes):
        at = rng.randrange(len(moved))
        moved[at : at + 1] = rng.choice([[], [moved[at]] * 2, [(moved[at][0], moved[at][1], -1.0)], [(-at, "z", None), moved[at]]])
    rng.shuffle(moved)
    return spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(moved, SCHEMA).repartition(3)


@pytest.mark.parametrize("changes, leaf_rows", [(0, 4096), (3, 4096), (3, 1), (40, 1), (1500, 1)])
def test_tree_finds_what_a_join_finds(spark, monkeypatch, changes, leaf_rows):
    monkeypatch.setattr(reconcile, "FAN_OUT", 64)
    source, target = tables(spark, changes, changes)
    want = found(reconcile.compare_rows(source, target, ["k"], ["g", "v"]))
    assert found(reconcile.compare_by_ranges(source, target, ["k"], ["g", "v"], leaf_rows)) == want and bool(want) == bool(changes)


def test_only_differing_ranges_are_joined(spark, monkeypatch):
    source = spark.range(0, 50_000, 1, 6).select("id", F.col("id").cast("string").alias("v"))
    target = source.withColumn("v", F.when(F.col("id") == 77, "x").otherwise(F.col("v")))
    below = []
    real = reconcile._below
    monkeypatch.setattr(reconcile, "_below", lambda *args: below.append(real(*args)) or below[-1])
    differences = reconcile.compare_by_ranges(source, target, ["id"], ["v"], leaf_rows=5)
    assert found(differences) == [(77, "values_differ")]
    text = below[-1]._jdf.queryExecution().executedPlan().toString()
    # Rows outside of the ranges are dropped where they are read.
    assert "BroadcastHashJoin" in text and "Exchange" not in text.replace("BroadcastExchange", "") and below[-1].count() <= 5
    assert reconcile.differing_ranges(source, source, ["id"], ["v"]) is None


def test_empty_tables(spark):
    source, _ = tables(spark, 1, 0)
    nothing = source.limit(0)
    assert found(reconcile.compare_by_ranges(nothing, nothing, ["k"], ["g", "v"])) == []
    assert found(reconcile.compare_by_ranges(source, nothing, ["k"], ["g", "v"])) == found(reconcile.compare_rows(source, nothing, ["k"], ["g", "v"]))

"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wardenry.operators import erasure, percentile, vault
from wardenry.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **conf):
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.fixture
def hot_rows(spark):
    """A third of the rows share one user and one token."""
    n = 30_000
    key = F.when(F.col("id") < n // 3, F.lit(0)).otherwise(F.col("id"))
    return spark.range(0, n, 1, 8).select(
        F.lit("t").alias("tenant_id"), key.cast("string").alias("user_id"), F.concat(F.lit("token_"), key.cast("string")).alias("token_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("email"),
    )


def test_hot_token_is_split(spark, hot_rows):
    with settings(spark, **SKEW):
        held = spark.range(0, 30_000, 7).select(
            F.concat(F.lit("token_"), F.col("id").cast("string")).alias("token_id"), F.col("id").cast("string").alias("value"),
            F.lit(None).cast("timestamp").alias("expires_at"))
        out = vault.detokenise(hot_rows, held, "2024-01-01")
        assert "skew=true" in final_plan(out)
        assert out.count() == 30_000


def test_hot_user_is_split(spark, hot_rows):
    with settings(spark, **SKEW):
        requests = spark.range(0, 30_000, 5).select(
            F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("user_id"), F.array(F.lit("email")).alias("fields_to_delete"))
        out = erasure.erase_fields(hot_rows, requests, ["email"])
        assert "skew=true" in final_plan(out)
        assert out.where("email IS NULL AND user_id = '0'").count() == 10_000
        gone = erasure.erase_records(hot_rows, requests, "user_id")
        assert "skew=true" in final_plan(gone)


NARROW = ["msk1_hash", "msk5_mask", "msk1_hash_text", "sch1_missing", "qlt1_errors", "aud3_action", "aud5_range", "aud7_violations",
          "lin3_touch", "lin12_violations", "ten1_ids", "ten6_paths", "job1_projection", "snk4_update", "src8_find"]


@pytest.mark.parametrize("name", NARROW)
def test_row_wise_operators_do_not_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    if re.match(r"(job|snk|src|vlt_job|aud8_purge|lin11|met_windows|qlt2_runs|qlt2_errors|met1_append|msk8_sketch)", name):
        pytest.skip("writes when it is built; its parts are covered by the other queries")
    text = plan(entry.queries()[name](spark, SF_DIR))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow"):
        assert banned not in text


@pytest.mark.parametrize("name, pushed", [
    ("aud5_range", "GreaterThanOrEqual(ts,2024-01-08T00:00)"), ("met5_window", "GreaterThanOrEqual(ts,2024-01-"), ("aud8_retention", "GreaterThanOrEqual(ts,2024-01-"),
    ("src10_replay", "GreaterThanOrEqual(event_id,500)"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    text = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    filters = " ".join(re.findall(r"PushedFilters: \[[^\]]*\]", text))
    assert pushed in filters


def test_only_needed_columns_are_read(spark):
    text = plan(entry.queries()["qlt2_gate"](spark, SF_DIR))
    assert "c_mktsegment" in text
    assert re.search(r"ReadSchema: struct<event_type:string>", plan(entry.queries()["aud6_count"](spark, SF_DIR))) is None
    assert "ReadSchema: struct<>" in plan(entry.queries()["aud6_count"](spark, SF_DIR))


def above(text: str, leaf: str) -> list[str]:
    """The operators over the one that ``leaf`` names."""
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if leaf in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out, now = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < now:
            out.append(line)
            now = depth(line)
    return out


def test_percentiles_shuffle_wanted_ranges_alone(spark, monkeypatch):
    """Half of the rows are one group. What is read for the answer moves no row that is outside of the narrowed ranges."""
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") < 30_000, 0).otherwise(F.col("id") % 300).alias("g"), F.col("id").cast("double").alias("v"))
    inside, counted = [], []
    real, count = percentile._inside, DataFrame.count
    monkeypatch.setattr(percentile, "_inside", lambda *args: inside.append(real(*args)) or inside[-1])
    monkeypatch.setattr(DataFrame, "count", lambda df: counted.append(plan(df)) or count(df))
    out = percentile.exact_percentiles(rows, ["g"], "v", [0.5, 0.99], 1000)
    answer = plan(out)
    monkeypatch.undo()
    assert not [p for p in counted if "Range" in p]  # no count of the rows before the answer is asked for
    # Rows meet the broadcast ranges where they are read; the one shuffle above them is of merged values.
    assert not [line for line in above(plan(inside[-1]), "Range (0, 60000") if "Exchange" in line] and "BroadcastHashJoin" in answer
    assert 0 < inside[-1].where("g = 0").count() < 2_000
    # Group 0: the first 30,000 ids and every 300th of the others.
    members = list(range(30_000)) + [i for i in range(30_000, 60_000) if i % 300 == 0]
    assert out.where("g = 0 AND fraction = 0.5").first().percentile == members[int(len(members) * 0.5)]


def test_schema_lookup_is_broadcast_when_small(spark):
    text = plan(entry.queries()["sch3_multi"](spark, SF_DIR))
    # The other join only picks the last registrations within the schema table.
    assert "BroadcastHashJoin" in text

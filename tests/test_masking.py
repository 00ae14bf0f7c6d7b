from __future__ import annotations

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardenry.functions import masking as mk
from wardenry.operators import masking


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


BANKING = {
    "customer_id": {"type": "string"},
    "email": {"type": "string", "sensitive": True, "masking_strategy": "hash"},
    "ssn": {"type": "string", "sensitive": True, "masking_strategy": "redact"},
    "credit_card": {"type": "string", "sensitive": True, "masking_strategy": "tokenize"},
}


def masked_value(spark, value, kind, strategy, field="", **options):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    return df.select(mk.mask_value(F.col("v"), kind, strategy, field, **options)).first()[0]


def test_hash_is_field_and_value(spark):
    assert masked_value(spark, "test123", T.StringType(), "hash", "test_field") == sha("test_field:test123")
    assert masked_value(spark, "test123", T.StringType(), "hash") == sha("test123")
    assert masked_value(spark, "test123", T.StringType(), "hash", "f", include_field=False) == sha("test123")


@pytest.mark.parametrize("text", ["x" * 10_000, "a!@#$%^&*()'\"\\", "你好 \U0001f600 é", "   ", "\t\n"])
def test_hash_of_any_text(spark, text):
    assert masked_value(spark, text, T.StringType(), "hash", "f") == sha(f"f:{text}")


@pytest.mark.parametrize("value, kind", [
    (12345, T.LongType()), (0, T.IntegerType()), (True, T.BooleanType()), (False, T.BooleanType()), (123.45, T.DoubleType()),
    (-123.45, T.DoubleType()), (datetime(2024, 1, 2, 3, 4, 5), T.TimestampType()),
    (datetime(2024, 1, 2, 3, 4, 5, 120), T.TimestampType()), (datetime(2024, 1, 2, 3, 4, 5, 100000), T.TimestampNTZType()),
])
def test_scalars_hash_as_their_text(spark, value, kind):
    assert masked_value(spark, value, kind, "hash", "f") == sha(f"f:{value}")


def test_doubles_have_their_shortest_text(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1.0, 1e7, 1e16, 1e15, 123456789.125, 1e-3, 1e-4, 1e-5, 1.5e-7, 1.7976931348623157e308,
              float("inf"), float("-inf"), float("nan"), 9007199254740993.0, 12345678.0, 0.1 + 0.2]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-30, 15) for _ in range(20000)]
    values += [round(rng.uniform(-1, 1) * 10 ** rng.randint(0, 12), rng.randint(0, 6)) for _ in range(20000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    texts = {r.i: r.t for r in df.select("i", mk.canonical_text(F.col("v"), T.DoubleType()).alias("t")).collect()}
    wrong = [(v, texts[i]) for i, v in enumerate(values) if texts[i] != str(v)]
    assert not wrong


def test_complex_values_hash(spark):
    df = spark.createDataFrame([([1, 2], {"k": "v"}, (1, None))], "a array<int>, m map<string,string>, s struct<x:int,y:int>")
    rules = {c: {"sensitive": True, "masking_strategy": "hash"} for c in df.columns}
    row = masking.mask_table(df, rules).first()
    assert row.a == sha("a:[1,2]") and row.s == sha('s:{"x":1,"y":null}') and len(row.m) == 64


@pytest.mark.parametrize("strategy", mk.STRATEGIES)
@pytest.mark.parametrize("value", [None, "null", "NULL", "Null", ""])
def test_blank_values_pass_through(spark, strategy, value):
    assert masked_value(spark, value, T.StringType(), strategy, "f") == value


def test_zero_false_and_spaces_are_masked(spark):
    assert masked_value(spark, 0, T.LongType(), "redact") == "***REDACTED***"
    assert masked_value(spark, False, T.BooleanType(), "redact") == "***REDACTED***"
    assert masked_value(spark, " ", T.StringType(), "redact") == "***REDACTED***"
    assert masked_value(spark, None, T.LongType(), "hash") is None


def test_table_masking(spark):
    df = spark.createDataFrame([("c1", "a@b.c", "123-45-6789", "4532", "kept")], "customer_id string, email string, ssn string, credit_card string, other string")
    out = masking.mask_table(df, BANKING)
    row = out.first()
    assert out.columns == df.columns
    assert (row.customer_id, row.email, row.ssn, row.other) == ("c1", sha("email:a@b.c"), "***REDACTED***", "kept")
    assert row.credit_card == "token_" + sha("4532")[:16]


@pytest.mark.parametrize("rule, expected", [
    ({"sensitive": True}, "redact"), ({"sensitive": True, "masking_strategy": "HaSh"}, "hash"),
    ({"sensitive": True, "masking_strategy": "rot13"}, "redact"), ({"masking_strategy": "hash"}, None), ("string", None),
    ({"sensitive": True, "masking_strategy": None}, "redact"),
])
def test_strategy_resolution(rule, expected):
    assert masking.field_strategy(rule) == expected


def test_fallback_is_flagged(spark):
    rows = spark.createDataFrame(
        [("s", "a", True, None), ("s", "b", True, "Tokenize"), ("s", "c", True, "rot13"), ("s", "d", False, "hash")],
        "schema_id string, field string, sensitive boolean, masking_strategy string")
    found = {r.field: (r.strategy, r.fell_back) for r in masking.resolve_strategies(rows).collect()}
    assert found == {"a": ("redact", False), "b": ("tokenize", False), "c": ("redact", True)}


def test_tokens_are_shared_between_fields_and_partitions(spark):
    df = spark.createDataFrame([(str(i % 10), str(i % 7)) for i in range(200)], "a string, b string")
    rules = {c: {"sensitive": True, "masking_strategy": "tokenize"} for c in df.columns}
    once = {tuple(r) for r in masking.mask_table(df, rules).collect()}
    again = {tuple(r) for r in masking.mask_table(df.repartition(7), rules).collect()}
    assert once == again
    assert masking.token_count(df, ["a", "b"]).first()[0] == 10
    assert masking.token_count(df, ["a", "b"], approximate=True).first()[0] == 10


def test_rotation_changes_every_token(spark):
    vault = spark.createDataFrame([("token_x", "v1"), ("token_y", "v2")], "token_id string, value string")
    rows = masking.rotate_tokens(vault, "2").collect()
    assert all(r.new_token != r.old_token and r.new_token.startswith("token_") for r in rows)
    assert len({r.new_token for r in rows}) == 2


def test_unknown_strategy_is_refused(spark):
    with pytest.raises(ValueError):
        masked_value(spark, "x", T.StringType(), "rot13")


def test_token_sketches_unite(spark):
    """Batches and columns are counted from their sketches alone; blanks hold no token."""
    rows = [(str(i % 900), str(i % 50) if i % 3 else None, i) for i in range(3000)] + [("", "null", 1), ("NULL", "", 2)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    parts = [masking.token_sketches(df.where(f"n % 3 <= {k}"), ["a", "b"], F.lit(k)) for k in range(3)]
    held = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert held.count() == 6
    for by, exact in ((["a"], "a"), (["b"], "b")):
        estimate = {r.column_name: r.token_count for r in masking.sketched_token_count(held, ["column_name"]).collect()}[exact]
        want = masking.token_count(df, by).first().token_count
        assert abs(estimate - want) <= masking.SKETCH_ERROR * want
    want = masking.token_count(df, ["a", "b"]).first().token_count
    assert abs(masking.sketched_token_count(held).first().token_count - want) <= masking.SKETCH_ERROR * want
    assert masking.token_sketches(df.limit(0), ["a"], F.lit(0)).count() == 0

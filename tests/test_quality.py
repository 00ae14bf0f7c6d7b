from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from wardenry.operators import conformance, quality, registry

USER_RULES = {"id": {"type": "string", "required": True}, "email": {"type": "string", "required": True}, "age": {"type": "int"}}


def test_rolling_gate_over_batches_of_a_stream(spark, tmp_path):
    """Failures of three batches fall into one window, which no batch alone would show."""
    schema = "ts timestamp, tenant_id string, id string"
    start = datetime(2024, 1, 1)
    batches = [[(0, "a"), (10, None)], [(20, None), (25, "b")], [(40, None), (70, "c"), (80, "d"), (200, "e")]]
    rows = []
    for batch in batches:
        part = [(start + timedelta(minutes=m), "t", v) for m, v in batch]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file:{tmp_path}/in")
    rules = {"id": {"required": True}}
    gate = lambda df: quality.rolling(quality.with_errors(df, rules), "ts", "60 minutes", "30 minutes", 0.5, ["tenant_id"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file:{tmp_path}/in")
    gate(stream).writeStream.format("parquet").option("checkpointLocation", f"file:{tmp_path}/ck").trigger(availableNow=True).start(f"file:{tmp_path}/out").awaitTermination()
    told = lambda df: sorted((r.window_end, r.passed_records, r.failed_records, r.circuit_breaker_triggered) for r in df.collect())
    whole = gate(spark.createDataFrame(rows, schema))
    streamed = spark.read.parquet(f"file:{tmp_path}/out")
    assert told(streamed) == [w for w in told(whole) if w[0] <= start + timedelta(minutes=190)]
    first = told(whole)[1]
    assert first == (start + timedelta(minutes=60), 2, 3, True)
    spans = quality.closed_spans(whole, ["tenant_id"]).collect()
    assert [(r.closed_at - start, r.reopened_at - start) for r in spans] == [(timedelta(minutes=60), timedelta(minutes=90))]
    with pytest.raises(ValueError):
        quality.rolling(quality.with_errors(stream, rules), "ts", "1 hour", "1 hour", watermark=None)


def records(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "key int, record string")


def errors(spark, *texts, rules=USER_RULES):
    checked = quality.with_errors(records(spark, *texts), rules, record="record")
    return sorted(tuple(r) for r in quality.error_table(checked, ["key"]).collect())


def test_absent_and_null_differ(spark):
    found = errors(spark, '{"id":"1","email":"e"}', '{"id":"1","email":null}', '{"id":"1"}', '{"id":null}')
    assert found == sorted([
        (1, "email", "null_value", "Required field is null: email"),
        (2, "email", "missing_field", "Required field missing: email"),
        (3, "email", "missing_field", "Required field missing: email"),
        (3, "id", "null_value", "Required field is null: id"),
    ])


@pytest.mark.parametrize("text, kind", [
    ("[1]", "list"), ('"x"', "str"), ("12", "int"), ("1.5", "float"), ("true", "bool"), ("null", "NoneType"), ("not json", "str"), (None, "NoneType"),
])
def test_not_an_object_is_one_structural_error(spark, text, kind):
    assert errors(spark, text) == [(0, None, "structural", f"Record must be dict, got {kind}")]


def test_empty_text_and_odd_field_names(spark):
    rules = {"a.b": {"required": True}, "it's": {"required": True}, "": {"required": True}}
    found = errors(spark, '{"a.b":1,"it\'s":2,"":3}', '{"a":{"b":1}}', rules=rules)
    assert [f[0] for f in found] == [1, 1, 1]


def test_rules_that_are_not_maps_are_optional(spark):
    assert errors(spark, "{}", rules={"id": "string", "name": "string"}) == []
    assert errors(spark, "{}", rules={}) == []


def test_tabular_form(spark):
    df = spark.createDataFrame([("1", None), ("2", "e")], "id string, email string")
    checked = quality.with_errors(df, {**USER_RULES, "phone": {"required": True}})
    found = sorted(tuple(r) for r in quality.error_table(checked, ["id"]).collect())
    assert [(f[0], f[1], f[2]) for f in found] == [
        ("1", "email", "null_value"), ("1", "phone", "missing_field"), ("2", "phone", "missing_field")]


@pytest.mark.parametrize("valid, invalid, threshold, score, tripped", [
    (19, 1, 0.95, 0.95, False), (80, 20, 0.95, 0.8, True), (3, 0, 0.95, 1.0, False), (2, 2, 0.5, 0.5, False), (0, 3, 0.0, 0.0, False),
    (0, 0, 0.95, 0.0, True), (0, 0, 0.0, 0.0, False),
])
def test_gate(spark, valid, invalid, threshold, score, tripped):
    texts = ['{"id":"1","email":"e"}'] * valid + ['{"id":"1"}'] * invalid
    rows = records(spark, *texts) if texts else spark.createDataFrame([], "key int, record string")
    row = quality.summarise(quality.with_errors(rows, USER_RULES, record="record"), threshold).first()
    assert tuple(row) == (valid, invalid, score, tripped)


@pytest.mark.parametrize("threshold", [-0.1, 1.1, "0.5", True, None])
def test_threshold_must_be_a_share(spark, threshold):
    with pytest.raises(ValueError):
        quality.summarise(quality.with_errors(records(spark, "{}"), USER_RULES, record="record"), threshold)


def test_tenants_are_gated_apart(spark):
    df = spark.createDataFrame([("tenant1", '{"id":"1","email":"e"}'), ("tenant2", '{"id":"1"}')], "tenant_id string, record string")
    out = {r.tenant_id: (r.quality_score, r.circuit_breaker_triggered)
           for r in quality.summarise(quality.with_errors(df, USER_RULES, record="record"), by=["tenant_id"]).collect()}
    assert out == {"tenant1": (1.0, False), "tenant2": (0.0, True)}


def test_presence_ignores_nulls_and_required_flags(spark):
    checked = registry.check_presence(records(spark, '{"id":null,"email":1,"age":2}', '{"id":1}', "[1]"), list(USER_RULES))
    rows = {r.key: (r.valid, r.missing_fields) for r in checked.collect()}
    assert rows == {0: (True, []), 1: (False, ["email", "age"]), 2: (False, None)}
    valid, rejected = registry.split_valid(checked)
    assert (valid.count(), rejected.count()) == (1, 2)


def test_last_registration_wins(spark):
    rows = registry.schema_rows("s", "s", "2", {"a": {}, "b": {"min": 1}}, datetime(2024, 1, 1))
    rows += registry.schema_rows("s", "s", "1", {"c": {}}, datetime(2024, 2, 1))
    schemas = registry.schema_table(spark, rows)
    assert [r.field for r in registry.latest_schemas(schemas).collect()] == ["c"]
    assert schemas.where("field = 'b'").first().extra == {"min": "1"}
    checked = registry.check_presence_by_schema(
        spark.createDataFrame([("s", '{"c":1}'), ("s", '{"a":1}'), ("t", "{}"), ("s", "3")], "schema_id string, record string"), schemas)
    assert sorted(r.problem or "" for r in checked.collect()) == ["", "Expected dict", "Missing required fields: c", "Schema not found: t"]


def test_quality_run_conformance(spark):
    runs = spark.createDataFrame([("b", 1, 1, 0.5), ("", -1, 1, 1.5), (None, 1, None, float("nan"))],
                                 "batch_id string, passed_records long, failed_records long, quality_score double")
    found = sorted(r.rule for r in conformance.quality_run_violations(runs).collect())
    assert found == ["batch_id_empty"] * 2 + ["failed_records_negative", "passed_records_negative"] + ["quality_score_out_of_range"] * 2

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardenry import schemas as S
from wardenry.operators import conformance, erasure

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [
        ("r1", "u1", "t1", "GDPR", ["email"], T0, "PENDING", None, None), ("r2", "u1", "t1", "GDPR", ["ssn"], T0, "PENDING", None, None),
        ("r3", "u2", "t2", "GDPR", ["email", "ssn"], T0, "COMPLETE", None, None),
    ]
    return spark.createDataFrame(rows, S.ERASURE_REQUESTS).cache()


def test_intake_splits_valid_and_rejected(spark):
    rows = [("u1", "t1", "GDPR", ["email"]), ("", "t1", "GDPR", ["email"]), ("u", "t", None, []), ("u", "t", "r", ["a", ""])]
    submitted = spark.createDataFrame(rows, "user_id string, tenant_id string, reason string, fields_to_delete array<string>")
    accepted, rejected = erasure.intake(submitted, T0)
    row = accepted.first()
    assert accepted.count() == 1 and row.status == "PENDING" and row.request_id
    assert sorted(tuple(r.broken_rules) for r in rejected.collect()) == [
        ("field_name_empty",), ("reason_empty", "fields_empty"), ("user_id_empty",)]
    assert conformance.request_violations(accepted).count() == 0
    assert erasure.submission_events(accepted).first().action == "ERASURE_REQUEST_SUBMITTED"


def test_state_machine(spark):
    log = [("a", "PENDING", T0), ("b", "PENDING", T0), ("b", "IN_PROGRESS", T0 + timedelta(1)), ("c", "PENDING", T0),
           ("c", "IN_PROGRESS", T0), ("c", "COMPLETE", T0)]
    states = spark.createDataFrame([(*r, None) for r in log], S.ERASURE_STATES)
    assert {r.request_id: r.status for r in erasure.current_states(states).collect()} == {"a": "PENDING", "b": "IN_PROGRESS", "c": "COMPLETE"}
    proposed = spark.createDataFrame([("a", "IN_PROGRESS"), ("a", "COMPLETE"), ("b", "FAILED"), ("c", "IN_PROGRESS"), ("z", "IN_PROGRESS")], "request_id string, status string")
    found = {(r.request_id, r.status): r.problem for r in erasure.judge_transitions(states, proposed).collect()}
    assert found == {("a", "IN_PROGRESS"): None, ("a", "COMPLETE"): "transition_not_allowed", ("b", "FAILED"): None,
                     ("c", "IN_PROGRESS"): "transition_not_allowed", ("z", "IN_PROGRESS"): "unknown_request"}
    asked = spark.createDataFrame([("a",), ("b",)], "request_id string")
    assert {r.request_id: r.problem for r in erasure.executable(states, asked).collect()} == {"a": None, "b": "transition_not_allowed"}


def test_outcome_and_events(requests):
    done = erasure.outcome(requests.where("request_id <> 'r3'"), F.when(F.col("request_id") == "r2", 3).otherwise(0))
    rows = {r.request_id: (r.status, r.error_message) for r in done.collect()}
    assert rows == {"r1": ("COMPLETE", None), "r2": ("FAILED", "Failed to delete 3 tokens")}
    events = erasure.execution_events(done, T0)
    assert events.groupBy("action").count().count() == 3
    assert conformance.audit_violations(events).count() == 0


def test_filters(requests):
    assert erasure.by_status(requests, "PENDING").count() == 2
    assert erasure.by_tenant(requests, "t2").first().request_id == "r3"
    assert erasure.by_id(requests, "nope").count() == 0
    assert erasure.count(requests).first()[0] == 3


def test_tokens_by_owner_or_all(spark, requests):
    rows = [("k1", "v", None, None, "t1", "u1", "email"), ("k2", "v", None, None, "t1", "u1", "card"), ("k3", "v", None, None, "t2", "u1", "email"),
            ("k4", "v", None, None, "t2", "u2", "ssn")]
    vault = spark.createDataFrame(rows, S.VAULT)
    assert sorted(r.token_id for r in erasure.doomed_tokens(vault, requests).collect()) == ["k1", "k4"]
    assert sorted(r.token_id for r in erasure.erase_tokens(vault, requests).collect()) == ["k2", "k3"]
    assert erasure.erase_tokens(vault, requests, "all").count() == 0
    none = requests.where("request_id = ''")
    assert erasure.erase_tokens(vault, none, "all").count() == 4 and erasure.doomed_tokens(vault, none, "all").count() == 0
    with pytest.raises(ValueError):
        erasure.erase_tokens(vault, requests, "some")


def test_field_erasure_combines_requests_and_keeps_rows(spark, requests):
    rows = [("t1", "u1", "e", "s", 1)] * 50 + [("t2", "u1", "e", "s", 2), ("t2", "u2", "e", "s", 3), (None, None, "e", "s", 4)]
    data = spark.createDataFrame(rows, "tenant_id string, user_id string, email string, ssn string, n int")
    out = erasure.erase_fields(data, requests, ["email", "ssn"])
    assert out.columns == data.columns and out.count() == 53
    assert {(r.n, r.email, r.ssn) for r in out.collect()} == {(1, None, None), (2, "e", "s"), (3, None, None), (4, "e", "s")}


def test_record_erasure(spark):
    data = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, v string")
    asked = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    assert sorted(r.v for r in erasure.erase_records(data, asked, "id").collect()) == ["c", "d"]
    assert {r.id: r.erased_rows for r in erasure.record_outcomes(data, asked, "id").collect()} == {1: 2, 9: 0}

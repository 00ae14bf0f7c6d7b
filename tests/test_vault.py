from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardenry import schemas as S
from wardenry.operators import vault

NOW = datetime(2024, 1, 1)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], S.VAULT)


def values(spark, *items):
    return spark.createDataFrame([(v,) for v in items], "value string")


def test_store_is_idempotent_and_skips_blank_values(spark, empty):
    fresh = vault.new_tokens(values(spark, "a", "a", "b", "", None), empty, NOW).cache()
    assert sorted(r.value for r in fresh.collect()) == ["a", "b"]
    assert all(len(r.token_id) == 22 and r.expires_at is None for r in fresh.collect())
    again = vault.new_tokens(values(spark, "a", "c"), fresh, NOW)
    assert [r.value for r in again.collect()] == ["c"]


@pytest.mark.parametrize("ttl", [0, 1, 3600])
def test_ttl_sets_the_expiry(spark, empty, ttl):
    row = vault.new_tokens(values(spark, "a"), empty, NOW, ttl_seconds=ttl).first()
    assert row.expires_at == NOW + timedelta(seconds=ttl)


def test_negative_ttl_is_refused(spark, empty):
    with pytest.raises(ValueError):
        vault.new_tokens(values(spark, "a"), empty, NOW, ttl_seconds=-1)


def test_round_trip_and_errors(spark, empty):
    held = vault.new_tokens(values(spark, "a", "b"), empty, NOW, ttl_seconds=10)
    tokens = {r.value: r.token_id for r in held.collect()}
    refs = spark.createDataFrame([(1, tokens["a"]), (2, "token_none"), (3, tokens["b"]), (4, tokens["a"])], "i int, token_id string")
    at_limit = {r.i: (r.value, r.vault_error) for r in vault.detokenise(refs, held, NOW + timedelta(seconds=10)).collect()}
    assert at_limit == {1: ("a", None), 2: (None, "unknown"), 3: ("b", None), 4: ("a", None)}
    after = {r.i: (r.value, r.vault_error) for r in vault.detokenise(refs, held, NOW + timedelta(seconds=11)).collect()}
    assert after[1] == (None, "expired") and after[2] == (None, "unknown")


def test_shared_token_is_found_once_per_reference(spark, empty):
    owners = spark.createDataFrame([("v", "t1", "u1"), ("v", "t2", "u2")], "value string, tenant_id string, user_id string")
    held = vault.new_tokens(owners, empty, NOW, owner=("tenant_id", "user_id"))
    assert held.count() == 2
    refs = held.select("token_id").distinct()
    assert vault.detokenise(refs, held, NOW).count() == 1


def test_delete_list_and_purge(spark, empty):
    held = vault.new_tokens(values(spark, "a", "b"), empty, NOW, ttl_seconds=0).cache()
    token = held.where("value = 'a'").select("token_id")
    assert [r.value for r in vault.delete_tokens(held, token).collect()] == ["b"]
    asked = token.unionByName(spark.createDataFrame([("token_none",)], "token_id string"))
    assert {r.deleted for r in vault.deletion_flags(held, asked).collect()} == {True, False}
    later = NOW + timedelta(days=1)
    assert vault.count_tokens(held).first()[0] == 2
    assert vault.list_tokens(held).count() == 2
    assert vault.purge_expired(held, later).count() == 0
    assert vault.token_metadata(held).columns == ["token_id", "created_at", "expires_at"]


def test_collisions_are_found(spark):
    held = spark.createDataFrame([("token_1", "a"), ("token_1", "b"), ("token_2", "c"), ("token_2", "c")], "token_id string, value string")
    assert [r.token_id for r in vault.collisions(held).collect()] == ["token_1"]
    with pytest.raises(vault.TokenCollision):
        vault.require_no_collisions(held, held.limit(0))
    one = held.where("token_id = 'token_2'")
    vault.require_no_collisions(one, one)
    with pytest.raises(vault.TokenCollision):
        vault.require_no_collisions(one.withColumn("value", F.lit("another")), one)

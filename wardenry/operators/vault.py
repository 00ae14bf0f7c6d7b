"""Token vault as a table (VLT-1..6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.functions.masking import token_text
from wardenry.operators.joins import lookup_join
from wardenry.schemas import moment, typed_literal


class TokenCollision(ValueError):
    """Two values share one token."""


def new_tokens(values: DataFrame, vault: DataFrame, created_at: object, ttl_seconds: int | None = None,
               column: str = "value", owner: tuple[str, ...] = ()) -> DataFrame:
    """Vault rows to append for values that have no token yet.

    Values are reduced to distinct ones before anything is joined, so a hot value costs one row. ``owner`` names
    columns to keep with the token (tenant_id, user_id, field); then a token has one row per owner.
    """
    if ttl_seconds is not None and ttl_seconds < 0:
        raise ValueError("ttl_seconds must not be negative")
    keys = ["token_id", "value", *owner]
    created = moment(created_at).cast("timestamp")
    expires = created + F.make_dt_interval(secs=F.lit(ttl_seconds)) if ttl_seconds is not None else F.lit(None).cast("timestamp")
    distinct = (
        values.where(F.col(column).isNotNull() & (F.col(column) != ""))
        .select(F.col(column).cast("string").alias("value"), *owner)
        .distinct()
        .withColumn("token_id", token_text(F.col("value")))
    )
    # Value and token both count: a new value with a token that is held for another must stay, to be found as a collision.
    known = vault.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys]
    return distinct.join(known, same, "left_anti").select(
        "token_id", "value", created.alias("created_at"), expires.alias("expires_at"), *owner
    )


def collisions(vault: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value. Must be empty before a vault is published."""
    # min and max tell whether a second value exists, with a state of two values whatever the group size.
    return (
        vault.groupBy("token_id")
        .agg(F.min("value").alias("first_value"), F.max("value").alias("last_value"))
        .where("first_value <> last_value")
    )


def require_no_collisions(fresh: DataFrame, held: DataFrame) -> None:
    """Only new tokens can collide: with each other, or with a held token of another value."""
    taken = held.select(F.col("token_id").alias("_token"), F.col("value").alias("_held"))
    other = (F.col("token_id") == F.col("_token")) & (F.col("value") != F.col("_held"))
    clash = collisions(fresh).select("token_id").unionByName(fresh.join(taken, other, "left_semi").select("token_id")).head()
    if clash is not None:
        raise TokenCollision(f"token {clash.token_id} stands for more than one value")


def unexpired(vault: DataFrame, as_of: object) -> Column:
    """A token expires strictly after ``expires_at``."""
    return F.col("expires_at").isNull() | (F.col("expires_at") >= typed_literal(vault, "expires_at", as_of))


def detokenise(refs: DataFrame, vault: DataFrame, as_of: object, token: str = "token_id", owner: tuple[str, ...] = ()) -> DataFrame:
    """Value of every referenced token, with ``vault_error`` unknown or expired where there is none.

    With ``owner`` columns a token resolves only for references of an owner that still holds it.
    """
    lookup = vault.select(
        F.col("token_id").alias(token), *owner, F.col("value").alias("_value"), unexpired(vault, as_of).alias("_live")
    ).groupBy(token, *owner).agg(F.max("_value").alias("_value"), F.max("_live").alias("_live"))
    return lookup_join(refs, lookup, [token, *owner]).withColumn("value", F.when(F.col("_live"), F.col("_value"))).withColumn(
        "vault_error", F.when(F.col("_live").isNull(), "unknown").when(~F.col("_live"), "expired")
    ).drop("_value", "_live")


def delete_tokens(vault: DataFrame, doomed: DataFrame, keys: tuple[str, ...] = ("token_id",)) -> DataFrame:
    """The vault without the given tokens."""
    return lookup_join(vault, doomed.select(*keys).distinct(), list(keys), "left_anti")


def deletion_flags(vault: DataFrame, doomed: DataFrame) -> DataFrame:
    """Per requested token, whether the vault held it."""
    asked = doomed.select("token_id").distinct()
    held = vault.select("token_id", F.lit(True).alias("deleted")).distinct()
    return asked.join(held, "token_id", "left").select("token_id", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def list_tokens(vault: DataFrame) -> DataFrame:
    """All tokens, expired ones included until they are purged."""
    return vault.select("token_id")


def count_tokens(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count("*").alias("token_count"))


def token_metadata(vault: DataFrame) -> DataFrame:
    return vault.select("token_id", "created_at", "expires_at")


def purge_expired(vault: DataFrame, as_of: object) -> DataFrame:
    return vault.where(unexpired(vault, as_of))

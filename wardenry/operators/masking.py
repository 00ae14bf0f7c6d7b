"""Table masking driven by schema rules (MSK-1..9)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenry.functions import masking as mk


def field_strategy(rule: object) -> str | None:
    """Strategy of one field rule, or None when the field is not sensitive."""
    if not isinstance(rule, Mapping) or not rule.get("sensitive", False):
        return None
    declared = str(rule.get("masking_strategy") or mk.DEFAULT_STRATEGY).lower()
    return declared if declared in mk.STRATEGIES else mk.DEFAULT_STRATEGY


def mask_table(df: DataFrame, rules: Mapping[str, object], epoch: str = "") -> DataFrame:
    """Mask the sensitive columns in one projection; other columns and the column order are kept."""
    projected = []
    for column in df.schema.fields:
        rule = rules.get(column.name)
        strategy = field_strategy(rule)
        value = F.col(f"`{column.name}`")
        if strategy is None:
            projected.append(value)
        else:
            projected.append(
                mk.mask_value(
                    value, column.dataType, strategy, column.name, rule.get("include_in_hash", True), epoch
                ).alias(column.name)
            )
    return df.select(*projected)


def resolve_strategies(schemas: DataFrame) -> DataFrame:
    """Schema rows with the strategy in force, and a flag where an unknown one fell back to redact."""
    declared = F.col("masking_strategy")
    return schemas.where("sensitive").select(
        "schema_id", "field", "masking_strategy",
        mk.resolved_strategy(declared).alias("strategy"),
        (declared.isNotNull() & ~F.lower(declared).isin(*mk.STRATEGIES)).alias("fell_back"),
    )


def tokenised_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct texts of the given columns that would receive a token."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [
        F.when(~mk.is_blank(F.col(c), kinds[c]), mk.canonical_text(F.col(c), kinds[c])) for c in columns
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*texts))).alias("value"))
        .distinct()
    )


def token_count(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Number of distinct tokens issued for the columns taken together."""
    if not approximate:
        return tokenised_values(df, columns).agg(F.count("*").alias("token_count"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [F.when(~mk.is_blank(F.col(c), kinds[c]), mk.canonical_text(F.col(c), kinds[c])) for c in columns]
    return df.select(F.explode(F.array_compact(F.array(*texts))).alias("value")).agg(
        F.approx_count_distinct("value").alias("token_count")
    )


# Size of the distinct-count sketches (2 to this power registers), and the relative error that they stay within (three standard errors).
SKETCH_BITS, SKETCH_ERROR = 14, 0.025


def token_sketches(df: DataFrame, columns: list[str], batch: Column) -> DataFrame:
    """Mergeable sketches ``(batch, column_name, sketch)`` of the values that tokens are issued for, to be appended to a table of sketches.

    Sketches of batches and columns unite without their rows: ``sketched_token_count`` never reads old rows again.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    of = lambda c: F.when(~mk.is_blank(F.col(c), kinds[c]), mk.canonical_text(F.col(c), kinds[c]))
    made = df.groupBy(batch.alias("batch")).agg(*[F.hll_sketch_agg(of(c), SKETCH_BITS).alias(f"s{i}") for i, c in enumerate(columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]))
    return made.select("batch", each.alias("s")).select("batch", "s.column_name", "s.sketch").where(F.col("sketch").isNotNull())


def sketched_token_count(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct tokens over all batches, within SKETCH_ERROR; ``by`` columns (``column_name``, ``batch``) are counted apart."""
    count = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("token_count")
    return sketches.groupBy(*by).agg(count) if by else sketches.agg(count)


def rotate_tokens(vault: DataFrame, new_epoch: str) -> DataFrame:
    """Old and new token of every vault value."""
    return vault.select(
        F.col("token_id").alias("old_token"), mk.token_text(F.col("value"), new_epoch).alias("new_token"), "value"
    )

"""Record-check expressions over raw JSON text or typed columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_TYPE = "array<struct<field:string,error_type:string,message:string>>"


def required_fields(rules: Mapping[str, object]) -> list[str]:
    """Fields a record must carry. A rule that is not a mapping makes its field optional."""
    return [name for name, rule in rules.items() if isinstance(rule, Mapping) and rule.get("required", False)]


def parse_record(record: Column) -> Column:
    """Top-level keys and value texts of a JSON object; a null value stays a key. NULL when the text is not an object.

    Checks and fields all read this one map, so that a record is parsed once whatever the number of its fields.
    """
    return F.from_json(record, "map<string,string>")


def field_value(parsed: Column, name: str | Column) -> Column:
    """Value text of a key; of a repeated key the last value, as JSON parsers keep it. NULL when absent or null."""
    place = F.nullif(F.array_position(F.reverse(F.map_keys(parsed)), name), F.lit(0))
    return F.try_element_at(F.map_values(parsed), (-place).cast("int"))


def typed_text(record: Column, parsed: Column, name: str) -> Column:
    """Value text of a key as typed columns have it: booleans are ``True`` and ``False``, the strings ``true`` and ``false`` stay.

    Only records with one of these texts in this field are parsed a second time, for the type of the value.
    """
    text = field_value(parsed, name)
    kind = F.schema_of_variant(field_value(F.from_json(record, "map<string,variant>"), name))
    return F.when(text.isin("true", "false"), F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)).otherwise(text)


def other_values(parsed: Column, names: Iterable[str]) -> Column:
    """Keys of a record beyond ``names`` with their value texts, of a repeated key the last; NULL when there are none."""
    others = F.array_distinct(F.array_except(F.map_keys(parsed), F.array(*map(F.lit, names)).cast("array<string>")))
    return F.when(F.size(others) > 0, F.map_from_arrays(others, F.transform(others, lambda key: field_value(parsed, key))))


def record_kind(record: Column) -> Column:
    """Name of what a record text holds when it is not an object."""
    text = F.ltrim(record)
    return (
        F.when(record.isNull() | (text == "null"), "NoneType")
        .when(text.startswith("["), "list")
        .when(text.isin("true", "false"), "bool")
        .when(text.rlike(r"^-?\d+\s*$"), "int")
        .when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), "float")
        .otherwise("str")
    )


def _error(field: str | None, kind: str, message: Column) -> Column:
    return F.struct(F.lit(field).cast("string").alias("field"), F.lit(kind).alias("error_type"), message.alias("message"))


def _field_errors(states: Iterable[tuple[str, Column, Column]]) -> Column:
    found = [
        F.when(absent, _error(field, "missing_field", F.lit(f"Required field missing: {field}")))
        .when(null, _error(field, "null_value", F.lit(f"Required field is null: {field}")))
        for field, absent, null in states
    ]
    if not found:
        return F.array().cast(ERROR_TYPE)
    return F.array_compact(F.array(*found)).cast(ERROR_TYPE)


def record_errors(parsed: Column, record: Column, fields: list[str]) -> Column:
    """All errors of one record. A key that is absent and a key that is null are different errors."""
    per_field = _field_errors(
        (f, ~F.map_contains_key(parsed, f), field_value(parsed, f).isNull()) for f in fields
    )
    structural = F.array(
        _error(None, "structural", F.concat(F.lit("Record must be dict, got "), record_kind(record)))
    ).cast(ERROR_TYPE)
    return F.when(parsed.isNull(), structural).otherwise(per_field)


def column_errors(columns: list[str], fields: list[str]) -> Column:
    """Tabular form: a field without a column is missing in every row, a NULL is a null value."""
    return _field_errors(
        (f, F.lit(f not in columns), F.col(f"`{f}`").isNull() if f in columns else F.lit(False)) for f in fields
    )


def missing_keys(parsed: Column, fields: Column) -> Column:
    """Schema fields that are not keys of the record; NULL when the record is not an object."""
    return F.array_except(fields, F.map_keys(parsed))

"""Resource patterns: exact names, shell globs and ``regex:`` expressions, evaluated on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGEX_PREFIX = "regex:"
# One bracket class, or any single character.
_GLOB_PARTS = r"(?s)\[!?\]?[^\]]*\]|."
_META = r"([\\.^$|(){}+*?\[\]\-&~#])"


def _glob_part(part: Column) -> Column:
    inner = F.regexp_replace(F.substr(part, F.lit(2)), r"\]$", "")
    negated = inner.startswith("!")
    members = F.when(negated, F.substr(inner, F.lit(2))).otherwise(inner)
    # Inside a Java class these would be set operators or nested classes.
    members = F.regexp_replace(members, r"([\\\[\]&^])", r"\\$1")
    return (
        F.when(part == "*", ".*")
        .when(part == "?", ".")
        .when(part.startswith("[") & (F.length(part) > 1), F.concat(F.when(negated, "[^").otherwise("["), members, F.lit("]")))
        .otherwise(F.regexp_replace(part, _META, r"\\$1"))
    )


def glob_regex(pattern: Column) -> Column:
    """Regular expression of a shell glob. ``*`` crosses ``/``; the whole text must match."""
    parts = F.transform(F.regexp_extract_all(pattern, F.lit(_GLOB_PARTS), F.lit(0)), _glob_part)
    return F.concat(F.lit(r"(?s)\A"), F.array_join(parts, ""), F.lit(r"\z"))


def matches(resource: Column, pattern: Column) -> Column:
    """Equal, or matched by the glob, or matched from the start by the expression after ``regex:``."""
    anchored = F.concat(F.lit(r"\A(?:"), F.substr(pattern, F.lit(len(REGEX_PREFIX) + 1)), F.lit(")"))
    return (
        (pattern == resource)
        | F.when(pattern.rlike(r"[*?\[]"), F.call_function("rlike", resource, glob_regex(pattern))).otherwise(False)
        | F.when(pattern.startswith(REGEX_PREFIX), F.call_function("rlike", resource, anchored)).otherwise(False)
    )


def tenant_id_denial(tenant_id: Column) -> Column:
    """Why a tenant id is refused, first reason first; NULL when it is valid."""
    text = tenant_id.cast("string")
    return (
        F.when(text.isNull() | (text == ""), "empty_tenant_id")
        .when(F.length(text) > 255, "tenant_id_too_long")
        .when(
            text.contains("/") | text.contains("\\") | text.contains("..") | text.contains("\0"),
            "invalid_characters",
        )
    )


def path_denial(path: Column, listing: bool = False) -> Column:
    """Why an object path is refused; an empty path is allowed only as a listing prefix."""
    empty = F.lit(False) if listing else (path == "")
    return (
        F.when(path.isNull(), "not_a_string")
        .when(empty, "empty_path")
        .when(path.contains(".."), "parent_reference")
        .when(path.startswith("/"), "absolute_path")
    )

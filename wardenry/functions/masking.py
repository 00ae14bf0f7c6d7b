"""Masking expressions: hash, tokenise, redact, and the guard that leaves blank values alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
REDACTED = "***REDACTED***"
TOKEN_PREFIX = "token_"
TOKEN_HEX_DIGITS = 16
STRATEGIES = ("hash", "tokenize", "redact")
DEFAULT_STRATEGY = "redact"


def _shortest(value: Column) -> Column:
    """Decimal text of a double in any notation. The JVM may print 17 or 18 digits where fewer read back as the value.

    Beyond 2**53 the last digit may still differ from the shortest text; cast such columns to DECIMAL or STRING first.
    """
    text = value.cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"^-?0\.0*|[-.]", "")
    sixteen, seventeen = F.format_string("%.15e", value), F.format_string("%.16e", value)
    return (
        F.when((F.length(digits) > 16) & (sixteen.cast("double") == value), sixteen)
        .when((F.length(digits) > 17) & (seventeen.cast("double") == value), seventeen)
        .otherwise(text)
    )


def _double_text(value: Column) -> Column:
    """Shortest round-trip text of a double: plain digits from 1e-4 up to 1e16, otherwise an exponent of two digits or more."""
    text = _shortest(value)
    mantissa = F.regexp_replace(F.regexp_replace(text, r"[eE].*$", ""), r"\.?0*$", "")
    power = F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).cast("int")
    scientific = F.concat(
        mantissa, F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"),
    )
    # Sixteen digits before the point and 22 after it hold every double in this range exactly as printed.
    plain = F.regexp_replace(text.cast("decimal(38,22)").cast("string"), r"(\.\d+?)0*$", "$1")
    size = F.abs(value)
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .when(~F.lower(text).contains("e"), text)
        .when((size >= 1e16) | (size < 1e-4), scientific)
        .otherwise(plain)
    )


def canonical_text(value: Column, kind: T.DataType) -> Column:
    """The one text a value is hashed or tokenised as, whatever its column type."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double_text(value.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        exact = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.when(exact.endswith(".000000"), whole).otherwise(exact)
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast("string")


def hash_text(text: Column, field: str = "", include_field: bool = True) -> Column:
    seed = F.concat(F.lit(f"{field}:"), text) if field and include_field else text
    return F.sha2(seed, 256)


def token_text(text: Column, epoch: str = "") -> Column:
    """Same text, same token, in every field and every task; a new ``epoch`` gives every text a new token."""
    seed = F.concat(F.lit(f"{epoch}:"), text) if epoch else text
    return F.concat(F.lit(TOKEN_PREFIX), F.substring(F.sha2(seed, 256), 1, TOKEN_HEX_DIGITS))


def is_blank(value: Column, kind: T.DataType) -> Column:
    """NULL, the empty string and the word null in any case are never masked."""
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "") | (F.lower(value) == "null")
    return value.isNull()


def mask_value(
    value: Column, kind: T.DataType, strategy: str, field: str = "",
    include_field: bool = True, epoch: str = "",
) -> Column:
    text = canonical_text(value, kind)
    if strategy == "hash":
        masked = hash_text(text, field, include_field)
    elif strategy == "tokenize":
        masked = token_text(text, epoch)
    elif strategy == "redact":
        masked = F.lit(REDACTED)
    else:
        raise ValueError(f"unknown masking strategy: {strategy}")
    kept = value if isinstance(kind, T.StringType) else F.lit(None).cast("string")
    return F.when(is_blank(value, kind), kept).otherwise(masked)


def resolved_strategy(raw: Column) -> Column:
    """Declared strategy in lower case; absent or unknown means redact."""
    lowered = F.lower(raw)
    return F.when(lowered.isin(*STRATEGIES), lowered).otherwise(F.lit(DEFAULT_STRATEGY))

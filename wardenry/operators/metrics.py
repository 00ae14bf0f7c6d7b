"""Metric queries and derived rates (MET-1..11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.operators.percentile import exact_percentiles
from wardenry.schemas import moment, typed_literal


class NoData(ValueError):
    """A rate was asked for over an empty window."""


def _hours(hours: int, least: int) -> int:
    if isinstance(hours, bool) or not isinstance(hours, int):
        raise TypeError("hours must be int")
    if hours < least:
        raise ValueError(f"hours must be at least {least}")
    return hours


def _strictly(result: DataFrame, strict: bool) -> DataFrame:
    if strict and result.isEmpty():
        raise NoData("no rows in the window")
    return result


def record(rows: DataFrame, name: str | Column, value: Column, labels: dict[str, Column] | None = None,
           ts: object | None = None) -> DataFrame:
    """Metric rows derived from ``rows``, one each."""
    at = F.current_timestamp() if ts is None else moment(ts).cast("timestamp")
    pairs = [part for key, label in (labels or {}).items() for part in (F.lit(key), label.cast("string"))]
    return rows.select(
        F.uuid().alias("metric_id"), (F.lit(name) if isinstance(name, str) else name).alias("name"),
        value.cast("double").alias("value"), at.alias("ts"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("labels"),
    )


def chronological(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("ts", "metric_id")


def by_name(metrics: DataFrame, name: str) -> DataFrame:
    return chronological(metrics.where(F.col("name") == name))


def by_label(metrics: DataFrame, key: str, value: str) -> DataFrame:
    """Metrics whose label ``key`` is ``value``; a metric without the label never matches."""
    return chronological(metrics.where(F.try_element_at("labels", F.lit(key)) == value))


def since(df: DataFrame, as_of: object, hours: int) -> DataFrame:
    """Trailing window: from ``as_of`` minus the hours on, included, with no upper end."""
    _hours(hours, 0)
    return df.where(F.col("ts") >= typed_literal(df, "ts", as_of) - F.make_dt_interval(hours=F.lit(hours)))


def trailing(metrics: DataFrame, name: str, as_of: object, hours: int = 1) -> DataFrame:
    return since(metrics.where(F.col("name") == name), as_of, hours)


def summary(metrics: DataFrame) -> DataFrame:
    """Per name: count, mean, min, max, p50, p99 and, from two values on, the sample deviation."""
    plain = metrics.groupBy("name").agg(
        F.count("value").alias("count"), F.round(F.avg("value"), 2).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.round(F.stddev_samp("value"), 2).alias("stdev"),
    )
    ranked = exact_percentiles(metrics, ["name"], "value", [0.50, 0.99])
    wide = ranked.groupBy(F.col("name").alias("_name")).agg(
        F.max(F.when(F.col("fraction") == 0.50, F.col("percentile"))).alias("p50"),
        F.max(F.when(F.col("fraction") == 0.99, F.col("percentile"))).alias("p99"),
    )
    # Null-safe, so that no NOT NULL filter lands in one branch of the percentile plan and parts its shared shuffle.
    return plain.join(wide, plain["name"].eqNullSafe(wide["_name"]), "left").drop("_name")


def throughput(metrics: DataFrame, as_of: object, hours: int = 1, strict: bool = False) -> DataFrame:
    """Per name, the sum of values in the window over the whole window's seconds."""
    seconds = float(_hours(hours, 1) * 3600)
    result = since(metrics, as_of, hours).groupBy("name").agg(
        F.round(F.sum("value") / F.lit(seconds), 2).alias("throughput")
    )
    return _strictly(result, strict)


def error_rate(audit: DataFrame, start: object, end: object, by: list[str] | None = None,
               strict: bool = False) -> DataFrame:
    """Failures as a percentage of the audit events between two moments, both included."""
    inside = audit.where(F.col("ts").between(typed_literal(audit, "ts", start), typed_literal(audit, "ts", end)))
    rate = F.round(F.count_if(F.col("status") == "FAILURE") / F.count("*") * 100, 2).alias("error_rate")
    counted = [rate, F.count("*").alias("event_count")]
    result = inside.groupBy(*by).agg(*counted) if by else inside.agg(*counted).where("event_count > 0")
    return _strictly(result, strict)


def latency_percentiles(metrics: DataFrame, percentiles: list[float], as_of: object, hours: int = 1,
                        strict: bool = False, approximate: bool = False) -> DataFrame:
    """Per name and percentile (0..100) the value by rank in the trailing window."""
    if any(not 0 <= p <= 100 for p in percentiles):
        raise ValueError("percentiles must be between 0 and 100")
    _hours(hours, 1)
    window = since(metrics, as_of, hours)
    if approximate:
        result = window.groupBy("name").agg(
            F.map_from_arrays(
                F.array(*[F.lit(float(p)) for p in percentiles]),
                F.percentile_approx("value", [p / 100 for p in percentiles], 10_000),
            ).alias("_by_percentile")
        ).select("name", F.explode("_by_percentile").alias("percentile", "latency"))
    else:
        by_fraction = exact_percentiles(window, ["name"], "value", [p / 100 for p in percentiles])
        wanted = F.coalesce(*[F.when(F.col("fraction") == p / 100, F.lit(float(p))) for p in percentiles])
        result = by_fraction.select("name", wanted.alias("_p"), F.col("percentile").alias("latency")).withColumnRenamed(
            "_p", "percentile"
        )
    return _strictly(result.withColumn("latency", F.round("latency", 2)), strict)


def count(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("metric_count"))

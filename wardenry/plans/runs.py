"""Job results, their run-history table and report (JOB-8)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenry import schemas as S


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class JobResult:
    job_type: str
    tenant_id: str
    status: str = "running"
    start_time: datetime = field(default_factory=utc_now)
    end_time: datetime | None = None
    records_processed: int = 0
    records_failed: int = 0
    error_message: str | None = None
    warnings: list[str] = field(default_factory=list)
    details: dict[str, str] = field(default_factory=dict)

    @property
    def elapsed_seconds(self) -> float:
        return ((self.end_time or utc_now()) - self.start_time).total_seconds()

    def finish(self, status: str) -> "JobResult":
        self.status, self.end_time = status, utc_now()
        return self

    def row(self, spark: SparkSession) -> DataFrame:
        values = (
            self.job_type, self.tenant_id, self.status, self.start_time, self.end_time, self.elapsed_seconds,
            self.records_processed, self.records_failed, self.error_message, self.warnings,
            {k: str(v) for k, v in self.details.items()},
        )
        return spark.createDataFrame([values], S.JOB_RUNS)


def history(job_runs: DataFrame) -> DataFrame:
    """Runs, mean elapsed seconds and processed records per job type, tenant and status."""
    return job_runs.groupBy("job_type", "tenant_id", "status").agg(
        F.count("*").alias("runs"), F.avg("elapsed_seconds").alias("avg_elapsed_seconds"),
        F.sum("records_processed").alias("records_processed"), F.sum("records_failed").alias("records_failed"),
    )

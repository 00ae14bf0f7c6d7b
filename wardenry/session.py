"""Session settings, the shared working folder, and size-checked broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# AQE splits a hot join key by map output, so a key that holds a third of the rows is read by many
# tasks. It needs no salt column, and a recomputed map task cannot move rows between salts.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# A rule or policy table with more rows or characters than this is joined by shuffle, never by broadcast.
BROADCAST_ROW_BOUND = 20_000
BROADCAST_TEXT_BOUND = 32_000_000


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "wardenry") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir():
        return context.getCheckpointDir().rsplit("/", 1)[0]
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="wardenry-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark)}/wardenry/{purpose}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """Hint a broadcast only after measuring that the side stays within ``bound`` rows and the text bound.

    Beyond either the side is returned as it is, and the join shuffles both sides.
    """
    length = F.length(F.to_json(F.struct(*df.columns)))
    rows, text = df.limit(bound + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    return F.broadcast(df) if rows <= bound and text <= BROADCAST_TEXT_BOUND else df


def observed(observation: Observation, name: str) -> int:
    """A count taken during a write; 0 when an empty input made Spark drop the counting from the plan."""
    try:
        return observation.get.get(name) or 0
    except Py4JJavaError as error:
        # A dropped observation ends as a row without a schema, which PySpark refuses to convert.
        if "AssertionError" in str(error.java_exception):
            return 0
        raise

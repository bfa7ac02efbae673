"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that matter for wide text rows on a cluster; all can be overridden.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Arrow batches towards the judge are bounded by bytes, not only by rows:
    # a document may be megabytes long.
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def get_session(app: str = "jurybox", **overrides: str) -> SparkSession:
    """Get or create a session; `overrides` use `_` for `.` in setting names."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in overrides.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """The shared folder the cluster names; `default` only where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or default
    if not found:
        raise ValueError("spark.checkpoint.dir is not set: name a folder all executors can reach")
    return found

"""The Spark session the engine expects: UTC, ANSI on, adaptive execution on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Checkpoints of results that nothing refers to any more are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Timestamps in nanoseconds come as whole numbers; readers.unify_temporal turns them into microseconds.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; the cluster's own settings decide sizes and parallelism."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()

"""Checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where a local session names none (tests, a laptop) a local folder is made and set.

    On a cluster that is an error, as executors could not see the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="opsloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint(df: DataFrame, *, batch_rows: int | None = None) -> DataFrame:
    """df, written where all executors reach it, with its lineage cut.

    batch_rows: rows that Python workers get at once meanwhile, for tables of large rows.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    if batch_rows is None:
        return df.checkpoint(eager=True)
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(batch_rows))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(BATCH_ROWS, before)

"""Tables that take a batch once.

A batch is written as a draft beside the table and committed by an exclusive rename to a name that query
and batch give it.  A retried batch, or a second writer of the same one, finds the name taken and adds
nothing.  Drafts have hidden names, so readers never see one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import storage


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Whether source was renamed; False if there is a target already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(b.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if b.toUri().getScheme() else fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Exception as e:
        if storage.exists(spark, target):
            return False
        raise e
    return True


def _target(folder: str, query: str, batch: int | str) -> str:
    """Named as a partition, so that other readers see the table too, with a column batch."""
    return f"{folder}/batch={query}-{f'{batch:012}' if isinstance(batch, int) else batch}"


def append_once(df: DataFrame, folder: str, query: str, batch: int | str) -> bool:
    """Adds the rows of df to the table at folder unless this batch of the query is in it; whether it did."""
    spark = df.sparkSession
    target = _target(folder, query, batch)
    if storage.exists(spark, target):
        return False
    draft = f"{folder}/.draft-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    if _rename(spark, draft, target):
        return True
    fs, p = storage.filesystem(spark, draft)
    fs.delete(p, True)
    return False


def read(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """All committed batches."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(folder)


def clear_drafts(spark: SparkSession, folder: str) -> int:
    """Removes what writers that died have left, once none is at work; returns how many."""
    fs, p = storage.filesystem(spark, folder)
    left = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(".draft-")]
    for d in left:
        fs.delete(d, True)
    return len(left)


def retrain(jobs: DataFrame, fit: Callable[[DataFrame, int], DataFrame], folder: str, query: str = "model", every: str | None = None):
    """Appends fit(batch, number), the model of each micro-batch as rows, to the table at folder/models, each batch once.

    A batch that is retried after its rows were committed is not fitted again.
    """
    from .flows import retrain as run

    def take(batch: DataFrame, number: int) -> None:
        if not storage.exists(batch.sparkSession, _target(f"{folder}/models", query, number)):
            append_once(fit(batch, number), f"{folder}/models", query, number)

    return run(jobs, take, f"{folder}/checkpoint", every)

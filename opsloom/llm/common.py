"""Shared plumbing of the training-data operators: inputs, shared scratch space, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words of the text contracts are runs of anything but ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and the executors, as the cluster names it.

    Only where a local session names none (tests, a laptop) is a local one made and set; on a cluster
    that is an error, as executors could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="opsloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/opsloom/{uuid.uuid4().hex}/{name}"


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path): works for any store that Spark itself can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the queries run inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: More ids than this meet the rows by shuffle instead of broadcast.
BROADCAST_IDS = 2_000_000


#: The columns of text_key.
TEXT_KEY = ["__text_a", "__text_b"]


def text_key(df: DataFrame, text: str = "text") -> DataFrame:
    """df with two independent hashes of its text, which name it where ids may be null or repeated.

    The seed of the second is hashed first: behind the text it would add nothing to the first hash.
    """
    return df.withColumn(TEXT_KEY[0], F.xxhash64(text)).withColumn(TEXT_KEY[1], F.xxhash64(F.lit(1), text))


def by_ids(df: DataFrame, ids: DataFrame, how: str, key: str | list[str] = "doc_id") -> DataFrame:
    """The rows of df with (left_semi) or without (left_anti) one of the ids, a written table of the key columns.

    A few ids are sent to all tasks, which saves the shuffle of whole texts; their count is checked.
    """
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def let(name: str, value: str, body: str) -> str:
    """SQL of body with name bound to value, which is evaluated once a row.

    Plain column references are no such binding: the optimiser may inline what they stand for into
    every lambda that mentions them.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def parts(batches: Iterator, rows: int = 500) -> Iterator:
    """Smaller batches, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run):
    """run, a function of batches, that gives the memory of its task back to the system when it ends.

    Python workers live on between tasks; what they keep is taken from the executor's other work.
    """

    def inner(batches):
        import ctypes

        import pyarrow

        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


class Stages:
    """Tables written between the steps of an operator.

    A written table cuts the lineage, so the loss of an executor costs at most the step that runs.
    ``keep`` holds what the lazy result still reads; ``drop`` frees what no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, name: str, df: DataFrame, *, batch_rows: int | None = None) -> DataFrame:
        """df as a written table.  batch_rows: rows that Python workers get at once, for tables of large rows.

        The shuffle files of the query go as soon as it has ended.
        """
        path = new_path(self.spark, name)
        with settings(self.spark, **{_FILE_CLEANUP: "true"} | ({_BATCH_ROWS: str(batch_rows)} if batch_rows else {})):
            df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        remove(self.spark, *(self.paths.pop(n) for n in names))

    @contextmanager
    def cleared_on_error(self):
        """All tables go if the steps inside fail: no result will read them."""
        try:
            yield self
        except BaseException:
            self.drop(*list(self.paths))
            raise

"""Small texts beside the tables that Spark writes, on any store that Spark reaches."""

from __future__ import annotations

import json
from datetime import UTC, date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme."""
    fs, p = filesystem(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def write_text(spark: SparkSession, path: str, text: str, *, overwrite: bool = False) -> str:
    fs, p = filesystem(spark, path)
    if not overwrite and fs.exists(p):
        raise FileExistsError(path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return path


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def jsonable(value):
    """Times as UTC with a Z, dates as ISO, decimals as numbers, sets and tuples as lists; deeply."""
    if isinstance(value, datetime):
        at = value if value.tzinfo else value.replace(tzinfo=UTC)
        return at.astimezone(UTC).isoformat().replace("+00:00", "Z")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [jsonable(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    return value


def write_json(spark: SparkSession, path: str, value, *, overwrite: bool = False) -> str:
    return write_text(spark, path, json.dumps(jsonable(value), indent=2) + "\n", overwrite=overwrite)


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def named_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """path and value (the whole text) of every file of that name below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")

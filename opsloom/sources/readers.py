"""Readers of raw job records."""

from __future__ import annotations

import re
import uuid
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..functions.transforms import ticks
from ..scratch import shared_dir
from ..storage import filesystem, is_folder, qualified
from . import archives

#: The columns of the Standard Workload Format.
SWF = [
    "job_number", "submit", "wait", "run_time", "allocated_processors", "average_cpu_time", "used_memory", "requested_processors", "requested_time",
    "requested_memory", "status", "user_id", "group_id", "executable", "queue", "partition", "preceding_job", "think_time",
]


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns missing in one are null, and types that differ become the wider, at last strings."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    order = ["tinyint", "smallint", "int", "bigint", "float", "double"]

    def wide(found: set[str]) -> str:
        if len(found) == 1:
            return next(iter(found))
        return max(found, key=order.index) if found <= set(order) else "string"

    out = None
    for f in frames:
        f = f.withColumns({n: F.col(f"`{n}`").cast(wide(kinds[n])) for n, k in f.dtypes if wide(kinds[n]) != k})
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Durations as seconds, nanoseconds as timestamps: Spark shows both as plain numbers, so each file's own schema tells them."""
    df = union([physical(spark, p) for p in paths])
    return df.select(*(f"`{c}`" for c in columns if c in df.columns)) if columns else df


def physical(spark: SparkSession, path: str) -> DataFrame:
    """The table at path with the columns of Arrow durations and of timestamps in nanoseconds as what they mean."""
    df = spark.read.parquet(path)
    longs = [n for n, k in df.dtypes if k == "bigint"]
    kinds = stored_kinds(spark, path) if longs else {}
    cols = {n: ticks(F.col(n), kinds[n][1]) for n in longs if kinds.get(n, ("",))[0] == "duration"}
    cols |= {n: F.timestamp_micros(F.floor(F.col(n) / 1000)) for n in longs if kinds.get(n) == ("timestamp", "ns")}
    return df.withColumns(cols) if cols else df


def stored_kinds(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """name -> (duration or timestamp, unit) of such columns of the first Parquet file at path, from its footer alone."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    fs, p = filesystem(spark, path)
    found = p
    if fs.getFileStatus(p).isDirectory():
        it = fs.listFiles(p, True)
        while it.hasNext():
            f = it.next().getPath()
            if f.getName().endswith(".parquet"):
                found = f
                break
        else:
            return {}
    size = fs.getFileStatus(found).getLen()
    stream = fs.open(found)
    try:
        stream.seek(max(0, size - 8))
        tail = bytes(stream.readNBytes(8))
        footer = int.from_bytes(tail[:4], "little") + 8
        stream.seek(max(0, size - footer))
        # A file of the magic number and the footer is all that the schema needs.
        schema = pq.read_schema(pa.BufferReader(b"PAR1" + bytes(stream.readNBytes(footer))))
    finally:
        stream.close()
    return {f.name: ("duration" if pa.types.is_duration(f.type) else "timestamp", f.type.unit) for f in schema if pa.types.is_duration(f.type) or pa.types.is_timestamp(f.type)}


def unify_temporal(df: DataFrame, nanos: tuple[str, ...] = ()) -> DataFrame:
    """Zoneless times as UTC timestamps; nanos: columns stored as whole nanoseconds."""
    cols = {n: F.col(f"`{n}`").cast("timestamp") for n, k in df.dtypes if k == "timestamp_ntz"} | {n: F.timestamp_micros(F.floor(F.col(n) / 1000)) for n in nanos}
    return df.withColumns(cols) if cols else df


def csv(spark: SparkSession, *paths: str, delimiter: str = ",", columns: list[str] | None = None, schema: str | None = None, plain: bool = False) -> DataFrame:
    """Files with the same header are read together, so jobs and the plan grow with the different headers, not with the files.

    A column has the type that its values in all files of a header fit.  plain: all paths are known to be files, not folders.
    """
    reader = spark.read.option("header", True).option("sep", delimiter)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = union([reader.csv(some) for some in _alike(spark, paths, plain, by_header=schema is None)])
    return df.select(*(f"`{c}`" for c in columns if c in df.columns)) if columns else df


def _alike(spark: SparkSession, paths: tuple[str, ...], plain: bool, by_header: bool) -> list[list[str]]:
    """The paths, files with the same first line together; folders and what has no line stay by themselves."""
    files = list(dict.fromkeys(p for p in paths if plain or not is_folder(spark, p))) if len(paths) > 1 else []
    heads: dict[str, str] = dict.fromkeys(files, "")
    if by_header and files:
        at = F.struct(F.monotonically_increasing_id().alias("nr"))
        lines = spark.read.text(files).where(F.col("value").rlike(r"[^\x00-\x20]") & (F.col("_metadata.file_block_start") == 0))
        found = lines.select("value", F.col("_metadata.file_path").alias("file"), at.alias("at")).groupBy("file").agg(F.min_by("value", "at").alias("head")).collect()  # a row a file
        # Spark tells the file's place encoded, and with one slash where there is no host.
        told = {re.sub("^([^:/]+):/+", r"\1:/", unquote(r.file)): r.head for r in found}
        place = lambda p: re.sub("^([^:/]+):/+", r"\1:/", p if "://" in p else qualified(spark, p))
        heads = {p: told[place(p)] for p in files if place(p) in told}
    groups: dict[tuple, list[str]] = {}
    for k, p in enumerate(paths):
        # A file that is named twice is read twice.
        groups.setdefault((True, heads.pop(p)) if p in heads else (False, k), []).append(p)
    return list(groups.values())


def json(spark: SparkSession, *paths: str, record_path: str | None = None) -> DataFrame:
    """Records below record_path with the scalars of their parents; nested values are dropped.

    A record's value wins where it has the key, even as null; elsewhere its parent's stands.  Without a
    path the top-level objects are the records.  Types are those that all values of a key fit, at last strings.
    """
    reader = spark.read.option("multiLine", True)
    df = reader.json(list(paths))
    nested = (ArrayType, MapType, StructType)
    scalar = lambda fields: {f.name: f.dataType.simpleString() for f in fields if not isinstance(f.dataType, nested)}
    parents = scalar(df.schema)
    if record_path is None:
        return df.select(*(f"`{c}`" for c in parents))
    kind = df.schema[record_path].dataType if record_path in df.columns else None
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType):
        raise ValueError(f"no lists of records below {record_path}")
    own = scalar(kind.elementType)
    # Read as maps, records show which keys they have.
    schema = StructType([f for f in df.schema if f.name in parents]).add(record_path, ArrayType(MapType(StringType(), StringType())))
    rows = reader.schema(schema).json(list(paths)).select(*(f"`{c}`" for c in parents), F.explode(F.col(f"`{record_path}`")).alias("__r")).where("__r is not null")

    def column(c: str):
        if c not in own:
            return F.col(f"`{c}`")
        wide = own[c] if parents.get(c, own[c]) == own[c] else "string"
        mine = F.try_element_at("__r", F.lit(c)).cast(wide)
        return F.when(F.map_contains_key("__r", F.lit(c)), mine).otherwise(F.col(f"`{c}`").cast(wide)).alias(c) if c in parents else mine.alias(c)

    return rows.select(*(column(c) for c in [*parents, *(c for c in own if c not in parents)]))


def swf(spark: SparkSession, *paths: str) -> DataFrame:
    """The 18 columns, with -1 as null, and submit, start and end as times; lines with fewer than four fields are left out.

    The base time stands in each file's header; a file without one starts in 1970.
    """
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("__file"))
    return swf_lines(lines)


def swf_lines(lines: DataFrame) -> DataFrame:
    base = F.nullif(F.regexp_extract("value", r"^;\s*UnixStartTime:\s*(\d+)", 1), F.lit("")).cast("bigint")
    bases = lines.where(F.col("value").startswith(";")).groupBy("__file").agg(F.max(base).alias("__base"))
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith(";")).withColumn("__f", fields).where(F.size("__f") >= 4).join(F.broadcast(bases), "__file", "left")
    value = [F.try_element_at("__f", F.lit(k + 1)).try_cast("double") for k in range(len(SWF))]
    parsed = rows.select("__base", *(F.when(v != -1, v).alias(n) for n, v in zip(SWF, value)))
    first = F.coalesce("__base", F.lit(0))
    start = F.col("submit") + F.coalesce("wait", F.lit(0.0))
    return parsed.select(
        *(c for c in SWF),
        F.timestamp_seconds(first + F.col("submit")).alias("submit_time"),
        F.timestamp_seconds(first + start).alias("start_time"),
        F.timestamp_seconds(first + start + F.col("run_time")).alias("end_time"),
    )


ALLOCATE = r"^\[([^\]]+)\].*Allocate JobId=(\d+) NodeList=(\S+) #CPUs=(\d+) Partition=(\S+)"
COMPLETE = r"^\[([^\]]+)\].*_job_complete: JobId=(\d+) done"


def scheduler_log(lines: DataFrame, order: str) -> DataFrame:
    """Jobs of a controller log with both lines, the last of each kind by order; lines: value and the order column."""
    start = F.regexp_extract("value", ALLOCATE, 1).try_cast("timestamp")
    allocated = lines.where(F.col("value").rlike(ALLOCATE)).select(
        F.regexp_extract("value", ALLOCATE, 2).cast("bigint").alias("job_id"), order,
        F.struct(start.alias("start_time"), F.regexp_extract("value", ALLOCATE, 3).alias("node_list"), F.regexp_extract("value", ALLOCATE, 4).cast("bigint").alias("allocated_cpus"), F.regexp_extract("value", ALLOCATE, 5).alias("partition")).alias("a"),
    )
    done = lines.where(F.col("value").rlike(COMPLETE)).select(F.regexp_extract("value", COMPLETE, 2).cast("bigint").alias("job_id"), order, F.regexp_extract("value", COMPLETE, 1).try_cast("timestamp").alias("end_time"))
    a = allocated.groupBy("job_id").agg(F.max_by("a", order).alias("a")).select("job_id", "a.*")
    b = done.groupBy("job_id").agg(F.max_by("end_time", order).alias("end_time"))
    runtime = F.greatest(F.lit(0.0), (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6)
    return a.join(b, "job_id").withColumn("runtime_seconds", runtime)


def scheduler_log_file(spark: SparkSession, *paths: str) -> DataFrame:
    """Jobs of controller logs by job_id; of several files the later one by name has the last word.

    Spark packs pieces of files into tasks by size, so the place of a line is its file, the start of its
    piece there, and its number in the task.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nr"))
    lines = spark.read.text(list(paths)).select("value", at.alias("__line"))
    return scheduler_log(lines, "__line").orderBy("job_id")


def accounting(lines: DataFrame, order: str) -> DataFrame:
    """job_id and state of pipe-separated accounting lines; step suffixes go, the last line wins."""
    part = F.split("value", r"\|")
    rows = lines.select(F.substring_index(F.element_at(part, 1), ".", 1).alias("job_id"), F.trim(F.try_element_at(part, F.lit(2))).alias("state"), order).where("job_id <> ''")
    return rows.groupBy("job_id").agg(F.max_by("state", order).alias("state"))


def shared(spark: SparkSession, local: str) -> str:
    """A file of the driver, copied to the folder that all executors share."""
    to = f"{shared_dir(spark)}/fetched/{uuid.uuid4().hex}/{Path(local).name}"
    fs, p = filesystem(spark, to)
    fs.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{Path(local).resolve()}"), p)
    return to


def decode(spark: SparkSession, kind: str, paths: list[str], *, pattern: str = "*", **options) -> DataFrame:
    """Archives unpacked by tasks, then read by kind: parquet, csv, json or swf; times without a zone are taken as UTC.

    Files of the driver are copied to the shared folder first, as executors don't see them.
    """
    kinds = {"parquet": (parquet, (".parquet",)), "csv": (csv, (".csv", ".tsv", ".txt", ".csv.gz")), "json": (json, (".json", ".json.gz")), "swf": (swf, (".swf", ".swf.gz", ".txt"))}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(kinds)}")
    read, suffixes = kinds[kind]
    files = archives.unpack(spark, [shared(spark, p) if "://" not in p else p for p in paths], pattern, suffixes)
    if not files:
        raise FileNotFoundError(f"no {kind} file in {', '.join(paths)}")
    return unify_temporal(read(spark, *files, **(options | ({"plain": True} if kind == "csv" else {}))))


def head(df: DataFrame, rows: int = 5, width: int = 120) -> DataFrame:
    """The first rows with every value as a string of at most width characters."""
    texts = [F.col(c).cast("string") for c in df.columns]
    return df.limit(rows).select(*(F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t).alias(c) for t, c in zip(texts, df.columns)))


def tiny_jobs(spark: SparkSession) -> DataFrame:
    """30 hourly jobs with known windows, for trials."""
    i = F.col("id")
    first = F.lit("2026-01-01 00:02:00").cast("timestamp")
    submit = F.timestamp_seconds(F.unix_timestamp(first) + i * 3600)
    runtime = F.lit(600.0) + 120.0 * (i % 10)
    start = F.timestamp_seconds(F.unix_timestamp(first) + i * 3600 + 180)
    return spark.range(0, 30, 1, 1).select(
        (i + 1001).alias("job_id"), submit.alias("submit_time"), start.alias("start_time"), runtime.alias("runtime_seconds"),
        F.timestamp_micros(F.unix_micros(start) + (runtime * 1e6).cast("bigint")).alias("end_time"), (i % 8 + 1).alias("allocated_cpus"),
        F.when(i % 2 == 0, "debug").otherwise("compute").alias("partition"),
    )


def tiny_embedded_jobs(spark: SparkSession, dim: int = 16) -> DataFrame:
    """48 hourly jobs in three clusters of vectors with their own runtimes."""
    i = F.col("id")
    base = tiny_jobs(spark).limit(0)
    submit = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01 00:02:00").cast("timestamp")) + i * 3600)
    noise = lambda k: (F.pmod(F.xxhash64(i, k), F.lit(1000)) / 10000.0)
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.when(k % 3 == i % 3, 1.0).otherwise(0.0) + noise(k)).cast("float"))
    runtime = F.element_at(F.array(F.lit(600.0), F.lit(1200.0), F.lit(1800.0)), (i % 3 + 1).cast("int")) + 10.0 * (i % 5)
    rows = spark.range(0, 48, 1, 1).select(
        (i + 1001).alias("job_id"), submit.alias("submit_time"), F.timestamp_seconds(F.unix_timestamp(submit) + 180).alias("start_time"), runtime.alias("runtime_seconds"),
        F.timestamp_micros(F.unix_micros(submit) + 180_000_000 + (runtime * 1e6).cast("bigint")).alias("end_time"), (i % 8 + 1).alias("allocated_cpus"),
        F.when(i % 2 == 0, "debug").otherwise("compute").alias("partition"), vector.alias("embedding"),
    )
    return base.unionByName(rows, allowMissingColumns=True)


def check_vectors(df: DataFrame, column: str) -> int:
    """The one length of the vectors of a column; nulls or several lengths are an error."""
    r = df.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi"), F.count_if(F.col(column).isNull()).alias("nulls")).first()
    if r.nulls or r.lo is None or r.lo != r.hi:
        raise ValueError(f"{column} has nulls or vectors of several lengths")
    return r.lo

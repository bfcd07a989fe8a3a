"""Declarative mapping of source columns onto the canonical job table.

A mapping is a dict: canonical name -> {"from": source, "type": transform, "format"/"unit": ...,
"derive": "end_minus_start", "synthesize": "row_index"}.  It becomes one select.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType

from ..functions.transforms import normal_name, transform
from .ranks import row_index

REQUIRED = ("job_id", "start_time", "end_time", "runtime_seconds")
#: The types of canonical columns, for those that no source fills.
TYPES = {
    "job_id": "string", "submit_time": "timestamp", "start_time": "timestamp", "end_time": "timestamp", "runtime_seconds": "double",
    "requested_seconds": "double", "num_nodes_req": "bigint", "num_cores_req": "bigint", "num_gpus_req": "bigint", "requested_memory_mib": "double",
    "num_nodes_alloc": "bigint", "num_cores_alloc": "bigint", "allocated_cpus": "bigint", "partition": "string", "queue": "string", "qos": "string",
    "user": "string", "account": "string", "name": "string", "job_state": "string", "node_list": "string",
}
_KINDS = {"timestamp", "duration", "memory", "memory_slurm", "hash_identifier", "integer", "number"}


def present(c: Column, text: bool) -> Column:
    return c.isNotNull() & (c != "") if text else c.isNotNull()


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def project(df: DataFrame, mapping: dict[str, dict], order: list[str] | None = None) -> DataFrame:
    """The mapped columns in the order of the mapping, missing required ones last as typed nulls.

    A runtime that is not there is the end minus the start, at least 0.  order: the row order that
    synthesized row numbers follow.
    """
    if any(rule.get("synthesize") == "row_index" for rule in mapping.values()):
        if not order:
            raise ValueError("row numbers need an order")
        df = row_index(df, order, "__row_index")
    cols = []
    for name, rule in mapping.items():
        source = "__row_index" if rule.get("synthesize") == "row_index" else rule.get("from")
        if source is None or source not in df.columns:
            cols.append(F.lit(None).cast(TYPES.get(name, "string")).alias(name))
            continue
        kind = rule.get("type")
        spec = {"type": kind, **{k: rule[k] for k in ("format", "unit", "salt", "strict") if k in rule}} if kind in _KINDS else None
        cols.append(transform(F.col(f"`{source}`"), spec).alias(name))
    cols += [F.lit(None).cast(TYPES[name]).alias(name) for name in REQUIRED if name not in mapping]
    out = df.select(*cols)
    return derive_runtime(out)


def derive_runtime(df: DataFrame, start: str = "start_time", end: str = "end_time", runtime: str = "runtime_seconds") -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = F.nullif(F.col(runtime), F.lit("")).cast("double") if is_text(df, runtime) else F.col(runtime)
    return df.withColumn(runtime, F.coalesce(own, F.greatest(F.lit(0.0), (micros(end) - micros(start)) / 1e6)))


def complete(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows in which every required column has a value; empty strings are none."""
    keep = F.lit(True)
    for name in required:
        keep = keep & present(F.col(name), is_text(df, name))
    return df.where(keep)


def allow_states(df: DataFrame, column: str, states: list[str]) -> DataFrame:
    """Rows in one of the states; none if there is no such column."""
    return df.where(F.col(column).isin(states)) if column in df.columns else df.where(F.lit(False))


def drop_empty_columns(df: DataFrame, keep: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Without the optional columns that have no value in any row; costs a pass over the data."""
    optional = [c for c in df.columns if c not in keep]
    for c in optional:
        if is_text(df, c):
            df = df.withColumn(c, F.nullif(F.col(c), F.lit("")))
    counts = df.agg(*(F.count(F.col(c)).alias(c) for c in optional)).first() if optional else {}
    return df.drop(*(c for c in optional if counts[c] == 0))


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """require_nonnull, require_positive (nulls stay), require_end_after_start (nulls stay)."""
    for key, value in filters.items():
        if key == "require_nonnull":
            df = df.dropna(subset=[c for c in value if c in df.columns]) if any(c in df.columns for c in value) else df
        elif key == "require_positive":
            for c in (c for c in value if c in df.columns):
                df = df.where(F.col(c).isNull() | (F.col(c) > 0))
        elif key == "require_end_after_start":
            if value and {"start_time", "end_time"} <= set(df.columns):
                df = df.where((F.col("start_time") <= F.col("end_time")) | F.col("start_time").isNull() | F.col("end_time").isNull())
        else:
            raise ValueError(f"unknown filter {key!r}")
    return df


def select(df: DataFrame, columns: list[str] | None, *, job_table: bool = True) -> DataFrame:
    """The columns in their order; those that were dropped as empty are nulls."""
    if not columns:
        return df
    missing = [c for c in REQUIRED if c not in columns] if job_table else []
    if missing:
        raise ValueError(f"a job table needs {', '.join(missing)}")
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(TYPES.get(c, "string")).alias(c) for c in columns))


def sample(df: DataFrame, order: list[str], *, rows: int, strategy: str = "head", by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """At most rows rows: the first, random ones, or in proportion to the groups of by.

    Random order is a hash of (seed, row number), so a sample is the same on any cluster.  Groups get
    their share rounded half to even; what that gives too much goes by row number.
    """
    if strategy == "head":
        return df.orderBy(*order).limit(rows)  # each task keeps its first rows only
    n = df.count()
    if n <= rows:
        return df
    indexed = row_index(df, order, "__row")
    dice = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("__row").cast("string")), 256)
    if strategy == "random":
        return indexed.withColumn("__dice", dice).orderBy("__dice").limit(rows).drop("__row", "__dice")
    if strategy != "stratified":
        raise ValueError(f"unknown strategy {strategy!r}")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by or [] if c in df.columns]
    keyed = indexed.withColumn("__key", F.concat_ws("\x1f", *keys) if keys else F.lit("")).withColumn("__dice", dice)
    share = keyed.groupBy("__key").agg(F.bround(F.lit(float(rows)) * F.count(F.lit(1)) / n).cast("int").alias("__quota"))
    # No quota is above rows, and a rank up to a constant is cut in each task before rows are shuffled.
    near = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__key").orderBy("__dice", "__row"))).where(F.col("__r") <= rows)
    ranked = near.join(share, "__key").where(F.col("__r") <= F.col("__quota"))
    return ranked.orderBy("__row").limit(rows).drop("__row", "__key", "__dice", "__quota", "__r")


def overlap(df: DataFrame, low, high, *, extra_days: int = 0, submit: str = "submit_time", end: str = "end_time") -> DataFrame:
    """Jobs submitted before the day after high and ended at or after low less extra_days; the predicate reaches the scan.

    Without the submit column the start stands for it, and without the end column what stands for the submission.
    """
    submit = submit if submit in df.columns else "start_time"
    end = end if end in df.columns else submit
    kind = "timestamp_ntz" if isinstance(df.schema[submit].dataType, TimestampNTZType) else "timestamp"
    last = F.lit(str(high)).cast(kind) + F.expr("INTERVAL 1 DAY")
    first = F.lit(str(low)).cast(kind) - F.expr(f"INTERVAL {int(extra_days)} DAYS")
    return df.where((F.col(submit) < last) & (F.col(end) >= first))


# -- profiles and suggestions ---------------------------------------------------------------

#: The names that suggest each canonical field.
ALIASES = {
    "job_id": ["job_id", "jobid", "jobid_raw", "slurm_job_id", "slurmjobid"],
    "start_time": ["start_time", "start", "start_ts", "starttime", "start_datetime"],
    "end_time": ["end_time", "end", "end_ts", "endtime", "end_datetime", "finish_time"],
    "submit_time": ["submit_time", "submit", "submit_ts", "submit_time_utc", "submit_time_ts"],
    "state": ["state", "job_state", "status"],
    "runtime_seconds": ["runtime_seconds", "runtime", "elapsed", "elapsed_time", "elapsed_seconds", "wallclock_used", "wallclock", "duration", "run_time"],
    "user": ["user", "user_id", "uid", "username"],
    "account": ["account", "acct", "project", "allocation"],
    "partition": ["partition", "queue", "qos_partition"],
    "qos": ["qos", "quality_of_service"],
    "nodes_requested": ["nodes_requested", "req_nodes", "nodes", "nnodes"],
    "memory_requested": ["memory_requested", "mem_req", "req_mem", "reqmem", "memory", "mem"],
    "processors_requested": ["processors_requested", "req_cpus", "reqcpus", "cpus", "ncpus", "processors"],
    "gpus_requested": ["gpus_requested", "req_gpus", "gpus", "ngpus", "gres_gpu", "reqgres", "gres"],
    "wallclock_requested": ["wallclock_requested", "wallclock_req", "wallclock_requested_seconds", "timelimit", "time_limit", "wallclock_limit", "limit"],
    "name": ["name", "job_name", "jobname"],
    "submit_line": ["submit_line", "command", "command_line", "cmdline"],
    "work_dir": ["work_dir", "workdir", "working_dir", "working_directory"],
    "script": ["script", "job_script", "batch_script"],
}
#: The kinds of columns that fit a field, where it is not categorical ones alone.
KINDS = {
    "job_id": ["numeric", "categorical"],
    "start_time": ["timestamp", "categorical"],
    "end_time": ["timestamp", "categorical"],
    "submit_time": ["timestamp", "categorical"],
    "runtime_seconds": ["numeric"],
    "nodes_requested": ["numeric"],
    "memory_requested": ["numeric"],
    "processors_requested": ["numeric"],
    "gpus_requested": ["numeric", "categorical"],
    "wallclock_requested": ["numeric", "categorical"],
}
#: The fields of a job table that a parsed log should have.
JOB_FIELDS = ["job_id", "start_time", "end_time", "runtime_seconds", "allocated_cpus", "partition", "node_list"]


def kind_of(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return "timestamp"
    if t.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return "numeric"
    return "categorical" if t.typeName() in ("string", "boolean") else "unknown"


def field_presence(df: DataFrame) -> DataFrame:
    """field, mapped_to, confidence, reason for each field of a job table: is there a column of its name?"""
    rows = [(f, f, 1.0, "field present in parsed rows") if f in df.columns else (f, None, 0.0, "field missing from parsed rows") for f in JOB_FIELDS]
    return df.sparkSession.createDataFrame(rows, "field string, mapped_to string, confidence double, reason string")


def profile(df: DataFrame, order: list[str], *, rows: int = 200, samples: int = 5) -> DataFrame:
    """column, name, dtype, kind, null_rate and the first values over the first rows."""
    head = df.orderBy(*order).limit(rows)
    texts = [F.col(c).cast("string").alias(c) for c in df.columns]
    kinds = F.create_map(*(F.lit(x) for c in df.columns for x in (c, f"{df.schema[c].dataType.simpleString()}|{kind_of(df, c)}")))
    long = head.select(F.monotonically_increasing_id().alias("__at"), *texts).unpivot("__at", df.columns, "column", "v")
    out = long.groupBy("column").agg(
        F.round(F.avg(F.col("v").isNull().cast("int")), 6).alias("null_rate"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("__at", "v")))), 1, samples), lambda s: s["v"]).alias("samples"),
    )
    told = F.split(F.element_at(kinds, F.col("column")), r"\|")
    return out.select("column", normal_name(F.col("column")).alias("name"), told[0].alias("dtype"), told[1].alias("kind"), "null_rate", "samples")


def suggest(df: DataFrame) -> DataFrame:
    """field, column, confidence, reason, rank of every column that may fill a field, best first.

    A field's own name scores 1, a name that contains one of its words 0.7; the right kind adds
    0.3, an unknown one 0.1, a wrong one takes 0.2.  From the schema alone: no data is read.
    """
    spark = df.sparkSession
    fields = spark.createDataFrame([(f, names, KINDS.get(f, ["categorical"])) for f, names in ALIASES.items()], "field string, names array<string>, wanted array<string>")
    columns = spark.createDataFrame([(c, kind_of(df, c)) for c in df.columns], "column string, kind string").withColumn("name", normal_name(F.col("column")))
    pairs = columns.select("column", "kind", "name", F.explode(F.array(*(F.lit(f) for f in ALIASES))).alias("field")).join(F.broadcast(fields), "field")  # 19 rows
    inside = F.get(F.filter("names", lambda n: F.contains(F.col("name"), n)), 0)
    exact = F.array_contains("names", F.col("name"))
    found = pairs.withColumn("inside", inside).where(exact | F.col("inside").isNotNull())
    fits = F.array_contains("wanted", F.col("kind"))
    by_name = F.when(exact, 1.0).otherwise(0.7)
    by_kind = F.when(fits, 0.3).when(F.col("kind") == "unknown", 0.1).otherwise(-0.2)
    said = F.when(exact, F.lit("exact alias match")).otherwise(F.concat(F.lit("contains alias '"), "inside", F.lit("'")))
    told = F.when(fits, F.concat(F.lit("kind '"), "kind", F.lit("' is compatible"))).when(F.col("kind") == "unknown", F.lit("unknown kind")).otherwise(F.concat(F.lit("kind '"), "kind", F.lit("' is unlikely")))
    scored = found.select("field", "column", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), by_name + by_kind)), 3).alias("confidence"), F.concat(said, F.lit("; "), told).alias("reason"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("confidence"), "column")))

"""Quality, issues and value profiles, each in a single pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from .ranks import running

EXAMPLES = 3
#: All that issues() can say.
ISSUES = ["missing_job_id", "missing_start_time", "missing_end_time", "missing_runtime_seconds", "negative_runtime", "non_numeric_runtime", "start_after_end", "too_few_cpus"]


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.isNull() | (c == "") if isinstance(df.schema[name].dataType, StringType) else c.isNull()


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, missing (nulls and empty strings), rate."""
    columns = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(missing(df, c)).alias(c) for c in columns))
    return one.unpivot("__n", columns, "column", "missing").select("column", "missing", F.when(F.col("__n") > 0, F.col("missing") / F.col("__n")).otherwise(0.0).alias("rate"))


def issues(df: DataFrame) -> Column:
    """The names of what is wrong with a job row."""
    rules = []
    for name in ("job_id", "start_time", "end_time", "runtime_seconds"):
        if name in df.columns:
            rules.append(F.when(missing(df, name), F.lit(f"missing_{name}")))
    if "runtime_seconds" in df.columns:
        runtime = F.col("runtime_seconds").cast("string").try_cast("double")
        rules += [F.when(runtime < 0, F.lit("negative_runtime")), F.when(F.col("runtime_seconds").isNotNull() & runtime.isNull(), F.lit("non_numeric_runtime"))]
    if {"start_time", "end_time"} <= set(df.columns):
        rules.append(F.when(F.col("start_time") > F.col("end_time"), F.lit("start_after_end")))
    if "allocated_cpus" in df.columns:
        rules.append(F.when(F.col("allocated_cpus") < 1, F.lit("too_few_cpus")))
    return F.array_compact(F.array(*rules))


def issue_summary(df: DataFrame, key: str) -> DataFrame:
    """issue, count, examples (the first keys), most frequent first.

    Counts are partial sums, and the rank of an example is cut in each task, so a frequent issue is no large group.
    """
    found = df.select(F.col(key).alias("key"), F.explode(issues(df)).alias("issue"))
    counts = found.groupBy("issue").agg(F.count(F.lit(1)).alias("count"))
    first = found.withColumn("__r", F.row_number().over(Window.partitionBy("issue").orderBy("key"))).where(F.col("__r") <= EXAMPLES)
    examples = first.groupBy("issue").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return counts.join(examples, "issue").orderBy(F.desc("count"), "issue")


def report(df: DataFrame, label: str | None = None) -> dict:
    """The quality report of a table: rows, missingness, issues and label counts; one pass, and one for the labels."""
    names = issues(df)
    every = df.select(*(missing(df, c).cast("int").alias(f"m{k}") for k, c in enumerate(df.columns)), names.alias("__issues"))
    known = [n for n in ISSUES if n.startswith("missing_") is False or n.removeprefix("missing_") in df.columns]
    sums = [F.sum(f"m{k}").alias(f"m{k}") for k in range(len(df.columns))] + [F.count_if(F.array_contains("__issues", n)).alias(n) for n in known]
    one = every.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
    out = {
        "rows": one["rows"],
        "missingness": {c: (one[f"m{k}"] or 0) / one["rows"] if one["rows"] else 0.0 for k, c in enumerate(df.columns)},
        "issues": {n: one[n] for n in known if one[n]},
    }
    if label:
        out["labels"] = {r["value"]: r["count"] for r in value_counts(df, label, 100).collect()}  # a report shows the most frequent
    return out


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """value (as a string), count; most frequent first, ties by value."""
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")
    return out.limit(top) if top else out


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, cardinality, missingness (nulls only, 6 digits).

    Values are counted through groups of (column, value), so no column is gathered in one place.
    """
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "v")
    by_value = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("column").agg(F.count("v").alias("cardinality"), F.round(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("missingness"))


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n, rank of every category; empty strings are nulls."""
    long = df.select(*(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).unpivot([], columns, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def category_profile(df: DataFrame, columns: list[str], *, rare: int = 2) -> DataFrame:
    """column, cardinality, null_rate, rare_values, rare_fraction, top value and its count."""
    c = categories(df, columns)
    seen = F.col("value").isNotNull()
    is_rare = seen & (F.col("n") <= rare)
    return c.groupBy("column").agg(
        F.count("value").alias("cardinality"),
        F.round(F.sum(F.when(~seen, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("null_rate"),
        F.count_if(is_rare).alias("rare_values"),
        F.round(F.sum(F.when(is_rare, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("rare_fraction"),
        F.min(F.when(seen, F.struct((-F.col("n")).alias("n"), "value")))["value"].alias("top_value"),
        F.max(F.when(seen, F.col("n"))).alias("top_count"),
    )


def one_hot_width(df: DataFrame, columns: list[str], *, floor: int = 2, most: int = 2048) -> DataFrame:
    """min_frequency, width: the least frequency at which the one-hot columns fit; no row if none does.

    A value below the frequency shares one column with the others of its kind.  Candidates are the
    counts that occur plus one, and the floor.  The width at a frequency is the number of values less
    those below it plus the columns that have any: two running sums over the counts in their order.
    """
    by_value = categories(df, columns).where("value is not null")
    values = by_value.groupBy("n").agg(F.count(F.lit(1)).alias("values"))
    shared = by_value.groupBy("column").agg(F.min("n").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("shared"))
    steps = values.join(shared, "n", "left").select("n", (F.coalesce("shared", F.lit(0)) - F.col("values")).alias("change"))
    start = df.sparkSession.range(1).select((F.col("id") + floor - 1).alias("n"), F.lit(0).cast("bigint").alias("change"))
    at = running(steps.union(start).groupBy("n").agg(F.sum("change").alias("change")), ["n"], "change", "upto")
    total = values.agg(F.coalesce(F.sum("values"), F.lit(0)).alias("total"))
    widths = at.where(F.col("n") >= floor - 1).join(F.broadcast(total)).select((F.col("n") + 1).alias("f"), (F.col("total") + F.col("upto")).alias("width"))
    return widths.where(F.col("width") <= most).groupBy().agg(F.min(F.struct("f", "width")).alias("s")).where("s is not null").select(F.col("s.f").alias("min_frequency"), F.col("s.width").alias("width"))


def coverage(df: DataFrame) -> DataFrame:
    """One row: how far a table meets the canonical requirements, with the runtimes and CPUs that it has."""
    required = [c for c in ("job_id", "start_time", "end_time", "runtime_seconds") if c in df.columns]
    gaps = sum((F.avg(missing(df, c).cast("double")) for c in required), F.lit(0.0)) / max(1, len(required))
    cpus = F.col("allocated_cpus") if "allocated_cpus" in df.columns else F.lit(None).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(gaps, 6).alias("required_missing"),
        F.round(F.avg((F.col("runtime_seconds") > 0).cast("double")), 6).alias("positive_runtime"),
        F.round(F.avg("runtime_seconds"), 4).alias("mean_runtime"),
        F.min(cpus).alias("min_cpus"),
        F.max(cpus).alias("max_cpus"),
        F.countDistinct("partition").alias("partitions"),
    )

"""Small reports on tables, windows and routes, and what they display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The spellings of units and formats that users give.
UNIT_NAMES = {
    "duration": {
        "seconds": ["s", "sec", "secs", "second", "seconds"],
        "minutes": ["m", "min", "mins", "minute", "minutes"],
        "hours": ["h", "hr", "hrs", "hour", "hours"],
        "hh:mm:ss": ["hh:mm:ss", "h:m:s"],
    },
    "timestamp": {
        "iso8601": ["iso", "iso8601", "iso-8601"],
        "epoch_s": ["epoch_s", "epoch_sec", "epoch_seconds"],
        "epoch_ms": ["epoch_ms", "epoch_millis"],
        "epoch_us": ["epoch_us", "epoch_micros"],
    },
    "memory": {"bytes": ["b", "bytes"], "kb": ["kb"], "mb": ["mb"], "gb": ["gb"], "kib": ["kib"], "mib": ["mib"], "gib": ["gib"]},
}


def unit_name(kind: str, text: str) -> str:
    """The unit or format meant by a user's spelling."""
    plain = text.strip().lower()
    for name, spellings in UNIT_NAMES[kind].items():
        if plain in spellings:
            return name
    raise ValueError(f"unsupported {kind} unit or format: {text}")


def short_id(text: str, prefix: str = "") -> str:
    """The last part of a dotted name."""
    return str(text or "").removeprefix(prefix).rpartition(".")[2]


def short_time(text: str | None, *, compact: bool = False) -> str:
    """An ISO time for display: its date and time in UTC, or month, day, hour and minute."""
    if not text:
        return "-"
    day, t, clock = str(text).replace("Z", "+00:00").partition("T")
    if not t:
        return day
    clock = clock.partition(".")[0].partition("+")[0]
    return f"{day[5:] or day} {clock[:5]}" if compact else f"{day} {clock} UTC"


def metric_text(name: str, value: float, target: str | None = None) -> str:
    """A metric for display: shares in percent, errors of runtimes as durations."""
    if name == "underprediction_ratio":
        return f"{value:.1f}%"
    if name == "mape":
        return f"{value:.1%}"
    if name == "r2":
        return f"{value:.3f}"
    if name in ("mae", "rmse") and target == "runtime_seconds":
        size = abs(value)
        for most, unit, form in ((60, 1, "{:.0f}s"), (3600, 60, "{:.1f} min"), (172800, 3600, "{:.1f} h"), (float("inf"), 86400, "{:.1f} d")):
            if size < most:
                return form.format(size / unit)
    return f"{value:.0f}" if float(value).is_integer() else f"{value:.3g}"


def spans_hours(jobs: DataFrame, time: str = "submit_time", least: int = 3) -> DataFrame:
    """hours, enough: whether submissions fall into enough hours for a rolling evaluation."""
    hours = jobs.select(F.date_trunc("hour", time).alias("h")).where("h is not null").distinct()
    return hours.agg(F.count(F.lit(1)).alias("hours")).withColumn("enough", F.col("hours") >= least)


def route_summary(routed: DataFrame, group: str = "window_id") -> DataFrame:
    """One row: windows, rows, rows by expert and by fallback, and the routed share."""
    return routed.agg(
        F.countDistinct(group).alias("windows"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("route") == "expert").alias("by_expert"),
        F.count_if(F.col("route") == "fallback").alias("by_fallback"), F.round(F.avg((F.col("route") == "expert").cast("double")), 6).alias("routed"),
    )


def window_summary(plan: DataFrame) -> DataFrame:
    """One row: windows in all, scored and skipped, test rows scored, days, refits."""
    ok = F.col("status") == "ok"
    return plan.agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(ok).alias("scored"), F.count_if(~ok).alias("skipped"), F.sum(F.when(ok, F.col("n_test")).otherwise(0)).alias("rows_scored"),
        F.countDistinct(F.when(ok, F.col("day"))).alias("days"), F.count_if(F.col("refresh")).alias("refits"),
    )


def close_values(df: DataFrame, column: str, wanted: list[str], *, most: int = 3) -> DataFrame:
    """wanted, value, distance: for values that are looked for the nearest that occur, by edit distance.

    The rank is cut in each task, so the values of a column are gathered nowhere.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    asked = F.explode(F.array(*(F.lit(w) for w in wanted)))
    scored = values.select("value", asked.alias("wanted")).withColumn("distance", F.levenshtein(F.lower("value"), F.lower("wanted")))
    rank = F.row_number().over(Window.partitionBy("wanted").orderBy("distance", "value"))
    return scored.withColumn("__r", rank).where(F.col("__r") <= most).select("wanted", "value", "distance")


def ingest_checks(df: DataFrame, order: list[str], rows: int = 50) -> DataFrame:
    """check, hits over the first rows: what a user should look at before a mapping is written."""
    head = df.orderBy(*order).limit(rows)
    checks = {}
    if {"start_time", "end_time"} <= set(df.columns):
        checks["start_after_end"] = F.col("start_time") > F.col("end_time")
    if "runtime_seconds" in df.columns:
        checks["runtime_not_positive"] = ~(F.col("runtime_seconds") > 0)
    for c in df.columns:
        checks[f"null_{c}"] = F.col(c).isNull()
    one = head.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(x).alias(n) for n, x in checks.items()))
    return one.unpivot("__n", list(checks), "check", "hits").where("hits > 0").select("check", "hits")


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, digest: equal for equal tables whatever the order of rows and files."""
    h = F.xxhash64(*(F.col(c) for c in sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.hex(F.bit_xor(h)).alias("x"), F.hex(F.sum((h % (1 << 31)).cast("decimal(20,0)")).cast("bigint")).alias("s")).select("rows", F.concat("x", F.lit("-"), "s").alias("digest"))


def portable_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, digest: the sum of the first 13 hex digits of each row's SHA-256 of its columns; other engines can make it too."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    n = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(n).cast("string").alias("digest"))


def duration_text(seconds: Column) -> Column:
    """45s, 12m 5s, 3h 0m, 2d 4h."""
    s = F.floor(seconds).cast("bigint")
    day, hour, minute = (s / 86400).cast("bigint"), (s % 86400 / 3600).cast("bigint"), (s % 3600 / 60).cast("bigint")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(minute.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .when(s < 86400, F.concat(hour.cast("string"), F.lit("h "), minute.cast("string"), F.lit("m")))
        .otherwise(F.concat(day.cast("string"), F.lit("d "), hour.cast("string"), F.lit("h")))
    )

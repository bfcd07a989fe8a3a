"""The time axis of a job table: daily volume, missing blocks, and the evaluation window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranks import quantiles, stepped_quantiles

DAY = 86400


def span(jobs: DataFrame, submit: str = "submit_time", q: float = 0.001) -> DataFrame:
    """lo_day, hi_day (days since 1970) of the submissions without the outer q on each side, and the full range."""
    s = F.floor(F.unix_micros(F.col(submit).cast("timestamp")) / 1_000_000)
    ends = jobs.agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    return ends.join(F.broadcast(stepped_quantiles(jobs, s, [q, 1 - q], 3600).withColumnRenamed("q", "p"))).selectExpr(
        f"cast(floor(cast(p[0] AS bigint) / {DAY}) AS int) AS lo_day", f"cast(floor(cast(p[1] AS bigint) / {DAY}) AS int) AS hi_day", f"cast(floor(lo / {DAY}) AS int) AS full_lo", f"cast(floor(hi / {DAY}) AS int) AS full_hi"
    )


def daily_volume(jobs: DataFrame, submit: str = "submit_time", q: float = 0.001) -> DataFrame:
    """day, n of every day in the span, also of empty ones."""
    days = span(jobs, submit, q).selectExpr("explode(sequence(lo_day, hi_day)) AS d")
    counts = jobs.groupBy(F.expr(f"cast(floor(unix_micros(cast({submit} AS timestamp)) / {DAY * 1_000_000}) AS int)").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    return days.join(counts, "d", "left").select(F.date_from_unix_date("d").alias("day"), F.coalesce("c", F.lit(0)).alias("n"))


def volume_stats(daily: DataFrame, frac: float = 0.05) -> DataFrame:
    """One row: days, rows, median and min over active days, max, floor below which a day counts as missing, rate."""
    active = F.when(F.col("n") > 0, F.col("n"))
    out = daily.agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("rows"), F.coalesce(F.median(active), F.lit(0.0)).alias("median"), F.min(active).alias("min"), F.max("n").alias("max"))
    return out.withColumn("gap_floor", F.greatest(F.lit(1.0), F.lit(frac) * F.col("median"))).withColumn("rate", F.round(F.col("rows") / F.col("days"), 1))


def gaps(daily: DataFrame, *, frac: float = 0.05, min_days: int = 3) -> DataFrame:
    """gap_start, gap_end, days of each run of at least min_days days below the floor.

    The daily series has one row a day, so the window over all of it is small whatever the jobs.
    """
    floor = volume_stats(daily, frac).select("gap_floor")
    low = daily.join(F.broadcast(floor), F.col("n") < F.col("gap_floor"))
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")))
    out = low.withColumn("g", island).groupBy("g").agg(F.min("day").alias("gap_start"), F.max("day").alias("gap_end"), F.count(F.lit(1)).alias("days"))
    return out.where(F.col("days") >= min_days).drop("g")


def select_window(daily: DataFrame, missing: DataFrame, *, anchor: float = 0.9, train_days: int = 10, test_days: int = 3) -> DataFrame:
    """One row: window_start, window_end, test_start, shift, n_rows, healthy.

    Windows that touch a missing block are out; of the others the one that ends nearest to the
    anchor of the span is chosen, later ones first at equal distance.  If none is clear, it is the
    anchor's window, flagged as unhealthy.
    """
    size = train_days + test_days
    edge = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).selectExpr("lo", "hi", f"datediff(hi, lo) + 1 AS span", f"least({size}, datediff(hi, lo) + 1) AS size")
    edge = edge.selectExpr("*", f"greatest(date_add(lo, size - 1), least(hi, date_add(lo, cast(bround({anchor} * (span - 1)) AS int)))) AS anchor_end")
    ends = edge.selectExpr("*", "explode(sequence(date_add(lo, size - 1), hi, interval 1 day)) AS e").selectExpr("*", "date_sub(e, size - 1) AS s", "abs(datediff(e, anchor_end)) AS shift")
    touched = ends.join(F.broadcast(missing), (F.col("gap_start") <= F.col("e")) & (F.col("gap_end") >= F.col("s")), "left").groupBy("e", "s", "shift", "anchor_end", "size").agg(F.count("gap_start").alias("touches"))
    order = F.struct((F.col("touches") > 0).cast("int").alias("bad"), "shift", F.datediff(F.lit("1970-01-01").cast("date"), F.col("e")).alias("later"))
    pick = touched.agg(F.min_by(F.struct("e", "s", "shift", "touches"), order).alias("w")).select("w.*")
    inside = pick.join(daily, (F.col("day") >= F.col("s")) & (F.col("day") <= F.col("e")))
    return inside.groupBy("s", "e", "shift", "touches").agg(F.sum("n").alias("n_rows")).selectExpr(
        "s AS window_start", "e AS window_end", f"greatest(s, date_sub(e, {test_days - 1})) AS test_start", "cast(shift AS bigint) AS shift", "n_rows", "touches = 0 AS healthy"
    )


def _spans(counts: DataFrame, group: str) -> DataFrame:
    return counts.groupBy(group).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))


def grouped_gaps(counts: DataFrame, group: str, *, frac: float = 0.05, min_days: int = 3) -> DataFrame:
    """group, gap_start, gap_end, days: the gaps between each group's first and last day.

    counts holds a row (group, day, n) for each active day only; the empty days are never rows.
    """
    floor = F.greatest(F.lit(1.0), F.lit(frac) * F.median("n").over(Window.partitionBy(group)))
    good = counts.withColumn("__floor", floor).where(F.col("n") >= F.col("__floor")).select(group, "day")
    ends = _spans(counts, group).select(group, F.explode(F.array(F.date_sub("lo", 1), F.date_add("hi", 1))).alias("day"))
    after = F.lead("day").over(Window.partitionBy(group).orderBy("day"))
    out = good.union(ends).withColumn("__next", after).select(group, F.date_add("day", 1).alias("gap_start"), F.date_sub("__next", 1).alias("gap_end"))
    return out.withColumn("days", F.datediff("gap_end", "gap_start").cast("bigint") + 1).where(F.col("days") >= min_days)


def _stretches(counts: DataFrame, missing: DataFrame, group: str) -> DataFrame:
    """group, a, b, first: the runs of days between gaps; first: does it begin with the group's span?"""
    spans = _spans(counts, group)
    low, high = F.date_sub("lo", 1), F.date_add("hi", 1)
    fences = missing.select(group, "gap_start", "gap_end", F.lit(False).alias("first")).union(spans.select(group, low, low, F.lit(True))).union(spans.select(group, high, high, F.lit(False)))
    after = F.lead("gap_start").over(Window.partitionBy(group).orderBy("gap_start"))
    return fences.withColumn("__next", after).select(group, F.date_add("gap_end", 1).alias("a"), F.date_sub("__next", 1).alias("b"), "first").where("a <= b")


def grouped_clear_windows(counts: DataFrame, missing: DataFrame, group: str, *, size: int = 5) -> DataFrame:
    """group, s, e: every window of size days that ends in the group's span and touches no gap."""
    ends = F.sequence(F.when(F.col("first"), F.col("a")).otherwise(F.date_add("a", size - 1)), "b", F.expr("interval 1 day"))
    clear = _stretches(counts, missing, group).where(F.col("first") | (F.datediff("b", "a") >= size - 1))
    return clear.select(group, F.explode(ends).alias("e")).select(group, F.date_sub("e", size - 1).alias("s"), "e")


def grouped_select_window(counts: DataFrame, missing: DataFrame, group: str, *, anchor: float = 0.9, train_days: int = 10, test_days: int = 3) -> DataFrame:
    """select_window for each group: of each run of days between gaps only the end nearest to the anchor is a candidate."""
    size = train_days + test_days
    edge = _spans(counts, group).selectExpr(group, "lo", "hi", f"least({size}, datediff(hi, lo) + 1) AS size", f"cast(bround({anchor} * datediff(hi, lo)) AS int) AS at")
    edge = edge.selectExpr(f"{group} AS __k", "size", "greatest(date_add(lo, size - 1), least(hi, date_add(lo, at))) AS anchor_end")
    run = _stretches(counts, missing, group)
    run = run.join(edge, run[group].eqNullSafe(edge["__k"])).where("datediff(b, a) >= size - 1")
    clear = run.selectExpr("__k", "size", "greatest(date_add(a, size - 1), least(b, anchor_end)) AS e", "anchor_end", "true AS healthy")
    either = clear.union(edge.selectExpr("__k", "size", "anchor_end", "anchor_end", "false")).selectExpr("*", "abs(datediff(e, anchor_end)) AS shift")
    best = F.min_by(F.struct("e", "size", "shift", "healthy"), F.struct((~F.col("healthy")).alias("bad"), "shift", (-F.unix_date("e")).alias("later")))
    pick = either.groupBy("__k").agg(best.alias("w")).selectExpr("__k", "w.e AS e", "date_sub(w.e, w.size - 1) AS s", "w.shift AS shift", "w.healthy AS healthy")
    inside = pick.join(counts, pick["__k"].eqNullSafe(counts[group]) & (F.col("day") >= F.col("s")) & (F.col("day") <= F.col("e")), "left")
    return inside.groupBy("__k", "s", "e", "shift", "healthy").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).selectExpr(
        f"__k AS {group}", "s AS window_start", "e AS window_end", f"greatest(s, date_sub(e, {test_days - 1})) AS test_start", "cast(shift AS bigint) AS shift", "n_rows", "healthy"
    )


def card(jobs: DataFrame, *, categorical: list[str] = (), **window) -> dict:
    """The dataset card: spans, volume, gaps, columns, runtime distribution and the chosen window."""
    from ..operators.quality import cardinality

    daily = daily_volume(jobs).cache()
    blocks = gaps(daily)
    out = {"n_rows": jobs.count(), "span": span(jobs).first().asDict(), "volume": volume_stats(daily).first().asDict()}
    out["gaps"] = [r.asDict() for r in blocks.orderBy("gap_start").collect()]
    have = [c for c in categorical if c in jobs.columns]
    out["columns"] = {r["column"]: {"cardinality": r["cardinality"], "missingness": r["missingness"]} for r in cardinality(jobs, have).collect()} if have else {}
    out["runtime_seconds"] = runtime_quantiles(jobs).first().asDict()
    out["window"] = select_window(daily, blocks, **window).first().asDict()
    daily.unpersist()
    return out


def runtime_quantiles(jobs: DataFrame, column: str = "runtime_seconds") -> DataFrame:
    ends = jobs.agg(F.min(column).alias("min"), F.max(column).alias("max"))
    return ends.join(F.broadcast(quantiles(jobs, column, [0.5, 0.9, 0.99]).withColumnRenamed("q", "p"))).selectExpr("min", "round(p[0], 1) AS median", "round(p[1], 1) AS p90", "round(p[2], 1) AS p99", "max")

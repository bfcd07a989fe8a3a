"""Rolling evaluation windows over jobs, without a join of windows and rows.

Windows tile time backwards from the last full hour of submissions.  A job is a test row of at most
one window and a training row of a range of windows, both by arithmetic on its times:

* test window: floor((submit - start) / step);
* training windows: those with end < t0 <= end + lookback, a range of numbers.

Aggregates over the training rows need no copy of a row for each window: a row adds its amount where
its range begins and takes it off behind its end, and running sums over the windows give the rest.
Only models that need the rows themselves explode the range and join on the window number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import row_index

MICROS = 1_000_000


@dataclass(frozen=True)
class Grid:
    """Windows of hours hours; number 0 begins at start (microseconds)."""

    start: int
    n: int
    hours: int
    lookback_days: int

    @property
    def step(self) -> int:
        return self.hours * 3600 * MICROS

    @property
    def lookback(self) -> int:
        return self.lookback_days * 86400 * MICROS


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def grid(jobs: DataFrame, *, n_windows: int, hours: int, lookback_days: int, submit: str = "submit_time") -> Grid:
    """The windows that end at the last submission's hour."""
    if min(n_windows, hours, lookback_days) <= 0:
        raise ValueError("windows, hours and days must be positive")
    latest = jobs.agg(F.max(micros(F.col(submit)))).first()[0]
    if latest is None:
        raise ValueError(f"{submit} has no value")
    hour = 3600 * MICROS
    return Grid(latest // hour * hour - (n_windows - 1) * hours * hour, n_windows, hours, lookback_days)


def window_table(spark, g: Grid) -> DataFrame:
    """window_id, t0, day, refresh: whether the day differs from that of the window before."""
    t0 = F.timestamp_micros(F.lit(g.start) + F.col("window_id") * g.step)
    rows = spark.range(0, g.n, 1, 1).select(F.col("id").cast("int").alias("window_id")).withColumn("t0", t0).withColumn("day", F.date_format("t0", "yyyy-MM-dd"))
    before = F.timestamp_micros(F.lit(g.start) + (F.col("window_id") - 1) * g.step)
    return rows.withColumn("refresh", (F.col("window_id") == 0) | (F.date_format(before, "yyyy-MM-dd") != F.col("day")))


def test_window(g: Grid, submit: Column) -> Column:
    k = F.floor((micros(submit) - g.start) / g.step)
    return F.when((k >= 0) & (k < g.n), k.cast("int"))


def train_range(g: Grid, end: Column) -> tuple[Column, Column]:
    """First and last window that a job with this end trains; empty if the first is larger."""
    off = micros(end) - g.start
    return F.greatest(F.lit(0), F.floor(off / g.step) + 1).cast("int"), F.least(F.lit(g.n - 1), F.floor((off + g.lookback) / g.step)).cast("int")


def train_sums(jobs: DataFrame, g: Grid, amounts: dict[str, Column], end: str = "end_time", keys: tuple[str, ...] = ()) -> DataFrame:
    """window_id (and keys), n_train, and the exact sum of each amount over the training rows.

    Two rows a job are aggregated to at most (windows + 1) rows a key before anything is shuffled.
    """
    lo, hi = train_range(g, F.col(end))
    ranged = jobs.select(*keys, lo.alias("lo"), hi.alias("hi"), *(c.cast("decimal(28,6)").alias(k) for k, c in amounts.items())).where("lo <= hi")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("sign"))))
    moved = ranged.select(*keys, *amounts, ends.alias("e")).groupBy(*keys, F.col("e.at").alias("at"))
    steps = moved.agg(F.sum("e.sign").alias("n_train"), *(F.sum(F.col(k) * F.col("e.sign")).alias(k) for k in amounts))
    every = steps.select(*keys).distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(g.n - 1)))) if keys else jobs.sparkSession.range(0, g.n, 1, 1).select(F.col("id").cast("int").alias("at"))
    full = every.join(steps, [*keys, "at"], "left")
    # One row a window and key: the running sums are over the number of windows only.
    run = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*keys, F.col("at").alias("window_id"), F.coalesce(F.sum("n_train").over(run), F.lit(0)).alias("n_train"), *(F.sum(k).over(run).alias(k) for k in amounts))


def train_rows(jobs: DataFrame, g: Grid, end: str = "end_time") -> DataFrame:
    """Every job once for each window that it trains."""
    lo, hi = train_range(g, F.col(end))
    return jobs.withColumn("__lo", lo).withColumn("__hi", hi).where("__lo <= __hi").withColumn("window_id", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def test_rows(jobs: DataFrame, g: Grid, submit: str = "submit_time") -> DataFrame:
    return jobs.withColumn("window_id", test_window(g, F.col(submit))).where("window_id is not null")


def split_plan(jobs: DataFrame, g: Grid) -> DataFrame:
    """window_id, t0, day, refresh, n_train, n_test, status of every window, also of empty ones."""
    tests = test_rows(jobs, g).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_test"))
    plan = window_table(jobs.sparkSession, g).join(train_sums(jobs, g, {}), "window_id").join(tests, "window_id", "left").withColumn("n_test", F.coalesce("n_test", F.lit(0)))
    return plan.withColumn("status", F.when(F.col("n_train") < 1, "insufficient_training_rows").when(F.col("n_test") < 1, "insufficient_test_rows").otherwise("ok"))


def daily_artifact_window(plan: DataFrame, least: int = 2) -> DataFrame:
    """day, window_id: the first window of each day with enough training rows."""
    return plan.where(F.col("n_train") >= least).groupBy("day").agg(F.min("window_id").alias("window_id"))


def rolling_mean(jobs: DataFrame, g: Grid, target: str = "runtime_seconds") -> DataFrame:
    """Test rows with the mean of their window's training rows as y_pred, and n_train."""
    means = train_sums(jobs.where(F.col(target).isNotNull()), g, {"total": F.col(target)}).where("n_train > 0")
    means = means.select("window_id", "n_train", (F.col("total").cast("double") / F.col("n_train")).alias("y_pred"))
    return test_rows(jobs, g).where(F.col(target).isNotNull()).withColumnRenamed(target, "y_true").join(F.broadcast(means), "window_id")


def time_decay_mean(jobs: DataFrame, g: Grid, rate: float, target: str = "runtime_seconds") -> DataFrame:
    """window_id, n_train and the mean of the training rows weighted by exp(-rate * days since their end).

    The weight splits into a factor of the row and one of the window, so running sums serve here too.
    Sums are of doubles scaled to the first window, and so depend on the order of rows in the last bits.
    """
    lo, hi = train_range(g, F.col("end_time"))
    age = (F.lit(g.start + g.n * g.step) - micros(F.col("end_time"))) / (86400.0 * MICROS)
    w = F.exp(-rate * age)
    ranged = jobs.where(F.col(target).isNotNull()).select(lo.alias("lo"), hi.alias("hi"), w.alias("w"), (w * F.col(target)).alias("wy")).where("lo <= hi")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("s")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("s"))))
    steps = ranged.select("w", "wy", ends.alias("e")).groupBy(F.col("e.at").alias("window_id")).agg(F.sum("e.s").alias("n"), F.sum(F.col("w") * F.col("e.s")).alias("w"), F.sum(F.col("wy") * F.col("e.s")).alias("wy"))
    run = Window.partitionBy(F.lit(0)).orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    every = jobs.sparkSession.range(0, g.n, 1, 1).select(F.col("id").cast("int").alias("window_id")).join(steps, "window_id", "left")
    sums = every.select("window_id", F.sum("n").over(run).alias("n_train"), F.sum("w").over(run).alias("w"), F.sum("wy").over(run).alias("wy"))
    return sums.where("n_train > 0").select("window_id", "n_train", (F.col("wy") / F.col("w")).alias("mean"))


def fixed_split(jobs: DataFrame, fraction: float, order: list[str]) -> DataFrame:
    """jobs with row_idx and is_test: the first part trains, the rest (all if none is left) tests."""
    ranked = row_index(jobs, order)
    n = ranked.count()
    n_train = max(1, int(n * fraction))
    return ranked.withColumn("is_train", F.col("row_idx") < n_train).withColumn("is_test", (F.col("row_idx") >= n_train) | F.lit(n_train >= n))

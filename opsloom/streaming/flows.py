"""Structured Streaming forms: volume and gaps, event pairs, users' histories, rolling retraining.

Each is a function from a streaming (or batch) DataFrame to another; the batch operators are what
they are tested against.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_volume(jobs: DataFrame, time: str = "submit_time", late: str = "1 day") -> DataFrame:
    """day, n of tumbling days; rows later than the watermark are left out."""
    return jobs.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "n")


def sliding_volume(jobs: DataFrame, time: str = "submit_time", days: int = 3, late: str = "1 day") -> DataFrame:
    return jobs.withWatermark(time, late).groupBy(F.window(time, f"{days} days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def active_spells(jobs: DataFrame, key: str, time: str = "submit_time", quiet: str = "3 days", late: str = "1 day") -> DataFrame:
    """key, start, end, n: spells of submissions with no pause of quiet between them; what lies between two is a gap."""
    return jobs.withWatermark(time, late).groupBy(key, F.session_window(time, quiet).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(jobs: DataFrame, key: str = "job_id", time: str = "submit_time", late: str = "1 day") -> DataFrame:
    return jobs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def pair_events(starts: DataFrame, ends: DataFrame, *, key: str = "job_id", late: str = "1 day", longest: str = "30 days") -> DataFrame:
    """starts (key, start_time) and ends (key, end_time) joined as both streams go on."""
    a = starts.withWatermark("start_time", late)
    b = ends.withColumnRenamed(key, "__key").withWatermark("end_time", late)
    on = (a[key] == b["__key"]) & (b["end_time"] >= a["start_time"]) & (b["end_time"] <= a["start_time"] + F.expr(f"INTERVAL {longest}"))
    return a.join(b, on).drop("__key")


#: Rows that a user's history gives back at once.
SLICE = 10_000


def user_history_mean(jobs: DataFrame, *, user: str = "user", time: str = "submit_time", key: str = "job_id", target: str = "runtime_seconds", theta: int = 50) -> DataFrame:
    """user, key, y_true, y_pred, n_context: the mean of the user's last theta jobs before each, kept as state.

    Means are over whole millionths, so they are those of history.context_mean (targets below 2^53 millionths); a job without a target counts as one of the
    theta and not in the mean.  The state is theta numbers a user.  A user's rows of one batch are held as arrays of
    32 bytes a row while they are sorted; maxFilesPerTrigger and the like bound a batch.
    """

    def step(group: tuple, frames, state: GroupState):
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([time, key])
        known = np.concatenate([np.array([v is not None for v in past], bool), rows["micros"].notna().to_numpy()])
        micros = np.concatenate([np.array([v or 0 for v in past], np.int64), rows["micros"].fillna(0).to_numpy(np.int64)])
        # Sums of the rows before each place, whole numbers, so a difference of two is exact.
        total, count = (np.concatenate([[0], np.cumsum(x)]) for x in (micros, known))
        to = np.arange(len(past), len(micros))
        start = np.maximum(0, to - theta)
        n = count[to] - count[start]
        mean = np.where(n > 0, (total[to] - total[start]) / 1e6 / np.maximum(n, 1), np.nan)
        last = slice(max(0, len(micros) - theta), None)
        state.update(([int(v) if there else None for v, there in zip(micros[last], known[last])],))
        out = pd.DataFrame({"user": group[0], "key": rows[key].to_numpy(), "y_true": rows[target].to_numpy(), "y_pred": mean, "n_context": n.astype(np.int32)})
        for at in range(0, len(out), SLICE):
            yield out.iloc[at : at + SLICE]

    kinds = dict(jobs.dtypes)
    schema = f"user {kinds[user]}, key {kinds[key]}, y_true double, y_pred double, n_context int"
    micros = (F.col(target).cast("decimal(28,6)") * 1_000_000).cast("bigint")
    return jobs.select(user, time, key, F.col(target).cast("double").alias(target), micros.alias("micros")).groupBy(user).applyInPandasWithState(step, schema, "past array<bigint>", "append", GroupStateTimeout.NoTimeout)


def retrain(jobs: DataFrame, fit: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Calls fit(batch, number) for each micro-batch; all that is there if every is None, else at that interval."""
    writer = jobs.writeStream.foreachBatch(fit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_available(out: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there, as a table in memory: for tests and small results."""
    out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.table(name)


def run_table(out: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there, written below a folder that all executors share, as a table.

    mode: append for rows that never change, complete for a whole result that each batch replaces.
    """
    spark, path = out.sparkSession, f"{folder}/rows"
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)

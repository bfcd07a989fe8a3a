"""Streams against the batch operators on the same input."""

import pytest
from pyspark.sql import functions as F

from opsloom.operators import history
from opsloom.sources.readers import tiny_jobs
from opsloom.streaming import flows, once


def stream(spark, tmp_path):
    jobs = tiny_jobs(spark).withColumnRenamed("partition", "user")
    jobs.write.parquet(str(tmp_path / "in"))
    return jobs, spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in"))


def test_daily_volume(spark, tmp_path):
    jobs, s = stream(spark, tmp_path)
    got = flows.run_available(flows.daily_volume(s), "volume", str(tmp_path / "c"), "complete")
    assert sorted((str(r.day), r.n) for r in got.collect()) == sorted((str(r.day), r["count"]) for r in jobs.groupBy(F.to_date("submit_time").alias("day")).count().collect())


def test_history(spark, tmp_path):
    jobs, s = stream(spark, tmp_path)
    got = {r.key: (r.n_context, r.y_pred) for r in flows.run_available(flows.user_history_mean(s, theta=5), "past", str(tmp_path / "c"), "append").collect()}
    batch = history.context_mean(jobs, user="user", order=["submit_time", "job_id"], target="runtime_seconds", theta=5)
    assert got == {r.job_id: (r.n_context, r.y_pred) for r in batch.collect()}


def test_history_of_a_busy_user_over_two_batches(spark, tmp_path):
    """200,000 rows of one user, some without a target, in two batches: the means of the batch operator, to the last bit."""
    i = F.col("id")
    value = F.when(F.pmod(F.xxhash64(i), F.lit(10)) > 0, F.pmod(F.xxhash64(i, F.lit(1)), F.lit(10**9)) / 1e5)
    jobs = spark.range(200_000).select(i.alias("job_id"), F.timestamp_seconds(F.floor(i / 3)).alias("submit_time"), F.when(i % 50 == 0, "b").otherwise("a").alias("user"), value.alias("runtime_seconds"))
    source, got = str(tmp_path / "in"), None
    s = None
    for part in (jobs.where("job_id < 100000"), jobs.where("job_id >= 100000")):
        part.write.mode("append").parquet(source)
        s = s if s is not None else spark.readStream.schema(jobs.schema).parquet(source)
        got = flows.run_table(flows.user_history_mean(s, theta=7), str(tmp_path / "out"))
    batch = history.context_mean(jobs, user="user", order=["submit_time", "job_id"], target="runtime_seconds", theta=7)
    same = got.join(batch, got["key"] == batch["job_id"]).where(got["y_pred"].eqNullSafe(batch["y_pred"]) & (got["n_context"] == batch["n_context"]))
    assert got.count() == 200_000 and same.count() == 200_000


def test_retrain(spark, tmp_path):
    _, s = stream(spark, tmp_path)
    seen = []
    flows.retrain(s, lambda batch, k: seen.append(batch.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == 30


def test_pairs(spark, tmp_path):
    jobs = tiny_jobs(spark)
    jobs.select("job_id", "start_time").write.parquet(str(tmp_path / "a"))
    jobs.where("job_id % 3 = 0").select("job_id", "end_time").write.parquet(str(tmp_path / "b"))
    a = spark.readStream.schema("job_id bigint, start_time timestamp").parquet(str(tmp_path / "a"))
    b = spark.readStream.schema("job_id bigint, end_time timestamp").parquet(str(tmp_path / "b"))
    got = flows.run_table(flows.pair_events(a, b), str(tmp_path / "out"))
    assert {(r.job_id, r.start_time, r.end_time) for r in got.collect()} == {(r.job_id, r.start_time, r.end_time) for r in jobs.where("job_id % 3 = 0").collect()}


def test_duplicates_within_the_watermark(spark, tmp_path):
    _, s = stream(spark, tmp_path)
    assert flows.run_table(flows.first_seen(s.union(s)), str(tmp_path / "out")).count() == 30


def test_a_retried_batch_adds_nothing(spark, tmp_path):
    """A batch dies after its rows were committed and before its checkpoint; the retry leaves them single."""
    _, s = stream(spark, tmp_path)
    folder, died = str(tmp_path / "out"), []

    def fit(batch, number):
        return batch.select("job_id")

    def dying(batch, number):
        once.append_once(fit(batch, number), f"{folder}/models", "model", number)
        died.append(number)
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        flows.retrain(s, dying, f"{folder}/checkpoint").awaitTermination()
    assert died == [0]
    once.retrain(s, fit, folder).awaitTermination()
    rows = once.read(spark, f"{folder}/models").collect()
    assert len(rows) == len({r.job_id for r in rows}) == 30


def test_one_of_two_writers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        told = list(pool.map(lambda k: once.append_once(spark.range(k, k + 5), folder, "q", 7), range(4)))
    assert told.count(True) == 1 and once.read(spark, folder).count() == 5
    spark.range(3).write.parquet(f"{folder}/.draft-x")
    assert once.read(spark, folder).count() == 5 and once.clear_drafts(spark, folder) == 1
    assert once.append_once(spark.range(2), folder, "q", 8) and once.read(spark, folder).count() == 7

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom import catalog_queries
from opsloom.operators import history, mapping, quality, ranks, similarity, summaries
from opsloom.plans import characterize, prepare
from opsloom.plans.validate import ValidationError, validate
from opsloom.sources import fetch, readers


def test_filters(spark):
    df = spark.createDataFrame([(1, 4.0), (2, -1.0), (3, None), (4, 8.0)], "job_id int, v double")
    assert [r.job_id for r in mapping.apply_filters(df, {"require_positive": ["v", "w"]}).orderBy("job_id").collect()] == [1, 3, 4]
    assert mapping.apply_filters(df, {"require_nonnull": ["v"]}).count() == 3
    with pytest.raises(ValueError, match="unknown filter"):
        mapping.apply_filters(df, {"other": 1})


def test_projection_derives_and_numbers(spark):
    df = spark.createDataFrame([("a", 100, 200), ("b", 100, 400)], "n string, s int, e int")
    rule = {"job_id": {"synthesize": "row_index"}, "start_time": {"from": "s", "type": "timestamp", "format": "epoch_s"}, "end_time": {"from": "e", "type": "timestamp", "format": "epoch_s"}, "queue": {"from": "gone"}}
    out = mapping.project(df, rule, ["n"])
    assert [(r.job_id, r.runtime_seconds, r.queue) for r in out.orderBy("job_id").collect()] == [(0, 100.0, None), (1, 300.0, None)]
    assert "queue" not in mapping.drop_empty_columns(out).columns
    rule |= {"end_time": rule["end_time"], "runtime_seconds": {"derive": "end_minus_start"}}
    made = prepare.target(df, {"mapping": rule, "select": ["queue", "job_id", "start_time", "end_time", "runtime_seconds"]}, ["n"])
    assert made.columns[0] == "queue" and made.count() == 2 and made.where("queue is not null").count() == 0
    with pytest.raises(ValueError, match="runtime_seconds"):
        mapping.select(out, ["job_id", "start_time", "end_time"])


def test_samples(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 4).cast("string").alias("g"))
    for strategy in ("head", "random", "stratified"):
        got = mapping.sample(df, ["i"], rows=20, strategy=strategy, by=["g"], seed=1)
        assert got.count() == 20 and got.columns == ["i", "g"]
    assert {r["count"] for r in mapping.sample(df, ["i"], rows=20, strategy="stratified", by=["g"]).groupBy("g").count().collect()} == {5}


def test_gaps_and_window(spark):
    days = [50] * 30 + [0] * 4 + [50] * 6
    df = spark.createDataFrame([(k, n) for k, n in enumerate(days)], "k int, n bigint").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("day"), "n")
    found = characterize.gaps(df)
    assert [(str(r.gap_start), r.days) for r in found.collect()] == [("2024-01-31", 4)]
    w = characterize.select_window(df, found, train_days=8, test_days=2).first()
    assert w.healthy and str(w.window_end) == "2024-01-30" and w.n_rows == 500
    assert not characterize.select_window(df, found, train_days=30, test_days=8).first().healthy


def test_validation(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "2024-01-02", 5.0), ("2", "2024-01-03", "2024-01-02", -1.0), ("", None, None, None)], "job_id string, s string, e string, runtime_seconds double")
    df = df.select("job_id", F.col("s").cast("timestamp").alias("start_time"), F.col("e").cast("timestamp").alias("end_time"), "runtime_seconds")
    r = validate(df)
    assert (r["rows"], r["bad_rows"], r["issues"]["start_after_end"]["count"], r["issues"]["negative_runtime"]["count"]) == (3, 2, 1, 1)
    with pytest.raises(ValidationError):
        validate(df, strict=True)
    assert {r["issue"]: r["count"] for r in quality.issue_summary(df, "job_id").collect()}["missing_job_id"] == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.swf").write_text("; UnixStartTime: 1000000000\n1 0 10 100 4 -1 -1 4 200 -1 1 3 1 1 1 1 -1 -1\n2 5 -1 -1\n3 9\n")
    rows = readers.swf(spark, str(tmp_path / "a.swf")).select("job_number", F.unix_timestamp("start_time").alias("s"), F.unix_timestamp("end_time").alias("e"), "run_time").orderBy("job_number").collect()
    assert [(r.job_number, r.s, r.e, r.run_time) for r in rows] == [(1, 1000000010, 1000000110, 100), (2, 1000000005, None, None)]
    (tmp_path / "j.json").write_text('[{"platform": "p", "w": {"x": 1}, "tasklist": [{"task_id": 1, "cpus": 2, "nodes": [1]}, {"task_id": "b", "cpus": 3, "nodes": []}]}]')
    out = readers.json(spark, str(tmp_path / "j.json"), record_path="tasklist")
    assert sorted(out.columns) == ["cpus", "platform", "task_id"] and sorted(r.task_id for r in out.collect()) == ["1", "b"]
    # A record's value wins where it has the key, even as null; a nested one is none; else the parent's stands.
    (tmp_path / "k.json").write_text('[{"g":"a","r":1,"tasklist":[{"x":1},{"x":2,"g":null},{"x":4,"r":"s"},null]},{"g":"b","tasklist":[{"x":3,"g":"own"}]},{"g":"c"},{"g":"d","tasklist":null}]')
    rows = readers.json(spark, str(tmp_path / "k.json"), record_path="tasklist").collect()
    assert sorted((r.x, r.g, r.r) for r in rows) == [(1, "a", "1"), (2, None, "1"), (3, "own", None), (4, "a", "s")]
    assert [r.g for r in readers.json(spark, str(tmp_path / "k.json")).orderBy("g").collect()] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        readers.json(spark, str(tmp_path / "k.json"), record_path="none")
    (tmp_path / "c.log").write_text("[2024-01-01T00:00:00] x Allocate JobId=1 NodeList=node1 #CPUs=2 Partition=debug\n[2024-01-01T00:01:00] _job_complete: JobId=1 done\n[2024-01-01T00:01:00] _job_complete: JobId=2 done\n")
    assert [(r.job_id, r.runtime_seconds, r.node_list) for r in readers.scheduler_log_file(spark, str(tmp_path / "c.log")).collect()] == [(1, 60.0, "node1")]


def test_archives_and_prepare(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x/jobs.csv", "jobid,sdt,edt,usr\n1,100,200,a\n2,100,90,b\n3,,5,c\n")
        z.writestr("x/readme.md", "no")
    d = {
        "dataset_id": "demo", "source": {"kind": "manual", "resources": [{"filename": "d.zip"}]}, "decode": {"format": "csv"},
        "targets": [{"domain": "runtime", "mapping": {"job_id": {"from": "jobid"}, "start_time": {"from": "sdt", "type": "timestamp", "format": "epoch_s"}, "end_time": {"from": "edt", "type": "timestamp", "format": "epoch_s"}, "user": {"from": "usr", "type": "hash_identifier"}}, "filter": {"require_end_after_start": True}}],
    }
    made = prepare.prepare(spark, d, str(tmp_path / "cache"), str(tmp_path / "out"), manual=str(tmp_path))
    assert made["runtime"]["rows"] == 1
    with pytest.raises(fetch.FetchError):
        fetch.fetch("other", {"kind": "manual", "resources": [{"filename": "z"}]}, str(tmp_path), offline=True)
    assert fetch.parse_size("2GiB") == 2 * 1024**3 and fetch.parse_size("5GB") == 5 * 10**9


def test_neighbour_weights(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 10.0), (0, 1, 0.6, 20.0), (0, 2, -0.3, 10.0), (0, 2, 0.8, 20.0), (0, 3, 0.0, 10.0), (0, 3, 0.0, 20.0)], "g int, query int, similarity double, value double")
    got = {r.query: r.y_pred for r in similarity.weighted_prediction(df, "g").collect()}
    assert got == pytest.approx({1: 0.625 * 10 + 0.375 * 20, 2: 20.0, 3: 15.0})


def test_texts_are_made_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "job_id int, partition string")
    out = prepare.embed(df, str(tmp_path / "v"), lambda t: similarity.hash_encode(t, 8))
    assert out.count() == 3 and spark.read.parquet(str(tmp_path / "v")).count() == 2
    assert prepare.embed(df, str(tmp_path / "v"), lambda t: similarity.hash_encode(t, 8)).count() == 3
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    for name in similarity.AFTERWARDS:
        with pytest.raises(ValueError, match="afterwards"):
            similarity.serialise(df.withColumn(name, F.lit("x")), extra=[name])


def test_texts_of_jobs(spark):
    """All concepts in their order, the first present name of each, and extra columns cut."""
    df = spark.sql("""SELECT 'sim' AS name, '' AS job_name, 'gpu' AS partition, 'high' AS qos, 'acc' AS account, 'u1' AS user, 'bio' AS science_field_short, 'big' AS machine, 86400.0D AS requested_seconds,
      2 AS num_nodes_req, 64L AS processors_requested, 8 AS num_gpus_req, '4G' AS mem_req, timestamp'2024-01-01 13:45:00' AS submit_time, '#!/bin/sh' AS script, 'COMPLETED' AS job_state""")
    prose = df.select(similarity.serialise(df, extra=["script"], limit=5).alias("t")).first().t
    assert prose == (
        "An HPC batch job named sim on the gpu partition (queue high), requesting 2 nodes, 64 cores, 8 GPUs, 4G memory, a walltime limit of 86400.0, charged to account acc, submitted by u1, in bio, on big, submitted on Monday 13:00. script:\n#!/bi"
    )
    kv = df.select(similarity.serialise(df, form="kv", instruction="find").alias("t")).first().t
    assert kv.split("\n") == [
        "Instruct: find", "Query: job name: sim", "partition: gpu", "queue: high", "account: acc", "user: u1", "science field: bio", "machine: big", "requested walltime: 86400.0", "requested nodes: 2", "requested cores: 64",
        "requested gpus: 8", "requested memory: 4G", "submitted: Monday 13:00",
    ]
    assert similarity.concepts(df)[:2] == ["job name", "partition"] and "COMPLETED" not in prose + kv
    assert similarity.text_columns(df) == ["account", "machine", "name", "partition", "qos", "science_field_short", "script", "user"]
    assert df.select(similarity.serialise(df.select(F.lit(2e7).alias("requested_seconds")), form="kv")) is not None


def test_quantiles_and_running_sums(spark):
    r = random.Random(2)
    values = [r.choice([1.5, 2.0, r.random() * 100]) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7)
    at = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    expected = df.agg(F.percentile("v", F.array(*map(F.lit, at))).alias("p")).first().p
    assert ranks.quantiles(df, "v", at).first().q == pytest.approx(expected, abs=1e-12)
    assert ranks.quantiles(df.where("v is null"), "v", at).first().q is None
    rows = ranks.running(df.where("v is not null").withColumn("n", F.lit(2)), ["v"], "n", "upto").collect()
    assert [x.upto for x in sorted(rows, key=lambda x: x.upto)] == [2 * k for k in range(1, 998)] and all(a.v <= b.v for a, b in zip(*(lambda s: (s, s[1:]))(sorted(rows, key=lambda x: x.upto))))


def test_bins(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, 99.0), (4, None), (5, -2.0)], "i int, v double").withColumn("e", F.array(F.lit(10.0), F.lit(20.0)))
    assert [r.b for r in df.select("i", history.bin_of(F.col("v"), F.col("e")).alias("b")).orderBy("i").collect()] == [0, 0, 1, -1, -1]


def test_fingerprint_ignores_order(spark):
    df = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    one = summaries.fingerprint(df).first()
    assert summaries.fingerprint(df.orderBy(F.desc("a")).repartition(7).select("b", "a")).first() == one
    assert summaries.fingerprint(df.where("a > 0")).first() != one
    assert summaries.unit_name("duration", " Mins ") == "minutes" and summaries.unit_name("duration", "H:M:S") == "hh:mm:ss" and summaries.unit_name("timestamp", "ISO-8601") == "iso8601"
    with pytest.raises(ValueError, match="memory"):
        summaries.unit_name("memory", "words")


def test_digest_encoder(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "i int, t string").withColumn("v", similarity.digest_encode(16)(F.col("t")))
    got = {r.i: r.v for r in df.collect()}
    assert sorted(x for x in got[1] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and not any(got[2]) and not any(got[3])


def test_gaps_and_windows_of_each_group(spark):
    """As the ungrouped functions on the dense series of each group, also of a busy one whose low days count as missing."""
    r = random.Random(4)
    start = date(2024, 1, 1)
    active = {g: {d: r.choice([1, 2, 90, 100, 110] if g == 1 else [1, 2]) for d in range(60) if d in (0, 59) or r.random() < share} for g, share in ((1, 0.9), (2, 0.5), (3, 0.1))} | {4: {7: 1}}
    counts = spark.createDataFrame([(g, start + timedelta(d), n) for g, days in active.items() for d, n in days.items()], "g int, day date, n bigint")
    missing = characterize.grouped_gaps(counts, "g")
    found = {g: sorted(tuple(x)[1:] for x in missing.where(F.col("g") == g).collect()) for g in active}
    picked = {x.g: tuple(x)[1:] for x in characterize.grouped_select_window(counts, missing, "g", train_days=3, test_days=2).collect()}
    clear = {g: {x.e for x in characterize.grouped_clear_windows(counts, missing, "g").where(F.col("g") == g).collect()} for g in active}
    for g, days in active.items():
        dense = spark.createDataFrame([(start + timedelta(d), days.get(d, 0)) for d in range(min(days), max(days) + 1)], "day date, n bigint")
        blocks = characterize.gaps(dense)
        gone = sorted(tuple(x) for x in blocks.collect())
        assert found[g] == gone
        assert picked[g] == tuple(characterize.select_window(dense, blocks, train_days=3, test_days=2).first())
        ends = [start + timedelta(d) for d in range(min(days), max(days) + 1)]
        assert clear[g] == {e for e in ends if not any(a <= e and b >= e - timedelta(4) for a, b, _ in gone)}
    assert found[1] and found[3] and not found[4]


def test_neighbours_are_searched_in_all_rows(spark, tmp_path):
    """The exact copy of a query whose id differs from it modulo 4, and no other group to hide it in."""
    rows = [(i, [1.0, float(i)], float(i)) for i in range(1, 8)] + [(100, [5.0, -1.0], 0.0), (103, [5.0, -1.0], 7.0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label double").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = [tuple(x) for x in catalog_queries.dense_knn_all(spark, str(tmp_path)).orderBy("rank").collect()]
    assert found[0] == (100, 103, 1.0, 1) and len(found) == 5


def test_workload_files_grow_in_number(spark, monkeypatch):
    """read_swf's files stay small, each with its header first, and all lines come back."""
    monkeypatch.setattr(catalog_queries, "SWF_LINES", 100)
    asked, swf = [], catalog_queries.readers.swf
    monkeypatch.setattr(catalog_queries.readers, "swf", lambda s, *paths: asked.extend(paths) or swf(s, *paths))
    got = catalog_queries.read_swf(spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("job_number"), (F.unix_micros(F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))) + F.col("o_orderkey") % 100 * 1000000).alias("start_us"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, orders.collect()))
    lines = spark.read.text(asked).select(F.col("_metadata.file_path").alias("file"), F.col("value").startswith(";").alias("head"), F.monotonically_increasing_id().alias("nr"))
    files = lines.groupBy("file").agg(F.count("*").alias("n"), F.count_if("head").alias("heads"), F.min_by("head", "nr").alias("first")).collect()
    assert len(files) >= orders.count() // 100 and all(r.first and r.heads == 1 and r.n <= 200 for r in files)

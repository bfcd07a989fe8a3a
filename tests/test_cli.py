import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml
from pyspark.sql import functions as F

from opsloom import storage
from opsloom.__main__ import COMMANDS, main
from opsloom.plans import catalog, evaluate, families, prepare, reports, traces, validate
from opsloom.sources import readers
from opsloom.sources.readers import tiny_embedded_jobs, tiny_jobs


@pytest.fixture
def run(spark, capsys):
    def call(*args):
        capsys.readouterr()
        main([str(a) for a in args])
        return json.loads(capsys.readouterr().out)

    return call


def test_commands(spark, tmp_path, run):
    t = tmp_path / "t.parquet"
    tiny_jobs(spark).write.parquet(str(t))
    assert run("validate", t)["bad_rows"] == 0 and (tmp_path / "t.parquet.quality.json").exists()
    assert run("characterize", t, tmp_path / "cards", "tiny")["n_rows"] == 30 and "UNHEALTHY" not in (tmp_path / "cards/tiny.md").read_text()
    recipe = {"model": {"id": "mean"}, "metrics": [{"name": n, "target": "runtime_seconds"} for n in ("mae", "rmse")], "split": {"method": "rolling", "n_windows": 3, "training_lookback_days": 2}}
    (tmp_path / "r.yml").write_text(yaml.safe_dump(recipe))
    assert run("evaluate", tmp_path / "r.yml", t, tmp_path / "runs/a")["mae"] > 0
    assert run("baseline", t, tmp_path / "runs/b", "--windows", 2)["mae"] > 0
    assert run("validate", tmp_path / "runs/a")["kind"] == "bundle"
    (tmp_path / "runs/broken").mkdir()
    (tmp_path / "runs/broken/result.json").write_text("{")
    board = run("leaderboard", tmp_path / "runs", tmp_path / "board")
    assert [e["run"] for e in board["entries"]] == ["a", "b"] and set(sum((e["best"] for e in board["entries"]), [])) == {"mae", "rmse"}
    assert "<b" in (tmp_path / "board/leaderboard.html").read_text() and json.loads((tmp_path / "board/leaderboard.json").read_text())["entries"]
    told = run("analyze", t, tmp_path / "analysis")
    assert told["quality"]["rows"] == 30 and [f["field"] for f in told["fields"] if f["confidence"] == 0] == ["node_list"] and (tmp_path / "analysis/analysis.html").exists()
    cut = run("slice", t, tmp_path / "slice", "2026-01-02", "2026-01-02", "--extra-days", 1, "--dataset", "tiny")
    assert cut["effective_window"] == {"start": "2026-01-01", "end": "2026-01-02"} and cut["rows"] == 30
    plan = run("plan", tmp_path / "cards", tmp_path / "plan", "--slices", tmp_path / "slice", "--overrides", json.dumps({"n_windows": 2, "params": {"numTrees": 2, "maxDepth": 2}}))
    assert {c["rows"] for c in plan["cells"]} == {30} and plan["embed"] == ["tiny"] and len(plan["cells"]) == sum(s == "rolling" for _, s in evaluate.MODELS)
    made = [c for c in plan["cells"] if c["model"] == "random_forest"]
    assert run("evaluate", made[0]["recipe"].replace("recipe.json", "recipe.json"), t, tmp_path / "runs/c")["mae"] >= 0 if made[0]["status"] == "cell" else True
    assert run("diagnose", t, tmp_path / "d.json")["categories"]["partition"]["cardinality"] == 2 and (tmp_path / "d.json").exists()
    assert len(run("record-hash", t)["digest"]) > 10 and run("suggest", t)[0]["rank"] == 1
    assert run("embed", t, tmp_path / "v", tmp_path / "te")["dim"] == 256 and spark.read.parquet(str(tmp_path / "te")).count() == 30
    with pytest.raises(SystemExit):
        main(["nonsense"])
    assert len(COMMANDS) == 19


def test_registry_commands(spark, tmp_path, run):
    assert len(run("browse", "--type", "dataset")) == 24 and run("info", "pwa_ricc")["input_schema"] == "swf"
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"id": "model.x", "type": "model", "tags": ["a"]}, {"id": "dataset.y", "type": "dataset"}]}))
    assert [e["id"] for e in run("browse", "--registry", tmp_path / "r.json", "--tag", "a")] == ["model.x"]
    with pytest.raises(KeyError, match="no such"):
        catalog.info(catalog.own_registry(spark), "nothing")


def test_ingest_commands(spark, tmp_path, run):
    (tmp_path / "a.log").write_text("[2024-01-01T00:00:00] x Allocate JobId=1 NodeList=n1 #CPUs=2 Partition=debug\n[2024-01-01T00:01:00] _job_complete: JobId=1 done\n" + "x" * 5000 + "\n")
    (tmp_path / "b.log").write_text("[2024-01-02T00:00:00] x Allocate JobId=1 NodeList=n9 #CPUs=2 Partition=debug\n[2024-01-02T00:02:00] _job_complete: JobId=1 done\n")
    assert run("ingest-log", tmp_path / "*.log", tmp_path / "l")["rows"] == 1
    row = spark.read.parquet(str(tmp_path / "l/data.parquet")).first()
    assert row.node_list == "n9" and row.runtime_seconds == 120  # the later file has the last word
    prepare.write_mapping(str(tmp_path / "m.yml"), {"job_id": {"from": "id"}, "start_time": {"from": "s", "type": "timestamp", "format": "epoch_sec"}, "end_time": {"from": "e", "type": "timestamp", "format": "epoch_sec"}, "requested_seconds": {"from": "w", "type": "duration", "unit": "mins"}})
    spark.createDataFrame([(1, 100, 200, 3)], "id int, s int, e int, w int").write.parquet(str(tmp_path / "raw"))
    assert run("ingest-parquet", tmp_path / "raw", tmp_path / "m.yml", tmp_path / "o")["rows"] == 1
    row = spark.read.parquet(str(tmp_path / "o/data.parquet")).first()
    assert (row.runtime_seconds, row.requested_seconds) == (100, 180) and run("validate", tmp_path / "o/manifest.json")["kind"] == "manifest"


def test_durations_and_nanoseconds_of_parquet(spark, tmp_path):
    t = pa.table({"d": pa.array([90_000_000_000, None], pa.duration("ns")), "at": pa.array([1_500_000_000_123_456_789, None], pa.timestamp("ns")), "ms": pa.array([1500, 2], pa.duration("ms")), "n": pa.array([1, 2])})
    pq.write_table(t, tmp_path / "x.parquet", version="2.6")
    rows = readers.parquet(spark, str(tmp_path / "x.parquet")).select("d", F.unix_micros("at").alias("at"), "ms", "n").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(90.0, 1_500_000_000_123_456, 1.5, 1), (None, None, 0.002, 2)]


def test_families(spark, tmp_path):
    (tmp_path / "a.swf").write_text("; UnixStartTime: 1000000000\n1 0 10 100 4 -1 -1 4 200 -1 1 3 1 1 1 1 -1 -1\n2 5 1 -1 2 -1 -1 2 60 -1 0 3 1 1 1 1 -1 -1\n")
    d = families.descriptor("demo", "workload_format", [{"filename": "a.swf"}], kind="manual")
    made = prepare.prepare(spark, d, str(tmp_path / "c"), str(tmp_path / "o"), manual=str(tmp_path))
    row = spark.read.parquet(str(tmp_path / "o/demo.job-runtime.parquet")).first()
    assert made["job-runtime"]["rows"] == 1 and row.runtime_seconds == 100 and row.requested_seconds == 200 and row.num_cores_req == 4
    for family in families.FAMILIES:
        prepare.check(families.descriptor("x", family, [{"url": "u", "filename": "f"}], {"job_id": "j", "start_time": "s"}))


def test_traces(spark, tmp_path):
    assert len(traces.TRACES) == 24
    for name in traces.TRACES:
        d = traces.trace(name)
        prepare.check(d)
        assert {"job_id", "submit_time", "start_time", "end_time", "runtime_seconds"} <= set(d["targets"][0]["mapping"]) and d["source"]["resources"]
    names = [r["filename"] for r in traces.trace("fresco_anvil")["source"]["resources"]]
    assert (names[0], names[1], names[6], len(names)) == ("job_accounting_july2022_anon.csv", "job_accounting_aug2022_anon.csv", "job_accounting_jan2023_anon.csv", 11)


def test_traces_are_prepared(spark, tmp_path):
    """One trace of each format, from files as their archives have them."""
    conte = ["jobID", "qtime", "start", "end", "resources_used.walltime", "Resource_List.walltime", "Resource_List.ncpus", "Resource_List.nodect", "queue", "Exit_status", "user", "group", "other"]
    (tmp_path / "conte").mkdir()
    for k, r in enumerate(traces.trace("fresco_conte")["source"]["resources"]):
        (tmp_path / "conte" / r["filename"]).write_text(",".join(conte) + f"\n{k},03/01/2015 07:00:00,03/01/2015 07:10:00,03/01/2015 08:10:00,3600,7200,16,1,q,0,u,g,x\n")
    (tmp_path / "atlas").mkdir()
    (tmp_path / "atlas/mustang_release_v1.0beta.csv.gz").write_bytes(__import__("gzip").compress(b"user_ID,group_ID,submit_time,start_time,end_time,wallclock_limit,job_status,node_count,tasks_requested\n7,8,2011-10-25 07:00:00-06:00,2011-10-25 07:10:00-06:00,2011-10-25 08:10:00-06:00,0 days 16:00:00.000000000,COMPLETED,2,48\n"))
    (tmp_path / "djc").mkdir()
    head = [c for c, _ in traces.COLUMNS["job_composite"].values()]
    for k in (1, 2):
        (tmp_path / f"djc/ANL-ALCF-DJC-THETA_{k}.csv").write_text(",".join(head) + f"\nj{k},2020-01-01 00:00:00,2020-01-01 00:01:00,2020-01-01 00:02:00,60,3600,64,64,1,1,q,0,u,p,theta,INCITE,Bio\n")
    (tmp_path / "ic2").mkdir()
    for name in ("all_workloads_ic2.json", "all_workloads_polaris.json", "all_workloads_aws.json"):
        (tmp_path / "ic2" / name).write_text(json.dumps([{"platform": name, "tasklist": [{"task_id": "1", "submit_time": 10, "start_time": 20, "finish_time": 50, "cpus": 2, "gpus": 0, "app_name": "a"}]}]))
    for name, folder, n, seconds, asked in (("fresco_conte", "conte", 12, 3600, 7200), ("atlas_mustang", "atlas", 1, 3600, 57600), ("alcf_djc_theta", "djc", 2, 60, 3600), ("ic2", "ic2", 3, 30, None)):
        d = traces.trace(name)
        if name == "alcf_djc_theta":
            d["source"]["resources"] = [{"filename": "ANL-ALCF-DJC-THETA_*.csv"}]
        made = prepare.prepare(spark, d, str(tmp_path / "cache"), str(tmp_path / "out"), manual=str(tmp_path / folder))
        table = spark.read.parquet(str(tmp_path / f"out/{name}.job-runtime.parquet"))
        assert made["job-runtime"]["rows"] == n and {r.runtime_seconds for r in table.collect()} == {seconds}
        assert asked is None or {r.requested_seconds for r in table.collect()} == {asked}


def test_broken_files_are_told(spark, tmp_path):
    storage.write_json(spark, str(tmp_path / "manifest.json"), {"rows": 1})
    with pytest.raises(prepare.DescriptorError, match="lacks"):
        validate.check_path(spark, str(tmp_path / "manifest.json"))
    with pytest.raises(FileNotFoundError):
        validate.check_path(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileExistsError):
        storage.write_text(spark, str(tmp_path / "manifest.json"), "x")
    assert reports.effective_start("2024-03-01", 1) == "2024-02-29"
    with pytest.raises(ValueError, match="several lengths"):
        readers.check_vectors(tiny_embedded_jobs(spark).withColumn("embedding", F.when(F.col("job_id") > 1001, F.col("embedding"))), "embedding")

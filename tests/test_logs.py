"""Controller logs and workload files as data sources: pieces, filters, growing files."""

import gzip

import pytest
from pyspark.sql import functions as F

from opsloom.sources import logs, readers
from opsloom.streaming import flows


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    logs.register(spark)


def lines(n):
    """Jobs whose lines are told again, jobs without an end, odd lines, an invalid time."""
    out = []
    for i in range(n):
        day = f"2024-01-{i % 28 + 1:02}"
        out += [f"[{day}T00:00:00.5] x Allocate JobId={i} NodeList=n{i % 7} #CPUs={i % 4} Partition={'ab'[i % 2]}", f"[{day}T00:0{i % 10}:00] debug: nothing of JobId={i}", "é" * (i % 5)]
        if i % 3:
            out.append(f"[{day}T01:00:00] _job_complete: JobId={i} done")
        if i % 5 == 0:
            out.append(f"[{day}T02:00:00] x Allocate JobId={i} NodeList=again #CPUs=9 Partition=c")
    return [*out, "[no time] x Allocate JobId=1 NodeList=z #CPUs=1 Partition=a"]


def table(df):
    cols = ["job_id", "start_time", "node_list", "allocated_cpus", "partition", "end_time", "runtime_seconds"]
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("piece", [31, 1 << 20])
def test_pieces_of_every_size_give_the_same_events(spark, tmp_path, piece):
    own = lines(8) if piece < 1000 else lines(300)
    (tmp_path / "a.log").write_text("\n".join(own))
    df = spark.read.format("controller_log").option("pieceBytes", piece).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == -(-len("\n".join(own).encode()) // piece)
    assert table(logs.jobs(df)) == table(readers.scheduler_log_file(spark, str(tmp_path / "a.log")))
    raw = (tmp_path / "a.log").read_bytes()
    for r in df.collect():
        assert f"JobId={r.job_id} ".encode() in raw[r.position :].split(b"\n")[0] + b" " and (r.position == 0 or raw[r.position - 1 : r.position] == b"\n")


def test_filters_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(lines(100)) + "\n")
    df = spark.read.format("controller_log").load(str(tmp_path))
    rows = df.collect()
    for condition, keep in [
        ("partition = 'b' and time >= timestamp'2024-01-10 00:00:00'", lambda r: r.partition == "b" and r.time is not None and r.time.day >= 10),
        ("job_id in (3, 4) and event = 'complete'", lambda r: r.job_id in (3, 4) and r.event == "complete"),
        ("time < timestamp'2024-01-03 00:00:00'", lambda r: r.time is not None and r.time.day < 3),
        ("length(partition) = 1 and allocated_cpus > 2", lambda r: r.partition is not None and r.allocated_cpus > 2),
    ]:
        got = df.where(condition)
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in rows if keep(r))
    for condition in ("partition = 'b'", "time >= timestamp'2024-01-10 00:00:00'"):
        assert " Filter " not in df.where(condition)._jdf.queryExecution().executedPlan().toString()


def test_a_file_in_ten_pieces_gives_the_jobs_of_one_read(spark, tmp_path):
    """The file grows, once in the middle of a line, and a second file comes; each run goes on where the last one stopped."""
    whole = ("\n".join(lines(200)) + "\n").encode()
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.format("controller_log").option("pieceBytes", 3000).load(str(folder))
    cut = len(whole) // 10 + 1
    for k in range(10):
        with open(folder / "a.log", "ab") as f:
            f.write(whole[k * cut : (k + 1) * cut])
        if k == 5:
            (folder / "b.log.gz").write_bytes(gzip.compress(b"[2024-02-01T00:00:00] x Allocate JobId=7 NodeList=late #CPUs=1 Partition=z\n"))
        got = flows.run_table(stream, str(tmp_path / "out"))
    once = spark.read.format("controller_log").load(str(folder))
    assert sorted(map(str, got.collect())) == sorted(map(str, once.collect()))
    assert table(logs.jobs(got)) == table(logs.jobs(once)) and logs.jobs(got).where("job_id = 7").first().node_list == "late"
    whole_result = flows.run_table(logs.jobs(stream), str(tmp_path / "jobs"), "complete")
    assert table(whole_result) == table(logs.jobs(once))
    (folder / "a.log").write_bytes(whole[:100])
    with pytest.raises(Exception, match="was cut"):
        flows.run_table(stream, str(tmp_path / "out"))


def test_workload_files(spark, tmp_path):
    body = "".join(f"{i} {i * 7} {i % 3 - 1} {i % 50} 4 -1 x 4 200\n" for i in range(400)) + "3 9\n\n"
    (tmp_path / "a.swf").write_text("; Version: 2\n; UnixStartTime: 1000000000\n" + body)
    (tmp_path / "b.swf").write_text(body)
    df = spark.read.format("workload_format").option("pieceBytes", 500).load(str(tmp_path))
    known = readers.swf(spark, str(tmp_path / "a.swf"), str(tmp_path / "b.swf"))
    assert sorted(map(str, df.drop("file", "position").collect())) == sorted(map(str, known.collect()))
    assert df.rdd.getNumPartitions() > 10


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert spark.read.format("controller_log").load(str(tmp_path / "in")).count() == 0
    (tmp_path / "in" / "a.log").write_text("")
    assert logs.jobs(spark.read.format("controller_log").load(str(tmp_path / "in"))).agg(F.count(F.lit(1))).first()[0] == 0
    with pytest.raises(Exception, match="none"):
        spark.read.format("controller_log").load(str(tmp_path / "none")).count()

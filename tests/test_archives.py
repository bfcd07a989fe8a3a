"""Members of archives, unpacked by tasks."""

import gzip
import io
import tarfile
import zipfile

import pytest

from opsloom.sources import archives, readers


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return f"file://{path}"


def tarred(path, members, mode):
    with tarfile.open(path, mode) as t:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    return f"file://{path}"


MEMBERS = {f"d/{k:02}.csv": f"a,b\n{k},x{k}\n" for k in range(50)}


@pytest.mark.parametrize("kind", ["zip", "w", "w:gz", "w:xz"])
def test_fifty_members(spark, tmp_path, kind):
    path = zipped(tmp_path / "a", MEMBERS) if kind == "zip" else tarred(tmp_path / "a", MEMBERS, kind)
    listed = archives.listing(spark, [path]).collect()
    assert {(r.member, r.bytes) for r in listed} == {(n, len(t)) for n, t in MEMBERS.items()} and {r.together for r in listed} == {kind in ("w:gz", "w:xz")}
    files = archives.unpack(spark, [path], "*.csv")
    assert {f.split("/d/")[1]: open(f.removeprefix("file://")).read() for f in files} == {n[2:]: t for n, t in MEMBERS.items()}
    assert sorted(r.a for r in readers.decode(spark, "csv", [path], pattern="d/1*.csv").collect()) == list(range(10, 20))


def test_members_of_one_archive_go_to_many_tasks(spark, tmp_path):
    path = zipped(tmp_path / "a.zip", MEMBERS)
    group = "unpack-test"
    spark.sparkContext.setJobGroup(group, group)
    try:
        archives.unpack(spark, [path])
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) == 50


def test_files_that_are_no_archive_stay_and_bad_names_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\n1\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"a\n2\n"))
    (tmp_path / "empty.csv").write_text("")
    plain = [f"file://{tmp_path}/{n}" for n in ("a.csv", "b.csv.gz", "empty.csv")]
    assert archives.unpack(spark, plain) == plain and archives.unpack(spark, []) == []
    both = [*plain[:2], zipped(tmp_path / "c.zip", {"x/c.csv": "a\n3\n", "x/c.txt": "no", "y.csv": "a\n4\n"})]
    assert sorted(r.a for r in readers.decode(spark, "csv", both, pattern="*.csv").collect()) == [1, 2, 3, 4]
    for name in ("../out.csv", "/out.csv", "x/../../out.csv"):
        with pytest.raises(ValueError, match="outside of itself"):
            archives.unpack(spark, [zipped(tmp_path / "bad.zip", {name: "a"})])
    with pytest.raises(FileNotFoundError):
        readers.decode(spark, "csv", [zipped(tmp_path / "none.zip", {"a.bin": "x"})])
    whole = tarred(tmp_path / "cut.tar", {"a.csv": "a\n" * 5000, "b.csv": "b"}, "w").removeprefix("file://")
    cut = open(whole, "rb").read()[:5000]
    open(whole, "wb").write(cut)
    with pytest.raises(Exception, match="unexpected end of data|truncated|ReadError"):
        archives.unpack(spark, [f"file://{whole}"])


def test_files_with_one_header_are_read_together(spark, tmp_path, monkeypatch):
    """As many reads as headers; an odd name, blank lines before a header, no rows, a folder and a file named twice are read too."""
    members = {f"part {k}.csv": f"a,b\n{k},{k}.5\n" for k in range(20)} | {"none.csv": "a,b\n", "late.csv": "\n \na,b\n20,1\n", "é%20+.csv": "a,b\n21,1\n", "other.csv": "b,a,c\n1.5,5000000000,x\n", "empty.csv": ""}
    path = zipped(tmp_path / "many.zip", members)
    asked, union = [], readers.union
    monkeypatch.setattr(readers, "union", lambda frames: asked.append(len(frames)) or union(frames))
    got = readers.decode(spark, "csv", [path])
    assert asked == [3]  # two headers and the empty file
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert sorted((r.a, r.b, r.c) for r in got.collect()) == [*((k, k + 0.5, None) for k in range(20)), (20, 1.0, None), (21, 1.0, None), (5000000000, 1.5, "x")]
    (tmp_path / "folder").mkdir()
    for name in ("x.csv", "y.csv", "folder/z.csv"):
        (tmp_path / name).write_text(f"a,b\n1,{name}\n")
    local = [str(tmp_path / n) for n in ("x.csv", "y.csv", "folder", "x.csv")]
    for schema in (None, "a int, b string"):
        rows = readers.csv(spark, *local, schema=schema)
        assert dict(rows.dtypes) == {"a": "int", "b": "string"}
        assert sorted(r.b for r in rows.collect()) == ["folder/z.csv", "x.csv", "x.csv", "y.csv"]
        assert asked[-1] == 3

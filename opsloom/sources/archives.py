"""Members of zip and tar archives, unpacked by the tasks of a Spark job.

A task lists each archive: of a zip the directory at its end, of a plain tar the headers of its members, both by
reads of those places only.  Then every member that is wanted is a row, and tasks copy their members, in
pieces of COPY bytes, to the folder that all executors share, where Spark's own readers find and split them.  A
compressed tar can be read in its order only, so one task takes its members.  The driver sees names and sizes.

A copy is written under a name of its own and renamed when it is whole, so a task that is tried again or runs
twice leaves one file.  Archives lie on a store that pyarrow knows.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import shutil
import sys
import tarfile
import uuid
import zipfile
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import cloudpickle
from pyspark.sql import SparkSession, functions as F

from ..scratch import shared_dir

# Functions sent to Python workers carry their code along, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COPY = 8 << 20
TASKS = 4096
FOUND = "archive string, member string, bytes bigint, together boolean"


def _open(path: str) -> io.BufferedReader:
    store, inner = stores.FileSystem.from_uri(path)
    return io.BufferedReader(store.open_input_file(inner), 1 << 16)


def _plain_tar(f: io.BufferedReader) -> bool:
    f.seek(0)
    return f.read(262)[257:] == b"ustar"


def _is_zip(f: io.BufferedReader) -> bool:
    try:
        return zipfile.is_zipfile(f)
    except pa.ArrowInvalid:  # shorter than a zip's least end
        return False


def _members(path: str) -> Iterator[tuple[str | None, int, bool]]:
    """(member, bytes, whether they must be read in order); one without a name for a file that is no archive."""
    with _open(path) as f:
        if _is_zip(f):
            with zipfile.ZipFile(f) as z:
                yield from ((m.filename, m.file_size, False) for m in z.infolist() if not m.is_dir())
            return
        plain = _plain_tar(f)
        f.seek(0)
        try:
            t = tarfile.open(fileobj=f)
        except tarfile.ReadError:
            yield None, 0, False
            return
        with t:
            yield from ((m.name, m.size, not plain) for m in t if m.isfile())


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            rows = list(_members(path))
            names, sizes, together = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(together, pa.bool_())], names=["archive", "member", "bytes", "together"])


def listing(spark: SparkSession, paths: list[str]):
    """archive, member, bytes, together: a row a member; a file that is no archive has one row without a member."""
    files = spark.createDataFrame([(p,) for p in paths], "archive string")
    return files.repartition(min(len(paths), TASKS), "archive").mapInArrow(_listed, FOUND)


def _place(into: str, archive: str, member: str) -> str:
    """Where a member goes; names that lead out of the folder are refused."""
    inside = posixpath.normpath(member.replace("\\", "/"))
    if inside.startswith(("/", "../")) or inside in ("..", "."):
        raise ValueError(f"{archive} has a member {member} outside of itself")
    return f"{into}/{inside}"


def _copy(source, target: str) -> int:
    store, inner = stores.FileSystem.from_uri(target)
    store.create_dir(posixpath.dirname(inner), recursive=True)
    draft = f"{posixpath.dirname(inner)}/.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        shutil.copyfileobj(source, out, COPY)
    store.move(draft, inner)
    return store.get_file_info(inner).size


def _copied(archive: str, wanted: dict[str, str]) -> Iterator[tuple[str, int]]:
    """Copies members (name -> target) of an archive."""
    with _open(archive) as f:
        if _is_zip(f):
            with zipfile.ZipFile(f) as z:
                for member, target in wanted.items():
                    with z.open(member) as source:
                        yield target, _copy(source, target)
            return
        f.seek(0)
        with tarfile.open(fileobj=f) as t:
            for m in t:
                if m.isfile() and m.name in wanted:
                    yield wanted[m.name], _copy(t.extractfile(m), wanted[m.name])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_archive: dict[str, dict[str, str]] = defaultdict(dict)
        for archive, member, target in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "target"))):
            by_archive[archive][member] = target
        for archive, wanted in by_archive.items():
            done = list(_copied(archive, wanted))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "bytes"])


def unpack(spark: SparkSession, paths: list[str], pattern: str = "*", suffixes: tuple[str, ...] = ()) -> list[str]:
    """Files of the members that match by name or path, sorted by archive and path; files that are no archive as they are.

    paths: where all executors see them.
    """
    if not paths:
        return []
    wanted = lambda n: (fnmatch.fnmatch(n, pattern) or fnmatch.fnmatch(posixpath.basename(n), pattern)) and (not suffixes or n.endswith(suffixes))
    found = sorted(listing(spark, paths).collect(), key=lambda r: (r.archive, r.member or ""))
    # An archive that holds a name twice gives the last one, as unpacking it would.
    root = f"{shared_dir(spark)}/members/{uuid.uuid4().hex}"
    number = {a: k for k, a in enumerate(dict.fromkeys(r.archive for r in found))}
    rows = [(r.archive, r.member, _place(f"{root}/{number[r.archive]:06}", r.archive, r.member), r.together) for r in found if r.member is not None and wanted(r.member)]
    if rows:
        todo = spark.createDataFrame(rows, "archive string, member string, target string, together boolean")
        # Members of a compressed tar share a task, others are spread.
        spread = todo.repartition(min(len(rows), TASKS), "archive", F.when(~F.col("together"), F.col("member")))
        done = {r.path: r.bytes for r in spread.mapInArrow(_unpacked, "path string, bytes bigint").collect()}
        if lost := [t for _, _, t, _ in rows if t not in done]:
            raise OSError(f"{lost[0]} was not unpacked")
    targets = dict.fromkeys(t for _, _, t, _ in rows)
    return sorted([*(r.archive for r in found if r.member is None), *targets])

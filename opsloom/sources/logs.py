"""Controller logs and workload files as Spark data sources, for one read and for streams of growing files.

    logs.register(spark)
    events = spark.read.format("controller_log").load("/logs")
    growing = spark.readStream.format("controller_log").load("/logs")

Files are cut into ranges of bytes (option pieceBytes); a range has the lines that begin in it, so one large
file is read by many tasks, and compressed ones (.gz) by one each.  Filters on single columns are tested before a
row is made.  A stream's offset is the number of bytes taken of each file, up to its last whole line: files
may grow and new ones may come, but one that got shorter is an error.  The offset has an entry a file.  The
last line of a file counts without its newline in a single read only.

Paths are files or folders (hidden names and names with _ in front are left out) on a store that pyarrow knows.
"""

from __future__ import annotations

import io
import operator
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from .readers import SWF

# Sources sent to Python workers carry their code along, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 64 << 20
BATCH_ROWS = 8192

ALLOCATE = re.compile(rb"\[([^\]]+)\].*Allocate JobId=(\d+) NodeList=(\S+) #CPUs=(\d+) Partition=(\S+)")
COMPLETE = re.compile(rb"\[([^\]]+)\].*_job_complete: JobId=(\d+) done")
BASE = re.compile(rb";\s*UnixStartTime:\s*(\d+)")
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin at start or later and before end."""

    file: str
    start: int
    end: int


def _files(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the file, or of all files below the folder, by name."""
    store, inner = stores.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    if info.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(stores.FileSelector(inner, recursive=True))
    top = inner.rstrip("/")
    seen = lambda p: not any(part.startswith((".", "_")) for part in p.removeprefix(top).split("/"))
    return sorted((path.rstrip("/") + f.path.removeprefix(top), f.size) for f in found if f.is_file and seen(f.path))


def _open(file: str) -> io.BufferedReader:
    store, inner = stores.FileSystem.from_uri(file)
    opened = store.open_input_stream(inner, compression="gzip") if file.endswith(".gz") else store.open_input_file(inner)
    return io.BufferedReader(opened, 1 << 20)


def _lines(piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line) of a piece."""
    with _open(piece.file) as f:
        at = piece.start
        if at:
            # The line that the byte before belongs to is another piece's, or ends there.
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < piece.end and (line := f.readline()):
            yield at, line.rstrip(b"\r\n")
            at += len(line)


def _whole_lines(file: str, size: int) -> int:
    """The place behind the last newline of a file's first size bytes."""
    with _open(file) as f:
        end = size
        while end:
            start = max(0, end - (1 << 16))
            f.seek(start)
            last = f.read(end - start).rfind(b"\n")
            if last >= 0:
                return start + last + 1
            end = start
    return 0


def _pieces(file: str, start: int, end: int, size: int) -> list[Piece]:
    if file.endswith(".gz"):
        return [Piece(file, 0, sys.maxsize)]
    return [Piece(file, at, min(at + size, end)) for at in range(start, end, size)]


TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda v, among: v in among, IsNotNull: lambda v, _: True}


class Reader(DataSourceReader):
    def __init__(self, source: Lines):
        self.source, self.wanted = source, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) not in TESTS or len(f.attribute) > 1 or (isinstance(value, datetime) and value.tzinfo is None):
                yield f
            else:
                self.wanted.append((f.attribute[0], TESTS[type(f)], value))

    def partitions(self):
        found = _files(self.source.path)
        return [p for file, size in found for p in _pieces(file, 0, size, self.source.piece_bytes)] or [Piece("", 0, 0)]

    def read(self, piece: Piece):
        return self.source.batches(piece, self.wanted)


class StreamReader(DataSourceStreamReader):
    def __init__(self, source: Lines):
        self.source, self.known = source, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file, size in _files(self.source.path):
            packed = file.endswith(".gz")
            if packed or self.known.get(file, (None, 0))[0] != size:
                self.known[file] = size, size if packed else _whole_lines(file, size)
        return {file: end for file, (_, end) in self.known.items()}

    def partitions(self, start: dict, end: dict):
        pieces = []
        for file, upto in sorted(end.items()):
            taken = start.get(file, 0)
            if upto < taken or (taken and upto > taken and file.endswith(".gz")):
                raise ValueError(f"{file} was cut or written anew: {taken} bytes were taken, {upto} are there")
            if upto > taken:
                pieces += _pieces(file, taken, upto, self.source.piece_bytes)
        return pieces

    def read(self, piece: Piece):
        return self.source.batches(piece, [])


class Lines(DataSource):
    """A source of files of lines; kinds of it say what columns a line gives."""

    columns: list[StructField] = []

    def __init__(self, options):
        super().__init__(options)
        if "path" not in options:
            raise ValueError("a path is needed: load(path)")
        path = options["path"]
        self.path = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.piece_bytes = int(options.get("pieceBytes", PIECE_BYTES))
        if self.piece_bytes < 1:
            raise ValueError("pieceBytes is 1 or more")

    def schema(self):
        return StructType([*self.columns, StructField("file", StringType()), StructField("position", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self)

    def rows(self, piece: Piece) -> Iterator[tuple]:
        raise NotImplementedError

    def batches(self, piece: Piece, wanted: list) -> Iterator[pa.RecordBatch]:
        """The rows of a piece that pass all tests, as Arrow batches."""
        if not piece.file:
            return
        schema = to_arrow_schema(self.schema())
        tests = [(schema.get_field_index(c), test, value) for c, test, value in wanted]
        rows = []
        for row in self.rows(piece):
            if all(row[c] is not None and test(row[c], value) for c, test, value in tests):
                rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield self._batch(rows, schema)
                rows = []
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows), schema)], schema=schema)


def _time(text: bytes) -> datetime | None:
    """An ISO time; without a zone in UTC, null if it is none."""
    try:
        at = datetime.fromisoformat(text.decode())
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


class ControllerLog(Lines):
    """Allocations and completions of jobs; other lines give no row."""

    columns = [
        StructField("event", StringType()), StructField("job_id", LongType()), StructField("time", TimestampType()), StructField("node_list", StringType()),
        StructField("allocated_cpus", LongType()), StructField("partition", StringType()),
    ]

    @classmethod
    def name(cls) -> str:
        return "controller_log"

    def rows(self, piece: Piece) -> Iterator[tuple]:
        for at, line in _lines(piece):
            if b"JobId=" not in line:
                continue
            if m := ALLOCATE.match(line):
                time, job, nodes, cpus, partition = m.groups()
                yield "allocate", int(job), _time(time), nodes.decode(errors="replace"), int(cpus), partition.decode(errors="replace"), piece.file, at
            if m := COMPLETE.match(line):
                yield "complete", int(m[2]), _time(m[1]), None, None, None, piece.file, at


class WorkloadFormat(Lines):
    """The 18 columns of the Standard Workload Format, -1 as null, and the times of submission, start and end.

    Lines with fewer than four fields give no row.  The base time stands in the comments that a file begins
    with, which each piece reads; without one it is 1970.
    """

    columns = [*(StructField(c, DoubleType()) for c in SWF), *(StructField(c, TimestampType()) for c in ("submit_time", "start_time", "end_time"))]

    @classmethod
    def name(cls) -> str:
        return "workload_format"

    def rows(self, piece: Piece) -> Iterator[tuple]:
        base = 0
        for _, line in _lines(Piece(piece.file, 0, sys.maxsize)):
            if not line.startswith(b";"):
                break
            if m := BASE.match(line):
                base = max(base, int(m[1]))
        after = lambda *parts: None if None in parts else EPOCH + timedelta(seconds=base + sum(parts))
        for at, line in _lines(piece):
            fields = [] if line.startswith(b";") else line.split()
            if len(fields) < 4:
                continue
            values = [_number(f) for f in fields[: len(SWF)]]
            values += [None] * (len(SWF) - len(values))
            submit, wait, run = values[1], values[2] or 0.0, values[3]
            yield *values, after(submit), after(submit, wait), after(submit, wait, run), piece.file, at


def _number(text: bytes) -> float | None:
    try:
        v = float(text)
    except ValueError:
        return None
    return None if v == -1 else v


def register(spark: SparkSession) -> None:
    """Makes the formats controller_log and workload_format known to the session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ControllerLog, WorkloadFormat):
        spark.dataSource.register(source)


def jobs(events: DataFrame) -> DataFrame:
    """Jobs of controller_log events with both lines, the last of each kind by file and place.

    One aggregate that is combined before its shuffle; of a stream its result is the whole table so far
    (output mode complete) or the jobs that changed (update).
    """
    place = F.struct("file", "position")
    last = lambda kind, value: F.max_by(value, F.when(F.col("event") == kind, place))
    told = F.struct(F.col("time").alias("start_time"), "node_list", "allocated_cpus", "partition")
    both = events.groupBy("job_id").agg(last("allocate", told).alias("a"), last("complete", F.struct(F.col("time").alias("end_time"))).alias("b"))
    runtime = F.greatest(F.lit(0.0), (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6)
    return both.where("a is not null and b is not null").select("job_id", "a.*", "b.*").withColumn("runtime_seconds", runtime)

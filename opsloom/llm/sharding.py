"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards.  Compaction sorts the shards below the target size
into tiers of similar size and rewrites runs of one tier as files of about the target size; arrivals
of more than twice the target are cut once.  Every change is committed as a new version of the
manifest, which is written under a draft name and then gets its own in one step that fails if the
name is taken: a hard link in local and mounted folders, a rename on HDFS.  So a version is either
whole or absent, and of two writers with one base the slower gets a CommitError.  Stores without such
a step are refused, unless the caller vouches for a single writer.

Old versions stay readable until vacuum() is called: it removes the manifests older than a retention
time and the data files that no kept version names.

Layout under a root that Spark can reach: data/<batch>/..., manifest/v<number>.json.  The manifest
grows with the number of shards, not of rows.

Defined results for odd input: an empty table commits a version without shards; a single row larger
than the target makes a shard above it; rows and columns are kept as they are, repeated rows included;
an input column named like the shard column makes read() choose a longer name.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .common import filesystem, remove

GROUP = "__shard_group"
#: With more shards than this to move, their plan is joined by shuffle instead of broadcast.
BROADCAST_SHARDS = 100_000


#: How a store gives a name to a file in one step that fails if the name is taken.
SCHEMES = {"file": "link", "hdfs": "rename", "viewfs": "rename", "abfs": "rename", "abfss": "rename"}


class CommitError(RuntimeError):
    pass


class ShardStore:
    """single_writer: the caller vouches that no one else writes below root, so that any store will do."""

    def __init__(self, spark: SparkSession, root: str, *, single_writer: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        fs, _ = filesystem(spark, self.root)
        scheme = fs.getUri().getScheme()
        if scheme not in SCHEMES and not single_writer:
            raise ValueError(f"{scheme}: no exclusive commit there; known: {', '.join(SCHEMES)}")
        self.naming = SCHEMES.get(scheme, "rename")

    # -- manifest ---------------------------------------------------------------------------
    def versions(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        return sorted(int(n[1:-5]) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The named version, the latest by default, an empty one before the first commit."""
        have = self.versions()
        if not have:
            return {"version": 0, "schema": None, "shards": []}
        path = f"{self.root}/manifest/v{version if version is not None else have[-1]}.json"
        fs, p = filesystem(self.spark, path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: StructType | None) -> dict:
        """The version after base, with the given shards; CommitError if another writer has made it."""
        new = {"version": base["version"] + 1, "committed_at": time.time(), "schema": schema.json() if schema else base["schema"], "shards": sorted(shards, key=lambda s: s["path"])}
        for k, s in enumerate(new["shards"]):
            s["id"] = k
        fs, draft = filesystem(self.spark, f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        _, final = filesystem(self.spark, f"{self.root}/manifest/v{new['version']}.json")
        try:
            if self.naming == "link":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                won = True
            else:
                won = not fs.exists(final) and fs.rename(draft, final)
        except FileExistsError:
            won = False
        if not won or self.naming == "link":
            fs.delete(draft, False)
        if not won:
            raise CommitError(f"version {new['version']} was committed by another writer")
        return new

    def vacuum(self, *, keep_seconds: float = 7 * 86400.0) -> list[str]:
        """Removes the versions committed longer ago than that, but the latest, and the older data files that no version left names.

        A file of a write that goes on is younger than keep_seconds, if that is above the time a write takes.
        """
        before = time.time() - keep_seconds
        versions = {v: self.manifest(v) for v in self.versions()}
        last = max(versions, default=0)
        kept = {v for v, m in versions.items() if v == last or m.get("committed_at", 0) >= before}
        named = {s["path"] for v in kept for s in versions[v]["shards"]}
        gone = []
        fs, data = filesystem(self.spark, f"{self.root}/data")
        if fs.exists(data):
            it = fs.listFiles(data, True)
            while it.hasNext():
                f = it.next()
                path = f.getPath().toString().rpartition("/data/")[2]
                if path.endswith(".parquet") and path not in named and f.getModificationTime() / 1000 <= before:
                    gone.append(path)
        for v in versions.keys() - kept:
            remove(self.spark, f"{self.root}/manifest/v{v}.json")
        for path in gone:
            remove(self.spark, f"{self.root}/data/{path}")
        return gone

    # -- shards -----------------------------------------------------------------------------
    def _written(self, batch: str) -> list[dict]:
        """Path below data/, bytes and rows of each shard of a batch; empty files are left out."""
        fs, p = filesystem(self.spark, f"{self.root}/data/{batch}")
        files, it = {}, fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            if s.getPath().getName().endswith(".parquet"):
                files[s.getPath().toString().rpartition("/data/")[2]] = s.getLen()
        if not files:
            return []
        found = self._read(list(files), None).groupBy("path").count().toArrow().to_pylist()
        return [{"path": r["path"], "bytes": files[r["path"]], "rows": r["count"]} for r in found]

    def _read(self, paths: list[str], schema: StructType | None) -> DataFrame:
        reader = self.spark.read.option("recursiveFileLookup", "true")
        df = (reader.schema(schema) if schema else reader).parquet(*(f"{self.root}/data/{p}" for p in paths))
        return df.withColumn("path", F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)) if schema is None else df

    def append(self, df: DataFrame) -> dict:
        """Writes each input partition as a small shard and commits them."""
        base, batch = self.manifest(), uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.root}/data/{batch}")
        return self.commit(base, base["shards"] + self._written(batch), df.schema)

    def plan(self, shards: list[dict], target: int, fan: int) -> list[list[dict]]:
        """Runs to merge: shards of one tier, packed in the order of size up to the target."""
        tiers: dict[int, list[dict]] = defaultdict(list)
        for s in shards:
            if s["bytes"] < target * 3 // 4:
                tiers[int(math.log(max(s["bytes"], 1), fan))].append(s)
        runs = []
        for _, tier in sorted(tiers.items()):
            run, size = [], 0
            for s in sorted(tier, key=lambda s: (s["bytes"], s["path"])):
                if run and size + s["bytes"] > target * 5 // 4:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            if len(run) >= fan or size >= target * 3 // 4 and len(run) > 1:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, *, target_bytes: int = 256 << 20, fan: int = 4, keep_seconds: float | None = None) -> dict:
        """Merges tiers until none has a run to merge; shards that arrived above twice the target are cut.

        keep_seconds: vacuums after each version, as vacuum() does; None keeps all.
        """
        now = self.manifest()
        while True:
            runs = self.plan(now["shards"], target_bytes, fan)
            cut = [s for s in now["shards"] if s["bytes"] > 2 * target_bytes and s["rows"] > 1 and not s.get("cut")]
            if not runs and not cut:
                return now
            batch, schema = uuid.uuid4().hex, StructType.fromJson(json.loads(now["schema"]))
            moved = [(s["path"], g, 1) for g, run in enumerate(runs) for s in run]
            groups = len(runs)
            for s in cut:
                pieces = min(s["rows"], -(-s["bytes"] // target_bytes))
                moved.append((s["path"], groups, pieces))
                groups += pieces
            rows = self._read([p for p, _, _ in moved], schema).withColumn("__path", F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1))
            plan = self.spark.createDataFrame(moved, f"__path string, {GROUP} int, __pieces int")
            placed = rows.join(F.broadcast(plan) if len(moved) <= BROADCAST_SHARDS else plan, "__path")
            grouped = placed.withColumn(GROUP, F.expr(f"{GROUP} + cast(pmod(monotonically_increasing_id(), __pieces) AS int)")).drop("__path", "__pieces")
            # A run has about the target size at most, and ranges keep runs apart, so each task writes a bounded file.
            grouped.repartitionByRange(groups, GROUP).write.option("compression", "zstd").partitionBy(GROUP).parquet(f"{self.root}/data/{batch}")
            gone = {p for p, _, _ in moved}
            whole = {g for g in range(len(runs), groups)}
            made = self._written(batch)
            for s in made:
                if int(s["path"].partition(f"{GROUP}=")[2].partition("/")[0]) in whole:
                    s["cut"] = True
            now = self.commit(now, [s for s in now["shards"] if s["path"] not in gone] + made, None)
            if keep_seconds is not None:
                self.vacuum(keep_seconds=keep_seconds)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the number of their shard, its rows and bytes in a column of structs."""
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"]))
        name = "shard"
        while name in schema.names:
            name += "_"
        kind = f"{name} struct<id:int,rows:bigint,bytes:bigint>"
        if not m["shards"]:
            return self.spark.createDataFrame([], schema).withColumn(name, F.lit(None).cast(kind.partition(" ")[2]))
        rows = self._read([s["path"] for s in m["shards"]], schema).withColumn("__path", F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1))
        table = self.spark.createDataFrame([(s["path"], (s["id"], s["rows"], s["bytes"])) for s in m["shards"]], f"__path string, {kind}")
        return rows.join(F.broadcast(table) if len(m["shards"]) <= BROADCAST_SHARDS else table, "__path").drop("__path")


def shard(docs: DataFrame, root: str, *, target_bytes: int = 256 << 20, fan: int = 4, single_writer: bool = False, keep_seconds: float | None = None) -> DataFrame:
    """Appends docs to the store at root, compacts it, and returns its rows with their shards."""
    store = ShardStore(docs.sparkSession, root, single_writer=single_writer)
    store.append(docs)
    store.compact(target_bytes=target_bytes, fan=fan, keep_seconds=keep_seconds)
    return store.read()


def shard_once(docs: DataFrame, root: str, **options) -> DataFrame:
    """shard() in a new folder that no one else writes to or reads from: only the last version stays."""
    return shard(docs, root, single_writer=True, keep_seconds=0, **options)

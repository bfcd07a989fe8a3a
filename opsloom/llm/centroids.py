"""Centroid clustering by annulus search.

Vectors are turned into whole numbers, so every distance and every mean is exact and no result depends
on the order of rows.  Centroids are sorted by norm.  A vector has an upper bound of its distance to
the nearest centroid: its distance to the centroid that it had before (first: to the one of nearest
norm).  By the triangle inequality all centroids at most that far have norms within the annulus
of that width around the vector's own norm, so two binary searches give the candidates; these alone are compared, in
whole numbers.  The annulus is widened by more than the rounding of norms, so ties on its edge are
compared too; the smaller number wins.

A round is one pass over a written table: tasks write the vectors with their cluster beside
their own sums for each cluster, and the sums are added up by Spark.  The driver and the tasks hold the
centroids only (``k`` times ``dims`` numbers).

Defined results for odd input: vectors with another number of components, with a null or a non-finite
one, and null vectors are left out; a null id hashes as an empty text; repeated ids and
repeated vectors are vectors of their own; with fewer vectors than ``k`` there are as many centroids;
numbers that pass 64 bits are computed exactly, and a distance or inertia that doesn't fit into
64 bits is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stages, lean

#: Whole numbers up to this are compared in 64 bits: 2^2 * 2^52 * 2^8 components stay below 2^63.
SMALL = 1 << 26
#: Pairs of a vector and a centroid compared at once.
PAIRS = 1 << 14
#: Sums travel as a high and a low part, each of which fits a decimal.
LOW_BITS = 40

ROUND = "id bigint, embedding array<float>, cluster int, distance decimal(38,0), dim int, high decimal(38,0), low decimal(38,0), n bigint"
_ARROW = pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("cluster", pa.int32()), ("distance", pa.decimal128(38, 0)), ("dim", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0)), ("n", pa.int64())])


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact as doubles: a power of two times a single-precision number."""
    return np.floor(vectors.astype(np.float64) * scale)


def _exact(row: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in row], dtype=object)


class Annuli:
    """Centroids sorted by norm, and the search among them."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.big = np.array([any(abs(x) > SMALL for x in c) for c in centroids], dtype=bool)
        self.numbers = np.array([[0 if b else x for x in c] for c, b in zip(centroids, self.big)], dtype=np.int64)
        norms = np.sqrt((np.array(centroids, dtype=np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def distances(self, x: np.ndarray, big: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[int] | np.ndarray:
        """Squared distances of pairs, as 64-bit numbers if all fit, else as Python numbers."""
        far = big[rows] | self.big[cols]
        if not far.any():
            out = np.empty(len(rows), dtype=np.int64)
            for at in range(0, len(rows), PAIRS):
                d = x[rows[at : at + PAIRS]].astype(np.int64) - self.numbers[cols[at : at + PAIRS]]
                out[at : at + PAIRS] = np.einsum("ij,ij->i", d, d)
            return out
        out = np.empty(len(rows), dtype=object)
        for n, (i, c) in enumerate(zip(rows, cols)):
            d = _exact(x[i]) - np.array(self.exact[c], dtype=object)
            out[n] = int((d * d).sum())
        return out

    def nearest(self, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, pairs compared) for rows of whole numbers.

        before: the centroid that each row had; None: the one of nearest norm gives the bound.
        """
        big = (np.abs(x) > SMALL).any(axis=1)
        norm = np.sqrt((x**2).sum(axis=1))
        if before is None:
            right = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
            left = np.maximum(right - 1, 0)
            before = self.order[np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)]
        bound = np.sqrt(self.distances(x, big, np.arange(len(x)), before).astype(np.float64))
        slack = 1e-6 + 1e-9 * (norm + bound)
        low = np.searchsorted(self.norms, norm - bound - slack, side="left")
        high = np.searchsorted(self.norms, norm + bound + slack, side="right")
        width = high - low
        first = np.cumsum(width) - width
        rows = np.repeat(np.arange(len(x)), width)
        cols = self.order[np.arange(len(rows)) - np.repeat(first, width) + np.repeat(low, width)]
        dist = self.distances(x, big, rows, cols)
        best = np.minimum.reduceat(dist, first)
        number = np.where(dist == np.repeat(best, width), cols, len(self.order))
        return np.minimum.reduceat(number, first), best, len(rows)


def _sums(x: np.ndarray, cluster: np.ndarray, totals: dict[int, list]) -> None:
    """Adds the rows of each cluster to totals[cluster] = [count, sums as Python numbers]."""
    big = (np.abs(x) > SMALL).any(axis=1)
    for c in np.unique(cluster):
        mine = cluster == c
        entry = totals.setdefault(int(c), [0, [0] * x.shape[1]])
        entry[0] += int(mine.sum())
        added = x[mine & ~big].astype(np.int64).sum(axis=0).tolist()
        for row in x[mine & big]:
            added = [a + int(b) for a, b in zip(added, row)]
        entry[1] = [a + b for a, b in zip(entry[1], added)]


def _round(centroids: list[list[int]], scale: int, dims: int):
    """The pass of one round over batches of (id, embedding, cluster)."""

    @lean
    def run(batches):
        search, totals = Annuli(centroids), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
            before = batch.column("cluster")
            cluster, best, _ = search.nearest(x, None if before.null_count else before.to_numpy())
            _sums(x, cluster, totals)
            n = batch.num_rows
            none = {f.name: pa.nulls(n, f.type) for f in _ARROW}
            far = [Decimal(int(d)) if int(d) < 10**38 else None for d in best]
            rows = none | {"id": batch.column("id"), "embedding": batch.column("embedding"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(far, pa.decimal128(38, 0))}
            yield pa.RecordBatch.from_arrays([rows[f.name] for f in _ARROW], schema=_ARROW)
        rows = [(c, j, s >> LOW_BITS, s & ((1 << LOW_BITS) - 1), n) for c, (n, sums) in totals.items() for j, s in enumerate(sums)]
        if rows:
            c, j, high, low, n = zip(*rows)
            none = {f.name: pa.nulls(len(rows), f.type) for f in _ARROW}
            sums = none | {"cluster": pa.array(c, pa.int32()), "dim": pa.array(j, pa.int32()), "high": pa.array(map(Decimal, high), pa.decimal128(38, 0)), "low": pa.array(map(Decimal, low), pa.decimal128(38, 0)), "n": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_arrays([sums[f.name] for f in _ARROW], schema=_ARROW)

    return run


def kept_vectors(vectors: DataFrame, id: str, vector: str, dims: int) -> DataFrame:
    """id and embedding of the vectors with exactly dims components, all of them finite numbers."""
    v = F.col("embedding")
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where((F.size(v) == dims) & ~bad)


def moved(centroids: list[list[int]], table: DataFrame) -> list[list[int]]:
    """The means of the clusters, floored; an empty cluster keeps its centroid.  At most k * dims rows reach the driver."""
    out = [list(c) for c in centroids]
    for r in table.where("dim is not null").groupBy("cluster", "dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect():
        out[r["cluster"]][r["dim"]] = ((int(r["high"]) << LOW_BITS) + int(r["low"])) // r["n"]
    return out


def cluster(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """(id, embedding, cluster, distance of every kept vector; the final centroids).

    The first centroids are the k vectors of least SHA-256 of ``seed:id``; each of the rounds assigns
    all vectors and moves the centroids; a last pass assigns them once more.  scale is a power of two.
    """
    stages = Stages(vectors.sparkSession)
    with stages.cleared_on_error():
        table = stages.write("vectors", kept_vectors(vectors, id, vector, dims).withColumn("cluster", F.lit(None).cast("int")))
        hashed = table.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
        first = hashed.orderBy("h", "embedding").limit(k).collect()
        centroids = [[int(x) for x in whole(np.array(r["embedding"], dtype=np.float32), scale)] for r in first]
        last = "vectors"
        for r in range(rounds + 1):
            if not centroids:
                break
            step = table.where("embedding is not null").select("id", "embedding", "cluster").mapInArrow(_round(centroids, scale, dims), ROUND)
            table = stages.write(f"round-{r}", step)
            stages.drop(last)
            last = f"round-{r}"
            if r < rounds:
                centroids = moved(centroids, table)
        if not centroids:
            table = table.withColumn("distance", F.lit(None).cast("decimal(38,0)"))
        return table.where("embedding is not null").select("id", "embedding", "cluster", "distance"), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def summary(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector.

    The side of the join has a row a cluster, so at most k.
    """
    spark = assigned.sparkSession
    names = spark.createDataFrame([(c, digest(x)) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(s for s in sums.values() if s is not None)
    fits = lambda s: int(s) if s is not None and s < 1 << 63 else None
    inertia = spark.createDataFrame([(c, fits(s), fits(total)) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint")
    return assigned.join(F.broadcast(names.join(inertia, "cluster")), "cluster").selectExpr("id AS vec_id", "cluster", "try_cast(distance AS bigint) AS distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2") -> str:
    """DuckDB SQL of the query: all vectors against all centroids in each round."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"p{r} AS (SELECT n, c, list_sum(list_transform(list_zip(v.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r})")
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM p{r} GROUP BY n)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT a.c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS j FROM v JOIN a{r} a USING (n)) GROUP BY c, j)")
            parts.append(f"m{r} AS (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY j) AS v FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))")
    a = f"a{rounds}"
    return f"""
WITH {", ".join(parts)}
SELECT v.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM {a} a JOIN v USING (n) JOIN c{rounds} USING (c)
"""
